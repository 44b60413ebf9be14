"""File sources: receipts, sidecar documents, report catalogues; and the report sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import basis_points, count_where

RECEIPT = (
    "source_execution_id string, session_id string, command_family string, reducer_id string, policy_decision string,"
    " exit_status_class string, fail_open_reason string, raw_stdout_bytes bigint, raw_stderr_bytes bigint, emitted_bytes bigint,"
    " candidate_bytes bigint, estimated_raw_tokens bigint, estimated_candidate_tokens bigint, recovery_hint_bytes bigint,"
    " duration_us bigint, reducer_duration_us bigint, active boolean, shadow boolean, never_worse_accepted boolean,"
    " forwarding_mutation boolean"
)


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    """Source-execution receipts, one JSON object per line, with a fixed schema (no inference pass)."""
    return spark.read.schema(RECEIPT).json(path)


def receipt_totals(receipts: DataFrame, known_sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Executions by exit class, linked sessions, byte and token totals and never-worse counts."""
    known = known_sessions.select(F.col("session_id").cast("string").alias("session_id")).distinct().withColumn("__known", F.lit(True))
    linked = receipts.join(known, "session_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    exits = ("success", "nonzero", "signal")
    return linked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("executions"),
        *[count_where(F.col("exit_status_class") == e).alias(f"exit_{e}") for e in exits],
        count_where(~F.coalesce(F.col("exit_status_class").isin(*exits), F.lit(False))).alias("exit_unknown"),
        count_where(F.coalesce("source_execution_id", F.lit("")) != "").alias("ids_present"),
        F.count("__known").alias("sessions_linked"),
        *[total(c) for c in ("raw_stdout_bytes", "raw_stderr_bytes", "emitted_bytes", "candidate_bytes", "estimated_raw_tokens", "estimated_candidate_tokens")],
        count_where(F.col("shadow")).alias("shadow_evaluations"), count_where(F.col("active")).alias("active_evaluations"),
        count_where(F.col("forwarding_mutation")).alias("forwarding_mutations"),
        count_where(F.coalesce("fail_open_reason", F.lit("")) != "").alias("fail_open_executions"),
        count_where(F.col("never_worse_accepted")).alias("never_worse_accepted"),
    )


# --- documents -------------------------------------------------------------------------------------------


def read_documents(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """(path, doc) for every JSON document below a folder."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    return files.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("doc"))


def _get(path: str, kind: str, source: str | Column = "doc") -> Column:
    return F.try_variant_get(source, path, kind)


IDENTITY = ("measurement_run_id", "session_id", "agent_pid", "started_at", "finished_at", "exit_status", "capture_complete")


def merge_sidecars(documents: DataFrame, version: int = 2) -> tuple[DataFrame, DataFrame]:
    """Accepted session rows, and rejected documents with the first reason that applies.

    Duplicate ids are found by counting, so neither copy of a collision is accepted silently: the
    documents that collide are all set aside.
    """
    sessions = F.coalesce(_get("$.sessions", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    row = F.get(sessions, F.lit(0))
    staged = documents.withColumn("row", row).withColumn("__count", F.size(sessions))
    mismatch = F.lit(False)
    for name in IDENTITY:
        mismatch = mismatch | ~_get(f"$.{name}", "string").eqNullSafe(_get(f"$.{name}", "string", "row"))
    is_list = F.coalesce(F.schema_of_variant(_get("$.sessions", "variant")).startswith("ARRAY"), F.lit(False))
    staged = staged.withColumn("run_id", _get("$.measurement_run_id", "string", "row")).withColumn("session_id", _get("$.session_id", "string", "row"))
    staged = staged.withColumn(
        "reason",
        F.when(~is_list, "invalid_document")
        .when(~F.coalesce(_get("$.measurement_instrument_version", "int") == version, F.lit(False)), "unsupported_version")
        .when(F.col("__count") != 1, "not_one_session")
        .when(mismatch, "identity_mismatch")
        .when(F.col("run_id").isNull() | F.col("session_id").isNull(), "missing_identity")
        .when(~F.coalesce(_get("$.capture_complete", "boolean", "row"), F.lit(False)), "incomplete_capture"),
    )
    valid = staged.where("reason is null")
    twice = lambda c: valid.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(c, F.lit(True).alias(f"__twice_{c}"))
    marked = staged.join(twice("run_id"), "run_id", "left").join(twice("session_id"), "session_id", "left")
    reason = F.coalesce(
        "reason", F.when(F.col("__twice_run_id"), "duplicate_run_id"), F.when(F.col("__twice_session_id"), "duplicate_session_id")
    )
    judged = marked.withColumn("reason", reason)
    accepted = judged.where("reason is null").select(
        "run_id", "session_id",
        *[_get(f"$.{c}", "bigint", "row").alias(c) for c in (
            "analysis_admitted_total", "analysis_requests_seen", "processed_deferred_total", "backlog_capacity_drops",
            "high_water_items", "high_water_bytes", "analysis_wait_us")],
    )
    return accepted, judged.where("reason is not null").select("path", "run_id", "session_id", "reason")


# Status of the first catalogue entries, set before convergence was recorded.
FIXED_STATUS = {"baseline-001": "exploratory", "baseline-002": "legacy_uncertified", "baseline-003": "valid"}


def report_catalogue(documents: DataFrame) -> DataFrame:
    """One row per report folder: its largest cohort's report and its status."""
    parts = documents.select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("id"),
        F.regexp_extract("path", r"baseline_n(\d+)\.json$", 1).alias("n"),
        F.col("path").rlike(r"convergence_[^/]*\.json$").alias("is_convergence"), "path", "doc",
    )
    reports = parts.where("n <> ''").groupBy("id").agg(
        F.max_by(
            F.struct(
                _get("$.dataset.requests_per_session.count", "bigint").alias("sessions"),
                _get("$.dataset.requests_total", "bigint").alias("requests"),
                _get("$.cohort_label", "string").alias("cohort"),
                _get("$.quality.measurement_integrity", "string").alias("measurement_integrity"),
            ),
            F.col("n").cast("int"),
        ).alias("r")
    )
    converged = parts.where("is_convergence").groupBy("id").agg(F.max_by(_get("$.status", "string"), F.col("path")).alias("status"))
    status = F.when(F.col("c") == "CONVERGED", "converged").otherwise("valid")
    for name, fixed in FIXED_STATUS.items():
        status = F.when(F.col("id") == name, fixed).otherwise(status)
    ids = parts.select("id").distinct()
    return ids.join(reports, "id", "left").join(converged.withColumnRenamed("status", "c"), "id", "left").select("id", status.alias("status"), "r.*")


def _share(rows: Column, name: str) -> Column:
    """Share of one content kind in a list of composition rows; the first row of that name counts."""
    found = F.filter(rows, lambda r: F.try_variant_get(r, "$.name", "string") == name)
    return F.try_variant_get(F.get(found, F.lit(0)), "$.token_share", "double")


def convergence_points(documents: DataFrame) -> DataFrame:
    """Shares, cache ratio, repetition and stability per cohort size."""
    parts = documents.select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("id"), F.regexp_extract("path", r"baseline_n(\d+)\.json$", 1).alias("n"),
        F.col("path").rlike(r"convergence_[^/]*\.json$").alias("is_convergence"), "doc",
    )
    detected = _get("$.composition.detected_content", "array<variant>")
    points = parts.where("n <> ''").select(
        "id", F.col("n").cast("int").alias("size"), _share(detected, "json").alias("json_share"),
        _share(detected, "plain_text").alias("plain_share"), _share(detected, "unknown").alias("unknown_share"),
        _get("$.provider_usage.cache_ratio", "double").alias("cache_ratio"),
        _get("$.repetition.exact_repeated_token_share", "double").alias("repetition"),
    )
    moves = parts.where("is_convergence").select("id", F.explode(_get("$.transitions", "array<variant>")).alias("t")).groupBy(
        "id", F.try_variant_get("t", "$.current_sessions", "int").alias("size")
    ).agg(F.max(F.try_variant_get("t", "$.stable", "boolean")).alias("stable"))
    return points.join(moves, ["id", "size"], "left").withColumn("cohort", F.concat(F.lit("N"), F.col("size").cast("string")))


def report_workloads(documents: DataFrame) -> DataFrame:
    """Workload rows of each report."""
    rows = documents.select("path", F.explode(_get("$.composition.by_workload", "array<variant>")).alias("w"))
    detected = F.try_variant_get("w", "$.by_detected_content", "array<variant>")
    return rows.select(
        "path", F.coalesce(F.try_variant_get("w", "$.name", "string"), F.lit("unknown")).alias("workload"),
        F.coalesce(F.try_variant_get("w", "$.session_count", "bigint"), F.lit(0)).alias("sessions"),
        F.try_variant_get("w", "$.workload_token_share", "double").alias("token_share"),
        _share(detected, "json").alias("json_share"), _share(detected, "plain_text").alias("plain_share"), _share(detected, "unknown").alias("unknown_share"),
    )


# Reducer of a source report -> (active, treatment arm, control arm, command family).
SOURCE_REDUCERS = {
    "explicit-rg-active": (True, "ExplicitRgActive", "ExplicitRgActiveControl", "rg"),
    "explicit-git-status-active": (True, "ExplicitGitStatusActive", "ExplicitGitStatusActiveControl", "git_status"),
    "explicit-git-status-shadow": (False, "ExplicitGitStatusShadow", "ExplicitGitStatusControl", "git_status"),
    "explicit-clippy-shadow": (False, "ExplicitClippyShadow", "ExplicitClippyControl", "cargo_clippy"),
    "explicit-check-active-v2": (True, "ExplicitCheckV2Active", "ExplicitCheckV2Control", "cargo_check"),
    "explicit-check-shadow-v2": (False, "ExplicitCheckV2Shadow", "ExplicitCheckV2Control", "cargo_check"),
    "explicit-active": (True, "ExplicitActive", "ExplicitActiveControl", "cargo_test"),
}
SOURCE_DEFAULT = (False, "ExplicitShadow", "ExplicitControl", "cargo_test")


def source_reports(documents: DataFrame) -> DataFrame:
    """One row per source-optimisation report: sizes, reduction, evaluations and decision."""
    reducer = _get("$.reducer", "string")
    place = lambda i, kind: F.coalesce(
        F.create_map(*[F.lit(v) for k, t in SOURCE_REDUCERS.items() for v in (k, t[i])])[reducer], F.lit(SOURCE_DEFAULT[i])
    ).cast(kind)
    rows = documents.where(_get("$.rows", "array<variant>").isNotNull()).select(
        F.coalesce(_get("$.experiment_id", "string"), F.lit("unknown-source-experiment")).alias("experiment_id"),
        F.coalesce(F.when(_get("$.analysis.decision", "string").isin("pass", "reject"), _get("$.analysis.decision", "string")), F.lit("pending")).alias("decision"),
        F.coalesce(_get("$.pairs", "bigint"), F.lit(0)).alias("pairs"), place(0, "boolean").alias("active"),
        place(1, "string").alias("treatment"), place(3, "string").alias("command_family"),
        F.explode_outer(_get("$.rows", "array<variant>")).alias("r"),
    )
    number = lambda name: F.when(
        F.try_variant_get("r", "$.arm", "string") == F.col("treatment"), F.coalesce(F.try_variant_get("r", f"$.{name}", "bigint"), F.lit(0))
    )
    total = lambda name: F.coalesce(F.sum(number(name)), F.lit(0))
    keys = ["experiment_id", "decision", "pairs", "active", "command_family"]
    sums = rows.groupBy(*keys).agg(
        F.count(number("source_stdout_bytes")).alias("executions"),
        (total("source_stdout_bytes") + total("source_stderr_bytes")).alias("raw_bytes"),
        total("source_emitted_bytes").alias("__emitted"), total("candidate_bytes").alias("__candidate"),
        total("active_evaluations").alias("__active"), total("shadow_evaluations").alias("__shadow"),
        total("never_worse_accepted").alias("never_worse_accepted"), total("forwarding_mutations").alias("forwarding_mutations"),
        total("recovery_requests").alias("recovery_requests"),
    )
    candidate = F.when(F.col("active"), F.col("__emitted")).otherwise(F.col("__candidate"))
    reduction = F.when((F.col("raw_bytes") > 0) & (candidate <= F.col("raw_bytes")), basis_points(F.col("raw_bytes") - candidate, "raw_bytes"))
    return sums.select(
        *keys, "executions", "raw_bytes", candidate.alias("candidate_bytes"), reduction.alias("reduction_bp"),
        F.when(F.col("active"), F.col("__active")).otherwise(F.col("__shadow")).alias("evaluations"), "never_worse_accepted", "forwarding_mutations",
        F.when(F.col("active"), F.coalesce(basis_points("recovery_requests", "forwarding_mutations"), F.lit(0))).alias("recovery_rate_bp"),
    )


def source_arms(documents: DataFrame) -> DataFrame:
    """Sessions, successes and usage per arm of each source report."""
    rows = documents.select(_get("$.experiment_id", "string").alias("experiment_id"), F.explode(_get("$.rows", "array<variant>")).alias("r"))
    r = lambda path, kind: F.try_variant_get("r", path, kind)
    success = F.coalesce(r("$.task_success", "boolean"), r("$.agent_exit_status_class", "string") == "success", F.lit(False))
    return rows.groupBy("experiment_id", r("$.arm", "string").alias("arm")).agg(
        F.count(F.lit(1)).alias("sessions"), count_where(success).alias("successful_sessions"),
        F.coalesce(F.sum(r("$.provider_usage.input_total", "bigint")), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum(r("$.provider_usage.input_uncached", "bigint")), F.lit(0)).alias("uncached_input_tokens"),
    )


def write_report(sections: dict[str, DataFrame], folder: str) -> None:
    """Write each section as JSON and as Parquet below the report folder."""
    for name, frame in sections.items():
        frame.write.mode("overwrite").json(f"{folder}/json/{name}")
        frame.write.mode("overwrite").parquet(f"{folder}/parquet/{name}")
