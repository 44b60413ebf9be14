"""Block text: tokens, fingerprints, detection, features, parsers and reduction candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..functions import text as tx
from ..operators import blocktext as bt
from ..operators import reduce as red
from ..sources.bindings import outputs, read, read_text
from .registry import query


def documents(spark, root):
    return read_text(spark, root, "documents", "doc_id", "text", "lang", "source")


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def cnt(source: str, pattern: str) -> str:
    return f"len(regexp_extract_all({source}, {q(pattern)}))"


def tokens_sql(source: str) -> str:
    binary = f"contains({source}, chr(0)) or {cnt(source, tx.CONTROL_CHARACTERS)} * 20 > length({source})"
    return f"case when not ({binary}) then {cnt(source, tx.TOKEN_CHARGES)} + {cnt(source, tx.WIDE_CHARACTERS)} end"


@query("C05_structural_tokens", f"select doc_id, {tokens_sql('text')} as estimated_tokens from documents")
def structural_tokens(spark, root):
    return documents(spark, root).select("doc_id", tx.structural_tokens("text").alias("estimated_tokens"))


@query(
    "C06_estimate_totals",
    """select lang, count(*) as observed_blocks, count(t) as estimated_blocks, cast(coalesce(sum(t), 0) as bigint) as subtotal,
         case when count(t) = count(*) then cast(sum(t) as bigint) end as complete_total,
         case when count(distinct e) = 1 then min(e) end as estimator
       from (select *, case when t is not null then case when source = 'web' then 'other' else 'structural_heuristic' end end as e
             from (select lang, source, case when doc_id % 50 = 0 and lang = 'fr' then null else tok end as t
                   from (select doc_id, lang, source, """ + tokens_sql("text") + """ as tok from documents))) group by 1""",
)
def estimate_totals(spark, root):
    rows = bt.tokens_of(documents(spark, root)).withColumn(
        "estimated_tokens", F.expr("case when doc_id % 50 = 0 and lang = 'fr' then null else estimated_tokens end")
    ).withColumn("estimator", F.expr("case when source = 'web' then 'other' else estimator end"))
    return bt.estimate_totals(rows, ["lang"], "estimated_tokens")


@query("F17_exact_fingerprint", "select doc_id, sha256(text) as exact_fp from documents")
def exact_fingerprint(spark, root):
    return documents(spark, root).select("doc_id", tx.exact_fingerprint("text").alias("exact_fp"))


@query(
    "F18_semantic_fingerprint",
    """select conv_id, turn, case when turn % 3 < 2 then sha256('\\x00\\x00\\x00\\x01'::blob || encode(case when turn % 3 = 0 then 'text'
         else 'message' end) || encode(role) || encode(text)) end as semantic_fp from conversations""",
)
def semantic_fingerprint(spark, root):
    kind = F.expr("case turn % 3 when 0 then 'text' when 1 then 'message' else 'tool_call' end")
    return read(spark, root, "conversations").select(
        "conv_id", "turn", tx.semantic_fingerprint(kind, "role", "text").alias("semantic_fp")
    )


@query(
    "F19_common_prefix",
    """select p_partkey, coalesce(list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda i: a[1:i] = b[1:i])), 0)
         as prefix_bytes from (select p_partkey, concat(p_name, p_type) as a, concat(p_name, p_brand) as b from part)""",
)
def common_prefix(spark, root):
    return read(spark, root, "part").select(
        "p_partkey", tx.common_prefix(F.concat("p_name", "p_type"), F.concat("p_name", "p_brand")).cast("bigint").alias("prefix_bytes")
    )


@query("F16_byte_quarter_tokens", "select doc_id, greatest(1, cast(ceil(strlen(text) / 4.0) as bigint)) as tokens from documents")
def byte_quarter_tokens(spark, root):
    return documents(spark, root).select("doc_id", labels.byte_quarter_tokens(F.octet_length("text")).alias("tokens"))


@query(
    "F28_recovery_id",
    "select doc_id, 'recovery-' || substr(sha256(text), 1, 16) as recovery_id from documents",
)
def recovery_id(spark, root):
    return documents(spark, root).select("doc_id", labels.recovery_id(tx.exact_fingerprint("text")).alias("recovery_id"))


@query(
    "C14_text_handle",
    """select page_id, substr(url, 1, 20) as head, strlen(url) > 20 as truncated, sha256(url) as hash from pages""",
)
def text_handle(spark, root):
    handle = labels.text_handle("url", 20)
    return read(spark, root, "pages").select(
        "page_id", handle["text"].alias("head"), handle["truncated"].alias("truncated"), handle["hash"].alias("hash")
    )


# --- detection and features ------------------------------------------------------------------------------


def signals_sql(source: str, text: str, key: str) -> str:
    doubled = "d"
    parts = [f"{cnt(doubled, p)} as {name}" for name, p in tx.LINE_PATTERNS.items()]
    parts += [f"{cnt('x', p)} as {name}" for name, p in tx.TEXT_PATTERNS.items()]
    return (
        f"select {key} as id, x, strlen(x) as bytes, json_valid(x) as document, {', '.join(parts)} from"
        f" (select *, {text} as x, chr(10) || replace({text}, chr(10), chr(10) || chr(10)) as d from {source})"
    )


VERDICT = """case when bytes = 0 then 'unknown/low' when contains(x, chr(0)) then 'binary_like/high'
  when bytes > 0 and controls * 100 >= bytes * 5 then 'binary_like/medium' when document then 'json/high'
  when diff_hunks >= 1 and ((diff_old_files >= 1 and diff_new_files >= 1) or diff_headers >= 1) then 'diff/high'
  when (diff_hunks >= 1 or (diff_old_files >= 1 and diff_new_files >= 1)) and diff_marks - diff_old_files - diff_new_files >= 2 then 'diff/medium'
  when considered >= 2 and test_markers > 0 and test_markers * 100 >= considered * 30 and test_summaries >= 1 then 'test_results/high'
  when considered >= 2 and test_markers > 1 and test_markers * 100 >= considered * 30 then 'test_results/medium'
  when considered >= 3 and path_lines * 100 >= considered * 80 then 'search_results/high'
  when considered >= 2 and path_lines * 100 >= considered * 50 then 'search_results/medium'
  when considered >= 3 and timestamps * 100 >= considered * 80 then 'log/high'
  when considered >= 2 and (timestamps * 100 >= considered * 50 or (considered >= 3 and levels * 100 >= considered * 50)) then 'log/medium'
  when marks >= 2 and considered >= 3 and code_punctuation * 100 >= considered * 50 then 'source_code/high'
  when (marks >= 2 and considered >= 2) or (marks >= 1 and considered >= 3 and code_punctuation * 100 >= considered * 50) then 'source_code/medium'
  when considered >= 1 and visible > 0 and letters * 100 >= visible * 60 and words * 100 >= considered * 300
    and not (code_punctuation * 100 >= considered * 50) then 'plain_text/medium'
  else 'unknown/low' end"""
MARKS = "cast(code_declarations > 0 as int) + cast(code_imports > 0 as int) + cast(code_comments > 0 as int) as marks"


@query(
    "C08_line_signals",
    "select id, considered, levels, timestamps, path_lines, test_markers, test_summaries, code_declarations, code_imports,"
    " code_comments, code_punctuation, letters, visible, words, error_lines, warning_lines, diff_marks from s",
    s=signals_sql("documents", "text", "doc_id"),
)
def line_signals(spark, root):
    out = bt.with_signals(documents(spark, root))
    names = ("considered levels timestamps path_lines test_markers test_summaries code_declarations code_imports"
             " code_comments code_punctuation letters visible words error_lines warning_lines diff_marks").split()
    return out.select(F.col("doc_id").alias("id"), *[F.col(f"sig.{n}").cast("bigint").alias(n) for n in names])


@query(
    "C07_detect_documents",
    "select id, split_part(v, '/', 1) as detected_kind, split_part(v, '/', 2) as confidence"
    f" from (select id, {VERDICT} as v from (select *, {MARKS} from s))",
    s=signals_sql("documents", "text", "doc_id"),
)
def detect_documents(spark, root):
    return bt.detect(documents(spark, root)).select(F.col("doc_id").alias("id"), "detected_kind", "confidence")


def output_texts(spark, root):
    """All derived tool outputs as one text block each."""
    names = ("test_stdout", "check_stderr", "rg_stdout", "status_stdout", "log_text", "json_text")
    pairs = F.array(*[F.struct(F.lit(n).alias("stream"), F.col(n).alias("text")) for n in names])
    return outputs(spark, root).select("block_id", F.explode(pairs).alias("p")).select("block_id", "p.*")


_TEXTS = "select block_id || '/' || stream as id, text from (unpivot t_outputs on columns(* exclude (block_id)) into name stream value text)"


@query(
    "C07_detect_outputs",
    "select id, split_part(v, '/', 1) as detected_kind, split_part(v, '/', 2) as confidence"
    f" from (select id, {VERDICT} as v from (select *, {MARKS} from s))",
    texts=_TEXTS, s=signals_sql("texts", "text", "id"),
)
def detect_outputs(spark, root):
    rows = output_texts(spark, root)
    return bt.detect(rows).select(
        F.concat_ws("/", F.col("block_id").cast("string"), "stream").alias("id"), "detected_kind", "confidence"
    )


def lines_sql(source: str) -> str:
    raw = f"string_split({source}, chr(10))"
    trimmed = f"list_transform({raw}, lambda l: regexp_replace(l, '\\r$', ''))"
    return f"case when {raw}[-1] = '' then {trimmed}[:-2] else {trimmed} end"


_FEATURES = """select id, bytes as raw_bytes, n as line_count, case when n > 0 then list_max(list_transform(lines, lambda l: strlen(l))) end as max_line_bytes,
    (n - u) * 1000000 // nullif(n, 0) as duplicate_line_ppm, u * 1000000 // nullif(n, 0) as unique_line_ppm,
    least(error_lines, n) * 1000000 // nullif(n, 0) as error_line_ppm, least(warning_lines, n) * 1000000 // nullif(n, 0) as warning_line_ppm,
    (strlen(array_to_string(lines, '')) - strlen(array_to_string(list_distinct(lines), ''))) * 1000000
      // nullif(strlen(array_to_string(lines, '')), 0) as repetition_ppm
  from (select *, len(lines) as n, len(list_distinct(lines)) as u from (select *, """ + lines_sql("x") + """ as lines from s))"""


@query("C09_line_features", "select * from f", s=signals_sql("documents", "text", "doc_id"), f=_FEATURES)
def line_features(spark, root):
    out = bt.features(bt.detect(documents(spark, root)))
    return out.select(
        F.col("doc_id").alias("id"), "raw_bytes", "line_count", "max_line_bytes", "duplicate_line_ppm", "unique_line_ppm",
        "error_line_ppm", "warning_line_ppm", "repetition_ppm",
    )


@query(
    "F07_parts_per_million",
    "select id, duplicate_line_ppm, unique_line_ppm from f",
    texts="select block_id as id, log_text as text from t_outputs", s=signals_sql("texts", "text", "id"), f=_FEATURES,
)
def parts_per_million(spark, root):
    rows = outputs(spark, root).select(F.col("block_id").alias("id"), F.col("log_text").alias("text"))
    return bt.features(bt.detect(rows)).select("id", "duplicate_line_ppm", "unique_line_ppm")


@query(
    "C09_json_features",
    """select block_id, json_valid(json_text) as is_json, case when json_valid(json_text) then json_array_length(json_text) end as json_item_count,
         case when json_valid(json_text) then 2 end as json_depth from t_outputs""",
)
def json_features(spark, root):
    rows = outputs(spark, root).select("block_id", F.col("json_text").alias("text"))
    return bt.features(bt.detect(rows)).select(
        "block_id", (F.col("detected_kind") == "json").alias("is_json"), "json_item_count", "json_depth"
    )


_SIGNALS = f"""select id, text, v as kind_sure, f.raw_bytes, f.line_count, f.duplicate_line_ppm from
  (select id, x as text, split_part({VERDICT}, '/', 1) as v, {VERDICT} <> 'unknown/low' as sure from (select *, {MARKS} from s)) d join f using (id)"""


@query(
    "C11_opportunity_signals",
    """select id, array_to_string(list_filter([case when raw_bytes >= 8192 then 'large_tool_result' end,
         case when line_count >= 8 and duplicate_line_ppm >= 500000 then 'high_duplication' end,
         case when kind_sure = 'log' and line_count >= 32 and duplicate_line_ppm >= 200000 then 'repetitive_logs' end,
         case when kind_sure = 'search_results' and raw_bytes >= 8192 then 'large_search_result' end,
         case when kind_sure = 'test_results' and raw_bytes >= 8192 then 'large_test_output' end,
         case when dup > 1 and raw_bytes >= 1024 then 'repeated_history' end], lambda x: x is not null), ',') as signals
       from (select *, count(*) over (partition by text) as dup from sg)""",
    s=signals_sql("documents", "text", "doc_id"), f=_FEATURES, sg=_SIGNALS,
)
def opportunity_signals(spark, root):
    rows = bt.features(bt.detect(documents(spark, root))).withColumn("fp", tx.exact_fingerprint("text"))
    copies = rows.groupBy(F.col("fp").alias("fp2")).agg(F.count(F.lit(1)).alias("dup"))
    slim = rows.drop("text", "sig", "js")
    joined = slim.join(copies, slim.fp == copies.fp2)
    signals = bt.opportunity_signals(F.lit("tool_result"), F.col("dup") > 1)
    return joined.select(F.col("doc_id").alias("id"), F.array_join(signals, ",").alias("signals"))


@query(
    "C13_text_shape",
    """select id, case when len(list_distinct(lines)) < len(lines) then 'duplicate_lines' when len(list_filter(lines,
         lambda l: regexp_matches(l, '^[^\\S\\n]*\\S+[^\\S\\n]+\\S+[^\\S\\n]+\\S') and contains(l, ' '))) * 2 >= greatest(len(lines), 1)
         then 'logs_like' else 'plain' end as text_shape
       from (select id, """ + lines_sql("x") + f""" as lines from (select *, {MARKS} from s) where {VERDICT} like 'plain_text%')""",
    s=signals_sql("documents", "text", "doc_id"),
)
def text_shape(spark, root):
    out = bt.shape(bt.detect(documents(spark, root)))
    return out.where("detected_kind = 'plain_text'").select(F.col("doc_id").alias("id"), "text_shape")


@query(
    "C13_json_shape",
    """select block_id, 'array_object' as json_root_kind, case when n < 10 then '2-9' else '10-99' end as json_array_length_bucket,
         '2-9' as json_key_count_bucket, 10000 as json_homogeneity_bp, 10000 as json_primitive_bp, 0 as json_nested_bp
       from (select block_id, json_array_length(json_text) as n from t_outputs where json_valid(json_text))""",
)
def json_shape(spark, root):
    rows = outputs(spark, root).select("block_id", F.col("json_text").alias("text"))
    out = bt.shape(bt.detect(rows)).where("detected_kind = 'json'")
    return out.select(
        "block_id", "json_root_kind", "json_array_length_bucket", "json_key_count_bucket", "json_homogeneity_bp",
        "json_primitive_bp", "json_nested_bp",
    )


@query(
    "D46_semantic_coverage",
    f"select split_part(id, '/', 2) as stream, count(*) filter ({VERDICT} not like 'unknown%') * 10000 // count(*) as semantic_coverage_bp"
    f" from (select *, {MARKS} from s) group by 1",
    texts=_TEXTS, s=signals_sql("texts", "text", "id"),
)
def semantic_coverage(spark, root):
    return bt.semantic_coverage(bt.detect(output_texts(spark, root)), ["stream"])


@query(
    "U02_detector_on_conversations",
    "select id, split_part(v, '/', 1) as detected_kind, split_part(v, '/', 2) as confidence"
    f" from (select id, {VERDICT} as v from (select *, {MARKS} from s))",
    texts="select conv_id || '-' || turn as id, text from conversations", s=signals_sql("texts", "text", "id"),
)
def detector(spark, root):
    rows = read(spark, root, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text"
    )
    return bt.detect(rows).select("id", "detected_kind", "confidence")


# --- parsers -----------------------------------------------------------------------------------------------

_RG_LINES = """select block_id, l, regexp_extract(l, '^([^:]*):([0-9]+):(.*)$', 1) as file,
    cast(regexp_extract(l, '^([^:]*):([0-9]+):(.*)$', 2) as bigint) as line, regexp_extract(l, '^([^:]*):([0-9]+):(.*)$', 3) as text
  from (select block_id, unnest(string_split(rg_stdout, chr(10))) as l from t_outputs)"""


@query(
    "C15_search_matches",
    """select block_id, row_number() over (partition by block_id order by file, line, text) - 1 as position, file, line, text from rg""",
    rg=_RG_LINES,
)
def search_matches(spark, root):
    return bt.search_rows(outputs(spark, root), "block_id", "rg_stdout").withColumn("position", F.col("position").cast("bigint"))


@query(
    "C16_test_results",
    """select block_id, pos as position, case when failed then 'failure' else 'summary' end as entry,
         case when failed then trim(case when i > 0 then substr(rest, 1, i - 1) else rest end) end as identifier,
         case when failed then case when i > 0 then trim(substr(rest, i + 3)) else '' end else trim(line) end as message
       from (select *, starts_with(line, 'FAILED ') as failed, substr(line, 8) as rest, instr(substr(line, 8), ' - ') as i
             from (select block_id, generate_subscripts(ls, 1) - 1 as pos, regexp_replace(unnest(ls), '\\r$', '') as line
                   from (select block_id, string_split(replace(replace(replace(test_stdout, 'test mod_a', 'FAILED mod_a'), ' ... FAILED', ' - assertion error'),
                     'running 12 tests', '3 tests passed'), chr(10)) as ls from t_outputs)))
       where failed or regexp_matches(line, ' (passed|failed|error|skipped)')""",
)
def test_results(spark, root):
    text = F.expr(
        "replace(replace(replace(test_stdout, 'test mod_a', 'FAILED mod_a'), ' ... FAILED', ' - assertion error'), 'running 12 tests', '3 tests passed')"
    )
    rows = bt.test_rows(outputs(spark, root).select("block_id", text.alias("text")), "block_id")
    return rows.withColumn("position", F.col("position").cast("bigint"))


@query(
    "C16_test_results_outputs",
    """select block_id, count(*) as summaries from (select block_id, unnest(string_split(t, chr(10))) as line from
         (select block_id, replace(replace(test_stdout, ' ... ok', ' - 3 passed'), 'running', 'saw failed') as t from t_outputs))
       where regexp_matches(line, ' (passed|failed|error|skipped)') group by 1""",
)
def test_results_outputs(spark, root):
    rows = outputs(spark, root).select(
        "block_id", F.expr("replace(replace(test_stdout, ' ... ok', ' - 3 passed'), 'running', 'saw failed')").alias("text")
    )
    return bt.test_rows(rows, "block_id").where("entry = 'summary'").groupBy("block_id").agg(F.count(F.lit(1)).alias("summaries"))


@query(
    "C17_test_counts",
    """select block_id, cast(coalesce(list_sum(list_transform(regexp_extract_all(t, '(\\d+) passed', 1), lambda x: cast(x as bigint))), 0) as bigint) as passed,
         cast(coalesce(list_sum(list_transform(regexp_extract_all(t, '(\\d+) failed', 1), lambda x: cast(x as bigint))), 0) as bigint) as failed
       from (select block_id, 'test result: ' || block_id % 90 || ' passed; ' || block_id % 7 || ' failed' || chr(10) || test_stdout as t from t_outputs)""",
)
def test_counts(spark, root):
    text = F.expr("concat('test result: ', block_id % 90, ' passed; ', block_id % 7, ' failed\\n', test_stdout)")
    return outputs(spark, root).withColumn("t", text).select("block_id", *bt.test_counts("t"))


@query(
    "F25_search_answer",
    """select block_id, len(list_filter(string_split(rg_stdout, chr(10)), lambda l: trim(l) <> '')) as matches,
         len(list_distinct(list_transform(string_split(rg_stdout, chr(10)), lambda l: split_part(l, ':', 1)))) as files from t_outputs""",
)
def search_answer(spark, root):
    return outputs(spark, root).select("block_id", *bt.search_answer("rg_stdout"))


@query(
    "F12_shell_family",
    """select block_id, case when block_id % 3 = 0 then 'tests' when block_id % 3 = 1 then 'unknown' else 'tests' end as family
       from t_outputs""",
)
def shell_family(spark, root):
    command = F.expr("case block_id % 3 when 0 then 'cargo test --all' when 1 then 'rg needle src' end")
    output = F.expr("concat('3 passed; 1 failed ', test_stdout)")
    return outputs(spark, root).select("block_id", labels.shell_family(command, output).alias("family"))


# --- reduction candidates --------------------------------------------------------------------------------------


def kept_sql(source: str) -> str:
    raw = f"string_split({source}, chr(10))"
    kept = f"list_transform({raw}[:-2], lambda l: l || chr(10))"
    return f"case when {raw}[-1] = '' then {kept} else list_append({kept}, {raw}[-1]) end"


def judged_sql(key: str, raw: str, extra: str) -> str:
    """Sizes and verdict from columns applies, candidate and the raw text."""
    return f"""select {key}, {extra}, applies as applicable, strlen({raw}) as raw_bytes, strlen(candidate) as candidate_bytes,
      sha256(candidate) as candidate_fp, applies and strlen(candidate) < strlen({raw})
        and cast(ceil(strlen(candidate) / 4.0) as bigint) < cast(ceil(strlen({raw}) / 4.0) as bigint) as accepted"""


def judged(df, *extra):
    return df.select(
        "block_id", *extra, "applicable", "raw_bytes", "candidate_bytes", F.sha2("candidate", 256).alias("candidate_fp"), "accepted"
    )


def _list_filter(source, pattern, keep):
    return f"list_filter({source}, lambda l: {'not ' if keep else ''}regexp_matches(l, {q(pattern)}))"


_TEST_SQL = judged_sql("block_id", "raw", "omitted_tests, omitted_progress") + f""" from (select *, case when applies then
    '[Agenttrace: ' || omitted_tests || ' passing test lines and ' || omitted_progress || ' progress lines omitted' || {{tail}} || body else raw end as candidate
  from (select *, omitted_tests > 0 or omitted_progress > 0 as applies from (select block_id, test_stdout || check_stderr as raw,
      len({_list_filter('tl', red.PASSING, False)}) as omitted_tests, len({_list_filter('cl', red.PROGRESS_AND_END, False)}) as omitted_progress,
      array_to_string({_list_filter(_list_filter('tl', red.PASSING, True), red.RUNNING, True)}, '')
        || array_to_string({_list_filter('cl', red.PROGRESS_AND_END, True)}, '') as body
    from (select *, {kept_sql('test_stdout')} as tl, {kept_sql('check_stderr')} as cl from t_outputs))))"""


@query("R14_cargo_test", _TEST_SQL.format(tail="'; recovery available when active.]' || chr(10)"))
def cargo_test(spark, root):
    out = red.cargo_test(outputs(spark, root), "test_stdout", "check_stderr")
    return judged(out, "omitted_tests", "omitted_progress")


@query("R18_cargo_test_active", _TEST_SQL.format(tail="'. Full output: recover abc]' || chr(10)"))
def cargo_test_active(spark, root):
    out = red.cargo_test(outputs(spark, root), "test_stdout", "check_stderr", "recover abc")
    return judged(out, "omitted_tests", "omitted_progress")


def _check_sql(pattern, tail):
    return judged_sql("block_id", "check_stderr", "omitted_progress") + f""" from (select *, case when applies then '[Agenttrace: '
        || omitted_progress || ' Cargo progress lines omitted' || {tail} || body else check_stderr end as candidate
      from (select *, omitted_progress > 0 as applies from (select block_id, check_stderr, len({_list_filter('cl', pattern, False)}) as omitted_progress,
          array_to_string({_list_filter('cl', pattern, True)}, '') as body from (select *, {kept_sql('check_stderr')} as cl from t_outputs))))"""


_SHADOW_TAIL = "'; recovery available when active.]' || chr(10)"


@query("R15_cargo_check_v1", _check_sql(red.PROGRESS_AND_END, _SHADOW_TAIL))
def cargo_check_v1(spark, root):
    return judged(red.cargo_check(outputs(spark, root), "check_stderr", keep_finished=False), "omitted_progress")


@query("R15_cargo_check_v2", _check_sql(red.PROGRESS, _SHADOW_TAIL))
def cargo_check_v2(spark, root):
    return judged(red.cargo_check(outputs(spark, root), "check_stderr"), "omitted_progress")


@query(
    "R16_ripgrep",
    judged_sql("block_id", "rg_stdout", "case when applies then len(ls) else 0 end as grouped_lines") + """ from (select *,
        case when applies then array_to_string(list_transform(range(1, len(ls) + 1), lambda i:
          case when i > 1 and regexp_extract(ls[i], '^(.*?):([0-9]+):', 1) = regexp_extract(ls[i - 1], '^(.*?):([0-9]+):', 1) then ''
            else regexp_extract(ls[i], '^(.*?):([0-9]+):', 1) || ':' || chr(10) end || '  ' || regexp_replace(ls[i], '(?s)^(.*?):([0-9]+):(.*)$', '\\2:\\3')), '')
          else rg_stdout end as candidate
      from (select *, len(list_filter(ls, lambda l: len(regexp_extract_all(replace(l, ':', '::'), ':[0-9]+:')) <> 1)) = 0 as applies
        from (select *, """ + kept_sql("rg_stdout") + """ as ls from t_outputs)))""",
)
def ripgrep(spark, root):
    return judged(red.ripgrep(outputs(spark, root), "rg_stdout"), "grouped_lines")


@query(
    "R17_git_status",
    judged_sql("block_id", "status_stdout", "omitted_hints") + f""" from (select *, case when applies then body else status_stdout end as candidate
      from (select *, omitted_hints > 0 as applies from (select *, case when starts_with(status_stdout, 'On branch ') then
          len({_list_filter('ls', '^  ' + chr(92) + '(use ".*' + chr(92) + ')' + chr(92) + 's*$', False)}) else 0 end as omitted_hints,
          array_to_string({_list_filter('ls', '^  ' + chr(92) + '(use ".*' + chr(92) + ')' + chr(92) + 's*$', True)}, '') as body
        from (select *, {kept_sql('status_stdout')} as ls from t_outputs))))""",
)
def git_status(spark, root):
    return judged(red.git_status(outputs(spark, root), "status_stdout"), "omitted_hints")


_RUNS = f"""select doc_id, ls, list_filter(range(1, len(ls) + 1), lambda i: i = 1 or ls[i] <> ls[i - 1]) as st
  from (select doc_id, {kept_sql('text')} as ls from documents)"""


@query(
    "W11_line_runs",
    """select doc_id, k - 1 as run, ls[st[k]] as line, coalesce(st[k + 1], len(ls) + 1) - st[k] as repeats
       from (select doc_id, ls, st, unnest(range(1, len(st) + 1)) as k from runs)""",
    runs=_RUNS,
)
def line_runs(spark, root):
    rows = red.line_runs(documents(spark, root), "doc_id")
    return rows.withColumn("run", F.col("run").cast("bigint")).withColumn("repeats", F.col("repeats").cast("bigint"))


@query(
    "R07_line_fold",
    """select doc_id, case when len(st) < len(ls) then sha256('Agenttrace line-fold v1' || chr(10) || array_to_string(list_transform(range(1, len(st) + 1),
         lambda k: case when coalesce(st[k + 1], len(ls) + 1) - st[k] >= 2 then 'repeat=' || (coalesce(st[k + 1], len(ls) + 1) - st[k]) || ' ' else '' end
           || 'line=' || to_json(ls[st[k]]) || chr(10)), '')) end as candidate_fp, case when not len(st) < len(ls) then 'not_applicable' end as failure
       from runs""",
    runs=_RUNS,
)
def line_fold(spark, root):
    out = red.line_fold(documents(spark, root))
    return out.select("doc_id", F.sha2("candidate", 256).alias("candidate_fp"), "failure")


@query(
    "R06_repeated_line",
    "select doc_id, len(st) as records, len(ls) as lines, len(st) < len(ls) as repeats from runs", runs=_RUNS,
)
def repeated_line(spark, root):
    runs = red.with_line_runs(documents(spark, root))
    return runs.select(
        "doc_id", F.size("starts").cast("bigint").alias("records"), F.size("lines").cast("bigint").alias("lines"),
        (F.size("starts") < F.size("lines")).alias("repeats"),
    )


_PREFIX = f"""select block_id, ls, ps, list_filter(range(1, len(ls) + 1), lambda i: i = 1 or ps[i] is null or ps[i - 1] is null or ps[i] <> ps[i - 1]) as st
  from (select block_id, ls, list_transform(ls, lambda l: case when strlen(regexp_extract(l, {q(red.SECOND_TOKEN)}, 1)) >= 3
      then regexp_extract(l, {q(red.SECOND_TOKEN)}, 1) end) as ps from (select block_id, {kept_sql('log_text')} as ls from t_outputs))"""


@query(
    "R09_log_prefix_fold",
    """select block_id, case when len(st) < len(ls) then sha256('Agenttrace log-prefix-fold v1' || chr(10) || array_to_string(list_transform(range(1, len(st) + 1),
         lambda k: case when coalesce(st[k + 1], len(ls) + 1) - st[k] >= 2 then 'prefix=' || to_json(ps[st[k]]) || ' tails=[' ||
           array_to_string(list_transform(ls[st[k]:coalesce(st[k + 1], len(ls) + 1) - 1],
             lambda l: to_json(regexp_replace(l, '^(\\S+ )(\\S+)( )', '\\1\\3'))), ',') || ']' || chr(10)
           else 'line=' || to_json(ls[st[k]]) || chr(10) end), '')) end as candidate_fp from p""",
    p=_PREFIX,
)
def log_prefix_fold(spark, root):
    rows = outputs(spark, root).select("block_id", F.col("log_text").alias("text"))
    return red.prefix_fold(rows).select("block_id", F.sha2("candidate", 256).alias("candidate_fp"))


def _json_rows(spark, root):
    return outputs(spark, root).select(
        "block_id", F.col("json_text").alias("text"), F.lit("json").alias("detected_kind")
    )


@query(
    "R02_json_minify",
    """select block_id, case when json_valid(json_text) then sha256(json_text::json::varchar) end as candidate_fp,
         case when not json_valid(json_text) then 'invalid_input' end as failure
       from (select block_id, replace(replace(json_text, ': ', ':'), ', ', ',') as json_text from t_outputs)""",
)
def json_minify(spark, root):
    return red.minify(_json_rows(spark, root)).select("block_id", F.sha2("candidate", 256).alias("candidate_fp"), "failure")


def _rows_sql(render: str, head: str, tail: str, join: str) -> str:
    return f"""select block_id, case when json_valid(json_text) then sha256({head} || array_to_string(list_transform(range(0, 2 + block_id % 30),
        lambda i: {render}), {join}) || {tail}) end as candidate_fp from t_outputs"""


_CELLS = "'[' || i || ',\"\",' || i * 10 || ',\"ok\"]'"
_KEYS = "'[\"id\",\"note\",\"price\",\"status\"]'"


@query("R03_json_tabular", _rows_sql(_CELLS, f"'[\"table2\",' || {_KEYS} || ',['", "']]'", "','"))
def json_tabular(spark, root):
    out = red.propose(_json_rows(spark, root), ["json.tabular"])
    return out.select("block_id", F.sha2("candidate", 256).alias("candidate_fp"))


@query(
    "R04_readable_table",
    _rows_sql(f"'row' || chr(9) || {_CELLS} || chr(10)", f"'Agenttrace table v1' || chr(10) || 'fields' || chr(9) || {_KEYS} || chr(10)", "''", "''"),
)
def readable_table(spark, root):
    out = red.propose(_json_rows(spark, root), ["json.readable_table"])
    return out.select("block_id", F.sha2("candidate", 256).alias("candidate_fp"))


@query(
    "R04_compact_records",
    _rows_sql(f"{_CELLS} || chr(10)", f"'Agenttrace records v1' || chr(10) || 'fields: ' || {_KEYS} || chr(10)", "''", "''"),
)
def compact_records(spark, root):
    out = red.propose(_json_rows(spark, root), ["json.compact_records"])
    return out.select("block_id", F.sha2("candidate", 256).alias("candidate_fp"))


@query(
    "R04_key_elision",
    _rows_sql(
        "'(' || i || ',\"\",' || i * 10 || ',\"ok\")' || chr(10)",
        "'Agenttrace key-elision v1' || chr(10) || 'fields(\"id\",\"note\",\"price\",\"status\"): ' || chr(10)", "''", "''",
    ),
)
def key_elision(spark, root):
    out = red.propose(_json_rows(spark, root), ["json.key_elision"])
    return out.select("block_id", F.sha2("candidate", 256).alias("candidate_fp"))


def _at_least(candidates: str, source: str, least: int) -> str:
    """Candidates of inputs with `least` bytes; smaller ones stay without one."""
    return (
        f"select block_id, case when strlen({source}) >= {least} then candidate_fp end as candidate_fp, strlen({source}) < {least} as below_minimum"
        f" from ({candidates}) join t_outputs using (block_id)"
    )


def _below():
    return F.coalesce(F.col("failure") == "below_minimum", F.lit(False)).alias("below_minimum")


@query(
    "R10_empty_noise_fields",
    _at_least(_rows_sql("'{\"id\":' || i || ',\"price\":' || i * 10 || ',\"status\":\"ok\"}'", "'['", "']'", "','"), "json_text", 128),
)
def empty_noise(spark, root):
    out = red.propose(_json_rows(spark, root), ["json.empty_noise_fields"])
    return out.select("block_id", F.sha2("candidate", 256).alias("candidate_fp"), _below())


@query(
    "R11_repeated_value_elision",
    _at_least(_rows_sql(
        "'{\"id\":' || i || ',\"price\":' || i * 10 || '}'", "'{\"common\":{\"note\":\"\",\"status\":\"ok\"},\"rows\":['", "']}'", "','"
    ), "json_text", 256),
)
def repeated_values(spark, root):
    out = red.propose(_json_rows(spark, root), ["json.repeated_value_elision"])
    return out.select("block_id", F.sha2("candidate", 256).alias("candidate_fp"), _below())


@query(
    "R05_repeated_subtree",
    """select block_id, case when json_valid(json_text) then sha256('["shared3",[{"id":0,"note":"","price":0,"status":"ok"}],[["$same_as",0],["$same_as",0]]]') end
         as candidate_fp from t_outputs""",
)
def repeated_subtree(spark, root):
    first = F.regexp_extract("text", r"\{[^}]*\}", 0)
    twice = _json_rows(spark, root).withColumn(
        "text", F.when(F.col("text").endswith("]"), F.concat(F.lit("["), first, F.lit(","), first, F.lit("]"))).otherwise(F.col("text"))
    )
    out = red.propose(twice, ["json.repeated_subtree"])
    return out.select("block_id", F.sha2("candidate", 256).alias("candidate_fp"))


_SHELL = """select block_id, ls, '{"exit_code":1,"stdout":' || to_json(array_to_string(ls, chr(10))) || '}' as t
  from (select block_id, list_transform(range(0, 20 + 2 * (block_id % 30)), lambda i: 'line ' || i) as ls from t_outputs)"""


@query(
    "R12_shell_projection",
    """select block_id, case when len(ls) - 48 > 1 and strlen(t) >= 256 then sha256('{"exit_code":1,"stdout":' || to_json(array_to_string(ls[1:24], chr(10)) || chr(10)
         || '[Agenttrace omitted ' || (len(ls) - 48) || ' output lines; local recovery is available]' || chr(10) || array_to_string(ls[-24:], chr(10))) || '}')
         end as candidate_fp, strlen(t) < 256 as below_minimum from sh""",
    sh=_SHELL,
)
def shell_projection(spark, root):
    lines = F.expr("array_join(transform(sequence(0, cast(19 + 2 * (block_id % 30) as int)), i -> concat('line ', i)), '\\n')")
    text = F.to_json(F.struct(F.lit(1).alias("exit_code"), lines.alias("stdout")))
    rows = outputs(spark, root).select("block_id", text.alias("text"), F.lit("json").alias("detected_kind"))
    out = red.propose(rows, ["shell.diagnostic_projection"])
    return out.select("block_id", F.sha2("candidate", 256).alias("candidate_fp"), _below())


@query(
    "R13_search_projection",
    """select o.block_id, case when n >= 2 and strlen(rg_stdout) >= 256 then sha256('[search results]' || chr(10) || body) end as candidate_fp,
         strlen(rg_stdout) < 256 as below_minimum from t_outputs o left join (
         select block_id, count(*) as n, string_agg(case when first_of then file || ':' || chr(10) else '' end || line || chr(9) || text || chr(10), ''
           order by file, line, text) as body
         from (select *, row_number() over (partition by block_id, file order by line, text) = 1 as first_of from rg) group by 1) b using (block_id)""",
    rg=_RG_LINES,
)
def search_projection(spark, root):
    rows = outputs(spark, root).select("block_id", F.col("rg_stdout").alias("text"), F.lit("plain_text").alias("detected_kind"))
    out = red.propose(rows, ["search.result_projection"])
    return out.select("block_id", F.sha2("candidate", 256).alias("candidate_fp"), _below())


@query("R08_block_fold")
def block_fold(spark, root):
    rows = documents(spark, root).withColumn("detected_kind", F.lit("plain_text"))
    out = red.propose(rows, ["text.readable_block_fold"])
    return out.select("doc_id", F.octet_length("candidate").cast("bigint").alias("candidate_bytes"), "failure")


@query(
    "R01_noop_controls",
    f"select doc_id, 'no_improvement' as status, strlen(text) as input_bytes, {tokens_sql('text')} as input_tokens from documents",
)
def noop_controls(spark, root):
    rows = documents(spark, root).withColumn("detected_kind", F.lit("plain_text"))
    return red.evaluate(red.propose(rows, ["text.noop"])).select(
        "doc_id", "status", "input_bytes", "input_tokens"
    )


@query(
    "G01_gate_line_fold",
    f"""select doc_id, case when candidate is null then 'not_applicable' when strlen(candidate) >= strlen(text) or ct >= it then 'no_improvement'
         else 'applicable' end as status, strlen(text) as input_bytes, strlen(candidate) as output_bytes, it as input_tokens, ct as output_tokens,
         strlen(text) - strlen(candidate) as bytes_delta, it - ct as token_delta
       from (select *, {tokens_sql('text')} as it, {tokens_sql('candidate')} as ct from (select doc_id, text, case when len(st) < len(ls) then
         'Agenttrace line-fold v1' || chr(10) || array_to_string(list_transform(range(1, len(st) + 1),
         lambda k: case when coalesce(st[k + 1], len(ls) + 1) - st[k] >= 2 then 'repeat=' || (coalesce(st[k + 1], len(ls) + 1) - st[k]) || ' ' else '' end
           || 'line=' || to_json(ls[st[k]]) || chr(10)), '') end as candidate from runs join documents using (doc_id)))""",
    runs=_RUNS,
)
def gate_line_fold(spark, root):
    rows = documents(spark, root).withColumn("detected_kind", F.lit("plain_text"))
    return red.evaluate(red.propose(rows, ["text.readable_line_fold"])).select(
        "doc_id", "status", "input_bytes", "output_bytes", "input_tokens", "output_tokens", "bytes_delta", "token_delta"
    )


_GATED = f"""select doc_id, candidate is not null as applies, case when candidate is null then 'not_applicable'
      when strlen(candidate) >= strlen(text) or ct >= it then 'no_improvement' else 'applicable' end as status
    from (select *, {tokens_sql('text')} as it, {tokens_sql('candidate')} as ct from (select doc_id, text, case when len(st) < len(ls) then
      'Agenttrace line-fold v1' || chr(10) || array_to_string(list_transform(range(1, len(st) + 1),
      lambda k: case when coalesce(st[k + 1], len(ls) + 1) - st[k] >= 2 then 'repeat=' || (coalesce(st[k + 1], len(ls) + 1) - st[k]) || ' ' else '' end
        || 'line=' || to_json(ls[st[k]]) || chr(10)), '') end as candidate from runs join documents using (doc_id)))"""


@query(
    "G01_recovery_gate",
    """select 'text.readable_line_fold' as candidate_id, doc_id, status from gated
       union all select 'planted.loss', doc_id, case when applies and doc_id % 2 = 1 then 'recovery_failed' else status end from gated
       union all select 'planted.noise', doc_id, case when applies and doc_id % 3 = 0 then 'internal_error' else status end from gated""",
    runs=_RUNS, gated=_GATED,
)
def recovery_gate(spark, root):
    """The line fold, one that loses its last run and one that never gives the same twice, through the whole gate."""
    rows = documents(spark, root).withColumn("detected_kind", F.lit("plain_text"))
    fold = red.INVERSES["text.readable_line_fold"]

    def loss(df, text="text"):
        cut = F.regexp_replace("candidate", "(?<=\n)[^\n]*\n$", "")
        return red.line_fold(df, text).withColumn("candidate", F.when(F.col("doc_id") % 2 == 1, cut).otherwise(F.col("candidate")))

    def noise(df, text="text"):
        return red.line_fold(df, text).withColumn("candidate", F.when(F.col("doc_id") % 3 == 0, F.concat("candidate", F.uuid())).otherwise(F.col("candidate")))

    tried = red.gated(rows, "text.readable_line_fold").unionByName(red.gated(rows, "planted.loss", job=loss, inverse=fold)).unionByName(red.gated(rows, "planted.noise", job=noise, inverse=fold))
    return red.evaluate(tried).select("candidate_id", "doc_id", "status")


@query(
    "G02_candidate_plan",
    """select candidate_id, count(*) as blocks from (select unnest(list_filter(case when detected_kind = 'json' then
         ['json.noop', 'json.minify', 'json.tabular', 'json.repeated_subtree', 'json.readable_table', 'json.compact_records', 'json.key_elision',
          case when raw_bytes >= 128 then 'json.empty_noise_fields' end, case when raw_bytes >= 256 then 'json.repeated_value_elision' end,
          case when raw_bytes >= 256 then 'search.result_projection' end]
         when detected_kind = 'plain_text' then ['text.noop', 'text.repeated_line', 'text.repeated_run', 'text.readable_line_fold',
          'text.readable_block_fold', 'text.log_prefix_fold', case when raw_bytes >= 256 and ordinal % 2 = 0 then 'search.result_projection' end]
         else [] end, lambda x: x is not null)) as candidate_id from t_blocks where kind = 'tool_result') group by 1""",
)
def candidate_plan(spark, root):
    from ..sources.bindings import star_trace

    blocks = star_trace(spark, root).blocks.withColumn("tool_family", labels.tool_family("tool_name")).withColumn(
        "shell_family", F.expr("case when ordinal % 2 = 0 then 'search' else 'generic' end")
    )
    return red.candidate_plan(blocks).groupBy("candidate_id").agg(F.count(F.lit(1)).alias("blocks"))


@query(
    "R19_policy_registry",
    """select reducer_id, l_linestatus, count(*) as executions, count(*) filter (reducer_id in ('cargo_test_v1_active', 'cargo_check_v2_active', 'rg_v1_active')
         and family_ok) as active_allowed
       from (select l_linestatus, ['cargo_test_v1_shadow', 'cargo_test_v1_active', 'cargo_check_v1_shadow', 'cargo_check_v1_active', 'cargo_check_v2_shadow',
           'cargo_check_v2_active', 'cargo_clippy_v1_shadow', 'rg_v1_shadow', 'rg_v1_active', 'git_status_v1_shadow', 'git_status_v1_active'][l_suppkey % 11 + 1] as reducer_id,
           case when l_suppkey % 11 < 2 then l_partkey % 2 = 0 when l_suppkey % 11 < 6 then l_partkey % 2 = 1 when l_suppkey % 11 in (7, 8) then l_partkey % 3 = 0 else false end as family_ok
         from lineitem) group by 1, 2""",
)
def policy_registry(spark, root):
    names = ", ".join(f"'{p[0]}'" for p in red.POLICIES)
    rows = read(spark, root, "lineitem").select(
        "l_linestatus", F.expr(f"element_at(array({names}), cast(l_suppkey % 11 + 1 as int))").alias("reducer_id"),
        F.expr(
            "case when l_suppkey % 11 in (7, 8) then case when l_partkey % 3 = 0 then 'ripgrep' else 'git_status' end"
            " when l_partkey % 2 = 0 then 'cargo_test' else 'cargo_check' end"
        ).alias("command_family"),
    )
    return red.active_allowed(rows).groupBy("reducer_id", "l_linestatus").agg(
        F.count(F.lit(1)).alias("executions"), F.count(F.when(F.col("active_allowed"), 1)).alias("active_allowed")
    )
