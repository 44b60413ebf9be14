"""Trace: the set of relational facts every operator reads.

Tables are produced lazily by name, so an operator only plans the scans it uses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TABLES


class Trace:
    """Named DataFrames, built on first use."""

    def __init__(self, tables: dict[str, Callable[[], DataFrame] | DataFrame]):
        self._makers = dict(tables)
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            if name not in self._makers:
                raise AttributeError(f"trace has no table {name!r}")
            maker = self._makers[name]
            self._built[name] = maker if isinstance(maker, DataFrame) else maker()
        return self._built[name]

    def replace(self, **tables: DataFrame) -> Trace:
        return Trace({**self._makers, **self._built, **tables})

    @property
    def names(self) -> list[str]:
        return sorted(self._makers)


def conform(df: DataFrame, table: str, keep_types: bool = False) -> DataFrame:
    """Select a table's documented columns; an absent column reads as a typed NULL."""
    present = set(df.columns)
    columns = []
    for name, kind in TABLES[table].items():
        if name not in present:
            columns.append(F.lit(None).cast(kind).alias(name))
        elif keep_types:
            columns.append(F.col(name))
        else:
            columns.append(F.col(name).cast(kind).alias(name))
    return df.select(*columns)


def read_trace(spark: SparkSession, root: str, tables: list[str] | None = None) -> Trace:
    """Open a folder of Parquet tables; a missing table reads as empty, a missing column as NULL."""

    def opener(name: str) -> Callable[[], DataFrame]:
        def open_table() -> DataFrame:
            path = f"{root}/{name}"
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
            for candidate in (path, f"{path}.parquet"):
                if files.exists(spark._jvm.org.apache.hadoop.fs.Path(candidate)):
                    return conform(spark.read.option("mergeSchema", "true").parquet(candidate), name)
            ddl = ", ".join(f"`{c}` {t}" for c, t in TABLES[name].items())
            return spark.createDataFrame([], ddl)

        return open_table

    return Trace({name: opener(name) for name in (tables or TABLES)})


def write_trace(trace: Trace, root: str, tables: list[str] | None = None) -> None:
    """Write the facts as Parquet, blocks clustered by snapshot so delta jobs read in order."""
    for name in tables or trace.names:
        frame = getattr(trace, name)
        if name == "blocks":
            frame = frame.repartition("snapshot_id").sortWithinPartitions("snapshot_id", "ordinal")
        frame.write.mode("overwrite").parquet(f"{root}/{name}")


class UnknownSessions(ValueError):
    """A cohort names sessions the trace does not contain."""


def missing_sessions(trace: Trace, cohort: DataFrame) -> DataFrame:
    """Cohort ids that no session carries."""
    return cohort.select("session_id").distinct().join(trace.sessions, "session_id", "left_anti")


def cohort(trace: Trace, selected: DataFrame, check: bool = True) -> Trace:
    """Restrict every table to the selected sessions, following the key chain with semi joins.

    An unknown session id is an error, not an empty result.
    """
    ids = selected.select("session_id").distinct()
    if check:
        absent = missing_sessions(trace, ids).limit(5).collect()
        if absent:
            raise UnknownSessions(", ".join(str(row[0]) for row in absent))

    def keep(df: DataFrame, key: str, allowed: DataFrame, allowed_key: str) -> DataFrame:
        return df.join(allowed.select(F.col(allowed_key).alias(key)), key, "left_semi")

    sessions = keep(trace.sessions, "session_id", ids, "session_id")
    operations = keep(trace.operations, "session_id", ids, "session_id")
    requests = keep(trace.requests, "operation_id", operations, "operation_id")
    attempts = keep(trace.attempts, "request_id", requests, "request_id")
    usage = keep(trace.usage, "attempt_id", attempts, "attempt_id")
    snapshots = keep(trace.snapshots, "session_id", ids, "session_id")
    blocks = keep(trace.blocks, "snapshot_id", snapshots, "snapshot_id")
    metrics = keep(trace.metrics, "snapshot_id", snapshots, "snapshot_id")
    return trace.replace(
        sessions=sessions, operations=operations, requests=requests, attempts=attempts,
        usage=usage, snapshots=snapshots, blocks=blocks, metrics=metrics,
        events=keep(trace.events, "session_id", ids, "session_id"),
    )
