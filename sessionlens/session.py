"""Session builder with the settings the jobs assume, and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDERS: dict[str, str] = {}


def build_session(app: str = "sessionlens", master: str | None = None, **conf: str) -> SparkSession:
    """Create or reuse a session; cluster settings given outside always win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by `spark.checkpoint.dir`.

    Where the setting is absent (tests, a first try), the session gets one below the warehouse; it is
    removed when the session's JVM ends. On a cluster a warehouse on a local disk is shared by nobody, and
    this is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    application = spark.sparkContext.applicationId
    if application in _OWN_FOLDERS:
        return _OWN_FOLDERS[application]
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not spark.sparkContext.master.startswith("local") and warehouse.startswith(("file:", "/")):
        raise RuntimeError(f"set spark.checkpoint.dir: {warehouse} is a local folder, which the executors of a cluster do not share")
    own = f"{warehouse.rstrip('/')}/_scratch-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return _OWN_FOLDERS.setdefault(application, own)


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """A frame written now, once, to a folder below the shared one, and read from there."""
    path = new_folder(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
