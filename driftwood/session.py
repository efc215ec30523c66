"""Session construction and the shared folder for stage tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own_dirs: dict[str, str] = {}


def get_session(app: str = "driftwood", master: str | None = None, partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # One JVM does all the work, and its default heap is 1 GB.
            builder = builder.config("spark.driver.memory", "12g")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="driftwood-")
    return _own_dirs[app]


def _session_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/driftwood/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{_session_dir(spark)}/{label}-{uuid.uuid4().hex}"


def drop_written_tables(spark: SparkSession) -> None:
    """Deletes the tables this session wrote by ``materialise``; DataFrames reading them end with it."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(_session_dir(spark))
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df, label: str):
    """Write ``df`` below the shared folder and read it back.

    Cuts the lineage, and survives the loss of any executor because the table lies in shared storage.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
