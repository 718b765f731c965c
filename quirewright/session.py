"""Spark session and shared-storage helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, app: str = "quirewright", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset, as in local tests, a folder of our own is taken.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + os.path.join(tempfile.gettempdir(), f"quirewright-{os.getpid()}")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found


#: With it Spark removes the shuffles of a job that has ended; without effect where Spark does not know it.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables that ``cut`` has written and nobody has removed.
_WRITTEN: list[str] = []


def release(spark: SparkSession, keep: int = 0) -> int:
    """Removes the tables that ``cut`` has written in this driver, but for the first ``keep``; gives how many there were.

    A long session takes ``written()`` before a job and releases what came after it when the job's result is stored.
    """
    gone = _WRITTEN[keep:]
    del _WRITTEN[keep:]
    for path in gone:
        _remove(spark, path)
    return len(gone)


def written() -> int:
    """Tables that ``cut`` has written and nobody has removed."""
    return len(_WRITTEN)


def cut(df: DataFrame, tidy: bool = False) -> DataFrame:
    """``df`` computed once, written as a table in the shared folder and read back.

    A lost executor then costs no recomputation of what lies before. The table is removed when the driver ends, or by
    ``release`` once nothing made from it is used any more. ``tidy``: what was shuffled for it is removed at once, else
    when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quirewright-{uuid.uuid4().hex}"
    # a collection alone leaves the shuffles of the job that has just ended, for they are still held
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true" if tidy else before)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    if not _WRITTEN:
        atexit.register(release, spark)
    _WRITTEN.append(path)
    if tidy:
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already; the folder is temporary
        pass


def once(udf):
    """``udf`` evaluated once for each row: the optimizer otherwise copies it into filters that an explode or a
    comparison implies, and Python runs twice."""
    return udf.asNondeterministic()


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """All rows of a table that must be small; raises where it holds more than ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return rows


def bounded_broadcast(df: DataFrame, limit: int = 10_000) -> DataFrame:
    """``df`` marked for broadcast if it is proven to hold at most ``limit`` rows, else unchanged."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
