"""Sessions, the shared scratch folder and lineage cuts.

A job of several passes must not recompute its first pass when an executor is lost, and must not keep
intermediate results on one machine. ``stage`` writes a table to the folder that all executors share
(``spark.checkpoint.dir``) and reads it again; the folder is never a local one on a cluster, because it is
taken from the session and only set here when the session has none (tests, local mode).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_staged: list[tuple[SparkSession, str]] = []


def local_session(cores: str | int = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster passes its own session to every function."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("brindle")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables: spark.checkpoint.dir, else (only in local mode) a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    at = tempfile.mkdtemp(prefix="brindle-")
    spark.sparkContext.setCheckpointDir(f"file://{at}")
    return f"file://{at}"


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as the session has cores, for steps that compute much per row.

    A table of few small files has fewer scan tasks than there are cores; only such a one is shuffled (round
    robin, so by no key). A table of many files comes back as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that is removed when the process ends, or by ``release``."""
    path = f"{shared_dir(spark)}/brindle-{name}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives the loss of executors.

    The table is removed when the process ends, or by ``release``.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables written by ``stage``; results that read them can't be computed again afterwards."""
    while _staged:
        _, path = _staged.pop()
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _at_exit() -> None:
    for spark, _ in _staged[:1]:
        try:
            release(spark)
        except Exception:  # noqa: BLE001  the session may be gone already; then its folder's owner cleans up
            _staged.clear()
