"""Session helpers: a tuned local session, table access and lineage cuts that survive executor loss."""

from __future__ import annotations

import gc
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, app: str = "lumenfold", memory: str = "8g", **conf: str) -> SparkSession:
    """A ``local[cpus]`` session with the settings the operators are written for."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
        os.environ.setdefault(name, "1")  # one BLAS thread for each Python worker: tasks are the parallelism
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # files of tables nobody holds any more
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` evaluated once and stored reliably in the shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``; only a local session without
    one gets a temporary folder of its own. The files outlive any executor.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lumenfold-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def uncut(df: DataFrame) -> None:
    """Deletes the files of a table ``cut`` made, once nothing that is still to run reads it; other tables stay as they are."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRDD":
        return
    stored = plan.rdd().getCheckpointFile()
    if stored.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(stored.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; loops call it between their rounds."""
    gc.collect()
    dropped = getattr(spark._jvm._gateway_client, "finalizer_deque", None)  # a thread tells the JVM of them, up to a second later
    until = time.monotonic() + 5
    while dropped and time.monotonic() < until:
        time.sleep(0.05)
    time.sleep(0.05)  # for the last one
    spark._jvm.java.lang.System.gc()


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most_rows`` rows; otherwise as it is, to be joined by shuffle."""
    return F.broadcast(df) if small_enough(df, most_rows) else df


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows; reads no more than one row beyond that."""
    return df.limit(most_rows + 1).count() <= most_rows
