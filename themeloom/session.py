"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "themeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; pass extra settings by keyword."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="themeloom-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/themeloom/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str = "table", large: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives later joins the real
    size of the table.  A ``large`` table, beside the input, is packed closer, and
    the shuffle files of the steps before it are released.
    """
    path = scratch_path(df.sparkSession, name)
    (df.write.option("compression", "zstd") if large else df.write).parquet(path)
    if large:
        release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that are done.

    It does so when the driver collects its garbage, which with a roomy driver can be long after the disks are full.
    Spark's listeners hold the last event, and with it the last step, until another one comes and is handled; if that
    takes long, the step's files go with the next call.
    """
    spark.range(0).collect()
    gc.collect()
    with contextlib.suppress(Py4JError):
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(5_000)
    spark.sparkContext._jvm.System.gc()


def shuffled(df: DataFrame) -> DataFrame:
    """Join ``df`` by a shuffle, however small it is.

    A table sent to all tasks goes through the driver first.  That is cheap
    once, but a loop would do it every round.
    """
    return df.hint("merge")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on a table that comes in fewer files than there are cores.

    A small file often is one row group, and a gzip CSV file is never split, so
    one task would do all the work.  Tables in many files stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df
