"""Session helpers.

The engine never sets cluster-wide knobs on a session it did not create:
``get_spark`` is for tests, benches and scripts. ``checkpoint_dir`` reads
``spark.checkpoint.dir`` from the running session; a local master (tests) may
leave it unset and gets a folder of its own, anything else must name a folder
that driver and executors share.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8,
              app: str = "comparo", extra: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # no Python call-site capture per Column call (plan building cost)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master.startswith("local"):      # tables of tests leave nothing in the working folder
        builder = builder.config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="comparo-warehouse-"))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, configuring the context from
    ``spark.checkpoint.dir``; a private folder only on a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="comparo-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


@contextmanager
def _held(spark: SparkSession, key: str, value: str):
    """Within it the session has `key` set to `value`."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def freed_shuffles(spark: SparkSession):
    """Within it, the shuffle files of an action go when it ends: what it wrote is all that is read again."""
    return _held(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession, most: int):
    """Within it, an action's Arrow batches hold about `most` bytes: a task holds some of them, in its JVM and its Python."""
    return _held(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def materialize(df: DataFrame, how: str = "table", name: str = "table", partition_by=()) -> DataFrame:
    """Cut lineage of a DataFrame that several reports reuse.

    ``table`` writes Parquet to the shared folder and reads it back: a lost executor loses
    nothing, no executor memory is held, and the planner knows its size. :func:`discard` deletes
    it; ``partition_by`` gives it a folder per value. ``checkpoint`` writes rows to the checkpoint folder; ``cache`` keeps them in executor
    memory until the caller unpersists the result; ``none`` returns the plan as it is.
    """
    if how == "table":
        path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        with freed_shuffles(df.sparkSession):
            (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    if how == "checkpoint":
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    if how == "cache":
        return df.persist()
    if how == "none":
        return df
    raise ValueError(f"unknown materialization {how!r}")


def discard(df: DataFrame) -> None:
    """Delete the files of a DataFrame that ``materialize(how='table')`` returned."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
