"""Where intermediate tables go, and how they are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset a temporary one serves a session on one machine
    (tests); on a cluster that is an error, as executors would not share it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("runloom.shared.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="runloom-")
        spark.conf.set("runloom.shared.dir", path)
    return path.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/runloom-{spark.sparkContext.applicationId}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, tidy: bool = False, plain: bool = False) -> DataFrame:
    """``df`` written as a table into the shared folder and read back: later steps neither recompute it nor lose it with an executor.
    It stays until ``clear``, since results that read it are evaluated later. tidy: the shuffle files of the write, which nothing else
    reads, are removed when it has ended, not when the driver happens to collect its garbage. plain: without dictionaries, which cost time
    and save nothing where most values of a column differ, as hashes do."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    try:
        conf.set(CLEANUP, "true" if tidy else before)
        df.write.options(**({"parquet.enable.dictionary": "false"} if plain else {})).parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes all tables this application has stored. To be called when its results have been written or read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores: for costly steps on a table that came as one small file.
    A table of many files is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df
