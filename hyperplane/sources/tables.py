"""Intermediate tables in the shared folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names; where the setting is absent on a local master, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="hyperplane-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder: computed once, with rows in the files that tasks wrote, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_apart(df: DataFrame, flag: str, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows of df without and with a boolean flag as two tables, from one pass; each can be dropped by itself."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(flag).parquet(path)
    rest = StructType([f for f in df.schema if f.name != flag])
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folders = [f"{path}/{flag}={value}" for value in ("false", "true")]
    # A side without rows has no folder.
    there = [at(f).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at(f)) for f in folders]
    without, having = (spark.read.schema(rest).parquet(f) if some else spark.createDataFrame([], rest) for f, some in zip(folders, there, strict=True))
    return without, having


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
            at(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at(folder), True)


def released(spark: SparkSession) -> None:
    """Lets go of the files of shuffles that nothing refers to any more, which Spark does only as the driver collects its garbage."""
    # The last query is held by the thread that told listeners of it, until there is another one.
    spark.range(1).collect()
    gc.collect()
    # What Python has let go of is passed on by a thread that looks for it once a second.
    waiting = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    until = time.monotonic() + 3
    while waiting and time.monotonic() < until:
        time.sleep(0.05)
    time.sleep(0.05)
    spark.sparkContext._jvm.System.gc()
