"""Intermediate tables in the shared folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where the setting is absent, as in local tests, one of our own, kept for the session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="hyperplane-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: written once, read by all that follows, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by_kind(df: DataFrame, name: str, kinds: tuple[int, ...]) -> list[DataFrame]:
    """df as one table per value of its column ``kind``, from one pass; each can be dropped by itself."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    rest = StructType([f for f in df.schema if f.name != "kind"])
    fs, jvm_path = _file_system(spark, path)
    out = []
    for k in kinds:
        # A kind without rows has no folder.
        some = fs.exists(jvm_path(f"{path}/kind={k}"))
        table = spark.read.schema(rest).parquet(f"{path}/kind={k}") if some else spark.createDataFrame([], rest)
        out.append(table.selectExpr(f"int({k}) kind", "*"))
    return out


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``written`` returned and nothing reads any more."""
    for df in tables:
        for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
            fs, at = _file_system(df.sparkSession, folder)
            fs.delete(at(folder), True)


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


#: Rows of an id column that may be broadcast: 8 bytes each.
BROADCAST_ROWS = 500_000


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of docs whose id is not in ``ids`` (doc_id); the ids are broadcast if counted few, joined by a shuffle otherwise."""
    from pyspark.sql import functions as F

    ids = written(ids.select(F.col("doc_id").alias(id_col)).distinct(), "ids")
    few = ids.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if few else ids, id_col, "left_anti").select(docs.columns)
