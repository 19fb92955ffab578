"""LIBSVM text: ``label idx:val ...`` with indices from 1.

The reader accepts a byte order mark, carriage returns, trailing and repeated
blanks, tabs, blank and ``#`` lines, rows without features and repeated
indices (the last counts).  Index 0, descending indices, and tokens that are
no pair or number fail the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import ranked


def read_libsvm(spark: SparkSession, path: str, dim: int = 0) -> tuple[DataFrame, int]:
    """(rows (id, label, features map<int, double>), dimension): the greater of ``dim`` and the greatest index.

    Ids run from 0 in order of file and line, however files are split.
    """
    line = F.trim(F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), r"\s+", " "))
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    lines = spark.read.text(path).select(line.alias("line"), *place).where("line <> '' and not startswith(line, '#')")
    lines = ranked(lines, [], ["file", "block", "at"], "id").select("id", "line")
    parts = F.split("line", " ")
    pairs = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(F.split(p, ":")[0].cast("int").alias("idx"), F.split(p, ":")[1].cast("double").alias("val")))
    rows = lines.select("id", parts[0].cast("double").alias("label"), pairs.alias("pairs"))
    ascending = F.aggregate("pairs", F.lit(0), lambda a, p: F.when((a < 0) | (p["idx"] < F.greatest(a, F.lit(1))), F.lit(-1)).otherwise(p["idx"]))
    checked = rows.withColumn("pairs", F.when(ascending >= 0, F.col("pairs")).otherwise(F.raise_error(F.lit("indices must be 1 or more and not descend"))))
    last = F.filter("pairs", lambda p, i: (i == F.size("pairs") - 1) | (F.try_element_at(F.col("pairs"), i + 2)["idx"] != p["idx"]))
    out = checked.select("id", "label", F.map_from_entries(last).alias("features"))
    top = out.agg(F.max(F.array_max(F.map_keys("features")))).first()[0] or 0
    return out, max(dim, top)


def densified(df: DataFrame, dim: int) -> DataFrame:
    """(id, label, x) with x an array of ``dim`` doubles."""
    return df.select("id", "label", F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.coalesce(F.try_element_at("features", i), F.lit(0.0))).alias("x"))


def classes(df: DataFrame) -> DataFrame:
    """(label, n, first): labels in order of their first row."""
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).orderBy("first")


def write_libsvm(df: DataFrame, path: str) -> None:
    """Rows (id, label, features) as text, in order of ids."""
    pairs = F.transform(F.array_sort(F.map_entries("features")), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string")))
    line = F.concat_ws(" ", F.col("label").cast("string"), F.concat_ws(" ", pairs))
    df.orderBy("id").select(F.rtrim(line).alias("value")).write.mode("overwrite").text(path)
