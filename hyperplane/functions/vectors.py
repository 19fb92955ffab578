"""Vector functions as Column expressions; a vector is an ``array<double>``, its long form rows (id, idx, val) with idx from 1."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def doubles(x: Column) -> Column:
    """The array with every element as a double."""
    return F.transform(x, lambda v: v.cast("double"))


def is_sparse(df: DataFrame, x_col: str = "x") -> bool:
    """Whether a column holds sparse vectors: arrays of (idx, val), or maps from index to value."""
    kind = df.schema[x_col].dataType.simpleString()
    return kind.startswith(("map<", "array<struct<"))


def width(df: DataFrame, x_col: str = "x") -> Column:
    """Values that a vector holds: of a matrix those of all its rows."""
    nested = df.schema[x_col].dataType.simpleString().startswith("array<array<")
    return F.size(F.flatten(x_col) if nested else F.col(x_col))


def entries(df: DataFrame, x_col: str = "x") -> DataFrame:
    """df with maps from index to value as arrays of (idx, val); other vectors stay."""
    if not df.schema[x_col].dataType.simpleString().startswith("map<"):
        return df
    pairs = F.transform(F.map_entries(x_col), lambda e: F.struct(e["key"].cast("int").alias("idx"), e["value"].cast("double").alias("val")))
    return df.withColumn(x_col, pairs)


def values(x: Column) -> Column:
    """The values of a sparse vector."""
    return F.transform(x, lambda e: e["val"])


def common(x: Column, z: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Sum of f(u, v), the same both ways, over the indices that two arrays of (idx, val) share; indices of a side differ.

    Both are merged in order of index, where entries that share one stand side by side.
    """
    none = F.struct(F.lit(None).cast("long").alias("idx"), F.lit(0.0).alias("val"), F.lit(0.0).alias("total"))
    tagged = lambda side, n: F.transform(side, lambda e: F.struct(e["idx"].cast("long").alias("idx"), F.lit(n).alias("side"), e["val"].cast("double").alias("val")))
    merged = F.array_sort(F.concat(tagged(x, 0), tagged(z, 1)))
    both = lambda a, e: a["total"] + F.when(e["idx"] == a["idx"], f(a["val"], e["val"])).otherwise(F.lit(0.0))
    return F.aggregate(merged, none, lambda a, e: F.struct(e["idx"].alias("idx"), e["val"].alias("val"), both(a, e).alias("total")), lambda a: a["total"])


def weighed(x: Column, w: Column) -> Column:
    """Product of an array of (idx, val) with an array of weights by index; indices beyond it are dropped."""
    return F.aggregate(x, F.lit(0.0), lambda a, e: a + e["val"] * F.coalesce(F.get(w, (e["idx"] - 1).cast("int")), F.lit(0.0)))


def dot(x: Column, z: Column) -> Column:
    return _sum(F.zip_with(x, z, lambda u, v: u * v))


def self_dot(x: Column) -> Column:
    return _sum(F.transform(x, lambda v: v * v))


def value_sum(x: Column) -> Column:
    return _sum(x)


def nnz(x: Column) -> Column:
    return F.size(F.filter(x, lambda v: v != 0))


def lp_norm(x: Column, p: float) -> Column:
    if p == 1:
        return _sum(F.transform(x, F.abs))
    if p == 2:
        return F.sqrt(self_dot(x))
    return F.pow(_sum(F.transform(x, lambda v: F.pow(F.abs(v), F.lit(float(p))))), F.lit(1.0 / p))


def normalized(x: Column, p: float = 2) -> Column:
    """x over its Lp norm; a zero vector stays as it is."""
    # Vector and norm are variables of lambdas: expressions inside a lambda are evaluated anew for each of its elements.
    by = lambda v: F.transform(F.array(lp_norm(v, p)), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda e: e / n)))[0]
    return F.transform(F.array(x), by)[0]


def histogram(x: Column) -> Column:
    """Absolute values with sum one: what chi-square kernels take."""
    return normalized(F.transform(x, F.abs), 1)


def subtract(x: Column, z: Column) -> Column:
    return F.zip_with(x, z, lambda u, v: u - v)


def preview(x: Column, n: int = 5) -> Column:
    """Dimension and the first n entries other than zero, as ``dim:idx/val ...`` with values to 4 places."""
    pairs = F.filter(F.transform(x, lambda v, i: F.struct((i + 1).alias("idx"), v.alias("val"))), lambda e: e["val"] != 0)
    shown = F.transform(F.slice(pairs, 1, n), lambda e: F.concat(e["idx"].cast("string"), F.lit("/"), F.format_string("%.4f", e["val"])))
    return F.concat(F.size(x).cast("string"), F.lit(":"), F.concat_ws(" ", shown))


def to_long(df: DataFrame, id_col: str = "id", x_col: str = "x") -> DataFrame:
    """(id, idx from 1, val) of entries other than zero."""
    return df.select(id_col, F.posexplode(x_col).alias("pos", "val")).where("val <> 0").select(id_col, (F.col("pos") + 1).alias("idx"), "val")


def densified(long: DataFrame, dim: int, id_col: str = "id") -> DataFrame:
    """(id, x) from the long form; missing indices are zero."""
    entries = long.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("idx", "val"))).alias("m"))
    return entries.select(id_col, F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("x"))


def long_dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, value): products of rows with equal ids of two long forms (id, idx, val), over the indices both have."""
    return a.join(b.select("id", "idx", F.col("val").alias("other")), ["id", "idx"]).groupBy("id").agg(F.sum(F.col("val") * F.col("other")).alias("value"))


def _long_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, idx, u, v) over the indices of either side, of ids that both sides have."""
    both = a.select("id", "idx", F.col("val").alias("u")).join(b.select("id", "idx", F.col("val").alias("v")), ["id", "idx"], "full_outer").na.fill(0.0, ["u", "v"])
    common = a.select("id").distinct().join(b.select("id").distinct(), "id", "left_semi")
    return both.join(common, "id", "left_semi")


def long_subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, idx, val): differences of rows with equal ids, without zeros."""
    return _long_both(a, b).select("id", "idx", (F.col("u") - F.col("v")).alias("val")).where("val <> 0")


def long_chi2(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, value): chi-square distances of rows with equal ids; a place whose sum is 0 adds nothing."""
    term = F.when(F.col("u") + F.col("v") == 0, 0.0).otherwise(F.pow(F.col("u") - F.col("v"), F.lit(2.0)) / (F.col("u") + F.col("v")))
    return _long_both(a, b).groupBy("id").agg(F.sum(term).alias("value"))


def sparse(long: DataFrame) -> DataFrame:
    """(id, x) from the long form, x an array of (idx, val) in order of index."""
    entry = F.struct(F.col("idx").cast("int").alias("idx"), F.col("val").cast("double").alias("val"))
    return long.groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("x"))
