"""Exact nearest rows of sparse vectors by an inverted index with bounds.

The index lists, by feature, the rows that have it.  A row's features are ordered
by what they can add to any product: its value times the feature's largest one.

1. Rows that share one of a row's first features get a partial product, which no
   full one is below; the n-th greatest of them is the row's threshold.
2. A row that shares none of the first m features can't reach more than what the
   others can add, so only features up to where that falls below the threshold are
   looked up.  Common features of low weight come last and are mostly left alone.
3. Of the rows found, those whose partial product and what the rest can add stay
   below the threshold go; the others' products are completed.

Every step is a join or a grouping by feature, row or pair.  Lists of a feature
are cut at ``LIST_ROWS`` on average by the rows that they name, and travel to the
rows that look them up as they are: pairs are formed where they are summed.

Where lists are short (``SHORT_LIST``), all features are looked up at once, as bounds and
completing would cost more than the pairs that they leave out.

Rows look for theirs in turns, each of as many pairs as ``TURN_SHARE`` times the
entries of the index, and let go of their shuffles after it: what is on disk at a
time grows with the index, not with the pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import entries
from ..sources.tables import dropped, released, stored
from .gram import topn

#: First features of a row that give its threshold.
SEEDS = 2
#: Share by which thresholds are lowered, as sums in another order may differ in rounding.
SLACK = 1e-9
#: Rows of a piece of a feature's list on average, and pairs that a task sums.
LIST_ROWS, TASK_PAIRS = 1 << 14, 1 << 20
#: Rows that an entry meets on average, up to which bounds don't pay.
SHORT_LIST = 200
#: Pairs of a turn: a multiple of the index's entries, and at least so many.
TURN_SHARE, TURN_PAIRS = 4, 20_000_000


def _bounded(df: DataFrame) -> DataFrame:
    """(id, idx, val, place, ahead): a row's features from the one that can add most; ahead: what it and those behind it can add."""
    long = entries(df).select("id", F.inline("x")).where("val <> 0")
    checked = F.when(F.col("val") > 0, F.col("val")).otherwise(F.raise_error(F.lit("values below 0 have no bounds here; most_similar takes them")))
    long = long.withColumn("val", checked)
    most = long.groupBy("idx").agg(F.max("val").alias("most"))
    w = Window.partitionBy("id").orderBy(F.desc("adds"), "idx")
    # A window's group is one row's features.
    place, ahead = F.row_number().over(w), F.sum("adds").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return long.join(most, "idx").withColumn("adds", F.col("val") * F.col("most")).select("id", "idx", "val", place.alias("place"), ahead.alias("ahead"))


@dataclass
class _Lists:
    """(idx, chunk, others, theirs): the rows that have a feature, and their values; ``pairs`` is how many all rows meet in them."""

    table: DataFrame
    chunks: int
    pairs: int
    entries: int

    @classmethod
    def of(cls, index: DataFrame) -> _Lists:
        each = index.groupBy("idx").agg(F.count(F.lit(1)).alias("c"))
        facts = each.agg(F.max("c").alias("most"), F.sum(F.col("c") * F.col("c")).alias("pairs"), F.sum("c").alias("entries")).first()
        chunks = -(-(facts.most or 1) // LIST_ROWS)
        # A row is in the chunk of the same number in all lists, so that pairs of one row and chunk meet.
        chunk = F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk")
        held = index.groupBy("idx", chunk).agg(F.collect_list(F.struct("id", "val")).alias("held"))
        return cls(held.select("idx", "chunk", F.col("held")["id"].alias("others"), F.col("held")["val"].alias("theirs")), chunks, int(facts.pairs or 0), int(facts.entries or 0))

    @property
    def turns(self) -> int:
        return max(1, -(-self.pairs // max(TURN_PAIRS, TURN_SHARE * self.entries)))


def _partial(some: DataFrame, lists: _Lists) -> DataFrame:
    """(id, other, part): products over the given features of rows with all others that have them."""
    tasks = max(1, -(-lists.pairs // (lists.turns * TASK_PAIRS)))
    met = some.select("id", "idx", "val").join(lists.table, "idx").select("id", "chunk", "val", "others", "theirs")
    met = met.repartition(tasks, *(["id"] if lists.chunks == 1 else ["id", "chunk"]))
    pairs = met.select("id", "chunk", "val", F.inline(F.arrays_zip(F.col("others").alias("other"), F.col("theirs").alias("theirs")))).where("id <> other")
    return pairs.groupBy("id", "chunk", "other").agg(F.sum(F.col("val") * F.col("theirs")).alias("part")).drop("chunk")


def topn_sparse(df: DataFrame, n: int) -> DataFrame:
    """(id, other, k, rank): for each row of df (id, x), the n others of greatest product, of those that share a feature with it.

    x: arrays of (idx, val) or maps, values of 0 or more; ids differ.  Ties go to
    the smaller id.  The result is a table.
    """
    index = stored(_bounded(df), "similar-index")
    lists = _Lists.of(index)
    lists.table = stored(lists.table, "similar-lists")
    found = []
    for turn in range(lists.turns):
        found.append(_turn(index, lists, turn, n))
        if lists.turns > 1:
            released(df.sparkSession)
    dropped(index, lists.table)
    return reduce(DataFrame.unionByName, found)


def _turn(index: DataFrame, lists: _Lists, turn: int, n: int) -> DataFrame:
    """The result of the rows of a turn."""
    mine = index.where(F.pmod(F.hash("id"), F.lit(lists.turns)) == turn)
    if lists.pairs <= SHORT_LIST * lists.entries:
        return stored(topn(_partial(mine, lists).withColumnRenamed("part", "k"), "id", n), "similar")
    chosen = stored(_candidates(mine, n, lists), "similar-candidates")
    # What the features that were not looked up add.
    others = mine.join(chosen.groupBy("id").agg(F.first("upto").alias("upto")), "id").where("place > upto").select("id", "idx", "val")
    theirs = index.select(F.col("id").alias("other"), "idx", F.col("val").alias("theirs"))
    more = chosen.where("rest > 0").select("id", "other").join(others, "id").join(theirs, ["other", "idx"]).groupBy("id", "other").agg(F.sum(F.col("val") * F.col("theirs")).alias("more"))
    whole = chosen.join(more, ["id", "other"], "left").select("id", "other", (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("k"))
    out = stored(topn(whole, "id", n), "similar")
    dropped(chosen)
    return out


def _candidates(index: DataFrame, n: int, lists: _Lists | None = None) -> DataFrame:
    """(id, other, part, rest, upto): pairs of the index's rows that the bounds leave, with the product over the features up to ``upto``."""
    lists = lists or _Lists.of(index)
    seeds = _partial(index.where(F.col("place") <= SEEDS), lists)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("part"), "other"))
    least = seeds.withColumn("place", place).where(F.col("place") <= n).groupBy("id").agg(F.min("part").alias("least"), F.count(F.lit(1)).alias("found"))
    least = least.where(F.col("found") == n).select("id", (F.col("least") * (1 - SLACK)).alias("least"))
    known = index.join(least, "id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    looked = known.where("ahead >= least")
    # What is ahead of the first feature that is not looked up; 0 where all are.
    rest = known.groupBy("id").agg(F.max(F.when(F.col("ahead") < F.col("least"), F.col("ahead"))).alias("rest"), F.max(F.when(F.col("ahead") >= F.col("least"), F.col("place"))).alias("upto"), F.first("least").alias("least"))
    found = _partial(looked, lists).join(rest, "id").withColumn("rest", F.coalesce("rest", F.lit(0.0)))
    return found.where(F.col("part") + F.col("rest") >= F.col("least")).select("id", "other", "part", "rest", "upto")
