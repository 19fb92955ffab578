"""Connected components of a table of links, by contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``links`` (a, b) reaches.

    Each round, every node points at its smallest neighbour or itself; pointers
    are followed to their ends by doubling; links between different ends are the
    next round's.  Hubs are aggregated with partial minima and joined, so no
    node's neighbours are gathered.  Every step is a table in the shared folder, dropped once the
    next is written.
    """
    links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    whole: DataFrame | None = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to")), "pointers")
        while True:
            onward = to.select(F.col("node").alias("to"), F.col("to").alias("next"))
            before = to
            to = written(to.join(onward, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "pointers")
            dropped(before)
            if to.where("moved").isEmpty():
                break
        to = to.drop("moved")
        ends = links.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        before = links
        links = written(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        dropped(before)
        roots = to.select("node", F.col("to").alias("root"))
        if whole is None:
            whole = roots
        else:
            ahead = roots.select(F.col("node").alias("root"), F.col("root").alias("last"))
            before = whole
            whole = written(whole.join(ahead, "root", "left").select("node", F.coalesce("last", "root").alias("root")), "roots")
            dropped(before, to)
    if whole is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return whole
