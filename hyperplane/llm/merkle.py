"""Merkle manifest of a table: a tree of hashes per group, a tree over the groups, and a proof for every row.

A leaf is the hash of a row's columns, each with its length.  Per group, leaves
in the order of the id are paired level by level until one node is left, the
subroot (a last node without a partner is hashed alone); subroots in the order of
their groups give the root likewise.

1. Leaves are hashed where their rows are read; no text is shuffled.
2. Leaves are ranked within groups over ranges, so a group of any size is split.
3. ``BLOCK`` consecutive leaves are a block, aligned in the tree.  Roots of
   blocks are leaves of a tree a thousandth of the size, for which steps 3 and 4
   run again until a group is one block.
4. A block is traversed by fractal traversal: for each stacked level of subtrees
   of height ``SUBTREE``, the existing one, which holds the current path, and the
   desired one to its right, which two hash steps a leaf complete just in time.
   Beside the block's leaves, a traversal holds those subtrees only.  Proofs of
   the block's root, joined by block, are appended to each path that comes out.

Hashes are SHA-256; digests are hashed as lowercase hex text.

Cases: null columns count as ``-``, which no value gives.  Null groups and ids
come first.  Rows of equal id are leaves of their own, in the order of their
hashes; equal rows have equal leaves and a proof each.  An empty table gives an
empty result.  Columns beside the hashed ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, dropped, written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves of a block (2 ** BLOCK) and height of the subtrees of a traversal.
BLOCK = 12
SUBTREE = 4

_OUT = "id long, leaf string, subroot string, root string, proof binary, sides string, proof_sha256 string, folded_root string"


def h(data: bytes) -> bytes:
    """The hash of digests one after another, which are hashed as hex text."""
    return hashlib.sha256(data.hex().encode()).digest()


def nodes_at(n: int, level: int) -> int:
    return -(-n >> level)


def height(n: int) -> int:
    """Levels above n leaves up to a single node."""
    return (n - 1).bit_length()


def subtree(leaf: Callable[[int], bytes], n: int, start: int, top: int, low: int, keep: dict[tuple[int, int], bytes]) -> Iterator[None]:
    """Builds the subtree of height ``top`` over leaves from ``start``, one node a step, with a stack of one node a level.

    Nodes from level ``low`` on are kept, by level and index.
    """
    waiting: list[bytes] = []
    for i in range(start, min(start + (1 << top), n)):
        level, index, digest = 0, i, leaf(i)
        while True:
            if level >= low:
                keep[level, index] = digest
            yield
            if level == top:
                break
            if index & 1:
                digest = h(waiting.pop() + digest)
            elif index + 1 < nodes_at(n, level):
                waiting.append(digest)
                break
            else:
                digest = h(digest)
            level, index = level + 1, index >> 1


def finished(steps: Iterator[None] | None) -> None:
    for _ in steps or ():
        pass


def tree_root(leaf: Callable[[int], bytes], n: int, levels: int) -> bytes:
    keep: dict[tuple[int, int], bytes] = {}
    finished(subtree(leaf, n, 0, levels, levels, keep))
    return keep[levels, 0]


def traversal(leaf: Callable[[int], bytes], n: int, levels: int, step: int | None = None) -> Iterator[list[bytes | None]]:
    """The authentication path of each of n leaves in turn: a sibling a level, None where a node has none."""
    step = step or SUBTREE
    tops = [min(low + step, levels) for low in range(0, levels, step)]
    existing: list[dict] = [{} for _ in tops]
    desired: list[dict] = [{} for _ in tops]
    growing: list[Iterator[None] | None] = [None] * len(tops)

    def begin(k: int, start: int) -> None:
        desired[k] = {}
        growing[k] = subtree(leaf, n, start, tops[k], k * step, desired[k]) if start < n else None

    for k, top in enumerate(tops):
        finished(subtree(leaf, n, 0, top, k * step, existing[k]))
        begin(k, 1 << top)
    for i in range(n):
        for k, top in enumerate(tops):
            if i and i & ((1 << top) - 1) == 0:
                finished(growing[k])  # a few steps at most, where the table ends
                existing[k] = desired[k]
                begin(k, i + (1 << top))
        yield [existing[level // step].get((level, (i >> level) ^ 1)) for level in range(levels)]
        for k, steps in enumerate(growing):
            if steps is not None and next(steps, steps) is not None and next(steps, steps) is not None:
                growing[k] = None


def packed(path: list[bytes | None], at: int) -> tuple[bytes, str]:
    """Siblings one after another, and for each level whether it stands left (L) or right (R) or is missing (-)."""
    return b"".join(x for x in path if x is not None), "".join("-" if x is None else "RL"[at >> level & 1] for level, x in enumerate(path))


def folded(digest: bytes, siblings: bytes, sides: str) -> bytes:
    """The root that a leaf gives with the siblings of its proof."""
    at = 0
    for side in sides:
        if side == "-":
            digest = h(digest)
        else:
            sibling = siblings[at : at + 32]
            digest = h(sibling + digest if side == "L" else digest + sibling)
            at += 32
    return digest


def _block_of(table: pa.Table, block: int) -> tuple[Callable[[int], bytes], int, int]:
    """Leaves of a block in order, their number, and the levels of its tree."""
    leaves = table.column("digest").combine_chunks()
    total = table.column("n")[0].as_py()
    return (lambda i: leaves[i].as_py()), len(leaves), block if total > 1 << block else height(total)


def _block_root(block: int, table: pa.Table) -> pa.Table:
    table = table.sort_by("at")
    leaf, n, levels = _block_of(table, block)
    one = table.slice(0, 1)
    return pa.table({
        "g": one.column("g"), "at": pa.array([one.column("at")[0].as_py() >> block], pa.int64()), "n": pa.array([nodes_at(one.column("n")[0].as_py(), block)], pa.int64()),
        "digest": pa.array([tree_root(leaf, n, levels)], pa.binary()),
    })


def _block_paths(block: int, table: pa.Table) -> pa.Table:
    """Paths of a block's nodes, with the proof of the block's root appended."""
    table = table.sort_by("at")
    leaf, n, levels = _block_of(table, block)
    upper, upper_sides = table.column("up_proof")[0].as_py(), table.column("up_sides")[0].as_py()
    out = [packed(path, i) for i, path in enumerate(traversal(leaf, n, levels))]
    return pa.table({
        "g": table.column("g"), "at": table.column("at"), "proof": pa.array([p + upper for p, _ in out], pa.binary()), "sides": pa.array([s + upper_sides for _, s in out], pa.string()), "root": table.column("up_root"),
    })


def _row_proofs(block: int, table: pa.Table) -> pa.Table:
    """What the manifest tells of each row of a block."""
    table = table.sort_by("at")
    leaf, n, levels = _block_of(table, block)
    upper, upper_sides = table.column("up_proof")[0].as_py(), table.column("up_sides")[0].as_py()
    presented = table.column("presented").combine_chunks()
    proofs, sides, hashed, roots = [], [], [], []
    for i, path in enumerate(traversal(leaf, n, levels)):
        proof, side = packed(path, i)
        proof, side = proof + upper, side + upper_sides
        proofs.append(proof)
        sides.append(side)
        hashed.append(h(proof).hex())
        roots.append(folded(presented[i].as_py(), proof, side).hex())
    same = lambda name: pa.array([table.column(name)[0].as_py().hex()] * n, pa.string())
    return pa.table({
        "id": table.column("id"), "leaf": pa.array([leaf(i).hex() for i in range(n)], pa.string()), "subroot": same("subroot"), "root": same("up_root"),
        "proof": pa.array(proofs, pa.binary()), "sides": pa.array(sides, pa.string()), "proof_sha256": pa.array(hashed, pa.string()), "folded_root": pa.array(roots, pa.string()),
    })


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """df (g, ...) with ``at``, the place of a row in its group in the given order, and ``n``, the group's size.

    df and the result are written tables.  Rows are sorted into ranges of group and order, and counted by group and range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["g", *order]
    ranges = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())
    ranges = written(ranges.withColumn("seat", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "merkle-ranges")
    counts = ranges.groupBy("part", "g").agg(F.count(F.lit(1)).alias("rows"), F.min("seat").alias("first"))
    # Of each group: a row for each range that it reaches into.
    group = Window.partitionBy("g")
    before = F.coalesce(F.sum("rows").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = written(counts.select("part", "g", (before - F.col("first")).alias("shift"), F.sum("rows").over(group).alias("n")), "merkle-offsets")
    few = offsets.count() <= BROADCAST_ROWS
    out = ranges.join(F.broadcast(offsets) if few else offsets, ["part", "g"]).withColumn("at", F.col("seat") + F.col("shift")).drop("part", "seat", "shift")
    out = written(out, "merkle-ranked")
    dropped(ranges, offsets)
    return out


def block_roots(nodes: DataFrame, block: int) -> DataFrame:
    """(g, at, n, digest) of the blocks of nodes (g, at, n, digest), a written table."""
    blocks = nodes.select("g", "at", "n", "digest").groupBy("g", F.shiftright("at", block)).applyInArrow(lambda x: _block_root(block, x), "g string, at long, n long, digest binary")
    return written(blocks, "merkle-blocks")


def paths(nodes: DataFrame, block: int) -> DataFrame:
    """(g, at, proof, sides, root) of nodes (g, at, n, digest) up to the root of their group, a written table."""
    roots = block_roots(nodes, block)
    above = _above(roots, block)
    out = written(_by_block(nodes.select("g", "at", "n", "digest"), above, block).applyInArrow(lambda x: _block_paths(block, x), "g string, at long, proof binary, sides string, root binary"), "merkle-paths")
    dropped(roots, above)
    return out


def _above(roots: DataFrame, block: int) -> DataFrame:
    """(g, at, proof, sides, root) of the roots of blocks, a written table."""
    if roots.where("n > 1").isEmpty():
        return written(roots.select("g", "at", F.lit(b"").alias("proof"), F.lit("").alias("sides"), F.col("digest").alias("root")), "merkle-paths")
    return paths(roots, block)


def _by_block(nodes: DataFrame, above: DataFrame, block: int):
    """Nodes beside the path of their block's root, grouped by block."""
    up = above.select("g", F.col("at").alias("block"), F.col("proof").alias("up_proof"), F.col("sides").alias("up_sides"), F.col("root").alias("up_root"), *(c for c in above.columns if c == "subroot"))
    return nodes.withColumn("block", F.shiftright("at", block)).join(up, ["g", "block"]).groupBy("g", "block")


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", order: str = "doc_id", presented: dict[str, Column] | None = None, where: Column | None = None, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot, root, the proof and whether the row as presented is verified by it.

    ``presented`` gives values of columns that stand in for the stored ones when
    the proof is folded, in rows for which ``where`` is true; without it, rows
    are verified as they are.  ``proof`` holds the siblings, 32 bytes each, and
    ``sides`` their places by level (``folded`` takes both).
    """
    stored = {c: F.col(c) for c in columns}
    leaf = leaf_hash(list(stored.values()))
    shown = F.when(F.lit(True) if where is None else where, leaf_hash([*(stored | presented).values()])).otherwise(leaf) if presented else leaf
    rows = docs.select(
        F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), F.col(group).cast("string"))).alias("g"),
        F.col(order).cast("long").alias("id"),
        F.unhex(leaf).alias("digest"),
        F.unhex(shown).alias("presented"),
        # Equal rows may be many: this deals them over ranges.
        F.monotonically_increasing_id().alias("tie"),
    )
    rows = written(rows, "merkle-leaves")
    nodes = ranked(rows, ["id", "digest", "tie"])
    dropped(rows)
    roots = block_roots(nodes, block)
    above = _above(roots, block)
    # The tree over the groups: its leaves are their roots.
    subroots = written(above.where("at = 0").select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("digest")), "merkle-subroots")
    tops = ranked(subroots, ["name"])
    found = paths(tops, block)
    top = tops.join(found.drop("g"), "at").select(F.col("name").alias("g"), F.col("proof").alias("top_proof"), F.col("sides").alias("top_sides"), F.col("root").alias("top_root"))
    top = written(top, "merkle-tops")
    few = top.count() <= BROADCAST_ROWS
    joined = above.join(F.broadcast(top) if few else top, "g")
    whole = written(joined.select("g", "at", F.concat("proof", "top_proof").alias("proof"), F.concat("sides", "top_sides").alias("sides"), F.col("root").alias("subroot"), F.col("top_root").alias("root")), "merkle-above")
    dropped(roots, above, subroots, tops, found, top)
    out = _by_block(nodes.select("g", "at", "n", "id", "digest", "presented"), whole, block).applyInArrow(lambda x: _row_proofs(block, x), _OUT)
    return out.withColumnRenamed("id", order).withColumn("verified", F.col("folded_root") == F.col("root"))
