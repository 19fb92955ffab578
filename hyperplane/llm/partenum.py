"""N-gram Jaccard join by PartEnum signatures.

Documents are sets of five-word shingle hashes; two link when their Jaccard
similarity reaches the threshold, exactly.  Sets similar enough differ in at
most ``k`` elements, where k follows from their sizes.  The feature domain is
cut into ``n1`` first-level partitions, each into ``n2`` second-level ones; a
set's signatures are the hashes of its elements in every subset of ``n2 - k2``
second-level partitions of a first-level one.  Of two sets that differ in k
elements, at most ``k // (k2 + 1)`` first-level partitions hold more than k2
differences; in any other one, a subset without differences is equal in both.
``LEVELS`` are bands of k with one partitioning each; a set takes part in the
bands of every size that may be its larger partner.

A set signs first-level partitions in their order until ``k // (k2 + 1) + 1`` of
them are usable, k being the most for any partner in that band; one is usable if
no subset of it is empty.  The shorter of two prefixes holds a usable partition
with an equal subset, and the other set signs it too, so no pair is lost and
none signs more than its own size asks for.  A set with too few usable
partitions also signs under a second partitioning, and so on; the last one signs
empty subsets too.

Plan: one pass over the texts emits packed signatures, dealt by hash to shuffle
buckets, with equal sets of a worker merged before the shuffle.  Buckets find
groups that share a signature; groups with the same members are one group.
Candidates come in three turns, and after each the verified links are joined,
so that groups within one component fall out:

  stars   each member with the smallest of its group
  covers  of each component in a group, one pair with another
  rest    all pairs between different components

Pairs of the last two are formed inside a group's task and leave it only if odd
sketches (a lower bound of the difference) allow them.  A group above ``LARGE``
that is still open is cut by signatures of another partitioning, which every
similar pair in it shares again; what stays above ``BLOCK`` is dealt in pairs of
blocks.  Every candidate is verified on its sets.  Copies (equal sets) are one
node throughout, so thousands of copies cost one.

Shingles and sets are known by 64-bit hashes.  Signatures travel as 32 bits and
their bucket, with 48 bits of the set's hash: both can only add candidates.

Cases: a null or empty text, or one without words, has no shingles, links with
nothing and is its own component.  Fewer than five words make one shingle.  Rows
with equal ids are separate rows of one id; the component of rows is the
smallest id reachable.  A row with a null id links like any other and gets the
smallest id of its component, null if there is none.  Only the named columns
are read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import BROADCAST_ROWS, dropped, released, written, written_by_kind
from .textbatch import Words, flat, lean, mix, pieces, shingle_sets

SHINGLE = 5
PERCENT = 80
#: Members of a group that are compared in one task; of a larger one, pairs of blocks are dealt.
BLOCK = 4096
#: Members from which on an open group is first cut by another partitioning.
LARGE = 16384
#: Bits of odd sketches: twice a power of two not below the size of the set, within these.
SKETCH_BITS = (128, 1 << 16)
#: Signatures gathered by a worker before it deals them out.
GATHER = 500_000
#: Sets of one signature among those from which on it is common: its members don't go to its bucket.
COMMON = 512
#: Signatures that a bucket takes in before it looks for common ones among them, and distinct sets that make one common there.
SETTLE = 2_000_000
GROWN = 8192
#: Partitionings that a set tries before it signs empty subsets.
SEEDS = 4
_NODE = np.uint64((1 << 48) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _levels() -> list[tuple[int, int, int, int]]:
    """(largest k, n1, n2, k2) of each band: subsets of two of four; for k = 1, of two of three."""
    out = [(1, 1, 3, 1)]
    need = 1
    while out[-1][0] < 1 << 40:
        out.append((3 * need - 1, need + (need > 1) + need // 8, 4, 2))
        need = max(need + 1, int(need * 1.4))
    return out


LEVELS = _levels()
_MOST = np.array([x[0] for x in LEVELS])


def difference(a: np.ndarray | int, b: np.ndarray | int, percent: int = PERCENT):
    """Most elements in which sets of sizes a and b of that similarity differ."""
    return ((100 - percent) * (a + b)) // (100 + percent)


def fingerprints(grams: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    total = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(mix(grams), out=total[1:])
    return mix(total[offs[1:]] - total[offs[:-1]] + np.diff(offs).astype(np.uint64) * _ODD)


def _sums(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2**64 by bin; halves are summed apart, which is exact below 2**21 values a bin."""
    low = np.bincount(at, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
    high = np.bincount(at, (values >> np.uint64(32)).astype(np.float64), n).astype(np.uint64)
    return low + (high << np.uint64(32))


def signatures(grams: np.ndarray, offs: np.ndarray, percent: int = PERCENT, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set number) of every set, some sets under several partitionings; each ``turn`` has partitionings of its own."""
    size = np.diff(offs)
    partner = (100 * size) // percent
    k_high = difference(size, partner, percent)
    first = np.searchsorted(_MOST, np.maximum(difference(size, size, percent), 1))
    last = np.searchsorted(_MOST, np.maximum(difference(partner, partner, percent), 1))
    out_sig, out_set = [], []
    for level in range(int(first.min()) if len(first) else 0, int(last.max()) + 1 if len(last) else 0):
        most, n1, n2, k2 = LEVELS[level]
        largest = ((most + 1) * (100 + percent) - 1) // (2 * (100 - percent))
        todo = np.flatnonzero((first <= level) & (level <= last) & (k_high > 0))
        for seed in range(SEEDS):
            if not len(todo):
                break
            n = size[todo]
            need = difference(n, np.minimum(partner[todo], largest), percent) // (k2 + 1) + 1
            ends = np.cumsum(n)
            g = grams[np.repeat(offs[todo] - (ends - n), n) + np.arange(ends[-1])]
            salt = mix(np.array([(turn * 64 + level) * 64 + seed + 1], np.uint64))[0]
            cells = n1 * n2
            cell = ((mix(g ^ salt) >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
            cell = np.repeat(np.arange(len(todo)) * cells, n) + cell.astype(np.int64)
            sums = _sums(mix(g + salt), cell, len(todo) * cells).reshape(-1, n1, n2)
            some = (np.bincount(cell, minlength=len(todo) * cells) > 0).reshape(-1, n1, n2)
            usable = (~some).sum(2) < n2 - k2
            so_far = np.cumsum(usable, 1)
            poor = so_far[:, -1] < need
            # The last partitioning of a poor set signs all it has, empty subsets too.
            every = poor & (seed == SEEDS - 1)
            row, part = np.nonzero((so_far - usable < need[:, None]) | every[:, None])
            sums, some, every = sums[row, part], some[row, part], every[row]
            for c, subset in enumerate(combinations(range(n2), n2 - k2)):
                use = some[:, subset].any(1) | every
                label = (part[use].astype(np.uint64) * np.uint64(64) + np.uint64(c)) * _ODD
                out_sig.append(mix(sums[use][:, subset].sum(1, dtype=np.uint64) ^ mix(label ^ salt)))
                out_set.append(todo[row[use]])
            todo = todo[poor]
    if not out_sig:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_sig), np.concatenate(out_set)


def sketches(grams: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """Odd sketches: those of two sets, folded to equal length, differ in at most as many bits as the sets in elements."""
    h = mix(grams * np.uint64(0xC2B2AE3D27D4EB4F))
    out = []
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        bits = min(max(SKETCH_BITS[0], 2 << (b - a - 1).bit_length()), SKETCH_BITS[1])
        odd = np.bincount((h[a:b] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8)).tobytes())
    return out


def _folded(rows: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to the length of the shortest."""
    words = min(map(len, rows)) // 8
    out = np.empty((len(rows), words), np.uint64)
    length = np.array([len(x) // 8 for x in rows])
    for n in np.unique(length).tolist():
        at = np.flatnonzero(length == n)
        # Folds of a few rows at a time, for long sketches.
        for some in np.array_split(at, max(1, len(at) * n >> 20)):
            whole = np.frombuffer(b"".join(rows[i] for i in some), np.uint64).reshape(len(some), n // words, words)
            out[some] = np.bitwise_xor.reduce(whole, 1)
    return out


def _packed(low: np.ndarray, node: np.ndarray) -> bytes:
    """Ascending 32-bit signatures as steps, byte plane by byte plane, then 48 bits of each node."""
    steps = np.diff(low, prepend=np.uint32(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes() + np.ascontiguousarray(node.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(data) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    n = len(raw) // 10
    steps = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view(np.uint32).ravel()
    node = np.zeros((n, 8), np.uint8)
    node[:, :6] = raw[4 * n :].reshape(n, 6)
    return np.cumsum(steps, dtype=np.uint32), node.view(np.uint64).ravel()


def _signed(buckets: int, n: int, percent: int, least_common: int):
    """Rows (key, whether the id is null, text) to packed rows of documents (kind 1), signatures of a bucket (0), members of a common signature (4), and its name (5)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        gathered, known = 0, set()

        def blobs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b[k] for b in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "data"])

        def deal() -> pa.RecordBatch:
            table = np.concatenate(held)
            held.clear()
            sig = table[:, 0]
            sig = ((sig >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(32) | (sig & np.uint64(0xFFFFFFFF))
            order = np.argsort(sig)
            sig, node = sig[order], table[order, 1] & _NODE
            del table, order
            first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            runs = np.diff(np.concatenate((first, [len(sig)])))
            common = runs >= least_common
            out: list[tuple[int, int, bytes]] = []
            if common.any():
                # Members of a common signature go straight to its group, from any bucket; its own bucket hears that it is one.
                for at, m in zip(first[common].tolist(), runs[common].tolist(), strict=True):
                    out.append((int(node[at] % np.uint64(buckets)), 4, np.stack((sig[at : at + m], node[at : at + m]), 1).tobytes()))
                    out.append((int(sig[at] >> np.uint64(32)), 5, sig[at : at + 1].tobytes()))
                rare = ~np.repeat(common, runs)
                sig, node = sig[rare], node[rare]
            bucket = sig >> np.uint64(32)
            cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            low = (sig & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            return blobs(out + [(int(i), 0, _packed(low[cut[i] : cut[i + 1]], node[cut[i] : cut[i + 1]])) for i in np.flatnonzero(cut[1:] > cut[:-1])])

        for batch in batches:
            buf, offs = flat(batch.column(2))
            keys = batch.column(0).to_numpy()
            null = np.asarray(batch.column(1)).astype(np.uint64)
            for lo, hi, part, part_offs in pieces(buf, offs):
                grams, _, cut = shingle_sets(Words(part, part_offs), n)
                size = np.diff(cut)
                fp = fingerprints(grams, cut)
                docs = np.stack((keys[lo:hi].view(np.uint64), size.astype(np.uint64), fp, null[lo:hi]), 1)
                yield blobs([(int(fp[0] % np.uint64(buckets)), 1, np.ascontiguousarray(docs).tobytes())])
                fresh = [i for i, x in enumerate(fp.tolist()) if size[i] and x not in known and not known.add(x)]
                if not fresh:
                    continue
                if len(fresh) < len(size):
                    take = np.zeros(len(size), bool)
                    take[fresh] = True
                    grams = grams[np.repeat(take, size)]
                    cut = np.concatenate(([0], np.cumsum(size[take])))
                    fp = fp[take]
                sig, of = signatures(grams, cut, percent)
                if len(sig):
                    held.append(np.stack((sig, fp[of]), 1))
                    gathered += len(sig)
                if gathered >= GATHER or len(known) > 200_000:
                    if gathered:
                        yield deal()
                    known.clear()
                    gathered = 0
        if gathered:
            yield deal()

    return emit


FOUND = "kind int, a long, b long, c long, d long"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket: rows of documents (1), stars of groups (2), members of groups of three and more (3), members of common signatures (4)."""

    def rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
        n = len(columns[0])
        columns = [np.ascontiguousarray(c).view(np.int64) for c in columns]
        columns += [np.zeros(n, np.int64)] * (4 - len(columns))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *map(pa.array, columns)], ["kind", "a", "b", "c", "d"])

    def groups(held: list[tuple[np.ndarray, np.ndarray]], common: list[np.uint64]) -> Iterator[pa.RecordBatch]:
        sig, node = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        held.clear()
        order = np.argsort(sig)
        sig = sig[order]
        same = sig[1:] == sig[:-1]
        multi = np.zeros(len(sig), bool)
        multi[1:] |= same
        multi[:-1] |= same
        # What a bucket still has of a common signature joins the group that other workers' members form.
        if common:
            mine = np.isin(sig, np.unique(np.array(common, np.uint64)))
            if mine.any():
                yield rows(4, mix(sig[mine]), node[order[mine]])
            multi &= ~mine
        sig, node = sig[multi], node[order[multi]]
        del order, same, multi
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node = sig[new], node[new]
        if not len(sig):
            return
        first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        count = np.diff(np.concatenate((first, [len(sig)])))
        # A group is named by its members, so that groups with the same ones are one.
        name = mix(np.add.reduceat(mix(node), first) + count.astype(np.uint64))
        _, once = np.unique(name, return_index=True)
        once = once[count[once] > 1]
        if not len(once):
            return
        n = count[once]
        at = np.repeat(first[once] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        leader, member, gid = np.repeat(node[first[once]], n), node[at], np.repeat(name[once], n)
        pair = np.unique(np.stack((leader, member), 1)[leader != member], axis=0)
        yield rows(2, pair[:, 0], pair[:, 1])
        more = np.repeat(n > 2, n)
        yield rows(3, gid[more], member[more])

    def grown(held: list[tuple[np.ndarray, np.ndarray]], common: list[np.uint64]) -> Iterator[pa.RecordBatch]:
        """Members of signatures that have grown common in a bucket go on; those of the others stay, each set once."""
        sig, node = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        held.clear()
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        del order
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node = sig[new], node[new]
        first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        n = np.diff(np.concatenate((first, [len(sig)])))
        go = (n >= GROWN) | np.isin(sig[first], np.array(common, np.uint64))
        common += list(sig[first[go]])
        go = np.repeat(go, n)
        if go.any():
            yield rows(4, mix(sig[go]), node[go])
        held.append((sig[~go], node[~go]))

    held, common, last, size, least = [], [], None, 0, SETTLE
    for batch in batches:
        for bucket, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if bucket != last:
                if held:
                    yield from groups(held, common)
                held, common, last, size, least = [], [], bucket, 0, SETTLE
            data = data.as_buffer()
            if kind == 1:
                table = np.frombuffer(data, np.uint64).reshape(-1, 4)
                yield rows(1, *(table[:, k] for k in range(4)))
            elif kind == 4:
                table = np.frombuffer(data, np.uint64).reshape(-1, 2)
                yield rows(4, mix(table[:, 0]), table[:, 1])
            elif kind == 5:
                common.append(np.frombuffer(data, np.uint64)[0])
            else:
                low, node = _unpacked(data)
                held.append((np.uint64(bucket << 32) | low.astype(np.uint64), node))
                size += len(low)
                if size >= least:
                    yield from grown(held, common)
                    size = len(held[0][0])
                    # As much again comes in before the next look, so that looks stay few.
                    least = size + max(SETTLE, size)
    if held:
        yield from groups(held, common)


def _sets(n: int):
    """Node, size, sketch and set of documents (node, text)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = flat(batch.column(1))
            for lo, hi, part, part_offs in pieces(buf, offs):
                grams, _, cut = shingle_sets(Words(part, part_offs), n)
                blobs = [grams[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(cut)), pa.array(sketches(grams, cut), pa.binary()), pa.array(blobs, pa.binary())], ["node", "n", "sketch", "grams"])
                # Of several rows with one key and different texts, only those of the node count.
                yield out.filter(pa.array(out.column(0).to_numpy() == fingerprints(grams, cut).view(np.int64)))

    return build


def _passing(n: np.ndarray, bits: np.ndarray, root: np.ndarray, m: int, within: bool, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all j) of members whose components differ and whose sizes and sketches allow the similarity: i < j for pairs ``within``, or i < m <= j."""
    size = n.astype(np.int64)
    for i in range(m):
        low = i + 1 if within else m
        ok = (root[low:] != root[i]) & (100 * np.minimum(size[i], size[low:]) >= percent * np.maximum(size[i], size[low:]))
        j = np.flatnonzero(ok) + low
        if len(j):
            j = j[np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64) <= difference(size[i], size[j], percent)]
            if len(j):
                yield i, j


def _compared(percent: int, cover: bool):
    """Candidates between components of groups; rows: gid, block, other, node, home, n, sketch, root, sorted by (gid, block, other).

    With ``cover``, each component in a group gives one pair, the first in order of nodes.
    """

    def pairs(t: pa.Table) -> pa.RecordBatch | None:
        node, n, home, root = (t.column(k).to_numpy() for k in ("node", "n", "home", "root"))
        block, other = t.column("block")[0].as_py(), t.column("other")[0].as_py()
        order = np.lexsort((node, home != block))
        bits = _folded(t.column("sketch").to_pylist())[order]
        node, n, root = node[order], n[order], root[order]
        m = int((home == block).sum())
        left, right = [], []
        roots, root_of = np.unique(root, return_inverse=True)
        bare = np.ones(len(roots), bool)
        for i, j in _passing(n, bits, root, m, block == other, percent):
            if cover:
                _, once = np.unique(root_of[j], return_index=True)
                want = bare[root_of[j[once]]]
                want[0] |= bare[root_of[i]]
                j = j[once[want]]
                bare[root_of[i]] = bare[root_of[j]] = False
            left.append(np.full(len(j), i))
            right.append(j)
            if cover and not bare.any():
                break
        if not left or not len(left[0]):
            return None
        x, y = node[np.concatenate(left)], node[np.concatenate(right)]
        pair = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = np.stack([batch.column(k).to_numpy() for k in ("gid", "block", "other")], 1)
            cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)] if len(key) else []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                mine = tuple(key[a].tolist())
                if held and mine != last:
                    if (out := pairs(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                last = mine
                held.append(batch.slice(a, b - a))
        if held and (out := pairs(pa.Table.from_batches(held))) is not None:
            yield out

    return compare


def _by_blocks(members: DataFrame) -> DataFrame:
    """Members (gid, node, m, ...) dealt to comparisons: one per group, or in a group above BLOCK one per pair of blocks."""
    m = members.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    m = m.withColumn("home", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("long"))
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)
    pair = F.transform(others, lambda k: F.struct(F.least(k, "home").alias("block"), F.greatest(k, "home").alias("other")))
    return m.withColumn("pair", F.explode(pair)).select("*", "pair.block", "pair.other").drop("pair", "m", "blocks")


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (gid, node, m, root) of groups that lie in several components."""
    m = members.select("gid", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = m.groupBy("gid").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("x"), F.max("root").alias("y"))
    return m.join(groups.where("x <> y").select("gid", "m"), "gid")


def _cut(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members (gid, node) of large groups by signatures of another partitioning, which similar pairs share again."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gid, node = (batch.column(k).to_numpy() for k in (0, 1))
            # A few sets at a time: each has about as many signatures as elements.
            size = np.array([len(x) // 8 for x in batch.column(2).to_pylist()], np.int64)
            bounds = np.concatenate(([0], np.cumsum(size)))
            for some in np.split(np.arange(len(size)), np.flatnonzero(np.diff(bounds[:-1] >> 17)) + 1):
                if len(some):
                    grams = np.concatenate([np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64) for i in some])
                    offs = np.concatenate(([0], np.cumsum(size[some])))
                    sig, of = signatures(grams, offs, percent, 1)
                    fine = mix(sig + mix(gid[some].view(np.uint64))[of])
                    yield pa.RecordBatch.from_arrays([pa.array(fine.view(np.int64)), pa.array(node[some][of])], ["gid", "node"])

    found = members.select("gid", "node").join(sets.select("node", "grams"), "node").select("gid", "node", "grams").mapInArrow(lean(split), "gid long, node long").distinct()
    found = written(found, "jaccard-cut")
    some = found.groupBy("gid").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("gid")
    return found.join(some, "gid")


def _candidates(members: DataFrame, sets: DataFrame, percent: int, cover: bool) -> DataFrame:
    """Distinct pairs (a, b) to verify, from members (gid, node, m, root) of open groups."""
    m = _by_blocks(members).join(sets.select("node", "n", "sketch"), "node")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = m.repartition(parts, "gid", "block", "other").sortWithinPartitions("gid", "block", "other").select("gid", "block", "other", "node", "home", "n", "sketch", "root")
    return dealt.mapInArrow(lean(_compared(percent, cover)), "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets reach the similarity."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("grams").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return joined.select("a", "b", "x", "y").mapInArrow(lean(verify), "a long, b long")


def _sketched(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes, from stars of 48-bit nodes, whose sizes and sketches allow the similarity."""

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                most = difference(batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent)
                apart = [int(np.bitwise_count(np.bitwise_xor.reduce(_folded([x, y]), 0)).sum()) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
                yield batch.filter(pa.array(np.array(apart) <= most)).select(["a", "b"])

    left = sets.select(F.col("part").alias("s"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x"))
    right = sets.select(F.col("part").alias("t"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))
    joined = stars.join(left, "s").join(right, "t").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return joined.select("a", "b", "na", "nb", "x", "y").mapInArrow(lean(allowed), "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: id, number of shingles, and the smallest id that links reach from it."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    # Rows without an id are found again by the hash of their text.
    rows = rows.select(F.coalesce("doc_id", F.xxhash64("text")).alias("key"), F.col("doc_id").isNull().alias("bare"), "text")
    signed = rows.mapInArrow(lean(_signed(8 * parts, n, percent, COMMON)), "bucket int, kind int, data binary")
    # What is known of a bucket's common signatures comes before its members.
    dealt = signed.repartition(parts, "bucket").sortWithinPartitions("bucket", F.desc("kind"))
    found, stars, members, common = written_by_kind(dealt.mapInArrow(lean(_grouped), FOUND), "jaccard-found", (1, 2, 3, 4))
    released(spark)
    documents = found.select(F.when(F.col("d") == 0, F.col("a")).alias("doc_id"), F.col("a").alias("key"), F.col("b").alias("n_shingles"), F.col("c").alias("node"))
    groups = members.select(F.col("a").alias("gid"), F.col("b").alias("part")).unionByName(common.select(F.col("a").alias("gid"), F.col("b").alias("part"))).distinct()
    least = common.groupBy(F.col("a").alias("a")).agg(F.min("b").alias("s"))
    stars = stars.select(F.col("a").alias("s"), F.col("b").alias("t")).unionByName(common.join(least, "a").select("s", F.col("b").alias("t")).where("s <> t"))
    stars = written(stars.distinct(), "jaccard-stars")

    # Only nodes of some pair need their sets; each comes from the text of its first document.
    live = stars.select(F.explode(F.array("s", "t")).alias("part")).distinct()
    held = documents.where("n_shingles > 0").withColumn("part", F.col("node").bitwiseAND(int(_NODE)))
    first = written(held.join(live, "part", "left_semi").groupBy("node").agg(F.min("key").alias("key")), "jaccard-live")
    n_live = first.count()
    keyed = F.broadcast(first) if n_live <= BROADCAST_ROWS else first
    sets = written(rows.join(keyed, "key").select("node", "text").mapInArrow(lean(_sets(n)), "node long, n long, sketch binary, grams binary"), "jaccard-sets")
    dropped(first)
    if sets.count() > n_live:
        again, sets = sets, written(sets.dropDuplicates(["node"]), "jaccard-sets")
        dropped(again)
    sets = sets.withColumn("part", F.col("node").bitwiseAND(int(_NODE)))

    likely = written(_sketched(stars, sets, percent).distinct(), "jaccard-likely")
    dropped(stars)
    links = written(_verified(likely, sets, percent), "jaccard-links")
    dropped(likely)
    roots = components(links)
    dropped(links)
    # What is open after the stars; later turns only read this.
    whole = groups.join(sets.select("part", "node"), "part").select("gid", "node")
    left = written(_open(whole, roots), "jaccard-open")
    dropped(members, common)
    released(spark)
    large = left.where(F.col("m") > LARGE)
    if not large.isEmpty():
        fine = _cut(large, sets, percent)
        rest, left = left, written(_open(left.where(F.col("m") <= LARGE).select("gid", "node").unionByName(fine), roots), "jaccard-open")
        dropped(rest)
    for cover in (True, False):
        if left.isEmpty():
            break
        likely = written(_candidates(left, sets, percent, cover), "jaccard-likely")
        links = written(_verified(likely, sets, percent), "jaccard-links")
        dropped(likely)
        if not links.isEmpty():
            ends = links.join(roots.withColumnRenamed("node", "a").withColumnRenamed("root", "x"), "a", "left").join(roots.withColumnRenamed("node", "b").withColumnRenamed("root", "y"), "b", "left")
            merged = components(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
            # Roots that were joined, and single nodes that now have one.
            onward = merged.select(F.col("node").alias("root"), F.col("root").alias("last"))
            old = roots.join(onward, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
            new = merged.join(roots.select("node"), "node", "left_anti")
            before, roots = roots, written(old.unionByName(new.select("node", "root")), "jaccard-roots")
            if cover:
                rest, left = left, written(_open(left, roots), "jaccard-open")
                dropped(rest)
            dropped(before)
        dropped(links)
        released(spark)
    dropped(left, sets)
    released(spark)
    of = documents.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    nodes = of.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("smallest"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    alone = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("smallest")), F.col("doc_id"))
    # A table of its own, so that the join on the root has plain shuffles on both sides and a large component is split.
    nodes = written(nodes, "jaccard-smallest")
    return of.join(nodes, "root", "left").select("doc_id", "n_shingles", alone.alias("component_id"))
