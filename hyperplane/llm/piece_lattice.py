"""SentencePiece encoding and decoding: Gumbel top-k sampling of segmentations without replacement.

A text, with a space in front and spaces as ``▁``, falls into units: a run
of ``▁`` and what follows up to the next one.  No piece crosses units, so
the lattice of a text is a chain of unit lattices.  Long units, as in texts without
spaces, are cut further, at places that none of their pieces crosses.  Pieces weigh by Zipf's law
of their merge rank; bytes stand in for characters that are no piece.

For each distinct unit of a batch, backward sums over its lattice give the share
of every continuation.  A number in [0, 1) picks a segmentation of a unit as
arithmetic decoding does: each segmentation owns an interval as long as its
probability.

The search is A-star over the chain with Gumbel-perturbed log masses: a node is
the set of segmentations that agree with a leaf up to a unit and differ from
known ones in it.  A node's perturbed maximum goes on to the leaf that attains
it; the nodes split off get maxima from Gumbels truncated at it.  The frontier's
largest node is expanded next, so leaves come in order of their perturbed
log-probabilities: the first k are k distinct segmentations sampled without
replacement, and the next maximum is the threshold of their inclusion scores,
1 - exp(-exp(log p - threshold)).  A text with fewer segmentations gives all of
them, with inclusion 1; what has a share below 1e-12 together counts as nothing,
as double precision can't tell it from rounding.

All random numbers are hashes of (seed, row key, place), so a row's samples do
not depend on partitions or on other rows.

Cases: a null text is empty; an empty text has one segmentation, the empty one.
A null key counts as 0 and is carried through as null.  Rows with equal keys and
texts get equal samples.  Texts of any length are encoded whole.  ``▁`` in a
text is decoded as a space, which is SentencePiece's own rule.  Only the named
columns are read.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbatch import flat, lean, mix, pieces

SPACE = "▁".encode()
#: Zipf offset and exponent of piece weights by merge rank.
ZIPF_SHIFT, ZIPF_POWER = 2.7, 1.0
SEED = 17
PIECE_BYTES = 1 << 19
#: Units above so many bytes are cut where no piece crosses; bytes looked at together, and the least length of a part.
LONG, CUT_BYTES, PART = 512, 1 << 18, 24
SCHEMA = "doc_id long, sample int, n_ids long, log_prob double, perturbed double, inclusion double, ids binary"


class Vocabulary:
    """Pieces of a SentencePiece model: a trie over byte classes, weights, and ids."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.spelled: list[bytes] = [b""] * n
        self.byte_id = np.full(256, -1, np.int64)
        usable: list[tuple[bytes, int, float]] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.spelled[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                raw = piece.encode()
                if SPACE in raw.replace(SPACE, b" ").lstrip(b" ").replace(b" ", SPACE):
                    continue  # a piece across units has no place in the chain
                self.spelled[i] = raw
                usable.append((raw, i, -sp.get_score(i)))
        norm = np.log(sum((r + ZIPF_SHIFT) ** -ZIPF_POWER for _, _, r in usable))
        used = sorted({b for raw, _, _ in usable for b in raw})
        self.longest = max((len(raw) for raw, _, _ in usable), default=1)
        self.cls = np.zeros(256, np.int64)
        self.cls[used] = np.arange(1, len(used) + 1)
        children: list[dict[int, int]] = [{}, {}]  # 0 is nowhere, 1 the root
        ends: dict[int, tuple[int, float]] = {}
        for raw, i, rank in usable:
            at = 1
            for b in raw:
                c = int(self.cls[b])
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                at = children[at][c]
            ends[at] = i, -ZIPF_POWER * np.log(rank + ZIPF_SHIFT) - norm
        # States with children come first; all others share one row of the table, which leads nowhere.
        self.width = len(used) + 1
        parents = [at for at, kids in enumerate(children) if kids or at < 2]
        self.inner = len(parents)
        number = {at: k for k, at in enumerate(parents)}
        for at in range(len(children)):
            number.setdefault(at, len(number))
        self.next = np.zeros((self.inner + 1) * self.width, np.int32)
        for at in parents:
            for c, to in children[at].items():
                self.next[number[at] * self.width + c] = number[to]
        self.weight = np.full(len(children), -np.inf)
        self.id = np.zeros(len(children), np.int32)
        for at, (i, w) in ends.items():
            self.weight[number[at]], self.id[number[at]] = w, i
        #: A byte weighs as the rarest piece would.
        self.byte_weight = float(self.weight[np.isfinite(self.weight)].min()) - np.log(2)

    def step(self, state: np.ndarray, byte_class: np.ndarray) -> np.ndarray:
        return self.next[np.minimum(state, self.inner) * self.width + byte_class]

    def cut(self, unit: bytes) -> list[bytes]:
        """A unit in parts that no piece crosses, so that its segmentations are theirs one after another; parts under ``PART`` bytes stay together."""
        n, cuts, far = len(unit), [0], 0
        raw = np.frombuffer(unit, np.uint8)
        for a in range(0, n, CUT_BYTES):
            b = min(a + CUT_BYTES, n)
            cls = self.cls[raw[a : min(b + self.longest, n)]]
            # The end of the longest piece that begins at each place.
            end = np.arange(b - a)
            row, state = end.copy(), np.ones(b - a, np.int64)
            for k in range(self.longest):
                state = self.step(state, cls[row + k])
                whole = self.weight[state] > -np.inf
                end[row[whole]] = row[whole] + k + 1
                live = (state > 0) & (row + k + 1 < len(cls))
                if not live.any():
                    break
                row, state = row[live], state[live]
            reach = np.maximum(np.maximum.accumulate(end) + a, far)
            far = int(reach[-1])
            at = np.flatnonzero(reach <= np.arange(a + 1, b + 1)) + a + 1
            # Characters stay whole.
            at = at[(at == n) | (raw[np.minimum(at, n - 1)] & 0xC0 != 0x80)]
            # Of the places in a stretch of PART bytes, the first.
            new = np.ones(len(at), bool)
            new[1:] = at[1:] // PART != at[:-1] // PART
            cuts += at[new].tolist()
        cuts = [c for c in cuts if c < n]
        return [unit[x:y] for x, y in zip(cuts, [*cuts[1:], n], strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids spell, without the space in front."""
        out = b"".join(map(self.spelled.__getitem__, ids.tolist())).replace(SPACE, b" ")
        return out[1:] if out[:1] == b" " else out


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattice:
    """Backward sums of distinct units; each has one slot more than bytes, the last being its end."""

    def __init__(self, voc: Vocabulary, units: list[bytes]):
        self.voc = voc
        size = np.array([len(u) for u in units], np.int64)
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        raw = np.frombuffer(b"\x00".join(units) + b"\x00", np.uint8)
        self.byte = raw
        self.cls = voc.cls[raw]
        self.cls[self.end] = 0
        self.lone = self._lone(raw)
        self.beta = np.full(len(raw), -np.inf)
        self.beta[self.end] = 0
        order = np.argsort(-size, kind="stable")
        end, size = self.end[order], size[order]
        for r in range(1, int(size[0]) + 1 if len(size) else 1):
            at = end[: int(np.searchsorted(-size, -r, "right"))] - r
            total = np.where(self.lone[at], voc.byte_weight + self.beta[at + 1], -np.inf)
            row, state, here = np.arange(len(at)), np.ones(len(at), np.int64), at
            for k in range(r):
                state = voc.step(state, self.cls[here + k])
                live = np.flatnonzero(state)
                if not len(live):
                    break
                row, state, here = row[live], state[live], here[live]
                total[row] = np.logaddexp(total[row], voc.weight[state] + self.beta[here + k + 1])
            self.beta[at] = total

    def _lone(self, raw: np.ndarray) -> np.ndarray:
        """Bytes of characters that are no piece."""
        lead = (raw & 0xC0) != 0x80
        size = np.where(raw >= 0xF0, 4, np.where(raw >= 0xE0, 3, np.where(raw >= 0xC0, 2, 1)))
        lone = np.zeros(len(raw) + 4, bool)
        at = np.flatnonzero(lead)
        is_end = np.zeros(len(raw), bool)
        is_end[self.end] = True
        at = at[~is_end[at]]
        state = np.ones(len(at), np.int64)
        for k in range(4):
            more = size[at] > k
            state[more] = self.voc.step(state[more], self.cls[np.minimum(at[more] + k, len(raw) - 1)])
        bad = at[~np.isfinite(self.voc.weight[state])]
        for k in range(4):
            lone[bad[size[bad] > k] + k] = True
        return lone[: len(raw)]

    def pick(self, unit: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Segmentation of each unit that owns the number t: (ids of all, offsets, log-probabilities, low ends of the intervals)."""
        voc, n = self.voc, len(unit)
        pos, end = self.start[unit].copy(), self.end[unit]
        t = t.copy()
        log_p, low = np.zeros(n), np.zeros(n)
        counts = np.zeros(n, np.int64)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        todo = np.flatnonzero(pos < end)
        while len(todo):
            p, u = pos[todo], t[todo]
            base = self.beta[p]
            m = len(todo)
            got, to, share, before = np.full(m, -1, np.int64), np.zeros(m, np.int64), np.zeros(m), np.zeros(m)
            acc = np.zeros(m)
            open_ = np.ones(m, bool)
            lone = np.flatnonzero(self.lone[p])
            if len(lone):
                q = np.exp(voc.byte_weight + self.beta[p[lone] + 1] - base[lone])
                got[lone], to[lone], share[lone] = voc.byte_id[self.byte[p[lone]]], p[lone] + 1, q
                acc[lone] = q
                open_[lone] = u[lone] >= q
            row = np.flatnonzero(open_)
            here, state = p[row], np.ones(len(row), np.int64)
            k = 0
            while len(row):
                state = voc.step(state, self.cls[here])
                live = np.flatnonzero(state)
                if len(live) < len(row):
                    row, state, here = row[live], state[live], here[live]
                here = here + 1
                w = voc.weight[state]
                some = np.flatnonzero(w > -np.inf)
                if len(some):
                    r, next_ = row[some], here[some]
                    q = np.exp(w[some] + self.beta[next_] - base[r])
                    if not q.all():
                        use = q > 0
                        r, q, some, next_ = r[use], q[use], some[use], next_[use]
                    past = acc[r]
                    got[r], to[r], share[r], before[r] = voc.id[state[some]], next_, q, past
                    acc[r] = past = past + q
                    found = u[r] < past
                    if found.any():
                        left = np.ones(len(row), bool)
                        left[some] = ~found
                        row, state, here = row[left], state[left], here[left]
                k += 1
            # Rounding may leave a number beyond the last edge; that edge takes it.
            t[todo] = np.clip((u - before) / share, 0, 1 - 2**-53)
            low[todo] += np.exp(log_p[todo]) * before
            log_p[todo] += np.log(share)
            steps.append((todo, got))
            counts[todo] += 1
            pos[todo] = to
            todo = todo[to < end[todo]]
        offs = np.concatenate(([0], np.cumsum(counts)))
        ids = np.empty(int(offs[-1]), np.int32)
        for k, (rows, got) in enumerate(steps):
            ids[offs[rows] + k] = got
        return ids, offs, log_p, low


def uniform(key: np.ndarray, place: np.ndarray, stream: int) -> np.ndarray:
    """Numbers in (0, 1) by row key, place and stream."""
    salt = np.uint64(stream * 0x9E3779B97F4A7C15 % (1 << 64))
    x = mix(mix(key + salt) + place.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def below(top: np.ndarray | float, g: np.ndarray) -> np.ndarray:
    """Gumbels g with their maximum truncated at ``top``."""
    return -np.logaddexp(-top, -g)


def _outside(v: float, taken: list[tuple[float, float]]) -> float:
    """The number v of [0, 1) as a place outside the taken intervals (low, length)."""
    x = v * (1 - sum(p for _, p in taken))
    for low, p in sorted(taken):
        if x >= low:
            x += p
    return min(max(x, 0.0), 1 - 2**-53)


def _rest(log_p: np.ndarray) -> np.ndarray:
    """log(1 - p); what rounding leaves of a sole segmentation counts as nothing."""
    rest = -np.expm1(np.minimum(log_p, 0))
    return np.where(rest > 1e-12, np.log(np.maximum(rest, 1e-300)), -np.inf)


class _Leaf:
    """A segmentation: units before ``at`` are its parent's.  ``nodes``: perturbed maxima of what splits off at each unit from ``at`` on."""

    __slots__ = ("at", "before", "ids", "log_p", "low", "nodes", "offs", "parent", "score", "taken")

    def total(self) -> float:
        return float(self.before[-1] + self.log_p[-1]) if len(self.log_p) else 0.0

    def chain(self, stop: int) -> list[np.ndarray]:
        """Ids of the units before ``stop``."""
        head = self.parent.chain(min(self.at, stop)) if self.parent is not None and self.at else []
        if stop <= self.at:
            return head
        return [*head, self.ids[self.offs[0] : self.offs[stop - self.at]]]


def units_of(text: bytes) -> list[bytes]:
    """Runs of spaces with what follows, of a text with a space in front; empty for an empty text."""
    if not text:
        return []
    text = b" " + text.replace(SPACE, b" ")
    words = text.split(b" ")[1:]
    if b"" not in words:
        return [SPACE + w for w in words]
    out, run = [], 1
    for w in words:
        if w:
            out.append(SPACE * run + w)
            run = 1
        else:
            run += 1
    return out + [SPACE * (run - 1)] if run > 1 else out


def sample(voc: Vocabulary, texts: list[bytes], keys: np.ndarray, k: int, seed: int = SEED) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text, up to k of (ids, log-probability, perturbed log-probability, inclusion), largest perturbed first."""
    number: dict[bytes, int] = {}
    flat_units: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    put = number.setdefault
    for i, text in enumerate(texts):
        units = units_of(text)
        if len(text) > LONG and max(map(len, units), default=0) > LONG:
            units = [part for u in units for part in (voc.cut(u) if len(u) > LONG else (u,))]
        counts[i] = len(units)
        flat_units += [put(u, len(number)) for u in units]
    unit = np.array(flat_units, np.int64)
    lattice = Lattice(voc, list(number))
    offs = np.concatenate(([0], np.cumsum(counts)))
    key = mix(keys.view(np.uint64) ^ mix(np.array([seed], np.uint64))[0])
    of = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(unit)) - offs[of]

    top = gumbel(uniform(key, np.zeros(len(texts)), 1))
    ids, ends, log_p, low = lattice.pick(unit, uniform(key[of], place, 2))
    # Log-probability of a text's units before each unit, per document.
    run = np.cumsum(log_p) - log_p
    before = run - run[np.minimum(offs[:-1], max(len(run) - 1, 0))][of] if len(run) else run
    noise = gumbel(uniform(key[of], place, 3))
    nodes = below(top[of], before + _rest(log_p) + noise)
    leaves: list[list[_Leaf]] = []
    for i in range(len(texts)):
        a, b = offs[i], offs[i + 1]
        leaf = _Leaf()
        leaf.at, leaf.parent, leaf.score, leaf.ids, leaf.offs = 0, None, float(top[i]), ids, ends[a : b + 1]
        leaf.log_p, leaf.low, leaf.before, leaf.nodes, leaf.taken = log_p[a:b], low[a:b], before[a:b], nodes[a:b], {}
        leaves.append([leaf])

    threshold = np.full(len(texts), -np.inf)
    for turn in range(1, k + 1):
        best: list[tuple[int, _Leaf, int]] = []
        for i, mine in enumerate(leaves):
            if len(mine) < turn:
                continue
            value, leaf, j = -np.inf, None, 0
            for x in mine:
                if len(x.nodes) and (v := x.nodes[c := int(x.nodes.argmax())]) > value:
                    value, leaf, j = v, x, c
            if leaf is None:
                continue
            if turn == k:
                threshold[i] = value
            else:
                best.append((i, leaf, j))
        if turn == k or not best:
            continue
        # The chosen nodes' leaves: another segmentation of the unit, and fresh ones of all after it.
        n = np.array([offs[i + 1] - offs[i] - x.at - j for i, x, j in best])
        own = np.repeat(np.arange(len(best)), n)
        doc = np.array([i for i, _, _ in best])[own]
        step = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        at = np.array([x.at + j for _, x, j in best])[own] + step
        t = uniform(key[doc], at, 4 * turn)
        first = np.cumsum(n) - n
        for m, (i, x, j) in enumerate(best):
            taken = x.taken.setdefault(j, [(float(x.low[j]), float(np.exp(x.log_p[j])))])
            t[first[m]] = _outside(float(t[first[m]]), taken)
        ids, ends, log_p, low = lattice.pick(unit[offs[doc] + at], t)
        noise = gumbel(uniform(key[doc], at, 4 * turn + 1))
        for m, (i, x, j) in enumerate(best):
            a, b = first[m], first[m] + n[m]
            leaf = _Leaf()
            leaf.at, leaf.parent, leaf.score, leaf.ids, leaf.offs = x.at + j, x, float(x.nodes[j]), ids, ends[a : b + 1]
            leaf.log_p, leaf.low = log_p[a:b], low[a:b]
            leaf.before = x.before[j] + np.cumsum(leaf.log_p) - leaf.log_p
            rest = leaf.before + _rest(leaf.log_p)
            taken = x.taken[j] = [*x.taken[j], (float(low[a]), float(np.exp(log_p[a])))]
            left = 1 - sum(p for _, p in taken)
            rest[0] = x.before[j] + np.log(left) if left > 1e-12 else -np.inf
            leaf.nodes = below(leaf.score, rest + noise[a:b])
            leaf.taken = {0: taken}
            x.nodes = x.nodes.copy()
            x.nodes[j] = -np.inf
            leaves[i].append(leaf)
    out = []
    for i, mine in enumerate(leaves):
        total = int(counts[i])
        found = []
        for leaf in mine:
            p = leaf.total()
            inclusion = 1.0 if threshold[i] == -np.inf else -float(np.expm1(-np.exp(min(p - threshold[i], 700))))
            chain = leaf.chain(total)
            found.append((np.concatenate(chain) if chain else np.zeros(0, np.int32), p, leaf.score, inclusion))
        out.append(found)
    return out


DECODED = SCHEMA + ", ids_crc32 long, decoded string"
CHECKED = SCHEMA + ", ids_crc32 long, text_crc32 long"


def _decoded(voc: Vocabulary, batch: pa.RecordBatch, texts: bool = True) -> Iterator[pa.RecordBatch]:
    """Encoded rows with the checksum of the ids, and the texts they spell, or only their checksums."""
    for at in range(0, batch.num_rows, 256):
        part = batch.slice(at, 256)
        ids = [x.as_buffer() for x in part.column(6)]
        spelled = [voc.decode(np.frombuffer(x, "<i4")) for x in ids]
        last = pa.array([x.decode("utf-8", "replace") for x in spelled], pa.string()) if texts else pa.array([zlib.crc32(x) for x in spelled], pa.int64())
        names = [*part.schema.names, "ids_crc32", "decoded" if texts else "text_crc32"]
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array([zlib.crc32(x) for x in ids], pa.int64()), last], names)


def encode_topk(docs: DataFrame, path: str, k: int = 2, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", checked: bool = False) -> DataFrame:
    """Up to k rows per row of ``docs``: sample number from 1, ids (little-endian 32-bit), log-probability, perturbed one, inclusion score.

    If ``checked``, the ids are decoded in the same pass, and rows also have the
    checksums of the ids and of the text that they spell.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            buf, offs = flat(batch.column(1))
            keys = batch.column(0)
            for lo, hi, part, part_offs in pieces(buf, offs, PIECE_BYTES):
                raw = part.tobytes()
                texts = [raw[a:b] for a, b in zip(part_offs[:-1].tolist(), part_offs[1:].tolist(), strict=True)]
                mine = keys.slice(lo, hi - lo)
                found = sample(voc, texts, mine.fill_null(0).to_numpy(), k, seed)
                rows = [(i, n + 1, *x) for i, many in enumerate(found) for n, x in enumerate(many)]
                which = pa.array([r[0] for r in rows], pa.int64())
                out = pa.RecordBatch.from_arrays(
                    [
                        mine.take(which), pa.array([r[1] for r in rows], pa.int32()), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.float64()),
                        pa.array([r[4] for r in rows], pa.float64()), pa.array([r[5] for r in rows], pa.float64()), pa.array([r[2].astype("<i4").tobytes() for r in rows], pa.binary()),
                    ],
                    ["doc_id", "sample", "n_ids", "log_prob", "perturbed", "inclusion", "ids"],
                )
                if checked:
                    yield from _decoded(voc, out, False)
                else:
                    yield out

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(lean(encode), CHECKED if checked else SCHEMA)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """The encoded rows with the checksum of the ids, and the texts they spell."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            yield from _decoded(voc, batch)

    return encoded.mapInArrow(lean(spell), DECODED)
