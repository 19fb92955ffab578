"""Token-ID output: fixed-width bit packing with block offsets.

A token file is one byte string: ``HPTK``, then little-endian unsigned 32-bit
integers version, bits per id, ids per block, documents, and a 64-bit count of
ids; then the 64-bit block offsets in bytes, the 64-bit document starts in ids
(one more than documents), the document ids, and the blocks.  Each block packs
its ids in the fewest bits that hold the vocabulary, least significant bit first
and padded to whole bytes, so any id or range is read by unpacking only the
blocks that hold it.

Files are rows of a Parquet table: ``part``, the number of a range of document
ids and of the file within it, so that reading parts in order gives the corpus
in ascending order of ids; ``span``, the range; ``first`` and ``n``, ids of the
range before the file and in it; and ``data``.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .textbatch import flat, mix, spans

MAGIC = b"HPTK"
BLOCK = 4096
#: Ids in one token file at most, unless one document has more.
FILE_IDS = 4_000_000
#: Characters of text that are encoded together.
GROUP = 800_000
#: Words whose ids a worker remembers, and pieces of words.
MEMORY = 2_000_000
PIECES = 200_000


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in ``bits`` bits each, least significant first."""
    ids = np.ascontiguousarray(ids, np.uint32)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {ids.max()} does not fit in {bits} bits")
    if bits == 16:
        return ids.astype("<u2").tobytes()
    spread = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | np.ndarray, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed data."""
    raw = np.frombuffer(data, np.uint8)
    if bits == 16:
        return raw[: 2 * n].view("<u2").astype(np.uint32)
    # Five bytes hold any id of up to 32 bits, whatever bit it starts at.
    at = np.arange(n, dtype=np.int64) * bits
    padded = np.concatenate((raw, np.zeros(5, np.uint8)))
    first = at >> 3
    word = np.zeros(n, np.uint64)
    for k in range(5):
        word |= padded[first + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def encode_file(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """A token file of documents with ``counts`` ids each."""
    blocks = [pack(ids[a : a + block], bits) for a in range(0, len(ids), block)]
    sizes = np.concatenate(([0], np.cumsum([len(x) for x in blocks], dtype=np.int64)))
    starts = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    head = MAGIC + np.array([1, bits, block, len(doc_ids)], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes()
    return b"".join([head, sizes.astype("<u8").tobytes(), starts.astype("<u8").tobytes(), np.asarray(doc_ids).astype("<i8").tobytes(), *blocks])


class TokenFile:
    """Reads a token file: ``doc_ids``, ``starts``, and ids of any range."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        version, self.bits, self.block, n_docs = np.frombuffer(data, "<u4", 4, 4).tolist()
        if version != 1:
            raise ValueError(f"token file version {version}")
        self.n_ids = int(np.frombuffer(data, "<u8", 1, 20)[0])
        n_blocks = -(-self.n_ids // self.block)
        at = 28
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at).astype(np.int64)
        at += 8 * (n_blocks + 1)
        self.starts = np.frombuffer(data, "<u8", n_docs + 1, at).astype(np.int64)
        at += 8 * (n_docs + 1)
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        self.body, self.data = at + 8 * n_docs, data

    def ids(self, a: int, b: int) -> np.ndarray:
        """ids[a:b], from the blocks that hold them."""
        if b <= a:
            return np.zeros(0, np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        out = []
        for k in range(first, last + 1):
            piece = self.data[self.body + self.offsets[k] : self.body + self.offsets[k + 1]]
            out.append(unpack(piece, self.bits, min(self.block, self.n_ids - k * self.block)))
        whole = np.concatenate(out)
        return whole[a - first * self.block : b - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


class ByteBpe:
    """The encoder of the vocabulary at ``path``, as its library encodes without adding special tokens; remembers ids of words.

    The known pattern (``_KNOWN``) never joins what stands before a single space
    to what follows it, unless white space surrounds the space: such texts, and
    those that hold an added token's string, are encoded in one piece, others
    word by word with the space in front.  Texts of a vocabulary with another
    pattern or normalizer all go through the library as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.by_words = all(spec.get(k) == v for k, v in _KNOWN.items()) and all(spec["model"].get(k) == v for k, v in _KNOWN_MODEL.items())
        self.added = [t["content"] for t in spec["added_tokens"]]
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        # Known words by the hash of their bytes, ascending: where their ids are in the pool, how many, and when they were last met.
        self.hash, self.at, self.size, self.met = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool = np.zeros(0, self.dtype)
        self.turn = 0
        self.pieces: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _packed(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.dtype == "<u2" else "I"
        return [array(code, x).tobytes() for x in self._plain(texts)]

    def _by_pieces(self, text: str) -> Iterator[tuple[str, bytes]]:
        """The pattern's pieces of a text of plain characters, each with its ids: the model alone encodes a piece."""
        tokenize, code, known = self.tokenizer.model.tokenize, "H" if self.dtype == "<u2" else "I", self.pieces
        if len(known) > PIECES:
            known.clear()
        pieces = _PATTERN.findall(text)
        spelled = _BYTE_CHARS[np.frombuffer("\x00".join(pieces).encode(), np.uint8)].tobytes().decode("utf-32-le").split("\x00")
        for piece, x in zip(pieces, spelled, strict=True):
            ids = known.get(piece)
            if ids is None:
                ids = known[piece] = array(code, [t.id for t in tokenize(x)]).tobytes()
            yield piece, ids

    def _encoded(self, words: list[str], n_heads: int) -> list[bytes]:
        """Ids of words, the first ``n_heads`` as they are, the others with a space in front."""
        out = dict.fromkeys(range(len(words)), b"")
        others = [k for k, w in enumerate(words) if (w or k >= n_heads) and not _PLAIN_WORD(w)]
        out |= zip(others, self._packed([words[k] if k < n_heads else " " + words[k] for k in others]), strict=True)
        for k in set(range(n_heads)).difference(others):
            out[k] = b"".join(ids for _, ids in self._by_pieces(words[k])) if words[k] else b""
        other = set(others)
        plain = [k for k in range(n_heads, len(words)) if k not in other] if others else range(n_heads, len(words))
        if plain:
            found: list[bytes] = []
            for piece, ids in self._by_pieces(" " + " ".join([words[k] for k in plain])):
                if piece[0] == " ":
                    found.append(ids)
                else:
                    found[-1] += ids
            out |= zip(plain, found, strict=True)
        return [out[k] for k in range(len(words))]

    def _learn(self, hashes: np.ndarray, ids: list[bytes]) -> None:
        """Adds words by their ascending hashes; of too many, those met least lately go."""
        if len(self.hash) + len(hashes) > MEMORY and len(self.hash):
            late = self.met >= np.partition(self.met, len(self.met) // 2)[len(self.met) // 2]
            if late.sum() > 0.75 * len(late):
                late = self.met == self.turn
            at, size = self.at[late], self.size[late]
            self.pool = self.pool[_spread(at, size)]
            self.hash, self.met, self.size = self.hash[late], self.met[late], size
            self.at = np.cumsum(size, dtype=np.int64) - size
        new = np.frombuffer(b"".join(ids), self.dtype)
        size = np.array([len(x) // new.itemsize for x in ids], np.int32)
        place = np.searchsorted(self.hash, hashes)
        self.at = np.insert(self.at, place, len(self.pool) + np.cumsum(size, dtype=np.int64) - size)
        self.hash, self.size, self.met = np.insert(self.hash, place, hashes), np.insert(self.size, place, size), np.insert(self.met, place, self.turn)
        self.pool = np.concatenate((self.pool, new))

    def __call__(self, text: str) -> np.ndarray:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        whole, split = [], []
        for i, text in enumerate(texts):
            apart = self.by_words and not any(x in text for x in self.added) and not (_may_join(text) and _JOINED.search(text))
            (split if apart else whole).append(i)
        for i, ids in zip(whole, self._plain([texts[i] for i in whole]), strict=True):
            out[i] = np.array(ids, np.uint32)
        if not split:
            return out
        raw = [texts[i].encode() for i in split]
        data = b" ".join(raw)
        buf = np.frombuffer(data, np.uint8)
        gaps = np.flatnonzero(buf == 0x20)
        start, end = np.concatenate(([0], gaps + 1)), np.append(gaps, len(buf))
        size = np.array([len(x) for x in raw], np.int64)
        head = np.searchsorted(start, np.cumsum(size + 1) - size - 1)
        h = spans(buf, start, end)
        h[head] = mix(h[head] ^ _HEAD)
        words, one, of = np.unique(h, return_index=True, return_inverse=True)
        self.turn += 1
        place = np.searchsorted(self.hash, words)
        known = np.zeros(len(words), bool)
        inside = np.flatnonzero(place < len(self.hash))
        known[inside] = self.hash[place[inside]] == words[inside]
        self.met[place[known]] = self.turn
        fresh = np.flatnonzero(~known)
        if len(fresh):
            is_head = np.zeros(len(start), bool)
            is_head[head] = True
            fresh = fresh[np.argsort(~is_head[one[fresh]], kind="stable")]
            spelled = [data[a:b].decode() for a, b in zip(start[one[fresh]].tolist(), end[one[fresh]].tolist(), strict=True)]
            ids = self._encoded(spelled, int(is_head[one[fresh]].sum()))
            order = np.argsort(words[fresh])
            self._learn(words[fresh[order]], [ids[k] for k in order.tolist()])
            place = np.searchsorted(self.hash, words)
        at, size = self.at[place][of], self.size[place][of]
        found = self.pool[_spread(at, size)].astype(np.uint32)
        bounds = np.append((np.cumsum(size, dtype=np.int64) - size)[head], len(found))
        for i, a, b in zip(split, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[i] = found[a:b]
        return out


def _spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places at, at + 1, ... of each of some runs, one run after another."""
    ends = np.cumsum(size, dtype=np.int64)
    return np.repeat(at - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def _may_join(text: str) -> bool:
    """False only if no white space stands before a space."""
    return text[:1] == " " or any(x in text for x in (_PAIRS[:10] if text.isascii() else _PAIRS))


#: Tells a word at the beginning of a text from one behind a space.
_HEAD = np.uint64(0x9E3779B97F4A7C15)
#: White space before a space; the first ten are of ASCII.
_PAIRS = [c + " " for c in map(chr, range(0x3001)) if c.isspace()]
_JOINED = re.compile(r"\s (?:\s|$)|^ (?:\s|$)")
#: Fixed value: the published pattern of byte-level BPE.
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words whose characters are of one class in every version of Unicode, with single line feeds inside.
_PLAIN_WORD = re.compile("[!-~\u00c0-\u024f]+(?:\n[!-~\u00c0-\u024f]+)*").fullmatch
#: The characters that byte-level BPE writes for bytes without a printable one of their own: from 256 on, in order.  Zero separates pieces.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = np.zeros(256, "<u4")
_BYTE_CHARS[_PRINTABLE] = _PRINTABLE
_BYTE_CHARS[sorted({*range(1, 256)} - {*_PRINTABLE})] = np.arange(257, 257 + 255 - len(_PRINTABLE))

#: The parts of a vocabulary file under which words are encoded apart.
_KNOWN = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "post_processor": None, "truncation": None, "padding": None}
_KNOWN_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


@cache
def byte_bpe(path: str) -> ByteBpe:
    """One encoder per worker, so that words stay known from task to task."""
    return ByteBpe(path)


def id_bits(path: str, end_id: int) -> int:
    """Bits that hold every id of the vocabulary at ``path``, added tokens included, and the end id."""
    from tokenizers import Tokenizer

    most = max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0)
    return max(1, max(most, end_id).bit_length())


FILES = "part long, span long, first long, n long, data binary"


def write_tokens(docs: DataFrame, path: str, end_id: int = 0, vocabulary: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, appends ``end_id``, and writes token files in ascending order of ids; returns their table.

    Documents are dealt to ranges of ids.  A null text is empty: one end id.
    Rows with a null id come first, as id -1 << 63; rows with equal ids follow
    each other in no set order.  Only the named columns are read.  An empty
    table gives an empty table.  Ids take the bits of the tokenizer's largest id,
    or of ``vocabulary`` ids if that is given; an id that does not fit is an error.
    """
    bits = id_bits(path, end_id) if vocabulary is None else max(1, int(vocabulary - 1).bit_length())
    file_ids, group = FILE_IDS, GROUP

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = byte_bpe(path)
        span, n_file, before, size = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids: list[int] = []
        counts: list[int] = []
        held: list[np.ndarray] = []

        def file() -> pa.RecordBatch:
            data = encode_file(np.array(doc_ids, np.int64), np.array(counts, np.int64), np.concatenate(held), bits)
            return pa.RecordBatch.from_arrays([pa.array([span * 1_000_000 + n_file]), pa.array([span]), pa.array([before]), pa.array([size]), pa.array([data])], ["part", "span", "first", "n", "data"])

        for batch in batches:
            ids = batch.column(0).fill_null(-(1 << 63)).to_pylist()
            length = batch.column(1).fill_null("").to_pandas().str.len().to_numpy()
            for some in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(np.cumsum(length) // group)) + 1):
                texts = [batch.column(1)[i].as_py() or "" for i in some.tolist()]
                for i, got in zip(some.tolist(), encode.many(texts), strict=True):
                    got = np.append(got, np.uint32(end_id))
                    doc_ids.append(ids[i])
                    counts.append(len(got))
                    held.append(got)
                    size += len(got)
                    if size >= file_ids:
                        yield file()
                        n_file, before, size = n_file + 1, before + size, 0
                        doc_ids.clear(), counts.clear(), held.clear()
        if doc_ids:
            yield file()

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    return written(ordered.mapInArrow(files, FILES), "token-files")


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start (ids before it in the corpus), n_tokens, ids_crc32 of each document, from token files alone.

    The starts of the ranges, of which there are as many as shuffle partitions
    when the files were written, are broadcast.
    """

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                f = TokenFile(data.as_py())
                crc, n = [], len(f.doc_ids)
                for a in range(0, n, 256):
                    b = min(n, a + 256)
                    ids, at = f.ids(int(f.starts[a]), int(f.starts[b])), f.starts[a : b + 1] - f.starts[a]
                    crc += [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(at[:-1], at[1:], strict=True)]
                doc = pa.array(f.doc_ids, mask=f.doc_ids == -(1 << 63))
                yield pa.RecordBatch.from_arrays([doc, pa.array(f.starts[:-1] + start), pa.array(np.diff(f.starts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = files.groupBy("span").agg(F.sum("n").alias("n")).select("span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = files.join(F.broadcast(spans), "span").select((F.col("before") + F.col("first")).alias("start"), "data")
    return placed.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
