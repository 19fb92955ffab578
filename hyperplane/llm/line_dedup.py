"""Line deduplication over the corpus: exploded lines, hashed keys, documents counted by key, texts put together again by position.

A line's key is the line without white space at its ends and with A-Z
lower-cased.  A key of at least ``min_chars`` code points that at least
``min_docs`` documents hold is common: its lines go everywhere but in the
document with the largest id.  All work is DataFrame code.

1. Keys are counted as 128-bit hashes, combined before the shuffle.  A count of
   lines is at least the count of documents, so only keys of ``min_docs`` lines
   can be common; all others end here, after one shuffle of hashes.
2. Lines of these keys are taken out as (document, position, key), and documents
   are counted by distinct ids, which spreads a key over all tasks first.
3. Positions to drop meet their texts by (id, hash of the text) in a shuffle that
   moves each text once, whatever the size; a text is joined again from the
   positions that stay.

Tables of keys are broadcast if counted small.  Otherwise keys are met by a
shuffle in which those that hold more than 1 / ``HOT`` of the lines, fewer than
``HOT`` by that rule, are dealt over ``SALTS`` tasks each.

Cases: a null or empty text is one empty line.  Rows of equal id are one
document: a key in several of them counts once, and the largest id keeps its
lines in all its rows.  A row without an id is no document that could be counted
or kept for: it keeps all its lines.  Texts of any length are taken whole.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, dropped, written

MIN_CHARS = 40
MIN_DOCS = 5
#: Keys above this share of the lines are dealt over several tasks when tables of keys are too large to broadcast.
HOT = 4096
SALTS = 256

_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["a", "b"]


def line_key(line: Column) -> Column:
    """The line without white space at both ends and with A-Z lower-cased; other letters stay."""
    bare = F.btrim(line, F.lit(_SPACE))
    # Lower-casing a text of ASCII alone is the same and much faster.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, hash of the text, position, two hashes of the key) of each line whose key is long enough; docs: (id, text)."""
    lines = docs.where("id is not null").select("id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    key = line_key(F.col("line"))
    lines = lines.where(F.char_length(F.btrim("line", F.lit(_SPACE))) >= min_chars)
    return lines.select("id", "t", "pos", F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def met(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """Lines with the columns of their key; keys: a written table (a, b, n, ...), n at least the number of lines of the key."""
    if keys.count() <= BROADCAST_ROWS:
        return lines.join(F.broadcast(keys), _KEY)
    total = keys.agg(F.sum("n")).first()[0]
    hot = keys.where(F.col("n") * HOT > total)
    salts = F.when(F.col("n") * HOT > total, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = lines.join(F.broadcast(hot.select(*_KEY, F.lit(SALTS).alias("salts"))), _KEY, "left")
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("id", "t", "pos"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    return dealt.join(keys.withColumn("salt", F.explode(salts)), [*_KEY, "salt"]).drop("salt")


def dropped_positions(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(id, t, gone) of each text that loses lines, a written table; docs: (id, text)."""
    lines = long_lines(docs, min_chars)
    often = written(lines.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs), "line-keys")
    held = written(met(lines, often).drop("n"), "line-held")
    counts = held.groupBy(*_KEY).agg(F.countDistinct("id").alias("docs"), F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    common = written(counts.where(F.col("docs") >= min_docs).drop("docs"), "line-common")
    gone = met(held, common).where("id <> last").groupBy("id", "t").agg(F.collect_set("pos").alias("gone"))
    out = written(gone, "line-gone")
    dropped(often, held, common)
    return out


def drop_common_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_lines (before dropping), n_dropped and the text of the lines that stay."""
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    gone = dropped_positions(docs, min_chars, min_docs)
    texts = docs.withColumn("t", F.xxhash64("text")).join(gone.hint("shuffle_hash"), ["id", "t"], "left").withColumn("lines", F.split("text", "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.array_join(F.transform(stay, lambda i: F.col("lines")[i]), "\n")
    return texts.select(
        F.col("id").alias(id_col),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
    )
