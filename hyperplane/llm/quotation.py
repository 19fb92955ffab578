"""Quotation linking: reply-ordered conversations without quotes.

A line's quote level is the number of ``>`` marks in front of it, blanks aside.
Runs of lines of one level are passages, over empty lines too.  Lines are normalised
(A-Z lower-cased, white space collapsed); a passage is its lines joined by one blank,
so wrapping does not matter.  Both are hashed with their length.  A quoted passage
joins all earlier messages of its conversation that hold it as an unquoted passage.
Only where none does (a quote cut short or changed), its lines join all earlier
messages that hold them unquoted.  A message replies to the candidate that holds most
of its level-one lines so counted, then of all its quoted lines, the latest of equals.
The root of a message is where its replies end up.

A conversation is ordered by root, then turn: a reply follows what it answers,
and messages of one thread stay together.  Bodies are the unquoted lines without
attributions (``On ... wrote:``) that introduce a quote.

Only DataFrame functions are used.  Equal quotes of a conversation are asked for once.
The holders of a quote's rarest part are candidates first; the holders of all parts
follow only where the rest could still reach the best of these, so the answer is the
same as from all.  A message takes the best candidate before it from a running maximum
over ranges of rows.  Roots are found by pointer doubling, and positions from ranges
of rows, so no conversation is gathered in one task.

Cases: a null or empty text is a message without lines and an empty body.  A row
with a null conversation or turn is carried through without reply, root or
position.  Rows with equal conversation and turn are one message of several
texts: links are found over all of them, each keeps its own body, and positions
follow the body's order among them.  Extra columns are not read.  An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines that introduce a quote (fixed values).
ATTRIBUTION = r"(?i)^\s*(on\s.{1,200}\swrote\s?:|le\s.{1,200}\sa écrit\s?:|am\s.{1,200}\sschrieb\s.{0,80}:|el\s.{1,200}\sescribió\s?:|-+ ?original message ?-+)\s*$"
_MARKS = r"^[ \t]*(?:>[ \t]?)+"


def parsed_lines(text: Column) -> Column:
    """Array of (level, body) of the lines of a text; attributions before a quote have level -1."""
    lines = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n", -1),
        lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, _MARKS, "").alias("body")),
    )
    return F.transform(lines, lambda x, i: F.struct(F.when((x["level"] == 0) & x["body"].rlike(ATTRIBUTION) & (_next_level(lines, i) > 0), -1).otherwise(x["level"]).alias("level"), x["body"].alias("body")))


def _next_level(lines: Column, i: Column) -> Column:
    return F.coalesce(F.try_element_at(lines, i + 2)["level"], F.lit(0))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(line, _UPPER, _LOWER), r"\s+", " "))


def passages(lines: Column) -> Column:
    """Array of (level, hash, size, lines of (hash, size)) of the runs of one level in lines (level, norm) that are not empty."""
    level = lambda i: F.element_at(lines, i)["level"]
    hashed = lambda x: (F.xxhash64(x).alias("hash"), F.length(x).alias("size"))
    starts = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: (i == 1) | (level(i) != level(F.greatest(i - 1, F.lit(1)))))
    bounds = F.arrays_zip(starts.alias("a"), F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(lines) + 1)).alias("z"))
    runs = F.transform(bounds, lambda b: F.slice(lines, b["a"], b["z"] - b["a"]))
    found = F.transform(runs, lambda r: F.struct(F.element_at(r, 1)["level"].alias("level"), *hashed(F.array_join(F.transform(r, lambda x: x["norm"]), " ")), F.transform(r, lambda x: F.struct(*hashed(x["norm"]))).alias("lines")))
    return F.when(F.size(lines) > 0, found)


_KEY = ["conv_id", "kind", "hash", "size"]


def _best_before(asked: DataFrame, scored: DataFrame, keep) -> DataFrame:
    """conv_id, turn, best: the greatest (near, all, original) of the message's class (conv_id, class) with original < turn."""
    row = ["conv_id", "class", "at", "candidate", "best"]
    best = F.struct("near", "all", "original")
    both = scored.select("conv_id", "class", F.col("original").alias("at"), F.lit(1).alias("candidate"), best.alias("best"))
    both = both.unionByName(asked.select("conv_id", "class", F.col("turn").alias("at"), F.lit(0).alias("candidate"), F.lit(None).cast(both.schema["best"].dataType).alias("best")))
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keep(both.repartitionByRange(parts, *row[:4]).withColumn("part", F.spark_partition_id()), "quotation-candidates")
    # What the last class of a partition hands to the next: one row per partition.
    key = F.struct("conv_id", "class")
    last = ranged.groupBy("part", "conv_id", "class").agg(F.max("best").alias("best")).groupBy("part").agg(F.max(key).alias("key"), F.max_by("best", key).alias("best"))
    handed, at, top = [], None, None
    for r in sorted(last.collect(), key=lambda r: r.part):
        if at is not None and top is not None:
            handed.append((r.part, at["conv_id"], at["class"], top))
        top = max((x for x in (top if r.key == at else None, r.best) if x is not None), default=None)
        at = r.key
    carried = asked.sparkSession.createDataFrame(handed, ranged.select("part", "conv_id", "class", F.col("best").alias("carried")).schema)
    within = F.max("best").over(Window.partitionBy("part", "conv_id", "class").orderBy("at", "candidate").rowsBetween(Window.unboundedPreceding, 0))
    out = ranged.withColumn("best", within).where("candidate = 0").join(F.broadcast(carried), ["part", "conv_id", "class"], "left")
    return out.select("conv_id", F.col("at").alias("turn"), F.greatest("best", "carried").alias("best"))


def _replies(kept: DataFrame, keep) -> DataFrame:
    """conv_id, turn, reply_to of the messages for whose quotes an original is found; ``keep`` writes a table that can go once this is computed."""
    each = kept.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.*")
    keys = F.concat(F.array(F.struct(F.lit(0).alias("kind"), "hash", "size")), F.transform(F.array_distinct("lines"), lambda x: F.struct(F.lit(1).alias("kind"), x["hash"].alias("hash"), x["size"].alias("size"))))
    keyed = lambda df: df.select("conv_id", "turn", F.explode(keys).alias("k")).select("conv_id", "turn", "k.*")

    # Passages and lines (kinds 0 and 1) that somebody quotes are few; only their holders are kept, but all of them.
    quoted = keep(each.where("level > 0"), "quotation-quoted")
    holders = keyed(each.where("level = 0")).join(keyed(quoted).select(_KEY).distinct(), _KEY, "left_semi")
    holders = keep(holders.select(*_KEY, F.col("turn").alias("original")).distinct(), "quotation-holders")
    known = holders.groupBy(_KEY).agg(F.min("original").alias("first"), F.count(F.lit(1)).alias("holders"))
    whole = quoted.join(known.where("kind = 0").select("conv_id", "hash", "size", "first"), ["conv_id", "hash", "size"], "left")
    asks = F.when(F.col("first") < F.col("turn"), F.array(F.struct(F.lit(0).alias("kind"), "hash", "size", F.size("lines").cast("long").alias("n")))).otherwise(
        F.transform("lines", lambda x: F.struct(F.lit(1).alias("kind"), x["hash"].alias("hash"), x["size"].alias("size"), F.lit(1).cast("long").alias("n")))
    )
    items = whole.select("conv_id", "turn", "level", F.explode(asks).alias("i")).select("conv_id", "turn", "level", "i.*").join(known, _KEY).where("first < turn")
    items = items.groupBy("turn", "holders", *_KEY).agg(F.sum(F.when(F.col("level") == 1, F.col("n")).otherwise(0)).alias("near"), F.sum("n").alias("all"))
    asked = items.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("holders", "kind", "hash", "size", "near", "all"))).alias("items"))
    asked = keep(asked.withColumn("class", F.xxhash64("items")), "quotation-asked")

    def parts(of: DataFrame) -> DataFrame:
        return of.dropDuplicates(["conv_id", "class"]).select("conv_id", "class", F.posexplode("items").alias("pos", "i")).select("conv_id", "class", "pos", "i.*").drop("holders")

    def summed(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("conv_id", "class", "original").agg(F.sum("near").alias("near"), F.sum("all").alias("all"))

    some = parts(asked)
    rare = some.where("pos = 0").join(holders, _KEY).select("conv_id", "class", "original")
    first = _best_before(asked, summed(rare.join(some, ["conv_id", "class"]).join(holders, [*_KEY, "original"])), keep)
    # Who holds the rarest part not at all has the rest at most.
    rest = F.aggregate(F.slice("items", 2, F.size("items")), F.struct(F.lit(0).cast("long").alias("near"), F.lit(0).cast("long").alias("all")), lambda a, x: F.struct((a["near"] + x["near"]).alias("near"), (a["all"] + x["all"]).alias("all")))
    first = keep(asked.join(first, ["conv_id", "turn"]).withColumn("sure", F.struct("best.near", "best.all") > rest), "quotation-first")
    open_ = first.where("not sure").drop("best")
    second = _best_before(open_, summed(parts(open_).join(holders, _KEY)), keep)
    return first.where("sure").select("conv_id", "turn", "best").unionByName(second).select("conv_id", "turn", F.col("best.original").alias("reply_to"))


def link_quotations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, reply_to (turn), root (turn), position in the conversation from 0, quoted lines, deepest level, body; one row per row."""
    rows = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    lines = F.col("lines")
    parsed = rows.withColumn("lines", parsed_lines(F.col("text"))).select(
        "conv_id", "turn", "role", lines,
        F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["body"]), "\n").alias("body"),
        F.size(F.filter(lines, lambda x: x["level"] > 0)).cast("long").alias("n_quoted"),
        F.greatest(F.array_max(F.transform(lines, lambda x: x["level"])), F.lit(0)).alias("deepest"),
    )
    # Of its lines a message keeps the hashes.
    norm = F.filter(F.transform(lines, lambda x: F.struct(x["level"].alias("level"), normalised(x["body"]).alias("norm"))), lambda x: x["norm"] != "")
    kept = written(parsed.withColumn("lines", norm).withColumn("passages", passages(F.col("lines"))).drop("lines"), "quotation-parsed")
    done: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        done.append(written(df, name))
        return done[-1]

    links = written(_replies(kept, keep), "quotation-links")
    dropped(*done)

    # Roots by pointer doubling: after k rounds a pointer spans 2**k replies.
    roots = links.select("conv_id", "turn", F.col("reply_to").alias("root"))
    before = None
    while True:
        ahead = roots.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"))
        roots = written(roots.join(ahead, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "quotation-roots")
        if before is not None:
            dropped(before)
        before = roots
        if roots.where("moved").isEmpty():
            break
        roots = roots.drop("moved")
    both = links.join(roots.select("conv_id", "turn", "root"), ["conv_id", "turn"])
    linked = kept.drop("passages").join(both, ["conv_id", "turn"], "left").withColumn("root", F.coalesce("root", "turn"))
    usable = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    linked = linked.withColumn("root", F.when(usable, F.col("root")))

    # Positions: rows fall into ranges of the order; ranks within ranges, offsets of ranges, and the first rank of each conversation.
    order = ["conv_id", "root", "turn", "body"]
    parts = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(linked.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "quotation-ranges")
    dropped(kept, links, roots)
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per partition
    before, total = {}, 0
    for r in sorted(sizes):
        before[r.part], total = total, total + r.n
    offset = F.element_at(F.create_map(*[F.lit(x) for p in before.items() for x in p]), F.col("part")) if before else F.lit(0)
    ranked = ranged.withColumn("rank", (offset + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1).cast("long"))
    # A table of its own, so that the join has plain shuffles on both sides and a large conversation is split.
    starts = written(ranked.groupBy("conv_id").agg(F.min("rank").alias("start")), "quotation-starts")
    out = ranked.join(starts, "conv_id", "left")
    return out.select("conv_id", "turn", "role", "reply_to", "root", F.when(usable, F.col("rank") - F.col("start")).alias("position"), "n_quoted", F.col("deepest").cast("int").alias("deepest"), "body")


def conversation_text(linked: DataFrame, template: str = "<|{role}|>\n{body}\n") -> DataFrame:
    """Each message as the formatted turn of a conversation, to be read in order of (conv_id, position)."""
    head, _, rest = template.partition("{role}")
    middle, _, tail = rest.partition("{body}")
    return linked.select("conv_id", "position", F.concat(F.lit(head), F.coalesce("role", F.lit("")), F.lit(middle), "body", F.lit(tail)).alias("formatted"))
