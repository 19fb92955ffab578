"""URL filters: pattern rules indexed by their rarest literal token.

A rule has a host, a path and a verdict and compiles to one regular expression
over ``host path``; ``*`` in either stands for any characters of it.  Its literal
tokens are the labels of the host and the whole segments of the path, as far as
they have no ``*``.  Token frequencies over the judged URLs choose the rarest
token of each rule as its index key; a URL fetches the rules keyed by one of its
tokens, and only those rules are matched.  Rules without any literal token are
keyed by the empty token, which every URL has.  Everything on the main path is
DataFrame code.

Tokens of the distinct URLs are joined with the index by key, so that a URL's work
follows the rules it fetches and not their number.  The index is broadcast if
counted small, and met by a shuffle otherwise.  Decisions meet the pages by host
and path; URLs without a fitting rule have none.

The verdict is that of the longest rule that fits, stars not counted; where none
fits it is the one given as default.

Cases: a null URL, or one without ``://``, has an empty host and path, which no
rule with a host fits, and gets the default verdict.  Equal rows give equal results.  A rule
listed twice counts once; of rules that fit with equal length the smaller text
wins, and block before allow.  Only the two named columns are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct labels of the host and segments of the path, and the empty token."""
    return F.array_distinct(F.concat(F.split(host, r"\."), F.split(path, "/"), F.array(F.lit(""))))


def rule_row(rule: tuple[str, str, str]) -> tuple[str, str, str, list[str], int]:
    """(text, verdict, pattern, literal tokens, length) of a rule (verdict, host, path)."""
    verdict, host, path = rule
    # The last segment of the path may go on in the URL, so it is a whole token only if a slash follows.
    whole = [x for x in path.split("/")[:-1] if x]
    tokens = sorted({x for x in (*host.split("."), *whole) if x and "*" not in x})
    pattern = rf"(?s)^(?:[^/]*\.)?{_any(host)}\x00{_any(path)}"
    return host + path, verdict, pattern, tokens or [""], len((host + path).replace("*", ""))


def _any(text: str) -> str:
    """Text as a pattern in which each star stands for any characters of the host or path."""
    return r"[^\x00]*".join(map(re.escape, text.split("*")))


RULE_SCHEMA = "rule string, verdict string, pattern string, tokens array<string>, length int"


def compile_rules(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The rules (verdict, host, path) as a table."""
    return df.sparkSession.createDataFrame([rule_row(x) for x in dict.fromkeys(rules)], RULE_SCHEMA)


def _met(left: DataFrame, right: DataFrame, rules: int, on: str, how: str = "inner") -> DataFrame:
    """left joined with a table of at most a few rows for each of so many rules."""
    return left.join(F.broadcast(right) if rules <= BROADCAST_ROWS // 10 else right, on, how)


def index_rules(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(token, rule, verdict, pattern, length): each rule under that of its literal tokens which the fewest of ``urls`` (host, path) hold."""
    table = compile_rules(urls, rules)
    literal = table.select(F.explode("tokens").alias("token")).distinct()
    tokens = urls.select(F.explode(tokens_of(F.col("host"), F.col("path"))).alias("token"))
    seen = _met(tokens, literal, len(rules), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = table.withColumn("token", F.explode("tokens")).join(seen, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return ranked.groupBy("rule", "verdict", "pattern", "length").agg(F.min_by("token", F.struct("n", "token")).alias("token"))


def decisions(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, hit) of the distinct ``urls`` (host, path) that a rule fits; hit: the longest rule and its verdict."""
    fetched = _met(urls.withColumn("token", F.explode(tokens_of(F.col("host"), F.col("path")))), index_rules(urls, rules), len(rules), "token")
    fits = fetched.where(F.rlike(F.concat("host", F.lit("\x00"), "path"), F.col("pattern")))
    hit = F.struct((-F.col("length")).alias("rank"), (F.col("verdict") != "block").alias("allows"), "rule", "verdict")
    return fits.groupBy("host", "path").agg(F.min(hit).alias("hit"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule (null if none fits) and verdict.

    Without a fitting rule the verdict is ``default``.
    """
    url = F.col("url")
    parsed = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).select("id", host_of(url).alias("host"), path_of(url).alias("path"))
    found = decisions(parsed.select("host", "path").distinct(), list(dict.fromkeys(rules)))
    judged = parsed.join(found, ["host", "path"], "left")
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), F.lit(default)).alias("verdict"))
