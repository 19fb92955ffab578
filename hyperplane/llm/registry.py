"""Queries of the operators over the driver's tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"

#: The contract's URL rules: (verdict, host, path).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quotation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quotation import link_quotations

    return link_quotations(table(spark, sf_dir, "conversations"))


OP1_SQL = r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations
), cut AS (
  SELECT rid, conv_id, turn, i, ls[i] AS line, regexp_extract(ls[i], '^[ \t]*(?:>[ \t]?)+') AS marks FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM m)
), levels AS (
  SELECT *, length(regexp_replace(marks, '[^>]', '', 'g')) AS own, substr(line, length(marks) + 1) AS body FROM cut
), lines AS (
  SELECT *, CASE WHEN own = 0 AND lead(own, 1, 0) OVER (PARTITION BY rid ORDER BY i) > 0
    AND regexp_matches(body, '(?i)^[\x09-\x0D\x20]*(on\s.{1,200}\swrote\s?:|le\s.{1,200}\sa écrit\s?:|am\s.{1,200}\sschrieb\s.{0,80}:|el\s.{1,200}\sescribió\s?:|-+ ?original message ?-+)[\x09-\x0D\x20]*$') THEN -1 ELSE own END AS level FROM levels
), bodies AS (
  SELECT rid, coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (WHERE level = 0), '') AS body, count(*) FILTER (WHERE level > 0) AS n_quoted, greatest(max(level), 0) AS deepest FROM lines GROUP BY rid
), kept AS (
  SELECT rid, conv_id, turn, i, level, norm, row_number() OVER (PARTITION BY rid ORDER BY i) - row_number() OVER (PARTITION BY rid, level ORDER BY i) AS run
  FROM (SELECT *, trim(regexp_replace(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+', ' ', 'g')) AS norm FROM lines WHERE conv_id IS NOT NULL AND turn IS NOT NULL) WHERE norm <> ''
), passages AS (
  SELECT row_number() OVER () AS pid, conv_id, turn, level, string_agg(norm, ' ' ORDER BY i) AS whole, list(norm ORDER BY i) AS parts FROM kept GROUP BY rid, conv_id, turn, level, run
), holders AS (
  SELECT DISTINCT conv_id, turn AS original, whole FROM passages WHERE level = 0
), line_holders AS (
  SELECT DISTINCT conv_id, turn AS original, norm FROM kept WHERE level = 0
), whole_credit AS (
  SELECT pid, p.conv_id, p.turn, level, original, len(parts) AS n FROM passages p JOIN holders h ON h.conv_id = p.conv_id AND h.whole = p.whole AND original < p.turn WHERE level > 0
), line_credit AS (
  SELECT q.conv_id, q.turn, level, original, 1 AS n FROM (SELECT conv_id, turn, level, unnest(parts) AS norm FROM passages WHERE level > 0 AND pid NOT IN (SELECT pid FROM whole_credit)) q
  JOIN line_holders h ON h.conv_id = q.conv_id AND h.norm = q.norm AND original < q.turn
), credit AS (
  SELECT conv_id, turn, original, sum(CASE WHEN level = 1 THEN n ELSE 0 END) AS near, sum(n) AS every
  FROM (SELECT conv_id, turn, level, original, n FROM whole_credit UNION ALL SELECT * FROM line_credit) GROUP BY ALL
), links AS (
  SELECT conv_id, turn, arg_max(original, (near, every, original)) AS reply_to FROM credit GROUP BY ALL
), roots AS (
  SELECT DISTINCT conv_id, turn, turn AS root FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND (conv_id, turn) NOT IN (SELECT conv_id, turn FROM links)
  UNION ALL SELECT l.conv_id, l.turn, r.root FROM links l JOIN roots r ON l.conv_id = r.conv_id AND l.reply_to = r.turn
)
SELECT m.conv_id, m.turn, m.role, reply_to, root, CASE WHEN root IS NOT NULL THEN row_number() OVER (PARTITION BY m.conv_id ORDER BY root NULLS FIRST, m.turn NULLS FIRST, body) - 1 END AS position, n_quoted, deepest::int AS deepest, body
FROM m JOIN bodies USING (rid) LEFT JOIN links l ON l.conv_id = m.conv_id AND l.turn = m.turn LEFT JOIN roots r ON r.conv_id = m.conv_id AND r.turn = m.turn
"""


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hit_words", "items")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p : p + 12], ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS key
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, dw.p, dw.n, item_id FROM dw JOIN bw USING (n, key)
), words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::varchar AS i FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_lattice import encode_topk

    return encode_topk(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model", checked=True)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .partenum import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .interpolated_lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op6_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repetition import repetition_coverage

    return repetition_coverage(table(spark, sf_dir, "documents")).drop("ngram_coverage")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_files import read_tokens, write_tokens

    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json"))))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


OP8_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (
  SELECT page_id, min((-(length(h) + length(p)), CASE verdict WHEN 'block' THEN 0 ELSE 1 END, h || p, verdict)) AS best
  FROM u JOIN r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY page_id
)
SELECT u.page_id, u.host, u.path, m.best[3] AS rule,
       coalesce(m.best[4], 'allow') AS verdict
FROM u LEFT JOIN m USING (page_id)
"""


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rff_quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_common_lines

    return drop_common_lines(table(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("text", 256)).drop("text")


OP11_SQL = r"""
WITH l AS (
  SELECT doc_id, i, ls[i] AS line, len(ls) AS n_lines, translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), common AS (
  SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.*, last IS NOT NULL AND doc_id < last AS gone FROM l LEFT JOIN common USING (key)
)
SELECT doc_id, n_lines::bigint AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, n_lines
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .middle_fill import fill_in_middle, restored

    made = fill_in_middle(table(spark, sf_dir, "documents"))
    text = restored(F.col("output"), F.col("form"))
    return made.withColumns({"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(text, 256)}).drop("output")


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256('42:' || doc_id) AS x FROM documents
), h AS (
  SELECT doc_id, text, w, len(w) AS n, ('0x' || x[1:8])::ubigint AS h1, ('0x' || x[9:16])::ubigint AS h2, ('0x' || x[17:24])::ubigint AS h3, ('0x' || x[25:32])::ubigint AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:n], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return manifest(table(spark, sf_dir, "documents"), presented={"n_chars": F.col("n_chars") + 1}, where=tampered).drop("proof", "sides")


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::varchar) || ':' || {0} END"
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang")) + ", {0}, " + _FIELD.format("text") + "))"
#: CRC-32 of the decimal id, byte by byte and bit by bit.
_CRC32 = (
    "xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)), "
    "lambda r, c: list_reduce([xor(r, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))))"
)
OP13_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce(':' || lang, '') AS g, {_LEAF.format(_FIELD.format("n_chars"))} AS leaf,
    CASE WHEN {_CRC32} % 7 = 0 THEN {_LEAF.format(_FIELD.format("(n_chars + 1)"))} END AS changed FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM rows
), tree AS (
  SELECT 0 AS level, g, i, n, leaf AS digest FROM leaves
  UNION ALL SELECT level + 1, g, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY level, g, i // 2, n
), subroots AS (
  SELECT g, digest, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1
), crown AS (
  SELECT 100 AS level, i, n, digest FROM subroots
  UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM crown WHERE n > 1 GROUP BY level, i // 2, n
), folded AS (
  SELECT 0 AS level, g, i AS leaf_i, i, n, coalesce(changed, leaf) AS digest, '' AS proof FROM leaves
  UNION ALL SELECT f.level + 1, f.g, leaf_i, f.i // 2, (f.n + 1) // 2,
    sha256(CASE WHEN f.i % 2 = 1 THEN s.digest || f.digest ELSE f.digest || coalesce(s.digest, '') END), f.proof || coalesce(s.digest, '')
  FROM folded f LEFT JOIN tree s ON s.level = f.level AND s.g = f.g AND s.i = xor(f.i, 1) WHERE f.n > 1
), up AS (
  SELECT 100 AS level, f.g, leaf_i, s.i, s.n, f.digest, f.proof FROM folded f JOIN subroots s USING (g) WHERE f.n = 1
  UNION ALL SELECT f.level + 1, f.g, leaf_i, f.i // 2, (f.n + 1) // 2,
    sha256(CASE WHEN f.i % 2 = 1 THEN s.digest || f.digest ELSE f.digest || coalesce(s.digest, '') END), f.proof || coalesce(s.digest, '')
  FROM up f LEFT JOIN crown s ON s.level = f.level AND s.i = xor(f.i, 1) WHERE f.n > 1
)
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, sha256(u.proof) AS proof_sha256, u.digest AS folded_root, u.digest = r.digest AS verified
FROM leaves l JOIN subroots s USING (g) JOIN up u ON u.g = l.g AND u.leaf_i = l.i AND u.n = 1, (SELECT digest FROM crown WHERE n = 1) r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quotation_threads": op1_quotation_threads,
        "op2_decontaminate": op2_decontaminate,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_language_model": op5_language_model,
        "op6_repetition_coverage": op6_repetition_coverage,
        "op7_token_files": op7_token_files,
        "op8_url_filters": op8_url_filters,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_quality": op10_quality,
        "op11_line_dedup": op11_line_dedup,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quotation_threads": OP1_SQL, "op2_decontaminate": OP2_SQL, "op8_url_filters": OP8_SQL, "op11_line_dedup": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
