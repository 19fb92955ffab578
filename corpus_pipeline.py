"""From raw documents to sampled token ids: five stages, each a table in the shared folder that the next one reads.

quality        documents that the classifier rejects go
near copies    one document, the smallest id, of each group of near copies stays
repeats        strings of 50 bytes that an earlier document holds are cut out
contamination  documents that hold benchmark windows beyond the limit go
tokens         two segmentations of each text are sampled, with inclusion scores

In every stage a null text is an empty one, an empty table gives an empty table,
and columns of any name stay as they are.  Rows with equal ids are one document:
they stay or go together.  Rows without an id are never dropped as copies or
contaminated, as nothing names them.  Texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperplane.llm.decontaminate import contamination
from hyperplane.llm.partenum import jaccard_components
from hyperplane.llm.piece_lattice import encode_topk
from hyperplane.llm.registry import TOKENIZERS, table
from hyperplane.llm.rff_quality import filter_quality
from hyperplane.llm.shared import dropped, without, written
from hyperplane.llm.suffix_dedup import drop_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is at least 0.3.  Empty and null texts are scored like any other.  Without labels all rows stay; labels of
    one kind only decide for all rows."""
    return filter_quality(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the smallest id of each component.  Texts without words link with nothing and stay; ties don't occur, as ids differ."""
    found = written(jaccard_components(docs), "pipeline-components")
    kept = without(docs, found.where("doc_id <> component_id"))
    dropped(found)
    return kept


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that a smaller id holds; rows left without a word, and later copies of whole texts, go.
    Texts that were empty before stay."""
    kept = drop_repeats(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which benchmark windows cover less than a twentieth; without benchmark items, all rows."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.where("contaminated"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two samples of each row, one where a text has a single segmentation; an empty text has one sample without ids."""
    return encode_topk(docs, f"{TOKENIZERS}/piece_bpe_32k.model", checked=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near copies", near_copies),
    ("repeats", repeats),
    ("contamination", benchmark),
    ("tokens", tokens),
]

#: Trained and sampled stages have no SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if before is not None:
            dropped(before)
        before = docs
    return docs
