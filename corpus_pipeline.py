"""A corpus pipeline: classify, drop copies and near copies, mix the sources, pack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import dsir, exact, minhash, mixing, packing
from paperloom.llm._util import DOCUMENT_COLUMNS, Workspace, documents


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the resampling classifier's sample; the rest are rejected.

    Null and empty texts weigh 0, which is within the sample; repeated rows and ties fare alike; without labels of
    good documents all stay; an empty table stays empty; columns other than those of documents are dropped.
    """
    return dsir.sample(docs, documents(spark, sf_dir, "labels")).select(*DOCUMENT_COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased; null as empty) the one with the largest doc_id.

    Repeated rows are cut to one, null doc_ids stay where alone; an empty table stays empty; other columns are dropped.
    """
    return exact.dedup(docs).select(*DOCUMENT_COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least doc_id.

    Texts without words are in no group and stay; repeated rows are cut to one; an empty table stays empty; other
    columns are dropped.
    """
    return minhash.dedup(docs).select(*DOCUMENT_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix repeats them, and of at most one a source its first words.

    Texts without words go, null sources are one source, repeated rows are documents of their own; an empty table stays
    empty; other columns are dropped.
    """
    return mixing.mix(docs).select(*DOCUMENT_COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens, each source at its share in every window.

    Null and empty texts are their end token alone; repeated rows are packed each; an empty table has no pieces; columns
    other than doc_id, text and source play no part.
    """
    return packing.pack(docs, quantum=32)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_windows", pack_windows),
]
#: Classifier, MinHash and tokens aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = ws.save(docs, name)
    return docs
