"""Retrieval quality: recall at k and mean reciprocal rank, overall and by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall_at(retrieved: Column, expected: Column, k: int) -> Column:
    """Share of the distinct expected ids among the first k; 1 if none is expected."""
    want = F.array_distinct(expected)
    return F.when(F.size(want) == 0, 1.0).otherwise(F.size(F.array_intersect(F.slice(retrieved, 1, k), want)) / F.size(want))


def reciprocal_rank(retrieved: Column, expected: Column) -> Column:
    """1 / rank of the first expected id, 0 without one; 1 if none is expected."""
    first = F.array_min(F.filter(F.transform(expected, lambda e: F.array_position(retrieved, e)), lambda p: p > 0))
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.coalesce(1.0 / first, F.lit(0.0)))


def evaluate(questions: DataFrame, hits: DataFrame, ks: tuple[int, int] = (5, 10)) -> DataFrame:
    """A row per question of questions (qid, expected, category, difficulty) against hits (qid, rank, chunk_id)."""
    ranked = hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("retrieved"))
    rows = questions.join(ranked, "qid", "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<string>")))
    for k in ks:
        rows = rows.withColumn(f"recall_{k}", recall_at(F.col("retrieved"), F.col("expected"), k))
    return rows.withColumn("mrr", reciprocal_rank(F.col("retrieved"), F.col("expected")))


def summary(results: DataFrame, metrics: tuple[str, ...] = ("recall_5", "recall_10", "mrr")) -> DataFrame:
    """Averages in all, by category and by difficulty in one pass."""
    sets = results.groupingSets([["category"], ["difficulty"], []], "category", "difficulty")
    return sets.agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics], F.grouping_id().alias("level"))
