"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._util import WORD, Workspace, documents

QUERY = "op2_mix_sources"


def _measures(seed: int) -> list[Column]:
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    return [
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), key.alias("u"),
    ]


def _targets(totals: DataFrame, weights: Sequence[float], max_epochs: float, share: float) -> DataFrame:
    """source, source_size, target; one row per source, so the windows without a partition hold no document rows.

    Sources in the order of cap / weight: the first whose level (what is left, shared by the weights that are left)
    stays below its own cap ends the clamping. That is the fixed point of sharing the excess until none is above.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("ratio", "rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = totals.withColumn("rank", F.row_number().over(by_name))
    t = t.withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    t = t.withColumn("whole", F.lit(float(share)) * F.sum("source_size").over(W.partitionBy()))
    t = t.withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("left", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
    t = t.withColumn("level", (F.col("whole") - F.col("before")) / F.col("left"))
    t = t.withColumn("final", F.min(F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(W.partitionBy()))
    t = t.withColumn("common", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(W.partitionBy())["level"])
    target = F.when(F.col("common").isNull() | (F.col("ratio") < F.col("final")), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("common")))
    return t.select("source", "source_size", target.alias("target"))


def plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 3, share: float = 1.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(sizes of the documents, one row per source with its repetitions and the place where its last one ends).

    A source gives `reps` whole repetitions of every document; of one more repetition, in the seeded order (u, doc_id,
    size), the documents before its `edge` go in whole and those at the edge with `edge_words` words. The edge is
    found through word sums by prefix of the seeded key, so only one prefix per source is put in order.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "mix")
    sizes = ws.save(docs.select(*_measures(seed)), "sizes")
    digits = max(1, math.ceil(math.log(max(sizes.count(), 1) / 20_000 + 1, 16)))
    prefix = F.substring("u", 1, digits)
    by_prefix = ws.save(sizes.groupBy("source", prefix.alias("prefix")).agg(F.sum("size").alias("words"), F.count("*").alias("n")), "prefixes")
    sources = _targets(by_prefix.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs, share)
    some = F.greatest(F.col("source_size"), F.lit(1))
    sources = sources.withColumn("goal", F.floor("target")).withColumn("reps", F.expr("goal div greatest(source_size, 1)"))
    sources = ws.save(sources.withColumn("rest", F.col("goal") - F.col("reps") * some), "sources")
    null_safe = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    ahead = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("prefix").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    crossing = by_prefix.withColumn("ahead", ahead).join(sources.select(F.col("source").alias("s"), "rest"), null_safe("source", "s"))
    crossing = crossing.filter((F.col("ahead") < F.col("rest")) & (F.col("rest") <= F.col("ahead") + F.col("words")))
    crossing = crossing.select("s", F.col("prefix").alias("p"), "ahead", "rest")
    close = sizes.join(crossing, null_safe("source", "s") & (prefix == F.col("p")))
    ties = close.groupBy("s", "p", "ahead", "rest", "u", "doc_id", "size").agg(F.count("*").alias("m"))
    running = W.partitionBy("s", "p").orderBy("u", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    ties = ties.withColumn("at", F.col("ahead") + F.coalesce(F.sum(F.col("size") * F.col("m")).over(running), F.lit(0)))
    edge = ties.filter((F.col("at") < F.col("rest")) & (F.col("rest") <= F.col("at") + F.col("size") * F.col("m")))
    edge = edge.select("s", F.struct("u", "doc_id", "size").alias("edge"), F.expr("(rest - at) div m").alias("edge_words"))
    found = ws.save(sources.join(edge, null_safe("source", "s"), "left").drop("s"), "edges")
    return sizes, found


def _taken() -> tuple[Column, Column]:
    """(words of the last, partial repetition; words taken in all) of a row of sizes joined with its source."""
    own = F.struct("u", "doc_id", "size")
    part = F.when(F.col("edge").isNull(), 0).when(own < F.col("edge"), F.col("size")).when(own == F.col("edge"), F.col("edge_words")).otherwise(0)
    return part.cast("bigint"), (F.col("reps") * F.col("size") + part).cast("bigint")


def _with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per source: broadcast while there are at most 100,000, else shuffled."""
    small = sources.withColumnRenamed("source", "s")
    if sources.count() <= 100_000:
        small = F.broadcast(small)
    return rows.join(small, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def decisions(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    size: words of the text (null: 0). Each source's taken words are its target rounded down; where rows repeat one
    doc_id exactly at a source's edge, they share its words evenly and up to their number less one are left out.
    Null sources are a source of their own, last in order. An empty table gives no rows; sources without words get 0.
    Columns other than doc_id, text and source play no part.
    """
    sizes, sources = plan(docs, **how)
    return _with_sources(sizes, sources).select("doc_id", "source", "size", "source_size", "target", _taken()[1].alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as it is repeated, and its first words for a partial repetition.

    The columns are those of docs, whatever others of their names there are here. Documents without words (null and
    empty texts) are left out as they hold nothing to mix. Repeated rows are documents of their own; of those that tie at
    a source's edge each gives its share of the words. Null sources are one source. An empty table stays empty.
    """
    _, sources = plan(docs, **how)
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), *_measures(how.get("seed", 0)))
    part, taken = _taken()
    rows = _with_sources(rows, sources).withColumn("__part", part).filter(taken > 0)
    copies = F.concat(
        F.array_repeat(F.lit(-1).cast("bigint"), F.col("reps").cast("int") + (F.col("__part") == F.col("size")).cast("int")),
        F.when((F.col("__part") > 0) & (F.col("__part") < F.col("size")), F.array("__part")).otherwise(F.array().cast("array<bigint>")),
    )
    rows = rows.select("__row", F.explode(copies).alias("__words"))
    # at most one document of a source is cut, so the regular expression runs on few rows
    cut = F.expr("array_join(slice(regexp_extract_all(__row.text, '([^\\\\x20\\\\x09-\\\\x0D]+)', 1), 1, cast(__words as int)), ' ')")
    text = F.when(F.col("__words") < 0, F.col("__row.text")).otherwise(cut)
    out = []
    for c in columns:
        if c == "text":
            out.append(text.alias("text"))
        elif c == "n_chars":
            out.append(F.when(F.col("__words") < 0, F.col("__row.n_chars")).otherwise(F.length(cut)).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            out.append(F.col(f"__row.`{c}`").alias(c))
    return rows.select(*out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(documents(spark, sf_dir)).drop("source")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat(doc_id, ':0')) AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM r),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS ratio FROM w),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
       - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
       / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
f AS (SELECT ratio AS final, level AS common FROM l WHERE level <= ratio ORDER BY ratio, rank LIMIT 1),
t AS (SELECT source, source_size,
       CASE WHEN common IS NULL OR ratio < final THEN cap ELSE least(cap, weight * common) END AS target
  FROM l LEFT JOIN f ON TRUE),
g AS (SELECT *, floor(target)::BIGINT // greatest(source_size, 1) AS reps,
       floor(target)::BIGINT - (floor(target)::BIGINT // greatest(source_size, 1)) * greatest(source_size, 1) AS rest FROM t),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY u, doc_id, size
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM d)
SELECT o.doc_id, o.size, g.source_size, g.target,
       (g.reps * o.size + greatest(0, least(o.size, g.rest - o.ahead)))::BIGINT AS taken
FROM o JOIN g ON o.source IS NOT DISTINCT FROM g.source
"""
