"""Change detection, chunk diffs, upserts and cache look-ups as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the largest `order`: aggregated map-side, so repeated keys shrink before the shuffle."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns if c not in keys]), order).alias("__r"))
    return best.select(*keys, *[F.col(f"__r.`{c}`").alias(c) for c in rows.columns if c not in keys]).select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new, which win by key."""
    both = old.withColumn("__seq", F.lit(0)).unionByName(new.withColumn("__seq", F.lit(1)))
    return latest(both, keys, "__seq").drop("__seq")


def detect_changes(sitemap: DataFrame, state: DataFrame, base: str = "") -> DataFrame:
    """url, change_type (new, changed, unchanged, removed) of sitemap (loc, lastmod, seq) against state (url, last_modified).

    Unchanged only if both dates are there and equal as strings; of a loc listed twice the later entry counts.
    """
    now = latest(sitemap.filter(F.col("loc").startswith(base)), ["loc"], "seq").select(F.col("loc").alias("url"), "lastmod", F.lit(1).alias("__n"))
    was = state.select("url", "last_modified", F.lit(1).alias("__o"))
    same = (F.coalesce("lastmod", F.lit("")) != "") & (F.col("lastmod") == F.col("last_modified"))
    kind = F.when(F.col("__o").isNull(), "new").when(F.col("__n").isNull(), "removed").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("changed")
    return now.join(was, "url", "full_outer").select("url", kind.alias("change_type"), "lastmod", "last_modified")


def without_sitemap(state: DataFrame, fetches: DataFrame) -> DataFrame:
    """Stored URLs and what a conditional fetch says: 304 unchanged, other answers changed, none skipped."""
    return state.select("url").join(fetches.select("url", "status_code"), "url").withColumn("change_type", F.when(F.col("status_code") == 304, "unchanged").otherwise("changed"))


def diff_chunks(new: DataFrame, old: DataFrame) -> DataFrame:
    """page_url, chunk_id, action (add, updated, unchanged, remove) by content_hash."""
    n = new.select("page_url", "chunk_id", F.col("content_hash").alias("__n"))
    o = old.select("page_url", "chunk_id", F.col("content_hash").alias("__o"))
    kind = F.when(F.col("__o").isNull(), "add").when(F.col("__n").isNull(), "remove").when(F.col("__n") == F.col("__o"), "unchanged").otherwise("updated")
    return n.join(o, ["page_url", "chunk_id"], "full_outer").select("page_url", "chunk_id", kind.alias("action"))


def cache_split(chunks: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """chunks with the cached vector of their hash; null for a miss. Chunks without a hash always miss."""
    known = cache.filter(F.col("model_name") == model).select("content_hash", F.col("vector").alias("cached_vector"))
    return chunks.join(known, "content_hash", "left")


def unseen(links: DataFrame, frontier: DataFrame) -> DataFrame:
    return links.dropDuplicates(["url"]).join(frontier.select("url"), "url", "left_anti")


def frontier_next(frontier: DataFrame, limit: int) -> DataFrame:
    """The pending URLs that come next: by depth, priority, then name."""
    return frontier.filter("status = 'pending'").orderBy("depth", "priority", "url").limit(limit)


def numbered(chunks: DataFrame, page: str, order: str) -> DataFrame:
    w = W.partitionBy(page)
    return chunks.withColumn("chunk_index", F.row_number().over(w.orderBy(order)) - 1).withColumn("total_chunks", F.count("*").over(w))
