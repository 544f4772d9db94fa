"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import Workspace, join_groups


def union(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least label of each of n nodes under the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            deeper = new[new]
            if (deeper == new).all():
                break
            new = deeper
        if (new == label).all():
            return label
        label = new


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = nodes[union(at[: len(a)], at[len(a) :], len(nodes))]
    yield pa.record_batch([pa.array(nodes), pa.array(root)], ["node", "root"])


def _star(ws: Workspace, edges: DataFrame, large: bool, name: str) -> DataFrame:
    """One step of the alternating star contraction: hangs neighbours on the least node around."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = ws.save(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")), f"{name}-least")
    joined = join_groups(both, least, "a", "n")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return ws.save(out.filter("a <> b").distinct(), name)


def components(ws: Workspace, edges: DataFrame, at_once: int = 2_000_000) -> DataFrame:
    """node, root (the least node it can reach) for every node of the edges (a, b), both bigint.

    Up to `at_once` edges fit one task's memory; beyond, rounds of large-star and small-star, each written out, whose
    joins split hubs. Both give the same labels.
    """
    edges = ws.save(edges.filter("a <> b").distinct(), "edges")
    if edges.count() <= at_once:
        return ws.save(edges.coalesce(1).mapInArrow(_in_one_task, "node long, root long"), "roots")
    print_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen, k = None, 0
    while (now := print_of(edges)) != seen:
        seen, k = now, k + 1
        edges = _star(ws, _star(ws, edges, True, f"large-{k}"), False, f"small-{k}")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return ws.save(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots), "roots")
