"""Exact vector search: filters first, then the top k."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import ensure_importable


def matches(df: DataFrame, filters: Mapping[str, Any] | None) -> Column:
    """AND of equality, or of membership for lists; a column that isn't there matches nothing."""
    out = F.lit(True)
    for name, value in (filters or {}).items():
        if name not in df.columns:
            return F.lit(False)
        out &= F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value
    return out


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """cosine, inner product, or 1 - squared distance (l2); higher is nearer. A zero vector has similarity 0."""
    if metric == "inner":
        return dot(a, b)
    if metric == "l2":
        squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
        return F.lit(1.0) - F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)
    if metric != "cosine":
        raise ValueError(f"unknown metric {metric}")
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def top_k(vectors: DataFrame, query: Sequence[float], k: int = 10, filters: Mapping[str, Any] | None = None, metric: str = "cosine", id_col: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """The k rows nearest to one query, with `score`; equal scores by id. Each task keeps k rows, nothing is shuffled."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.filter(matches(vectors, filters)).withColumn("score", similarity(F.col(vector), q, metric))
    return rows.orderBy(F.desc("score"), id_col).limit(k)


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", id_col: str = "chunk_id", vector: str = "vector", qid: str = "qid", qvector: str = "qvector", block: int = 1024, most_bytes: int = 256 << 20) -> DataFrame:
    """The k nearest rows of each query, with `score` and `rank` from 1; scores that agree in 12 places rank by id.

    One pass over the vectors serves as many queries as fit in most_bytes (a task's copy of them); more take further
    passes. Matrix products score a tile of `block` queries against so many rows of an Arrow batch that the scores take
    4 MB at most, whatever the tables' sizes, and at most k rows of each query leave a batch: those below k others of
    the task's are left out. Nothing else is shuffled. Vectors that are null or of another dimension than the queries
    are left out.
    """
    if metric not in ("cosine", "inner", "l2"):
        raise ValueError(f"unknown metric {metric}")
    ensure_importable(vectors.sparkSession)
    n, width = queries.agg(F.count("*"), F.max(F.size(qvector))).first()
    queries = queries.filter(F.size(qvector) == F.lit(width or 0))  # a query of another dimension has no hits
    passes = max(1, -(-(n * max(width or 1, 1) * 8) // most_bytes))
    schema = T.StructType([queries.schema[qid], *vectors.schema.fields, T.StructField("score", T.DoubleType())])
    out = None
    for b in range(passes):
        part = queries if passes == 1 else queries.filter(F.pmod(F.xxhash64(qid), F.lit(passes)) == b)
        rows = part.select(qid, qvector).toArrow()
        if not rows.num_rows:
            continue
        names, flat = rows.column(0).combine_chunks(), rows.column(1).combine_chunks()
        q = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
        own = vectors.sparkSession.sparkContext.broadcast((names, q))
        nearest = vectors.mapInArrow(_nearest(own, k, metric, id_col, vector, qid, block), schema)
        out = nearest if out is None else out.unionByName(nearest)
    if out is None:
        return vectors.sparkSession.createDataFrame([], schema.add("rank", T.IntegerType()))
    rank = F.row_number().over(W.partitionBy(qid).orderBy(F.desc(F.round("score", 12)), id_col))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def _best(score: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k largest scores of each column, equal ones by place."""
    if len(score) <= k:
        at, who = np.divmod(np.arange(score.size), score.shape[1])
    else:
        at, who = np.nonzero(~(score < np.partition(score, len(score) - k, 0)[len(score) - k]))
    keep = _first(who, score[at, who], place[at], k)
    return at[keep], who[keep]


def _first(who: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Where the k largest scores of each who are, equal ones by place; no number is above all numbers, as in SQL."""
    order = np.lexsort((place, -np.where(np.isnan(score), np.inf, score), who))
    mine = who[order]
    return order[np.arange(len(mine)) - np.searchsorted(mine, mine) < k]


#: Bytes of the scores that a task has at once, and rows that it hands on at once.
_TILE, _ROWS = 4 << 20, 8192


def _nearest(own, k: int, metric: str, id_col: str, vector: str, qid: str, block: int):
    def scores(v: np.ndarray, q: np.ndarray) -> np.ndarray:
        score = v @ q.T
        if metric == "cosine":
            size = np.multiply.outer(np.sqrt((v * v).sum(1)), np.sqrt((q * q).sum(1)))
            fits = size != 0
            np.divide(score, size, out=score, where=fits)
            score[~fits] = 0
        elif metric == "l2":
            score *= -2
            score += np.add.outer((v * v).sum(1), (q * q).sum(1))
            np.subtract(1, score, out=score)
        return score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = own.value
        wide = max(1, min(block, _TILE // (8 * max(k, 1))))
        least = np.full(len(queries), -np.inf)  # k rows of each query have this score or more, in the batches so far
        for batch in batches:
            column = batch.column(vector)
            fits = np.flatnonzero(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False), nan=-1) == queries.shape[1])
            if not len(fits):
                continue
            if len(fits) < len(batch):
                batch = batch.take(pa.array(fits))
            v = batch.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(len(fits), -1)
            place = np.argsort(np.argsort(np.array(batch.column(id_col).to_pylist(), object), kind="stable"))
            for j in range(0, len(queries), wide):
                q, floor = queries[j : j + wide], least[j : j + wide]
                high = max(1, _TILE // (8 * len(q)))
                at, who, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                for i in range(0, len(v), high):
                    some = scores(v[i : i + high].astype(np.float64), q)
                    a, w = np.nonzero(~(some < floor - (1e-12 + 1e-14 * np.abs(floor))))  # less by what rounding may add
                    if not len(a):
                        continue
                    if len(a) > 4 * k * len(q):
                        some = np.round(some, 12)
                        a, w = _best(some, place[i : i + high], k)
                    at, who, score = np.concatenate([at, a + i]), np.concatenate([who, w]), np.concatenate([score, np.round(some[a, w], 12)])
                    keep = _first(who, score, place[at], k)
                    at, who, score = at[keep], who[keep], score[keep]
                    last = np.flatnonzero(np.arange(len(who)) - np.searchsorted(who, who) == k - 1)
                    floor[who[last]] = np.fmax(floor[who[last]], score[last])
                for b in range(0, len(at), _ROWS):
                    rows = batch.take(pa.array(at[b : b + _ROWS]))
                    yield pa.record_batch([names.take(pa.array(who[b : b + _ROWS] + j)), *rows.columns, pa.array(score[b : b + _ROWS])], [qid, *batch.schema.names, "score"])

    return run
