"""Language identification: known words first, character n-grams for the rest."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom import ensure_importable

from ._util import documents
from .hashing import mix

QUERY = "op7_language_id"
#: Documents that a model is fitted on, at most: of each language, and in all (where there are more languages than
#: that allows, fewer of each, one at least). Every language is learned.
MAX_PER_LANGUAGE, MAX_DOCUMENTS = 500, 20_000
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
#: Bounds of a word as its n-grams see it; no letters.
_OPEN, _CLOSE = 1, 2
#: Numbers (words times languages) that one vectorised pass holds, and characters.
_CELLS, _CHARS = 4_000_000, 1 << 20


@cache
def _letters() -> np.ndarray:
    """Which code points are letters (general category L)."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
        x = np.full(n + 1, b, _U)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _sums(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(1 << max(len(points), 1 << 16).bit_length())
    sums = np.zeros(len(points) + 1, _U)
    np.cumsum(mix(points.astype(_U) + _U(7)) * up[: len(points)], out=sums[1:])
    return sums, down


def _hashes(sums: np.ndarray, down: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each run of code points; equal runs have equal ones wherever they stand."""
    return mix((sums[start + size] - sums[start]) * down[start] + size.astype(_U))


def keys_of(runs: list[str]) -> np.ndarray:
    size = np.array([len(r) for r in runs], np.int64)
    return _hashes(*_sums(code_points("".join(runs))), np.cumsum(size) - size, size)


def _words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of letters."""
    letter = np.zeros(len(points) + 2, bool)
    letter[1:-1] = _letters()[points]
    change = np.flatnonzero(letter[1:] != letter[:-1])
    return change[::2], change[1::2] - change[::2]


def _marked(points: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The given words one after the other, each between bounds: (code points, their starts, their lengths)."""
    full = size + 2
    begin = np.cumsum(full) - full
    out = np.full(full.sum(), _CLOSE, np.uint32)
    out[begin] = _OPEN
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(begin + 1, size) + inner] = points[np.repeat(start, size) + inner]
    return out, begin, full


class Model:
    """Log frequencies by language of words, and of their character n-grams, n = 1 ... `longest`, from 2 on with word ends."""

    def __init__(self, counts: dict[str, Counter], longest: int = 4, least: int = 2, backoff: float = 0.5):
        self.languages = sorted(counts)
        self.longest, self.penalty = longest, math.log(backoff)
        words: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(self.languages)))
        grams: list[dict[str, np.ndarray]] = [defaultdict(lambda: np.zeros(len(self.languages))) for _ in range(longest + 1)]
        for k, language in enumerate(self.languages):
            for word, n in counts[language].items():
                words[word][k] += n
                for size in range(1, longest + 1):
                    for g in self._grams(word, size):
                        grams[size][g][k] += n
        total = sum(words.values(), np.zeros(len(self.languages)))
        self.words = self._table({w: self._log(c, total, len(words)) for w, c in words.items() if c.sum() >= least})
        self.grams = [None]
        for t in grams[1:]:
            sums = sum(t.values(), np.zeros(len(self.languages)))
            self.grams.append(self._table({g: self._log(c, sums, len(t)) for g, c in t.items()}))

    def _table(self, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(sorted keys, their rows)"""
        keys = keys_of(list(rows))
        order = np.argsort(keys)
        return keys[order], np.array(list(rows.values()), np.float32).reshape(len(rows), len(self.languages))[order]

    @staticmethod
    def _log(count: np.ndarray, total: np.ndarray, kinds: int) -> np.ndarray:
        return np.log((count + 0.5) / (total + 0.5 * (kinds + 1))).astype(np.float32)

    @staticmethod
    def _grams(word: str, size: int) -> Iterator[str]:
        word = chr(_OPEN) + word + chr(_CLOSE) if size > 1 else word
        return (word[i : i + size] for i in range(max(len(word) - size + 1, 0)))

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of the table, -1 for a key it lacks)"""
        if not len(table[0]):
            return np.full(len(keys), -1), table[1]
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return np.where(table[0][at] == keys, at, -1), table[1]

    def weigh(self, points: np.ndarray, start: np.ndarray, size: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Log frequencies of words by language; of an unseen one, those of its longest n-grams that are known, on average."""
        at, rows = self._find(self.words, keys)
        out = np.zeros((len(keys), len(self.languages)), np.float32)
        out[at >= 0] = rows[at[at >= 0]]
        left = np.flatnonzero(at < 0)
        for step, n in enumerate(range(self.longest, 0, -1), 1):
            if not len(left):
                break
            if n > 1:
                text, begin, full = _marked(points, start[left], size[left])
            else:  # without bounds
                text, begin, full = points, start[left], size[left]
            count = np.maximum(full - n + 1, 0)
            owner = np.repeat(np.arange(len(left)), count)
            s = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
            g, rows = self._find(self.grams[n], _hashes(*_sums(text), s, np.full(len(s), n)))
            owner, g = owner[g >= 0], g[g >= 0]
            known, first, many = np.unique(owner, return_index=True, return_counts=True)
            if len(known):
                out[left[known]] = np.add.reduceat(rows[g], first, 0) / many[:, None] + np.float32(step * self.penalty)
            left = np.delete(left, known)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(languages, their posteriors); the words' mean log frequency counts as that of ten words at most."""
        total, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for i, j, part in _parts(texts):
            self._add(part, total[i:j], n[i:j])
        some = n > 0 if self.languages else np.zeros(len(texts), bool)
        names, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        if some.any():
            x = total[some] / n[some, None] * np.minimum(n[some], 10)[:, None]
            p = np.exp(x - x.max(1, keepdims=True))
            best = p.argmax(1)
            names[some], score[some] = np.array(self.languages, object)[best], p[np.arange(len(p)), best] / p.sum(1)
        return names.tolist(), score

    def _add(self, lowered: list[str], total: np.ndarray, n: np.ndarray) -> None:
        points = code_points(" ".join(lowered))
        start, size = _words(points)
        if not len(start):
            return
        ends = np.cumsum([len(t) + 1 for t in lowered])
        owner = np.searchsorted(ends, start, "right")
        keys = _hashes(*_sums(points), start, size)
        kinds, first, back = np.unique(keys, return_index=True, return_inverse=True)
        n += np.bincount(owner, minlength=len(n))
        at_once = max(1, _CELLS // max(len(self.languages), 1))
        rows = np.concatenate([self.weigh(points, start[f], size[f], kinds[k : k + at_once]) for k in range(0, len(kinds), at_once) for f in [first[k : k + at_once]]])
        for k in range(0, len(back), at_once):
            own = owner[k : k + at_once]
            known, begin = np.unique(own, return_index=True)
            total[known] += np.add.reduceat(rows[back[k : k + at_once]], begin, 0, np.float64)


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int, list[str]]]:
    """(i, j, the lower-cased texts i to j) of about _CHARS characters together; a longer text in pieces cut between words."""
    now: list[str] = []
    i = room = 0
    for k, t in enumerate(texts):
        low = (t or "").lower()
        if now and (len(low) > room or len(low) > _CHARS):
            yield i, k, now
            now = []
        if len(low) > _CHARS:
            at = 0
            while at < len(low):
                end = len(low)
                if end - at > _CHARS:
                    end = at + _CHARS
                    while end < len(low) and low[end - 1].isalpha():  # a run of letters is never cut
                        end += 1
                yield k, k + 1, [low[at:end]]
                at = end
            continue
        if not now:
            i, room = k, _CHARS
        now.append(low)
        room -= len(low)
    if now:
        yield i, i + len(now), now


def held_out(divisor: int = 4, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor == rest, F.lit(False))


def fit(docs: DataFrame, max_per_language: int = MAX_PER_LANGUAGE, max_documents: int = MAX_DOCUMENTS, **how) -> Model:
    """A model of the texts and lang values of docs. Of each language at most max_per_language documents are read, and
    max_documents in all as long as each language has one: those with the least hash of their text."""
    rows = docs.filter("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("h"), "text")
    least = rows.groupBy("lang", "h").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    ranked = least.withColumn("rank", rank).filter(F.col("rank") <= max_per_language).select("lang", "h", "rank")
    kept = [r["n"] for r in ranked.groupBy("rank").agg(F.count("*").alias("n")).orderBy("rank").collect()]
    most, room = 0, max_documents
    for n in kept:  # how many languages have a document of each rank
        room -= n
        if most and room < 0:
            break
        most += 1
    chosen = ranked.filter(F.col("rank") <= most).select("lang", "h")
    texts = rows.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"])
    words = texts.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("word"))
    counts: dict[str, Counter] = defaultdict(Counter)
    for r in words.groupBy("lang", "word").count().collect():
        counts[r["lang"]][r["word"]] += r["count"]
    return Model(counts, **how)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score; one row per document.

    Only the text is read: lower-cased runs of letters (Unicode category L, so digits, fractions and number forms are
    none), each with the log frequencies by language of the word, or of its longest known n-grams with a penalty for
    each step back. Null texts and texts without a letter give `und` with score 0, as does a model without languages;
    equal scores give the first language by name. Whole texts count, very long ones in pieces cut between words.
    An empty table gives no rows; repeated rows are predicted alike; other columns play no part.
    """
    ensure_importable(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = known.value.predict(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, fit(docs.filter(~held_out())))
