"""Toxicity scores from an induced lexicon: random walks from labelled seed words over a word graph."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import ensure_importable

from ._util import Workspace, documents
from .hashing import Substrings, mix

QUERY = "op8_toxicity"
_U = np.uint64
#: Labelled documents that seeds and the calibration are fitted on, at most.
MAX_LABELLED = 40_000
#: Toxic seeds, four for each clean one; words to either side of a word that are its neighbours.
SEEDS, WINDOW = 100, 30
#: The least share of a word's weight that an edge has, and of a walk's visits that a word has whose own neighbours
#: are counted: at most 10,000 edges of a word and 2,000 words of a walk at a time, whatever the input.
LEAST_EDGE, LEAST_VISIT = 1e-4, 0.0005
_WORD = re.compile(rb"[a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters (any character beyond ASCII counts as one)."""
    return _WORD.findall(text.lower().encode()) if text else []


def _training(docs: DataFrame, labels: DataFrame, divisor: int, rest: int, most: int) -> DataFrame:
    """doc_id, toxic, text of at most `most` labelled documents, chosen by hash; held-out ids are never read."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(divisor, rest))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")


def held_out(divisor: int = 3, rest: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor == rest, F.lit(False))


def _leanings(train: DataFrame) -> tuple[list[tuple[str, int, int]], int, int]:
    """(word, toxic documents, clean documents with it) of words in 3 documents or more, and both totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, list[int]] = {}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                for w in set(words(text)):
                    seen.setdefault(w, [0, 0])[0 if toxic else 1] += 1
            yield pa.record_batch([pa.array([w.decode(errors="replace") for w in seen], pa.string()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], ["word", "bad", "good"])

    counts = train.mapInArrow(run, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    n = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    # the sample is bounded, so is the number of its words
    found = [(r["word"], r["bad"], r["good"]) for r in counts.filter(F.col("bad") + F.col("good") >= 3).collect()]
    return found, n.get(1, 0), n.get(0, 0)


def _settings(train: DataFrame, candidates: list[str]) -> dict[str, int]:
    """In how many different settings (word before, word after) each candidate stands in toxic documents.

    Copies of one document repeat a word's setting, so a word isn't toxic for being in a text that was copied often.
    """
    wanted = train.sparkSession.sparkContext.broadcast({w.encode() for w in candidates})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for text in batch.column("text").to_pylist():
                own = words(text)
                for k, w in enumerate(own):
                    if w in wanted.value:
                        seen.add((w, b" ".join((own[k - 1] if k else b"", *own[k + 1 : k + 2]))))
            yield pa.record_batch([pa.array([x[0].decode(errors="replace") for x in seen], pa.string()), pa.array([x[1] for x in seen], pa.binary())], ["word", "setting"])

    rows = train.filter("toxic = 1").select("text").mapInArrow(run, "word string, setting binary").distinct()
    return {r["word"]: r["count"] for r in rows.groupBy("word").count().collect()}


def _split(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray]:
    """(hash of each word, offsets by text, words of each text, the text they stand in, starts and ends there)."""
    lowered = [(t or "").lower().encode() for t in texts]
    raw = b" ".join(lowered) + b" "
    buf = np.frombuffer(raw, np.uint8)
    letter = np.zeros(len(buf) + 2, bool)
    letter[1:-1] = (buf >= 128) | ((buf >= 97) & (buf <= 122))
    change = np.flatnonzero(letter[1:] != letter[:-1])
    s, e = change[::2], change[1::2]
    h = mix(Substrings(buf).hash(s, e) + (e - s).astype(_U))
    edges = np.searchsorted(s, np.cumsum([0] + [len(t) + 1 for t in lowered]))
    return h, edges, np.diff(edges), raw, np.stack([s, e])


def _found(h: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the hashes that are among the sorted keys, which key each is)."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == h)
    return hit, at[hit]


def word_keys(vocabulary: list[str]) -> np.ndarray:
    """The hashes of words, in the order of the vocabulary."""
    return np.array([_split([w])[0][0] for w in vocabulary], _U)


def _slices(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    i = total = 0
    for j, t in enumerate(texts):
        if j > i and total + len(t or "") > most:
            yield i, j
            i, total = j, 0
        total += len(t or "")
    if i < len(texts):
        yield i, len(texts)


def word_counts(docs: DataFrame) -> DataFrame:
    """h, word, n: how often each word stands in all documents; counted in each slice before it moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in _slices(texts):
                h, _, _, raw, at = _split(texts[i:j])
                kinds, first, n = np.unique(h, return_index=True, return_counts=True)
                words = [raw[a:b] for a, b in at[:, first].T.tolist()]
                yield pa.record_batch([pa.array(kinds.astype(np.int64)), pa.array(words, pa.binary()), pa.array(n)], ["h", "word", "n"])

    return docs.select("text").mapInArrow(run, "h long, word binary, n long").groupBy("h", "word").agg(F.sum("n").alias("n"))


def neighbours(docs: DataFrame, keys: np.ndarray, window: int = WINDOW) -> DataFrame:
    """u (place in keys), w (hash of a word), n: in how many different settings of u a word stands at most `window`
    words away from it, over all documents. A setting is the word before and the word after u: copies of a text repeat
    it, so being copied makes no two words related; of occurrences in one setting one counts, that with the least
    hash. Each occurrence moves as one row, and pairs of words are counted where they are before they move."""
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast((keys[order], order))

    def near(h: np.ndarray, edges: np.ndarray, place: np.ndarray, which: np.ndarray) -> pa.RecordBatch:
        text = np.searchsorted(edges, place, "right") - 1
        low, high = np.maximum(edges[text], place - window), np.minimum(edges[text + 1], place + window + 1)
        before = np.where(place > edges[text], h[place - 1], _U(0))
        after = np.where(place + 1 < edges[text + 1], h[np.minimum(place + 1, len(h) - 1)], _U(0))
        setting = mix(mix(before * _U(0x9E3779B97F4A7C15) + after) + which.astype(_U))
        count = high - low - 1
        row = np.repeat(np.arange(len(place)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        at += at >= place[row]
        once = np.unique(np.stack([row.astype(_U), h[at]]), axis=1)  # a word counts once for an occurrence
        row = once[0].astype(np.int64)
        offsets = pa.array(np.searchsorted(row, np.arange(len(place) + 1)), pa.int32())
        whole = np.concatenate([[_U(0)], np.cumsum(mix(once[1]), dtype=_U)])
        print_of = whole[offsets.to_numpy()[1:]] - whole[offsets.to_numpy()[:-1]]
        return pa.record_batch([pa.array(which.astype(np.int32)), pa.array(setting.astype(np.int64)), pa.array(print_of.astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(once[1].astype(np.int64)))], ["u", "s", "p", "around"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, order = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in _slices(texts):
                h, edges, *_ = _split(texts[i:j])
                place, at = _found(h, known)
                for k in range(0, len(place), 20_000):
                    yield near(h, edges, place[k : k + 20_000], order[at[k : k + 20_000]])

    rows = docs.select("text").mapInArrow(run, "u int, s long, p long, around array<long>")
    one = rows.groupBy("u", "s").agg(F.min_by("around", "p").alias("around"))
    return one.select("u", F.explode("around").alias("w")).groupBy("u", "w").agg(F.count("*").alias("n"))


def positive_pmi(near: DataFrame, counts: DataFrame, total: int, shift: float = 4.0, deviations: float = 2.0) -> pa.Table:
    """u, w, word (hash and spelling), weight of the edges of the graph: log of how much oftener than by chance a word is
    near u, less log(shift), where that is positive. Of counts, what `deviations` of their own chance leave is taken,
    so a few encounters of rare words are no edge."""
    all_ = near.groupBy("u").agg(F.sum("n").alias("around"))
    sure = F.col("n") - F.lit(deviations) * F.sqrt("n")
    rows = near.filter(sure > 0).join(counts.select(F.col("h").alias("w"), "word", F.col("n").alias("seen")), "w").join(F.broadcast(all_), "u")
    rows = rows.withColumn("weight", F.log(sure * F.lit(float(total)) / (F.col("around") * F.col("seen") * F.lit(shift)))).filter("weight > 0")
    sums = rows.groupBy("u").agg(F.sum("weight").alias("sum"))
    rows = rows.join(F.broadcast(sums), "u").filter(F.col("weight") >= LEAST_EDGE * F.col("sum"))
    return rows.select("u", "w", "word", "weight").toArrow().sort_by([("u", "ascending"), ("w", "ascending")])


def walk(graph: np.ndarray, seeds: np.ndarray, rows: np.ndarray, restart: float = 0.4, evidence: float = 3.0, steps: int = 100) -> np.ndarray:
    """How often a random walk is at each word that returns to a seed with probability `restart` at each step.

    graph holds the edges of the words `rows`; all other words lead back to the seeds, and so does, as far as its
    edges weigh less than `evidence` together, a word that has few or faint ones.
    """
    at, to = np.nonzero(graph)
    return walk_edges(rows[at], to, graph[at, to], seeds, restart, evidence, steps)


def walk_edges(start: np.ndarray, to: np.ndarray, weight: np.ndarray, seeds: np.ndarray, restart: float = 0.4, evidence: float = 3.0, steps: int = 100) -> np.ndarray:
    """walk() over edges given one by one; words that start none lead back to the seeds."""
    p0 = seeds / max(seeds.sum(), 1e-12)
    move = (1 - restart) * weight / np.maximum(np.bincount(start, weight, len(seeds)), evidence)[start]
    new = p = p0
    for _ in range(steps):
        come = np.bincount(to, p[start] * move, len(seeds))
        new = come + (1 - come.sum()) * p0
        if np.abs(new - p).sum() < 1e-9:
            break
        p = new
    return new


class WordGraph:
    """The part of the graph of all words that the walks come to. Rows of words are counted over all documents when a
    walk has brought enough to them, so no vocabulary is fixed in advance."""

    def __init__(self, docs: DataFrame, window: int):
        self.docs, self.window = docs, window
        # rarer words can't have an edge
        self.ws = Workspace(docs.sparkSession, "toxic")
        counts = self.ws.save(word_counts(docs).filter("n > 4"), "words")
        self.total = counts.agg(F.sum("n")).first()[0] or 1
        self.counts = counts
        self.words: dict[int, str] = {}  # hash -> spelling, in the order of the walk's vectors
        self.place: dict[int, int] = {}
        self.counted: set[int] = set()  # places of the words whose neighbours are counted
        self.edges = np.zeros((2, 0), np.int64), np.zeros(0)  # from and to, weights

    def _at(self, h: int, word: str) -> int:
        self.words.setdefault(h, word)
        return self.place.setdefault(h, len(self.place))

    def expand(self, words: list[str]) -> None:
        """Counts the neighbours of words."""
        keys = word_keys(words)
        places = np.array([self._at(int(k.astype(np.int64)), w) for k, w in zip(keys, words)], np.int64)
        self.counted |= set(places.tolist())
        near = self.ws.save(neighbours(self.docs, keys, self.window), f"near-{len(self.counted)}")
        found = positive_pmi(near, self.counts, self.total)
        to = [self._at(w, word.decode(errors="replace")) for w, word in zip(found["w"].to_pylist(), found["word"].to_pylist())]
        pairs, weights = self.edges
        new = np.stack([places[found["u"].to_numpy()], np.array(to, np.int64)])
        self.edges = np.concatenate([pairs, new], 1), np.concatenate([weights, found["weight"].to_numpy()])

    def walk(self, seeds: dict[str, float]) -> np.ndarray:
        """walk() from seeds, in the order of self.words."""
        p0 = np.zeros(len(self.place))
        for w, weight in seeds.items():
            p0[self.place[int(word_keys([w])[0].astype(np.int64))]] = weight
        (start, to), weight = self.edges
        return walk_edges(start, to, weight, p0)

    def follow(self, sides: tuple[dict[str, float], ...], least: float) -> int:
        """Counts the neighbours of the words that the walks from each side come to, then of those that they come to
        from there, and so on, until no word with more than `least` of a walk's visits is left; how many times.

        A word k steps away has at most (1 - restart)^k of the visits, so the rounds end."""
        for rounds in itertools.count():
            names = list(self.words.values())
            near = {names[k] for side in sides for k in np.flatnonzero(self.walk(side) > least).tolist() if k not in self.counted}
            if not near:
                return rounds
            self.expand(sorted(near))


class Lexicon:
    """Words with polarity weights, and the calibration of what they add up to in a text."""

    def __init__(self, vocabulary: list[str], polarity: np.ndarray, coefficients: np.ndarray | None = None):
        order = np.argsort(keys := word_keys(vocabulary))
        self.words = [vocabulary[k] for k in order]
        self.keys, self.polarity = keys[order], polarity[order]
        self.coefficients = coefficients

    def features(self, texts: list[str | None]) -> np.ndarray:
        """By text: the log of one plus its toxic weight, the share of its words that is toxic, one."""
        out = np.zeros((len(texts), 3))
        out[:, 2] = 1
        for i, j in _slices(texts):
            h, edges, n, *_ = _split(texts[i:j])
            place, at = _found(h, self.keys)
            owner = np.searchsorted(edges, place, "right") - 1
            toxic = np.bincount(owner, np.maximum(self.polarity[at], 0), j - i) if len(at) else np.zeros(j - i)
            out[i:j, 0], out[i:j, 1] = np.log1p(toxic), 10 * toxic / np.maximum(n, 1)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.coefficients, -50, 50)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    keep = np.array([ridge] * (x.shape[1] - 1) + [1e-9])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9), x.T @ (p - y) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def seed_words(train: DataFrame, seeds: int = SEEDS) -> tuple[dict[str, float], dict[str, float], int, int]:
    """(toxic seeds, clean seeds, toxic documents, clean documents) of labelled documents; seeds with their weights.

    Toxic seeds lean most to toxic documents: log odds over their standard error, counting different settings in place
    of copies. Clean seeds are words that don't lean to them, of about the toxic seeds' frequency.
    """
    found, bad, good = _leanings(train)
    if not bad or not good:
        return {}, {}, bad, good
    rate = np.array([(b + 0.1) / (bad + 1) / ((g + 0.1) / (good + 1)) for _, b, g in found])
    # few words are twice as frequent in toxic documents or more; the sample bounds their number
    settings = _settings(train, [w for (w, _, _), r in zip(found, rate) if r > 2])
    b = np.array([min(x[1], settings.get(x[0], 0)) if r > 2 else x[1] for x, r in zip(found, rate)])
    g = np.array([x[2] for x in found])
    rate = np.minimum(rate, (b + 0.1) / (bad + 1) / ((g + 0.1) / (good + 1)))
    z = (np.log((b + 0.5) / (bad - b + 0.5)) - np.log((g + 0.5) / (good - g + 0.5))) / np.sqrt(1 / (b + 0.5) + 1 / (g + 0.5))
    toxic = [k for k in np.argsort(-z, kind="stable") if rate[k] > 8 and b[k] >= 3 and z[k] > 3.5][:seeds]
    if not toxic:
        return {}, {}, bad, good
    far = np.abs(np.log((g + 0.5) / (np.median(b[toxic]) * good / bad + 0.5)))
    clean = [k for k in np.argsort(far, kind="stable") if rate[k] < 1.5][: max(seeds // 4, 1)]
    return {found[k][0]: float(z[k]) for k in toxic}, {found[k][0]: 1.0 for k in clean}, bad, good


def induce(docs: DataFrame, labels: DataFrame, divisor: int = 3, rest: int = 1, max_labelled: int = MAX_LABELLED, seeds: int = SEEDS, window: int = WINDOW, least: float = 0.5) -> Lexicon:
    """A lexicon of the words of all documents, from seeds of labelled ones.

    Two random walks, from the toxic and from the clean seeds, over the graph of positive pointwise mutual information
    of words say how near a word is to either side: t and c, visits in units of what the middle seed of that side gets.
    The graph is counted as far as the walks go, however many steps from the seeds (`WordGraph.follow`).
    Polarity is (t - c) / (t + c + 1/4): a seed near other toxic words gets more than one that stands alone, and a word
    that no labelled document holds gets as much as the walk brings there. Words below `least` don't count.
    Labels serve for seeds and for the calibration (logistic regression on two sums over a text's words).
    Without labels of both kinds, or a word that leans to toxic documents, nothing is learned and every score is the
    share of toxic labels. Repeated rows count as often as they are there, but not their settings; null and empty
    texts hold no words; an empty table gives an empty lexicon; other columns play no part.
    """
    ensure_importable(docs.sparkSession)
    train = _training(docs, labels, divisor, rest, max_labelled)
    toxic, clean, bad, good = seed_words(train, seeds)
    if not toxic:
        return Lexicon([], np.zeros(0), np.array([0.0, 0.0, 30.0 if bad and not good else -30.0 if not bad else float(np.log(bad / good))]))
    graph = WordGraph(docs, window)
    graph.expand([*toxic, *(w for w in clean if w not in toxic)])
    graph.follow((toxic, clean), LEAST_VISIT)
    t, c = (_scaled(graph, side) for side in (toxic, clean))
    polarity = (t - c) / (t + c + 0.25)
    chosen = np.flatnonzero(np.abs(polarity) >= least)
    names = list(graph.words.values())
    lexicon = Lexicon([names[k] for k in chosen], polarity[chosen])
    return _calibrated(lexicon, train)


def _scaled(graph: WordGraph, seeds: dict[str, float]) -> np.ndarray:
    """Visits in units of what the middle one of the seeds gets."""
    at = graph.walk(seeds)
    return at / max(float(np.median([at[graph.place[int(k.astype(np.int64))]] for k in word_keys(list(seeds))])), 1e-12)


def _calibrated(lexicon: Lexicon, train: DataFrame) -> Lexicon:
    known = train.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = known.value.features(batch.column("text").to_pylist())
            yield pa.record_batch([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column("toxic")], ["a", "b", "toxic"])

    rows = train.select("text", "toxic").mapInArrow(run, "a double, b double, toxic int").toPandas().sort_values(["a", "b", "toxic"]).to_numpy()
    lexicon.coefficients = _logistic(np.column_stack([rows[:, :2], np.ones(len(rows))]), rows[:, 2])
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, divisor: int = 3, rest: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per document, from its whole text alone.

    Null and empty texts hold no toxic word and score as such. Repeated rows score alike, an empty table gives no
    rows, and columns other than doc_id and text play no part.
    """
    ensure_importable(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = known.value.score(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(x), pa.array((x >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(divisor, rest).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, induce(docs, documents(spark, sf_dir, "labels")))
