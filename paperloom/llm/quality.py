"""Quality rules: per-document counts, and lines that too many documents of a host share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import Workspace, arrow_rows, documents, join_groups, raw_texts, row_key, slices
from .hashing import Substrings, _power, mix, word_bounds

QUERY = "op4_quality_rules"
_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Lines that differ in case or digits alone are one line; so are those that differ in blanks, as words are hashed.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[48:58] = 48
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[edges[1:]] - total[edges[:-1]]


def _sequence(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the word hashes [start, end)."""
    up, down = _power(1, len(h))
    total = np.zeros(len(h) + 1, _U)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))


def measure(texts: list[bytes], repeat: int = 5) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(counts of each text, text of each line that has a word, hash of the normalised line, its number of words)."""
    raw = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(raw, np.uint8)
    edges = np.cumsum([0] + [len(t) + 1 for t in texts])
    s, e = word_bounds(buf)
    size = (e - s).astype(_U)
    exact = Substrings(buf)
    word = mix(exact.hash(s, e) + size)
    plain = mix(Substrings(_PLAIN[buf]).hash(s, e) + size)
    words = np.searchsorted(s, edges)  # offsets of each text's words
    owner = np.repeat(np.arange(len(texts)), np.diff(words))
    blank = np.ones(len(buf), np.int8)
    step = np.zeros(len(buf) + 1, np.int8)
    step[s], step[e] = 1, -1
    blank = np.cumsum(step[:-1], dtype=np.int8) == 0
    out = {"n_words": np.diff(words), "word_chars": _per_text(~blank & ((buf & 0xC0) != 0x80), edges), "n_symbols": _per_text(_SYMBOL[buf], edges)}

    line_end = np.flatnonzero(buf == 10)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    first, last = np.searchsorted(s, line_start), np.searchsorted(s, line_end)
    has = last > first
    line_start, line_end, first, last = line_start[has], line_end[has], first[has], last[has]
    line_of = owner[first] if len(first) else np.zeros(0, np.int64)
    own = mix(exact.hash(line_start, line_end) + (line_end - line_start).astype(_U)) + mix(line_of.astype(_U))
    once = np.unique(own, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(line_of, minlength=len(texts)) - np.bincount(line_of[once], minlength=len(texts))

    covered = np.zeros(len(word) + 1, np.int64)
    n = len(word) - repeat + 1
    if n > 0:
        at = np.flatnonzero(owner[:n] == owner[repeat - 1 :])
        gram = np.zeros(len(at), _U)
        for k in range(repeat):
            gram = mix(gram * _U(0x9E3779B97F4A7C15) + word[at + k])
        _, back, seen = np.unique(gram + mix(owner[at].astype(_U)), return_inverse=True, return_counts=True)
        again = at[seen[back] > 1]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + repeat, -1)
    out["n_repeat_words"] = _per_text(np.cumsum(covered[:-1]) > 0, words)
    return out, line_of, _sequence(plain, first, last), last - first


def _measured(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    texts = raw_texts(batch.column("text"))
    for i, j in slices(texts):
        counts, owner, line, size = measure(texts[i:j])
        # the distinct lines of each text with the words they hold there together
        order = np.lexsort((line, owner))
        owner, line, size = owner[order], line[order], size[order]
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(new)
        size = np.add.reduceat(size, begin) if len(begin) else size
        offsets = pa.array(np.searchsorted(owner[begin], np.arange(j - i + 1)), pa.int32())
        some = batch.slice(i, j - i)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64))) for x in (line[begin], size)]
        same = [some.column(c) for c in ("uid", "doc_id", "__h", "th", "host")]
        yield pa.record_batch([*same, *(pa.array(counts[c].astype(np.int64)) for c in COUNTS), *lists], ["uid", "doc_id", "__h", "th", "host", *COUNTS, "lines", "line_words"])


def _host() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def _judged(docs: DataFrame, least: int, power: float) -> tuple[Workspace, DataFrame, DataFrame]:
    """(workspace, measured documents, host and line of lines above the limit)."""
    ws = Workspace(docs.sparkSession, "quality")
    _, h = row_key()
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), h, F.xxhash64("text").alias("th"), _host().alias("host"), "text")
    schema = "uid long, doc_id long, __h long, th long, host string, " + ", ".join(f"{c} long" for c in COUNTS) + ", lines array<long>, line_words array<long>"
    rows = ws.save(arrow_rows(rows, _measured, schema), "measured")
    texts = rows.groupBy("host", "th").agg(F.any_value("lines").alias("lines"))
    hosts = rows.select("host", "th").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    common = texts.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("docs_with")).filter(F.col("docs_with") > least)
    bad = common.join(hosts, "host").filter(F.col("docs_with") > F.greatest(F.lit(float(least)), F.pow(F.col("docs").cast("double"), F.lit(power))))
    return ws, rows, ws.save(bad.select("host", "line", "docs_with"), "common")


def _removed(ws: Workspace, rows: DataFrame, bad: DataFrame) -> DataFrame:
    """uid, words and hashes of the lines that go, for the documents that have such."""
    pairs = rows.select("uid", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("uid", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    # docs_with counts texts; copies of a text make a key hotter, so rows are counted anew
    counted = pairs.join(F.broadcast(bad.select("host", "line")), ["host", "line"]) if bad.count() <= 100_000 else None
    if counted is None:
        keys = ws.save(pairs.groupBy("host", "line").agg(F.count("*").alias("m")).join(bad.select("host", "line"), ["host", "line"]), "common-rows")
        counted = join_groups(pairs, keys, ["host", "line"], "m")
    return counted.groupBy("uid").agg(F.sum("words").alias("lost"), F.collect_list("line").alias("gone"))


def verdicts(docs: DataFrame, least: int = 20, power: float = 1 / 3, depleted: int = 50, min_words: int = 10, max_repeat: int = 20) -> DataFrame:
    """One row per document: doc_id, __h, the counts, base_failed, n_removed_words, kept, gone (hashes of its lines that go).

    Words are runs without ASCII blanks. base_failed: fewer than min_words words, or more than max_repeat percent of
    words in 5-word windows found twice or more. Lines are normalised (A-Z lower-cased, digits alike, blanks
    collapsed) and hashed; in each host (source; null is one more host) the distinct texts with a line are counted,
    and lines of more than max(least, the host's distinct texts ** power) go: 20 up to 8,000 texts, 150 of 3.3 million. A document that loses more than
    `depleted` percent of its words is not kept. Exact copies count once, so being copied makes no line common.
    Null and empty texts have no words and fail the base rule. Repeated rows are judged alike, an empty table gives
    no rows, and columns other than doc_id, text and source play no part.
    """
    ws, rows, bad = _judged(docs, least, power)
    out = rows.drop("lines", "line_words").join(_removed(ws, rows, bad), "uid", "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    lost = F.coalesce("lost", F.lit(0))
    return out.select("doc_id", "__h", *COUNTS, failed.alias("base_failed"), lost.alias("n_removed_words"), (~failed & (100 * lost <= depleted * F.col("n_words"))).alias("kept"), "gone")


def clean(docs: DataFrame, **how) -> DataFrame:
    """The documents that are kept, without their common lines; all columns, whatever their names. Equal rows of one
    doc_id stay as many; null and empty texts fail the base rule and go; an empty table stays empty."""
    ws = Workspace(docs.sparkSession, "quality-rows")
    kept = verdicts(docs, **how).filter("kept").groupBy("doc_id", "__h").agg(F.any_value("gone").alias("__gone"))
    kept = ws.save(kept.withColumnRenamed("doc_id", "__a").withColumnRenamed("__h", "__b"), "kept")
    columns = docs.columns

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = []
        for text, gone in zip(raw_texts(batch.column("text")), batch.column("__gone").to_pylist()):
            if gone:
                lines, gone = text.split(b"\n"), set(gone)
                with_word = [k for k, x in enumerate(lines) if x.split()]
                hashes = measure([text])[2].astype(np.int64).tolist()
                drop = {k for k, h in zip(with_word, hashes) if h in gone}
                text = b"\n".join(x for k, x in enumerate(lines) if k not in drop)
            texts.append(text.decode())
        out = batch.drop_columns(["__gone"])
        k = out.schema.get_field_index("text")
        yield out.set_column(k, "text", pa.array(texts, out.schema.field(k).type))

    same = F.col("__id").eqNullSafe(F.col("__a")) & (F.col("__h") == F.col("__b"))
    rows = docs.select("*", *row_key()).join(kept.hint("shuffle_hash"), same).select(*columns, "__gone")
    return arrow_rows(rows, cut, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(documents(spark, sf_dir)).select("doc_id", *COUNTS, "base_failed", "kept")
