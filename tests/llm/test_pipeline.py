"""The pipeline's stages, each against a brute-force version on what its predecessor kept."""

import collections
import hashlib
import math
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from paperloom.llm import dsir
from paperloom.llm.tokens import encoder
from test_llm import LOWER, WORDS, brute_near

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


def brute_mix(rows, weights=(5, 2, 1), epochs=3):
    """doc_id -> words taken."""
    size = {r.doc_id: len(WORDS.findall(r.text or "")) for r in rows}
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s))
    own = {s: sum(size[r.doc_id] for r in rows if r.source == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    target, free, rest = {}, set(sources), float(sum(size.values()))
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > epochs * own[s]}
        if not over:
            break
        for s in over:
            target[s] = epochs * own[s]
            rest -= target[s]
        free -= over
    target |= share
    taken = {}
    for s in sources:
        whole, left = divmod(math.floor(target[s] + 1e-6), max(own[s], 1))
        for r in sorted((r for r in rows if r.source == s), key=lambda r: (hashlib.md5(f"{r.doc_id}:0".encode()).hexdigest(), r.doc_id)):
            part = min(left, size[r.doc_id])
            left -= part
            taken[r.doc_id] = whole * size[r.doc_id] + part
    return taken


def test_stages(spark):
    docs = corpus_pipeline.documents(spark, DATA)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "exact_dedup", "near_dedup", "mix_sources", "pack_windows"]
    out = {}
    for name, stage in stages.items():
        before = docs
        docs = stage(spark, docs, DATA)
        if name != "pack_windows":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(docs.collect(), docs.schema)  # cuts the plan
        out[name] = (before, docs)
    labels = corpus_pipeline.documents(spark, DATA, "labels")
    before, after = (x.collect() for x in out["quality_classifier"])
    kept = {r.doc_id for r in dsir.weights(out["quality_classifier"][0], labels).filter("kept").collect()}
    assert {r.doc_id for r in after} == kept and {r.doc_id for r in labels.filter("quality = 1").collect()} <= kept and len(kept) < len(before)
    before, after = (x.collect() for x in out["exact_dedup"])
    best = {}
    for r in before:
        key = (r.text or "").encode().translate(LOWER)
        best[key] = max(best.get(key, -1), r.doc_id)
    assert {r.doc_id for r in after} == set(best.values()) and len(after) < len(before)
    before, after = (x.collect() for x in out["near_dedup"])
    assert {r.doc_id for r in after} == {i for i, n, c, k in brute_near([(r.doc_id, r.text) for r in before]) if k or not n} and len(after) < len(before)
    before, after = (x.collect() for x in out["mix_sources"])
    words = collections.Counter()
    for r in after:
        words[r.doc_id] += len(WORDS.findall(r.text))
    assert +words == +collections.Counter(brute_mix(before))
    before, after = out["pack_windows"][0].collect(), out["pack_windows"][1].toPandas()
    tokens = collections.Counter()
    for r in before:
        tokens[r.doc_id] += len(np.frombuffer(encoder().encode(r.text), "<u2")) + 1
    assert after.groupby("doc_id").length.sum().to_dict() == dict(tokens)
    assert (after.groupby("sequence_id").length.sum() <= 2048).all()


def test_run_gives_the_stages_result(spark):
    out = corpus_pipeline.run(spark, DATA).toPandas()
    assert len(out) and set(out.columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}
    again = corpus_pipeline.run(spark, DATA).toPandas()
    assert out.length.sum() == again.length.sum() and out.groupby("doc_id").length.sum().equals(again.groupby("doc_id").length.sum())
