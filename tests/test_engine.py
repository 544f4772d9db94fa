"""Functions and operators of the retrieval engine on small fixtures."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import ids, text
from paperloom.functions import url as U
from paperloom.functions import version as V
from paperloom.operators import changes, chunking, classify, crawl, discovery, embed, evaluate, extract, search
from paperloom.plans.engine import Engine, roll_up
from paperloom.sources import backends, config, tables, web
from paperloom.sources.tables import Tables
from paperloom.streaming import updates


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()["x"]


def many(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("raw, want", [
    ("HTTPS://Docs.X.org/A/B/", "https://docs.x.org/A/B"), ("https://x.org", "https://x.org/"), ("https://x.org/a?b=2&a=1#f", "https://x.org/a?a=1&b=2"),
    ("https://x.org/a?k", "https://x.org/a?k="), ("https://x.org/a//", "https://x.org/a/"), ("https://x.org/a;p=1", "https://x.org/a;p=1"),
])
def test_normal_urls(spark, raw, want):
    assert one(spark, U.normalize(F.col("u")), u=raw) == want


@pytest.mark.parametrize("glob, path, fits", [("/docs/**", "/docs/a/b", True), ("/docs/*", "/docs/a/b", False), ("/d?c", "/doc", True), ("/d?c", "/d/c", False), ("/a.b", "/axb", False)])
def test_globs(glob, path, fits):
    assert bool(re.search(U.glob_regex(glob), path)) == fits


def test_url_filter_and_links(spark):
    allowed = lambda u: one(spark, U.is_allowed(F.col("u"), "https://x.org/docs", ["/docs/**"], ["/docs/private/**"]), u=u)
    assert [allowed(f"https://x.org{p}") for p in ("/docs/a", "/docs/private/a", "/other", "/docs/blog/a", "/docs/a.PDF")] == [True, False, False, False, False]
    assert not allowed("https://y.org/docs/a")
    html = '<a href="b">1</a><link href="/docs/c?z=1#x"><a href="../docs/b"><a href="mailto:a@b"><a href="https://y.org/docs/q"><a href="/img.png">'
    got = one(spark, U.links(F.col("h"), F.lit("https://x.org/docs/a"), "https://x.org/"), h=html)
    assert got == ["https://x.org/docs/b", "https://x.org/docs/c?z=1"]


def test_names_and_crumbs(spark):
    names = many(spark, U.software_name, ["https://docs.foo.com/x", "https://foo.readthedocs.io/en/", "http://www.bar.org", "https://docs.readthedocs.io", "x"])
    assert names == ["foo", "foo", "bar", "readthedocs", "unknown"]
    assert one(spark, U.breadcrumb(F.col("u")), u="https://x.org/a/b-c/d.html?q") == ["a", "b-c", "d"]


def test_versions(spark):
    order = ["latest", "1.0.0-alpha", "1.0.0", "7.2.0", "7.10.0", "17"]
    shuffled = random.Random(1).sample(order, len(order))
    df = spark.createDataFrame([(v,) for v in shuffled], "v string")
    assert [r.v for r in df.orderBy(V.key(F.col("v"))).collect()] == order
    same = df.select((V.key(F.lit("17")) == V.key(F.lit("17.0.0"))).alias("x")).first().x
    assert same
    assert many(spark, V.looks_like, ["v1.2", "3", "1.2-rc", "1.x", "x1", "2.0.stable"]) == [True, True, True, False, False, True]
    assert one(spark, V.of_url(U.path(F.col("u")), "/docs"), u="https://x.org/docs/16/a") == "16"


def test_content_hash_ignores_blanks_and_case(spark):
    a, b, c = many(spark, ids.content_hash, ["  Hello \n world", "hello world ", "hello  there"])
    assert a == b != c and len(a) == 64


WORD = st.text("ab_1 .é\n", max_size=12)


@settings(max_examples=12, deadline=None)
@given(st.lists(WORD, min_size=1, max_size=9), st.integers(1, 8))
def test_folds_equal_the_model(spark, parts, n):
    raw = "\n\n".join(parts)
    split = one(spark, text.split_by_tokens(F.col("t"), n), t=raw)
    assert split == chunking.split_by_tokens(raw, n)
    assert one(spark, text.merge_small(F.split("t", "\n\n", -1), n), t=raw) == chunking.merge_small(raw.split("\n\n"), n)
    assert one(spark, text.overlap(F.split("t", "\n\n", -1), n), t=raw) == chunking.overlap(raw.split("\n\n"), n)


MD = "# Top\nintro\n## Use\nrun it\n```bash\n# not code\npip install x\n```\n### Deep\nmore\n"


def test_markdown_structure(spark):
    assert one(spark, text.headings(F.col("t")), t=MD) == ["Top", "Use", "not code", "Deep"]
    assert [(b.language, b.content) for b in one(spark, text.code_blocks(F.col("t")), t=MD)] == [("bash", "# not code\npip install x")]
    assert one(spark, text.code_languages(F.col("t")), t=MD) == ["bash"]
    assert many(spark, text.code_language, ["SELECT 1", "def f(a):", "nothing here", "docker ps"]) == ["sql", "python", None, "bash"]
    assert many(spark, text.class_language, ["x language-C++", "highlight-go", "highlight", None]) == ["c++", "go", None, None]


def cut(md, strategy, **how):
    return chunking.chunk_texts(md, "T", strategy, **{"least": 0, "n_overlap": 0} | how)


def test_chunk_strategies():
    heads = cut(MD, "heading")
    assert heads[0] == ("Top", "# Top\n\nintro") and heads[1][1].startswith("# Top\n## Use\n\nrun it") and len(heads) == 4
    api = cut("intro\n## f(x)\nbody\n### Parameters\np\n## class A\nz", "api_ref")
    assert [a for a, _ in api] == ["", "f(x)", "Parameters", "class A"]
    steps = cut("lead\n## Step 1 go\n```\n1. no\n```\n2) next\nx", "tutorial")
    assert [a for a, _ in steps] == ["", "Step 1 go", "2) next"]
    code = cut("a\n```sql\nx\n```\nb\n```\nopen", "code")
    assert [t for _, t in code] == ["```sql\nx\n```", "a\nb\n```\nopen"]
    table = "t\n| a | b |\n|---|---|\n" + "\n".join(f"| {k} | {k} |" for k in range(30)) + "\nend"
    parts = cut(table, "table", most=40)
    assert parts[0][1] == "t" and parts[-1][1] == "end" and all(p.startswith("| a | b |\n| 0 | 0 |") for _, p in parts[1:-1]) and len(parts) > 5
    assert cut("", "heading") == [("", "")] and cut("x y z", "heading", target=1, most=1) == [("", "x y z")]


def test_chunks_carry_places_and_overlap(spark):
    pages = spark.createDataFrame([("u1", "T", "# A\n" + "a b c " * 30 + "\n# B\n" + "d e f " * 30, "guide"), ("u2", "T", None, "tutorial")], "url string, title string, markdown string, page_type string")
    out = chunking.chunk_pages(pages, least=10, n_overlap=4).orderBy("url", "chunk_index").collect()
    assert [(r.url, r.chunk_index, r.total_chunks) for r in out] == [("u1", 0, 2), ("u1", 1, 2), ("u2", 0, 1)]
    assert out[1].content.startswith("c a b c\n\n# B") and out[1].section_heading == "B" and not out[0].has_code
    chunking.register("paragraph", chunking.paragraphs, "faq")
    assert chunking.strategy_of("faq") == "paragraph"
    chunking._BY_TYPE.pop("faq")


PAGE = """<html><head><title>Make an index | Site</title><meta name="Generator" content="sphinx"><link rel="canonical" href="https://x.org/c"></head><body>
<nav class="docs"><a href="/">Home</a></nav><div class="breadcrumb"><a>Docs</a><span>SQL</span></div><main><h1>CREATE <em>INDEX</em></h1><p>Builds an index on some_table, see <a href="../alter">alter</a>.
<div class="admonition note"><p class="admonition-title">Note</p><p>Takes a   lock.</p></div><ul><li>one<li>two</ul><pre><code class="language-sql">CREATE INDEX i ON t (a);
</code></pre><table><tr><th>k<th>v</tr><tr><td colspan="2">both</table><img src="/i.png" alt="pic"><footer>foot</footer></main></body></html>"""


def test_extraction(spark):
    got = extract.extract_page(PAGE, "https://x.org/docs/create")
    assert got["title"] == "CREATE INDEX" and got["breadcrumb"] == ["Docs", "SQL"] and got["raw_metadata"] == {"generator": "sphinx", "canonical": "https://x.org/c", "extraction_method": "semantic:main"}
    md = got["markdown"]
    assert md.startswith("# CREATE *INDEX*\n\nBuilds an index on some\\_table, see [alter](https://x.org/alter).")
    assert "> **Note:** Takes a lock." in md and "- one\n- two" in md and "```sql\nCREATE INDEX i ON t (a);\n```" in md and "| both | both |" in md and "![pic](https://x.org/i.png)" in md and "foot" not in md
    assert got["code_blocks"] == [{"language": "sql", "content": "CREATE INDEX i ON t (a);"}]
    rows = extract.extract(spark.createDataFrame([("u", PAGE), ("v", None), ("w", "")], "url string, html string"))
    assert [r.title for r in rows.orderBy("url").collect()] == ["CREATE INDEX", "Untitled", "Untitled"]
    assert one(spark, extract.title(F.col("h")), h="<title>A | B</title>") == "A" and one(spark, extract.title(F.col("h")), h="x") == "Untitled"
    assert extract.html_breadcrumb('<div class="breadcrumbs"><ul><li>a<li> b </ul></div>') == ["a", "b"]
    assert extract.tidy_fences("x\n```\n1 | pip install y\n\n```\nz") == "x\n\n```bash\npip install y\n```\n\nz"
    assert extract.main_content(extract.parse('<div id="content"><p>some longer text</p></div>'), {})[1] == "heuristic"
    assert extract.main_content(extract.parse("<b>x</b>"), {})[1] == "body_fallback"


def test_doc_score(spark):
    assert one(spark, F.round(extract.doc_score(F.col("h")), 2), h="<h1>x</h1><pre><code>y</code></pre><nav>") == 0.65
    assert one(spark, extract.doc_score(F.col("h")), h="pricing login") == 0.0


def test_classification(spark):
    schema = "url string, title string, headings array<string>, markdown string, code_blocks array<struct<language:string,content:string>>, breadcrumb array<string>, raw_metadata map<string,string>"
    rows = [
        ("https://x.org/tutorial/1", "A tutorial", ["Step 1"], "m" * 100, [("text", "c" * 20)], ["Tutorial"], {}),
        ("https://x.org/p", "Plain", ["Notes"], "m", [], [], {}),
        ("https://x.org/faq/", "FAQ", [], "m" * 10, [], ["FAQ"], {"page:class": "faq"}),
        ("https://x.org/ref/1", "Plain", [], "m", [], [], {}),
    ]
    out = classify.classify(spark.createDataFrame(rows, schema), {"reference_paths": ["https://x.org/ref/*"]}).collect()
    assert [r.page_type for r in out] == ["tutorial", "unknown", "faq", "api_reference"]
    assert out[0].confidence == pytest.approx(0.3 + 0.25 + 0.2 + 0.1 * 0.3 + 0.1) and out[1].confidence == 0 and out[3].confidence == 1 and out[2].confidence == pytest.approx(0.7)


def test_search(spark):
    rows = [(f"c{k}", [1.0 if j == k % 4 else 0.0 for j in range(4)], "sw" if k < 8 else "other") for k in range(12)]
    v = spark.createDataFrame(rows, "chunk_id string, vector array<float>, software string")
    hits = search.top_k(v, [1, 0, 0, 0], 3, {"software": "sw"}).collect()
    assert [(r.chunk_id, r.score) for r in hits] == [("c0", 1.0), ("c4", 1.0), ("c1", 0.0)]
    assert search.top_k(v, [1, 0, 0, 0], 3, {"nothing": 1}).count() == 0
    q = spark.createDataFrame([("q1", [0.0, 1.0, 0.0, 0.0]), ("q2", [0.0, 0.0, 0.0, 0.0])], "qid string, qvector array<float>")
    for block in (1, 10):
        got = search.top_k_batch(v, q, 2, block=block).filter("qid = 'q1'").orderBy("rank").collect()
        assert [r.chunk_id for r in got] == ["c1", "c5"]
    assert search.top_k_batch(v, q, 2, most_bytes=32).count() == 4 and search.top_k_batch(v, q.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        search.similarity(F.col("a"), F.col("b"), "other")


@pytest.mark.parametrize("n, k", [(3, 5), (200, 4), (50, 50)])
def test_best_of_a_tile_are_those_of_a_sort(n, k):
    rng = random.Random(n)
    score = np.array([[rng.randrange(5) / 4 for _ in range(7)] for _ in range(n)])
    place = np.array(rng.sample(range(n), n))
    at, who = search._best(score, place, k)
    for j in range(7):
        assert at[who == j].tolist() == sorted(range(n), key=lambda i: (-score[i, j], place[i]))[:k]


@pytest.mark.parametrize("metric", ["cosine", "inner", "l2"])
def test_nearest_takes_the_same_memory_at_every_size(metric):
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    rng = np.random.default_rng(1)
    v, q, k = rng.integers(-3, 4, (12_000, 8)).astype(np.float32), rng.integers(-3, 4, (1500, 8)).astype(float), 3
    v[7] = 0
    ids = rng.permutation(len(v))
    rows = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(v), pa.list_(pa.float32()))], ["id", "vector"])
    own = SimpleNamespace(value=(pa.array(np.arange(len(q))), q))
    tracemalloc.start()
    got = list(search._nearest(own, k, metric, "id", "vector", "qid", 1024)(iter([rows[:9000], rows[9000:]])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20 and max(b.num_rows for b in got) <= search._ROWS
    best = {}
    for b in got:
        for r in b.to_pylist():
            best.setdefault(r["qid"], []).append((-round(r["score"], 12), r["id"]))
    for j in range(0, len(q), 37):
        score = v.astype(float) @ q[j] if metric != "l2" else 1 - ((v - q[j]) ** 2).sum(1)
        if metric == "cosine":
            size = np.linalg.norm(v.astype(float), axis=1) * np.linalg.norm(q[j])
            score = np.divide(score, size, out=np.zeros(len(v)), where=size > 0)
        assert sorted(best[j])[:k] == sorted(zip((-np.round(score, 12)).tolist(), ids.tolist(), strict=True))[:k]


def test_ten_nearest_for_the_metrics_are_found_in_little_memory():
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    v = np.random.default_rng(2).normal(size=(10_000, 8)).astype(np.float32)
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.array(list(v), pa.list_(pa.float32()))], ["vec_id", "vector"])
    own = SimpleNamespace(value=(pa.array(np.arange(0, len(v), 25)), v[::25].astype(float)))
    tracemalloc.start()
    got = [r for b in search._nearest(own, 10, "cosine", "vec_id", "vector", "qid", 1024)(iter([rows])) for r in b.select(["qid", "vec_id"]).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20 and len(got) == 10 * 400
    assert sum(r["qid"] == r["vec_id"] for r in got) == 400


def test_nearest_is_no_number_first(spark):
    v = spark.createDataFrame([("a", [float("nan"), 1.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0])], "chunk_id string, vector array<float>").coalesce(1)
    q = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, qvector array<float>")
    assert [r.chunk_id for r in search.top_k_batch(v, q, 2).orderBy("rank").collect()] == ["a", "b"]
    assert [r.chunk_id for r in search.top_k(v, [1.0, 0.0], 2).collect()] == ["a", "b"]


def test_changes(spark):
    site = spark.createDataFrame([("a", "1", 0), ("b", "2", 0), ("c", None, 0), ("d", "1", 0), ("d", "9", 1)], "loc string, lastmod string, seq int")
    state = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", "9"), ("e", "1")], "url string, last_modified string")
    assert {r.url: r.change_type for r in changes.detect_changes(site, state).collect()} == {"a": "unchanged", "b": "changed", "c": "changed", "d": "unchanged", "e": "removed"}
    old = spark.createDataFrame([("p", "1", "x"), ("p", "2", "y")], "page_url string, chunk_id string, content_hash string")
    new = spark.createDataFrame([("p", "1", "x"), ("p", "2", "z"), ("p", "3", "w")], "page_url string, chunk_id string, content_hash string")
    assert {r.chunk_id: r.action for r in changes.diff_chunks(new, old).collect()} == {"1": "unchanged", "2": "updated", "3": "add"}
    assert {r.chunk_id: r.action for r in changes.diff_chunks(new.filter("chunk_id = '1'"), old).collect()}["2"] == "remove"


def test_evaluation(spark):
    q = spark.createDataFrame([("q1", ["a", "b"], "x", "easy"), ("q2", [], "y", "easy"), ("q3", ["z"], "y", "hard")], "qid string, expected array<string>, category string, difficulty string")
    h = spark.createDataFrame([("q1", 1, "c"), ("q1", 2, "b")], "qid string, rank int, chunk_id string")
    out = evaluate.evaluate(q, h)
    assert {r.qid: (r.recall_5, r.mrr) for r in out.collect()} == {"q1": (0.5, 0.5), "q2": (1.0, 1.0), "q3": (0.0, 0.0)}
    assert {(r.category, r.difficulty): r.n for r in evaluate.summary(out).collect()} == {("x", None): 1, ("y", None): 2, (None, "easy"): 2, (None, "hard"): 1, (None, None): 3}


def test_sitemaps_and_robots(spark, tmp_path):
    flat = '<urlset xmlns="http://s"><url><loc> https://x/a </loc><lastmod>1</lastmod><priority>bad</priority></url><url><loc></loc></url><url><loc>https://x/b?c&amp;d</loc></url></urlset>'
    index = "<sitemapindex><sitemap><loc>flat</loc></sitemap><sitemap><loc>missing</loc></sitemap></sitemapindex>"
    store = spark.createDataFrame([("root", index), ("flat", flat)], "url string, xml string")
    assert [tuple(r)[:3] for r in web.sitemap(store.filter("url = 'flat'")).collect()] == [("https://x/a", "1", None), ("https://x/b?c&d", None, None)]
    assert web.sitemap_tree(store, "root").count() == 2
    (tmp_path / "s.xml").write_text(flat)
    assert {r["loc"] for r in web.sitemap_file(spark, str(tmp_path / "s.xml")).collect()} == {"https://x/a", "https://x/b?c&d"}
    txt = "Sitemap: https://x/s.xml\nUser-agent: other\nDisallow: /z\nUser-agent: *\nDisallow: /private/ # no\nDisallow:\nCrawl-delay: 2"
    r = web.robots(spark.createDataFrame([("x.org", txt)], "host string, robots string")).first()
    assert (r.disallowed, r.crawl_delay, r.sitemaps) == (["/private/"], 2.0, ["https://x/s.xml"])
    urls = spark.createDataFrame([("https://x.org/private/a",), ("https://x.org/b",), ("https://y.org/private/a",)], "url string")
    rules = web.robots(spark.createDataFrame([("x.org", txt)], "host string, robots string"))
    assert web.robots_gate(urls, rules).count() == 2 and web.robots_gate(urls, rules, False).count() == 3


def test_registry_and_discovery(spark, tmp_path):
    (tmp_path / "software").mkdir()
    (tmp_path / "software/b.json").write_text('{"name": "pg", "display_name": "PG", "documentation": {"base_url": "https://pg.org/docs", "versions": {"known_versions": ["17", "16"], "latest": "17"}}}')
    (tmp_path / "software/empty.json").write_text("{}")
    reg = web.registry(spark, str(tmp_path))
    assert [r.name for r in reg.collect()] == ["pg"]
    with pytest.raises(ValueError):
        web.check_entry({"name": "x", "display_name": "X", "documentation": {"base_url": "ftp://x"}})
    out = {r.input: r for r in discovery.resolve(spark.createDataFrame([("pg",), ("https://docs.foo.com/",), ("my-lib",)], "input string"), reg).collect()}
    assert out["pg"].latest_version == "17" and out["https://docs.foo.com/"].name == "foo" and out["my-lib"].display_name == "My Lib" and out["my-lib"].versions == ["latest"]
    urls = spark.createDataFrame([("pg", "https://pg.org/docs/9/a"), ("pg", "https://pg.org/docs/16/a"), ("pg", "https://pg.org/docs/x/a")], "name string, loc string")
    assert discovery.detect(reg, "sitemap", urls).first().versions == ["16", "9"]
    answers = spark.createDataFrame([("https://pg.org/docs/16/", 200, ""), ("https://pg.org/docs/17/", 404, "")], "url string, status_code int, html string")
    assert discovery.detect(reg, "url_enumeration", fetches=answers).first().versions == ["16"]
    assert discovery.detect(reg, "explicit").first().versions == ["17", "16"]
    found = discovery.probe(spark.createDataFrame([("foo",)], "name string"), spark.createDataFrame([("https://docs.foo.com/", 200, "<h1>x</h1><pre><code>")], "url string, status_code int, html string"))
    assert found.first().url == "https://docs.foo.com/"


def test_config(tmp_path):
    (tmp_path / "u.toml").write_text("[chunker]\nmin_chunk_size = 5\ntarget_chunk_size = 100\n")
    c = config.load_config(user_file=str(tmp_path / "u.toml"), project_file=str(tmp_path / "none"), environ={"PAPERLOOM_CHUNKER__TARGET_CHUNK_SIZE": "200", "PAPERLOOM_CRAWLER__RESPECT_ROBOTS": "no"}, overrides={"storage": {"metric": "l2"}})
    assert (c["chunker"]["min_chunk_size"], c["chunker"]["target_chunk_size"], c["crawler"]["respect_robots"], c["storage"]["metric"]) == (5, 200, False, "l2")
    for bad in ({"chunker": {"nothing": 1}}, {"storage": {"metric": "x"}}, {"crawler": {"parallelism": 0}}):
        with pytest.raises(ValueError):
            config.load_config(overrides=bad, environ={}, user_file=str(tmp_path / "none"), project_file=str(tmp_path / "none"))


def test_roll_up():
    assert [roll_up(x) for x in (["failed"], ["failed", "completed"], ["completed"], [])] == ["failed", "partial", "completed", "completed"]


def test_snapshots(spark, tmp_path):
    t = Tables(spark, f"{tmp_path}/t")
    row = lambda v: spark.createDataFrame([("u", "sw", "1", v, None, None, None)], t.read("page_state").schema)
    t.upsert("page_state", row("a"))
    before = t.read("page_state")
    t.upsert("page_state", row("b"))
    assert before.first().content_hash == "a" and t.read("page_state").first().content_hash == "b" and t.read("page_state").count() == 1
    t.delete("page_state", F.col("url") == "u")
    t.vacuum("page_state")
    assert t.read("page_state").count() == 0


def test_writes_touch_their_partitions_alone(spark, tmp_path):
    t = Tables(spark, f"{tmp_path}/t")
    row = lambda u, sw, v, h="a": spark.createDataFrame([(u, sw, v, h, None, None, None)], t.read("page_state").schema)
    t.upsert("page_state", row("u", "s/w%", "1").unionByName(row("u", "s/w%", "2")).unionByName(row("u", "other", "1.10")))
    folders = lambda: {p: f for p, f in t._manifest("page_state")[1]}
    before = folders()
    assert set(before) == {("s/w%", "1"), ("s/w%", "2"), ("other", "1.10")} and t.read("page_state").count() == 3  # one URL in three versions
    t.upsert("page_state", row("u", "s/w%", "2", "b").unionByName(row("w", "s/w%", "2")))
    after = folders()
    assert {p for p in after if after[p] != before[p]} == {("s/w%", "2")}
    assert sorted((r.url, r.software, r.version, r.content_hash) for r in t.read("page_state").collect()) == [("u", "other", "1.10", "a"), ("u", "s/w%", "1", "a"), ("u", "s/w%", "2", "b"), ("w", "s/w%", "2", "a")]
    t.merge("page_state", None, spark.createDataFrame([("w", "s/w%", "2")], "url string, software string, version string"))
    assert t.read("page_state").filter("url = 'w'").count() == 0
    n = t._manifest("page_state")[0]
    t.delete("page_state", F.col("software") == "s/w%")
    assert set(folders()) == {("other", "1.10")} and folders()[("other", "1.10")] == before[("other", "1.10")] and t._manifest("page_state")[0] == n + 1
    assert "PartitionFilters: [isnotnull(software" in t.read("page_state").filter("software = 'other'")._jdf.queryExecution().executedPlan().toString()


def test_concurrent_writers(spark, tmp_path):
    one, two = Tables(spark, f"{tmp_path}/t"), Tables(spark, f"{tmp_path}/t")
    row = lambda u, sw: spark.createDataFrame([(u, sw, "1", "a", None, None, None)], one.read("page_state").schema)
    one.upsert("page_state", row("u", "a").unionByName(row("u", "b")))
    _, seen = two._manifest("page_state")
    one.upsert("page_state", row("w", "a"))
    new = two._write("page_state", row("z", "b"))
    two._commit("page_state", seen, {("b", "1")}, lambda now: [x for x in now if x[0] != ("b", "1")] + new)  # another partition: on top
    assert sorted(r.url for r in one.read("page_state").collect()) == ["u", "w", "z"]
    with pytest.raises(tables.Conflict):
        two._commit("page_state", seen, {("a", "1")}, lambda now: now)


def test_logs_append_and_compact(spark, tmp_path):
    t = Tables(spark, f"{tmp_path}/t")
    for k in range(tables.SEGMENTS + 3):
        t.upsert("crawl_queue", spark.createDataFrame([("u", k, 0, "pending"), (f"u{k}", 0, 0, "pending")], t.read("crawl_queue").schema))
    assert t.read("crawl_queue").count() == tables.SEGMENTS + 4 and t.read("crawl_queue").filter("url = 'u'").first().depth == tables.SEGMENTS + 2
    assert len(t._manifest("crawl_queue")[1]) <= tables.SEGMENTS
    t.delete("crawl_queue", F.col("url") == "u")
    t.vacuum("crawl_queue")
    assert t.read("crawl_queue").count() == tables.SEGMENTS + 3


def site():
    page = lambda k, links, more="": f"<html><head><title>Page {k}</title></head><body><main><h1>Page {k}</h1><p>Text of page {k}. {more}</p>" + "".join(f'<a href="{x}">{x}</a>' for x in links) + "</main></body></html>"
    base = "https://x.org/docs/1/"
    rows = [(base, page(0, ["/docs/1/a", "./1/b", "/blog/z", "/docs/1/private/p"])), (base + "a", page(1, ["b", "c"])), (base + "b", page(2, [])), (base + "c", page(3, ["missing"])), (base + "private/p", page(4, []))]
    return base, [(u.rstrip("/"), 200, h, None, None) for u, h in rows]


def test_crawl_levels_resume_and_limits(spark, tmp_path):
    base, rows = site()
    fetch = crawl.table_fetcher(spark.createDataFrame(rows, crawl.FETCHED))
    rules = spark.createDataFrame([("x.org", ["/docs/1/private/"])], "host string, disallowed array<string>")
    t = Tables(spark, f"{tmp_path}/t")
    got = crawl.crawl(t, [base], fetch, rules, max_pages=2)
    assert got.count() == 2
    got = crawl.crawl(t, [base], fetch, rules, resume=True)
    assert sorted(r.url[-1] for r in got.collect()) == ["1", "a", "b", "c"]
    assert {r.status: r.n for r in crawl.queue_stats(t.read("crawl_queue")).collect()} == {"completed": 4, "failed": 1, "skipped": 1}


def counting(rows, spark):
    """A source that answers from rows and notes what it was asked."""
    asked = []
    inner = crawl.table_fetcher(spark.createDataFrame(rows, crawl.FETCHED))

    def fetch(urls):
        asked.extend(r.asDict() for r in urls.collect())
        return inner(urls)

    return fetch, asked


def test_crawl_obeys_robots_and_its_cache(spark, tmp_path):
    base, rows = site()
    rows = [(u, c, h, f"tag-{k}", "yesterday") for k, (u, c, h, _, _) in enumerate(rows)]
    fetch, asked = counting(rows + [("https://x.org/robots.txt", 200, "User-agent: *\nDisallow: /docs/1/private/", None, None)], spark)
    t = Tables(spark, f"{tmp_path}/t")
    assert crawl.crawl(t, [base], fetch, respect_robots=True).count() == 4
    assert sum(a["url"].endswith("robots.txt") for a in asked) == 1 and not any("private" in a["url"] for a in asked)
    asked.clear()
    assert crawl.crawl(t, [base], fetch, respect_robots=True).count() == 4
    assert {a["url"] for a in asked} == {"https://x.org/robots.txt", "https://x.org/docs/1/missing"}  # the rest from the cache
    t.replace("response_cache", t.read("response_cache").withColumn("expires_at", F.lit("2000-01-01").cast("timestamp")))
    same = [(u, 304, None, None, None) for u, *_ in rows]
    fetch, asked = counting(same, spark)
    assert crawl.crawl(t, [base], fetch).count() == 5 - 1 + 1 and {a["etag"] for a in asked if a["url"].endswith("/a")} == {"tag-1"}
    assert "Text of page 1" in t.read("response_cache").filter("url like '%/a'").first().html and tables.cached(t).count() >= 4
    crawl.clear(t), crawl.clear(t, "response_cache")
    assert t.read("crawl_queue").count() == t.read("response_cache").count() == 0


def test_http_fetcher_tries_again(spark):
    def get(url, etag, last):
        get.n = getattr(get, "n", 0) + 1
        if get.n == 1:
            raise OSError
        return {"status_code": 200, "html": url + (etag or "")}

    urls = spark.createDataFrame([("https://x.org/a",)], "url string")
    assert crawl.http_fetcher(get, attempts=1, hosts=1)(urls).first().html == "https://x.org/a"


def test_engine_from_index_to_delete(spark, tmp_path):
    base, rows = site()
    c = config.load_config(environ={}, user_file="/none", project_file="/none", overrides={"general": {"data_dir": f"{tmp_path}/kb"}, "embeddings": {"model": "bag-256"}, "chunker": {"min_chunk_size": 1}})
    reg = spark.createDataFrame([("sw", "Soft", "https://x.org/docs", None, None, "explicit", ["1"], "1", {}, [], ["/docs/1/private/**"], {})], web.REGISTRY_SCHEMA)
    pages = spark.createDataFrame(rows, crawl.FETCHED)
    heard = []
    with Engine(spark, reg, c) as e:
        e.events.on("*", lambda name, data: heard.append(name))
        r = e.index("sw", fetch=crawl.table_fetcher(pages))
        assert (r.status, r.pages, r.chunks) == ("completed", 4, 4) and heard == ["index_started", "embedding_progress", "index_completed"]
        assert e.stats("sw") == {"software": "sw", "versions": 1, "pages": 4, "chunks": 4}
        best = e.search("missing page 3", "sw", k=2).first()
        assert best.title == "Page 3" and best.score > 0.3
        many = e.search_many(spark.createDataFrame([("q", "page 2")], "qid string, text string"), "sw", k=1).collect()
        assert [r.title for r in many] == ["Page 2"]
        changed = [(u, s, h.replace("Text of page 2", "Fresh words on page 2"), a, b) for u, s, h, a, b in rows if not u.endswith(("c", "p"))] + [("https://x.org/docs/1/new", 200, "<main><h1>New</h1><p>brand new page</p></main>", None, None)]
        u = e.update("sw", pages=spark.createDataFrame(changed, crawl.FETCHED))[0]
        assert u.embedded == 2 and e.stats("sw")["pages"] == 4 and e.search("brand new page", "sw", k=1).first().title == "New"
        assert e.search("page 3", "sw").filter("title = 'Page 3'").count() == 0 and e.search("fresh words", "sw", k=1).first().title == "Page 2"
        assert e.reembed("sw", "hash-8").embedded == 4 and e.search("x", "sw", model="hash-8").count() == 4
        e.set_latest("sw", "1")
        assert e.versions("sw") == ["1"] and e.latest("sw") == "1" and e.list_indexed().first().chunks == 4 and e.runs("sw").count() == 2
        e.delete("sw")
        assert e.list_indexed().count() == 0 and e.tables.read("vectors").count() == 0
        with pytest.raises(ValueError):
            e.stats("sw")
        with pytest.raises(ValueError):
            embed.provider("none")


def knowledge_base(spark, tmp_path, reg=None, **over):
    c = config.load_config(environ={}, user_file="/none", project_file="/none", overrides={"general": {"data_dir": f"{tmp_path}/kb"}, "embeddings": {"model": "bag-256"}, "chunker": {"min_chunk_size": 1}, **over})
    return Engine(spark, reg, c)


def pages_of(spark, host, n, more="", tag=None):
    rows = [(f"https://{host}/docs/{k}", 200, f"<main><h1>Page {k}</h1><p>{host} text {k} {more if k == 1 else ''}</p></main>", tag, None) for k in range(n)]
    return spark.createDataFrame(rows, crawl.FETCHED)


def urls_of(e, software):
    return sorted(r.url for r in e.tables.read("page_state").filter(F.col("software") == software).collect())


def test_update_of_all_keeps_softwares_apart(spark, tmp_path):
    with knowledge_base(spark, tmp_path) as e:
        a, b = pages_of(spark, "a.org", 3), pages_of(spark, "b.org", 2)
        e.index("a", "1", pages=a), e.index("b", "1", pages=b)
        out = e.update(pages=pages_of(spark, "a.org", 2, "new").unionByName(b))
        assert [(r.software, r.status) for r in out] == [("a", "completed"), ("b", "completed")] and set(out[0].seconds) == {"detect", "process", "embed", "store"}
        assert urls_of(e, "a") == ["https://a.org/docs/0", "https://a.org/docs/1"] and urls_of(e, "b") == ["https://b.org/docs/0", "https://b.org/docs/1"]
        assert e.stats("a")["chunks"] == 2 and e.stats("b")["chunks"] == 2
        assert out[0].embedded == 1 and e.search("new", "a", k=1).first().url == "https://a.org/docs/1"


def test_pages_of_two_versions_are_both_kept(spark, tmp_path):
    with knowledge_base(spark, tmp_path) as e:
        e.index("a", "1", pages=pages_of(spark, "a.org", 2)), e.index("a", "2", pages=pages_of(spark, "a.org", 3))
        assert e.stats("a") == {"software": "a", "versions": 2, "pages": 5, "chunks": 5}
        assert e.versions("a") == ["1", "2"] and e.exists("a", "2") and e.version_info("a", "2")["page_count"] == 3
        e.update("a", pages=pages_of(spark, "a.org", 1))
        assert e.tables.read("page_state").groupBy("version").count().orderBy("version").collect() == [("1", 2), ("2", 1)]
        e.set_latest("a", "1")
        assert e._version("a", None) == "1" and e.marked_latest("a") == "1"
        e.delete("a", "1")
        assert e.versions("a") == ["2"] and e.tables.read("chunk_state").count() == 1


def test_update_fetches_under_conditions(spark, tmp_path):
    with knowledge_base(spark, tmp_path) as e:
        e.index("a", "1", pages=pages_of(spark, "a.org", 3, tag="t"))
        now = pages_of(spark, "a.org", 2, "fresh words", tag="t2").filter("url like '%/1'").unionByName(spark.createDataFrame([("https://a.org/docs/0", 304, None, None, None)], crawl.FETCHED))
        asked = []

        def fetch(urls):
            asked.extend(urls.collect())
            return crawl.table_fetcher(now)(urls)

        r = e.update("a", fetch=fetch)[0]  # /0 unchanged, /1 changed, /2 without an answer
        assert (r.status, r.pages, r.embedded) == ("completed", 1, 1) and {x.etag for x in asked} == {"t"} and len(urls_of(e, "a")) == 3
        assert e.tables.read("page_state").filter("url like '%/1'").first().etag == "t2"
        with pytest.raises(ValueError):
            e.update("a")

        def broken(urls):
            raise OSError("no network")

        assert e.update(fetch=broken)[0].status == "failed"
        assert [x.status for x in e.runs("a", 9).collect()].count("failed") == 1


def test_update_by_sitemap_fetches_what_changed(spark, tmp_path):
    reg = spark.createDataFrame([("a", "A", "https://a.org/docs", None, "https://a.org/map.xml", "explicit", ["1"], "1", {}, [], [], {})], web.REGISTRY_SCHEMA)
    entry = lambda k, day: f"<url><loc>https://a.org/docs/{k}</loc><lastmod>2024-01-{day}</lastmod></url>"
    index = ("https://a.org/map.xml", 200, "<sitemapindex><sitemap><loc>https://a.org/sub.xml</loc></sitemap></sitemapindex>", None, None)
    store = lambda days, more="": pages_of(spark, "a.org", 3, more).unionByName(spark.createDataFrame([index, ("https://a.org/sub.xml", 200, "<urlset>" + "".join(entry(k, d) for k, d in days.items()) + "<url><loc>https://b.org/x</loc></url></urlset>", None, None)], crawl.FETCHED))
    with knowledge_base(spark, tmp_path, reg) as e:
        e.index("a", "1", pages=pages_of(spark, "a.org", 2))
        assert e.update("a", fetch=crawl.table_fetcher(store({0: "01", 1: "01", 2: "01"})))[0].pages == 3 and len(urls_of(e, "a")) == 3
        r = e.update("a", fetch=crawl.table_fetcher(store({0: "01", 1: "02"}, "later")))[0]
        assert (r.pages, r.embedded) == (1, 1) and urls_of(e, "a") == ["https://a.org/docs/0", "https://a.org/docs/1"]


def test_index_discovers_places_and_versions(spark, tmp_path):
    doc = "<html><head><title>Tool documentation</title></head><body><nav class='toc'><a href='/guide'>guide</a></nav><main><h1>API reference</h1><p>Tool documentation tutorial guide</p><pre><code>x</code></pre></main></body></html>"
    fetch = crawl.table_fetcher(spark.createDataFrame([("https://docs.tool.com/", 200, doc, None, None), ("https://docs.tool.com", 200, doc, None, None), ("https://z.io/docs/2/", 200, doc, None, None)], crawl.FETCHED))
    reg = spark.createDataFrame([("z", "Zed", "https://z.io/docs", "https://z.io/docs/{version}/", None, "url_enumeration", ["3", "2", "1"], "3", {}, [], [], {})], web.REGISTRY_SCHEMA)
    with knowledge_base(spark, tmp_path, reg, crawler={"respect_robots": False}) as e:
        found = e.discover("tool", fetch)
        assert found["base_url"] == "https://docs.tool.com/" and found["latest_version"] == "latest"
        assert e.index("tool", fetch=fetch).pages == 1 and e.versions("tool") == ["latest"]
        assert e.discover("https://docs.tool.com/", fetch)["base_url"] == "https://docs.tool.com/"
        assert e.discover("z", fetch)["versions"] == ["2"] and e.discover("z")["versions"] == ["3", "2", "1"]
        heard = []
        e.events.on("discovery_failed", lambda name, data: heard.append(data["software"]))
        assert e.discover("z", lambda urls: 1 / 0)["versions"] == ["3", "2", "1"] and heard == ["z"]


def test_extractor_and_classifier_can_be_replaced(spark, tmp_path):
    with knowledge_base(spark, tmp_path) as e:
        e.classifier = lambda pages, hints: pages.withColumn("page_type", F.lit("faq")).withColumn("confidence", F.lit(1.0))
        e.index("a", "1", pages=pages_of(spark, "a.org", 1))
        assert e.vectors.read("a").first().page_type == "faq"


def file_service(at):
    """A service that notes what it is told; a class of its own, so that tasks get it by value."""

    class FileService:
        def _log(self, *what):
            import json
            import uuid

            with open(f"{at}/{uuid.uuid4().hex}.json", "w") as f:
                json.dump(what, f, default=str)

        def upsert(self, collection, points):
            self._log("upsert", collection, points)

        def delete(self, collection, ids):
            self._log("delete", collection, ids)

        def search(self, collection, vector, k, condition):
            self._log("search", collection, condition)
            import json
            import pathlib

            points = [p for f in pathlib.Path(at).glob("*.json") for kind, c, some in [json.loads(f.read_text())] if kind == "upsert" and c == collection for p in some]
            return [(p["id"], sum(x * y for x, y in zip(vector, p["vector"]))) for p in points][:k]

    return FileService


@pytest.mark.parametrize("name", ["qdrant", "weaviate", "chroma", "lance"])
def test_service_backends(spark, tmp_path, name):
    import json

    (tmp_path / "log").mkdir()
    at = str(tmp_path / "log")
    c = config.load_config(environ={}, user_file="/none", project_file="/none", overrides={"general": {"data_dir": f"{tmp_path}/kb"}, "embeddings": {"model": "bag-256"}, "chunker": {"min_chunk_size": 1}})
    c["storage"] |= {"backend": name, "connect": file_service(at), "batch": 2}
    with Engine(spark, None, c) as e:
        e.index("a", "1", pages=pages_of(spark, "a.org", 3))
        e.update("a", pages=pages_of(spark, "a.org", 2))
        log = [json.loads(f.read_text()) for f in (tmp_path / "log").glob("*.json")]
        points = [p for kind, _, some in log if kind == "upsert" for p in some]
        assert len(points) == 3 and sum(len(some) for kind, _, some in log if kind == "delete") == 1 and all(len(p["vector"]) == 256 for p in points)
        hits = e.search("text 1", "a", k=5, filters={"page_type": "unknown", "url": ["x", "y"]}).collect()
        assert len(hits) == 2 and hits[0].score >= hits[1].score and e.stats("a")["chunks"] == 2
        asked = [json.loads(f.read_text())[2] for f in (tmp_path / "log").glob("*.json") if json.loads(f.read_text())[0] == "search"][0]
        assert {"qdrant": lambda x: len(x["must"]) == 2, "weaviate": lambda x: x["operator"] == "And", "chroma": lambda x: len(x["$and"]) == 2, "lance": lambda x: x == "page_type = 'unknown' AND url IN ('x', 'y')"}[name](asked)
    with pytest.raises(ValueError, match="known"):
        backends.backend("nothing", None)
    with pytest.raises(ValueError, match="connect"):
        backends.backend(name, Tables(spark, f"{tmp_path}/t"))


def test_embedding_services(spark):
    asked = []

    def post(url, key, body):
        asked.append((url, key, body))
        return {"data": [{"index": k, "embedding": [float(len(t)), 1.0]} for k, t in reversed(list(enumerate(body["input"])))]}

    for service, model, more in (("openai", "text-embedding-3-small", {"dimensions": 2}), ("voyage", "voyage-3", {"input_type": "document"}), ("jina", "jina-embeddings-v3", {"task": "retrieval.passage"})):
        name = embed.register_service(service, model, "k", f"{service}-test", dimensions=2 if service == "openai" else None, per_second=200, post=post)
        call, size, tokens = embed.provider(name)
        assert call(["a", "bbb"]).tolist() == [[1, 1], [3, 1]] and tokens > 8000 and size == (2 if service == "openai" else 1024)
        assert more.items() <= asked[-1][2].items() and asked[-1][1] == "k" and asked[-1][0].startswith("https://api.")
    with pytest.raises(ValueError):
        embed.register_service("nobody", "m")
    with pytest.raises(ValueError):
        embed.register_service("voyage", "unknown")

    class Local:
        def encode(self, texts, normalize_embeddings):
            return [[1.0, 0.0] for _ in texts]

    name = embed.register_local("bge-small-en", "local-test", load=lambda model: Local())
    assert embed.provider(name)[0](["x"]).shape == (1, 2) and embed.provider(name)[1] == 384 and embed.PRESETS["bge-small-en"][0].startswith("BAAI/")


def test_embedding_holds_a_few_texts_at_a_time(spark):
    def blocks(texts):
        import sys

        return [None if t == "skip" else [sys.getallocatedblocks(), float(len(t))] for t in texts]

    embed.register("blocks-test", blocks, 2)
    rows = spark.range(0, 25_000, 1, 1).selectExpr("id", "case when id % 1000 = 7 then 'skip' when id % 1000 = 8 then null else repeat('x', cast(200 + id % 100 as int)) end as t")
    got = embed.embed_texts(rows, "blocks-test", "t").collect()
    assert {r.id for r in got} == {k for k in range(25_000) if k % 1000 != 7}
    assert all(r.vector[1] == (0 if r.id % 1000 == 8 else 200 + r.id % 100) for r in got)
    held = [r.vector[0] for r in got if r.id >= 2000]
    assert max(held) - min(held) < 5000


def test_own_strategies_reach_tasks_and_failing_pages_are_skipped(spark):
    def fails(markdown, title, target, most):
        if "bad" in markdown:
            raise KeyError("x")
        return [("own", markdown)]

    pages = spark.createDataFrame([("u1", "good text", "t", "guide"), ("u2", "bad text", "t", "guide")], "url string, markdown string, title string, page_type string")
    chunking.register("fails", fails)
    try:
        out = chunking.chunk_pages(pages, least=1, strategy="fails").collect()
        assert [(r.url, r.section_heading) for r in out] == [("u1", "own")]
    finally:
        chunking.STRATEGIES.pop("fails")
    with pytest.raises(ValueError, match="known"):
        chunking.chunk_pages(pages, strategy="fails")


def test_stored_metadata_is_decoded(spark):
    df = spark.createDataFrame([('{"title": "T", "breadcrumb": ["a"], "crawl_timestamp": "2024-01-02T03:04:05+00:00"}', "2024-01-02"), ("broken", "no time"), (None, None)], "m string, t string")
    rows = df.select(backends.decode_metadata(F.col("m")).alias("m"), backends.decode_timestamp(F.col("t")).cast("date").cast("string").alias("d")).collect()
    assert (rows[0].m.title, rows[0].m.breadcrumb, rows[0].m.has_code, rows[0].m.page_type) == ("T", ["a"], False, "unknown") and rows[0].m.crawl_timestamp.year == 2024
    assert rows[1].m.title == rows[2].m.url == "" and [r.d for r in rows] == ["2024-01-02", "1970-01-01", "1970-01-01"]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 0), ("b", 2)], "url string, depth int")
    rows.write.parquet(f"{tmp_path}/urls")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/urls")
    assert updates.to_completion(updates.first_seen(stream), "seen").count() == 2
    events = spark.range(100).select(F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.lit("x").alias("event_type"), F.lit(1.0).alias("value"), (F.col("id") % 3).alias("user_id"))
    events.write.parquet(f"{tmp_path}/events")
    live = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    assert updates.to_completion(updates.windowed_counts(live), "windows", "complete").agg(F.sum("n")).first()[0] == 100
    assert updates.to_completion(updates.sessions(live, "1 hour"), "sessions", "append").count() >= 0
    c = config.load_config(environ={}, user_file="/none", project_file="/none", overrides={"general": {"data_dir": f"{tmp_path}/kb"}, "chunker": {"min_chunk_size": 1}})
    pages = spark.createDataFrame([("u", "<main><p>old</p></main>", 0), ("u", "<main><p>newer</p></main>", 1)], "url string, html string, seq int")
    pages.write.parquet(f"{tmp_path}/pages")
    e = Engine(spark, None, c)
    updates.index_stream(e, spark.readStream.schema(pages.schema).parquet(f"{tmp_path}/pages"), "sw", "1", f"{tmp_path}/cp").awaitTermination()
    assert [r.content for r in e.tables.read("vectors").collect()] == ["newer"]
