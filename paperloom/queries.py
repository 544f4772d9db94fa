"""The registered queries of the retrieval engine, each with the DuckDB SQL whose rows it equals (where SQL can say it)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ensure_importable, spread
from .functions import ids, text
from .functions import url as U
from .functions import version as V
from .operators import changes, chunking, classify, crawl, discovery, embed, evaluate, extract, search
from .plans import engine
from .sources import backends, web
from .streaming import updates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str, busy: bool = False) -> DataFrame:
    """busy: for queries that compute much on each row; small files then use all cores."""
    ensure_importable(spark)
    rows = spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")
    return spread(rows) if busy else rows


def six(c):
    return F.round(c, 6)


# -- vector search

_UNIT = "SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings"


def _first(spark: SparkSession, sf: str) -> list[float]:
    """A query vector: the one stored under id 0."""
    return list(table(spark, sf, "embeddings").filter("vec_id = 0").first()["embedding"])


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").withColumnRenamed("embedding", "vector")


@query(f"WITH e AS ({_UNIT}) SELECT a.vec_id, round(list_inner_product(a.v, b.v) / (a.n * b.n), 6) AS score FROM e a, e b WHERE b.vec_id = 0 ORDER BY list_inner_product(a.v, b.v) / (a.n * b.n) DESC, a.vec_id LIMIT 10")
def vector_topk(spark, sf):
    return search.top_k(_vectors(spark, sf), _first(spark, sf), 10, id_col="vec_id").select("vec_id", six("score").alias("score"))


@query(f"WITH e AS ({_UNIT}) SELECT a.vec_id, a.label, round(list_inner_product(a.v, b.v) / (a.n * b.n), 6) AS score FROM e a, e b WHERE b.vec_id = 0 AND a.label IN (1, 2, 3) ORDER BY list_inner_product(a.v, b.v) / (a.n * b.n) DESC, a.vec_id LIMIT 10")
def vector_topk_filtered(spark, sf):
    return search.top_k(_vectors(spark, sf), _first(spark, sf), 10, {"label": [1, 2, 3]}, id_col="vec_id").select("vec_id", "label", six("score").alias("score"))


@query(f"WITH e AS ({_UNIT}) SELECT a.vec_id, round(1 - list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6) AS score FROM e a, e b WHERE b.vec_id = 0 ORDER BY 1 - list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) DESC, a.vec_id LIMIT 10")
def vector_topk_l2(spark, sf):
    return search.top_k(_vectors(spark, sf), _first(spark, sf), 10, metric="l2", id_col="vec_id").select("vec_id", six("score").alias("score"))


_BATCH = f"""e AS ({_UNIT}), r AS (SELECT q.vec_id AS qid, a.vec_id, a.label, q.label AS qlabel, round(list_inner_product(a.v, q.v) / (a.n * q.n), 6) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(a.v, q.v) / (a.n * q.n) DESC, a.vec_id) AS rank
  FROM e a, e q WHERE q.vec_id % 25 = 0)"""


def _batch(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """Every 25th vector as a query against all of them."""
    q = table(spark, sf, "embeddings").filter("vec_id % 25 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("qlabel"), F.col("embedding").alias("qvector"))
    hits = search.top_k_batch(_vectors(spark, sf), q, k, id_col="vec_id")
    return hits.join(F.broadcast(q.select("qid", "qlabel")), "qid")


@query(f"WITH {_BATCH} SELECT qid, vec_id, score, rank FROM r WHERE rank <= 5")
def vector_topk_batch(spark, sf):
    return _batch(spark, sf, 5).select("qid", "vec_id", six("score").alias("score"), F.col("rank").cast("long").alias("rank"))


def _hundredth(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvector"))


def _hundredths(score: str, where: str = "") -> str:
    """SQL of the ten nearest rows of every 100th vector."""
    return f"""WITH e AS ({_UNIT}), s AS (SELECT q.vec_id AS qid, a.vec_id, a.label, {score} AS s FROM e a, e q WHERE q.vec_id % 100 = 0 {where}),
  r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 12) DESC, vec_id) AS rank FROM s) SELECT qid, vec_id, label, round(s, 6) AS score, rank FROM r WHERE rank <= 10"""


@query(_hundredths("list_inner_product(a.v, q.v) / (a.n * q.n)", "AND a.label IN (1, 2, 3)"))
def vector_topk_filtered_batch(spark, sf):
    v = _vectors(spark, sf)
    hits = search.top_k_batch(v.filter(search.matches(v, {"label": [1, 2, 3]})), _hundredth(spark, sf), 10, id_col="vec_id")
    return hits.select("qid", "vec_id", "label", six("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_hundredths("1 - list_sum(list_transform(list_zip(a.v, q.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"))
def vector_topk_l2_batch(spark, sf):
    hits = search.top_k_batch(_vectors(spark, sf), _hundredth(spark, sf), 10, metric="l2", id_col="vec_id")
    return hits.select("qid", "vec_id", "label", six("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT label, count(*) AS n, round(avg(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS mean_norm FROM embeddings GROUP BY label")
def vector_count(spark, sf):
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"), six(F.avg(search.norm(F.col("embedding")))).alias("mean_norm"))


@query("SELECT label, count(*) AS n FROM embeddings WHERE NOT (label = 0) GROUP BY label")
def vector_delete(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.filter(~search.matches(e, {"label": 0})).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (WHERE FALSE) AS n FROM embeddings")
def filter_missing_key(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.filter(search.matches(e, {"software": "x"})).agg(F.count("*").alias("n"))


@query("SELECT label, list_aggregate(vs, 'count') AS n, lo FROM (SELECT label, list(vec_id) AS vs, min(vec_id) AS lo FROM embeddings GROUP BY label)")
def vector_read_back(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label").groupBy("label").agg(F.size(F.collect_list("vec_id")).cast("long").alias("n"), F.min("vec_id").alias("lo"))


# -- identifiers

@query(r"SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')))) AS content_hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents", busy=True).select("doc_id", ids.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, sha256(concat_ws('|', source, lang, 'u/' || doc_id, 'h' || doc_id % 3, (doc_id % 7)::VARCHAR)) AS chunk_id FROM documents")
def chunk_id(spark, sf):
    d = table(spark, sf, "documents")
    url, heading = F.concat(F.lit("u/"), F.col("doc_id")), F.concat(F.lit("h"), F.col("doc_id") % 3)
    return d.select("doc_id", ids.chunk_id(F.col("source"), F.col("lang"), url, heading, F.col("doc_id") % 7).alias("chunk_id"))


@query("SELECT page_id, sha256(concat_ws('|', url, 'Page ' || page_id)) AS pid FROM pages")
def page_ids(spark, sf):
    return table(spark, sf, "pages").select("page_id", ids.page_id(F.col("url"), F.concat(F.lit("Page "), F.col("page_id"))).alias("pid"))


@query("SELECT DISTINCT source, lang, concat_ws('_', source, lang, substr(md5(translate(lower('BAAI/bge-Small.en'), '/-.', '___')), 1, 8)) AS name FROM documents")
def collection_name(spark, sf):
    return table(spark, sf, "documents").select("source", "lang").distinct().select("source", "lang", ids.collection(F.col("source"), F.col("lang"), F.lit("BAAI/bge-Small.en")).alias("name"))


# -- text

_TOK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"


@query(rf"SELECT doc_id, length(regexp_extract_all(text, '{_TOK}')) AS n_tokens FROM documents")
def token_count(spark, sf):
    return table(spark, sf, "documents", busy=True).select("doc_id", text.token_count(F.col("text")).cast("long").alias("n_tokens"))


_SPLIT = rf"""p AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: {{'t': x, 'n': length(regexp_extract_all(x, '{_TOK}'))}}) AS parts,
  length(regexp_extract_all(text, '{_TOK}')) AS total, text FROM documents),
f AS (SELECT doc_id, text, total, list_reduce(parts, lambda a, x: CASE WHEN length(a.out) > 0 AND a.n + x.n <= 128
  THEN {{'out': list_concat(a.out[:-2], [a.out[-1] || chr(10) || x.t]), 'n': a.n + x.n}}
  ELSE {{'out': list_append(a.out, x.t), 'n': x.n}} END, {{'out': []::VARCHAR[], 'n': 0::BIGINT}}) AS acc FROM p),
s AS (SELECT doc_id, CASE WHEN total <= 128 THEN [text] ELSE acc.out END AS parts FROM f)"""


@query(f"WITH {_SPLIT} SELECT doc_id, length(parts) AS n, md5(array_to_string(parts, '~')) AS digest FROM s")
def split_by_tokens(spark, sf):
    parts = text.split_by_tokens(F.col("text"), 128, "\n")
    return table(spark, sf, "documents", busy=True).select("doc_id", parts.alias("p")).select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "~")).alias("digest"))


_MERGE = rf"""m AS (SELECT doc_id, list_reduce(string_split(text, chr(10)), lambda a, x: CASE
  WHEN length(a) > 0 AND length(regexp_extract_all(a[-1], '{_TOK}')) < 64 THEN list_concat(a[:-2], [a[-1] || chr(10) || chr(10) || x])
  ELSE list_append(a, x) END, []::VARCHAR[]) AS parts FROM documents)"""


@query(f"WITH {_MERGE} SELECT doc_id, length(parts) AS n, md5(array_to_string(parts, '~')) AS digest FROM m")
def merge_small(spark, sf):
    parts = text.merge_small(F.split("text", "\n", -1), 64)
    return table(spark, sf, "documents", busy=True).select("doc_id", parts.alias("p")).select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "~")).alias("digest"))


@query(rf"""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents), e AS (SELECT doc_id, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM p),
w AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM e),
k AS (SELECT *, regexp_extract_all(b, '{_TOK}') AS toks FROM w),
o AS (SELECT *, CASE WHEN i = 1 THEN '' WHEN length(toks) <= 8 THEN b ELSE array_to_string(toks[-8:], ' ') END AS lead FROM k)
SELECT doc_id, i::BIGINT - 1 AS chunk_index, md5(CASE WHEN lead = '' THEN x ELSE lead || chr(10) || chr(10) || x END) AS digest FROM o""")
def overlap_tail(spark, sf):
    parts = text.overlap(F.split("text", "\n", -1), 8)
    return table(spark, sf, "documents", busy=True).select("doc_id", F.posexplode(parts).alias("chunk_index", "x")).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("x").alias("digest"))


#: Markdown made of the documents' lines, the same on both sides: headings, fences and steps by line number.
_LINES = """ln AS (SELECT doc_id, source, unnest(t) AS x, generate_subscripts(t, 1)::BIGINT AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS t FROM documents)),
md AS (SELECT doc_id, i, CASE WHEN i % 7 = 1 THEN '# ' || x WHEN i % 7 = 4 THEN '## ' || x WHEN i % 7 = 6 THEN '```sql' WHEN i % 7 = 0 THEN '```' ELSE x END AS x FROM ln)"""


def _markdown(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents", busy=True).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "x")).withColumn("i", (F.col("i") + 1).cast("long"))
    k, x = F.col("i") % 7, F.col("x")
    return lines.select("doc_id", "i", F.when(k == 1, F.concat(F.lit("# "), x)).when(k == 4, F.concat(F.lit("## "), x)).when(k == 6, "```sql").when(k == 0, "```").otherwise(x).alias("x"))


def _joined(spark: SparkSession, sf: str) -> DataFrame:
    """The same, one row per document, without a shuffle."""
    def line(x, i):
        k = (i + 1) % 7
        return F.when(k == 1, F.concat(F.lit("# "), x)).when(k == 4, F.concat(F.lit("## "), x)).when(k == 6, "```sql").when(k == 0, "```").otherwise(x)

    return table(spark, sf, "documents", busy=True).select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("markdown"))


@query(rf"WITH {_LINES} SELECT doc_id, count(*) AS n, md5(string_agg(regexp_extract(trim(x), '^#{{1,6}}\s+(.+)$', 1), '~' ORDER BY i)) AS digest FROM md WHERE regexp_matches(trim(x), '^#{{1,6}}\s+\S') GROUP BY doc_id")
def headings(spark, sf):
    h = _joined(spark, sf).select("doc_id", text.headings(F.col("markdown")).alias("h")).filter(F.size("h") > 0)
    return h.select("doc_id", F.size("h").cast("long").alias("n"), F.md5(F.array_join("h", "~")).alias("digest"))


@query(f"WITH {_LINES}, c AS (SELECT doc_id, count(*) FILTER (WHERE i % 7 = 6) AS opened, count(*) FILTER (WHERE i % 7 = 0) AS closed FROM md GROUP BY doc_id) SELECT doc_id, closed AS n_blocks, opened > 0 AS has_code FROM c")
def code_blocks(spark, sf):
    m = _joined(spark, sf)
    return m.select("doc_id", F.size(text.code_blocks(F.col("markdown"))).cast("long").alias("n_blocks"), (F.size(text.code_languages(F.col("markdown"))) > 0).alias("has_code"))


@query(f"""WITH {_LINES}, w AS (SELECT *, sum((x LIKE '```%')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS f FROM md)
SELECT doc_id, i, (f % 2 = 1)::BOOLEAN AS fenced FROM w""")
def fence_parity(spark, sf):
    w = W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    return _markdown(spark, sf).select("doc_id", "i", (F.sum(F.col("x").startswith("```").cast("int")).over(w) % 2 == 1).alias("fenced"))


@query(f"""WITH {_LINES}, g AS (SELECT *, sum((i % 7 IN (1, 4))::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sec,
  last_value(CASE WHEN i % 7 = 1 THEN x END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS h1 FROM md)
SELECT doc_id, sec::BIGINT AS section, max(h1) AS h1, count(*) AS n_lines FROM g GROUP BY doc_id, sec""")
def heading_sections(spark, sf):
    w = W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    k = F.col("i") % 7
    g = _markdown(spark, sf).withColumn("section", F.sum(k.isin(1, 4).cast("long")).over(w)).withColumn("h1", F.last(F.when(k == 1, F.col("x")), ignorenulls=True).over(w))
    return g.groupBy("doc_id", "section").agg(F.max("h1").alias("h1"), F.count("*").alias("n_lines"))


@query("""WITH t AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'SELECT 1' WHEN 1 THEN 'def f(x):' WHEN 2 THEN 'const a = 1' WHEN 3 THEN 'package main' WHEN 4 THEN 'curl x' WHEN 5 THEN 'kubectl get' ELSE 'plain' END AS c FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(c, '(?i)\\bselect\\b') THEN 'sql' WHEN regexp_matches(c, '(?i)\\bdef \\w+\\(') THEN 'python' WHEN regexp_matches(c, '(?i)\\bconst\\b') THEN 'javascript'
WHEN regexp_matches(c, '(?i)\\bpackage main\\b') THEN 'go' WHEN regexp_matches(c, '(?i)\\b(curl|kubectl)\\b') THEN 'bash' END AS language FROM t""".replace("\\\\", "\\"))
def code_language(spark, sf):
    samples = F.array(*[F.lit(x) for x in ("SELECT 1", "def f(x):", "const a = 1", "package main", "curl x", "kubectl get", "plain")])
    c = F.element_at(samples, (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", text.code_language(c).alias("language"))


# -- URLs and pages

_URLSQL = r"""u AS (SELECT page_id, url, html, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host,
  regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages)"""


@query(rf"""WITH {_URLSQL}, p AS (SELECT *, list_sort(list_transform(list_filter(string_split(q, '&'), lambda x: x <> ''), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END)) AS qs FROM u)
SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE path END
 || CASE WHEN length(qs) = 0 THEN '' ELSE '?' || array_to_string(qs, '&') END AS url FROM p""")
def url_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.normalize(F.col("url")).alias("url"))


_FOLDERS, _SUFFIXES = "|".join(U.NON_DOC_FOLDERS), "|".join(U.NON_DOC_SUFFIXES)


@query(rf"""WITH {_URLSQL} SELECT page_id, host = 'ththre.example.com' AND NOT regexp_matches(lower(path), '/({_FOLDERS})/') AND NOT regexp_matches(lower(path), '\.({_SUFFIXES})$')
 AND NOT regexp_matches(path, '^/[^/]*/9.*$') AND regexp_matches(path, '^/.*$') AS allowed FROM u""")
def url_filter(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.is_allowed(F.col("url"), "http://ththre.example.com/", ["/**"], ["/*/9**"]).alias("allowed"))


@query(rf"""WITH {_URLSQL}, h AS (SELECT page_id, url, scheme, host, path, unnest(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1)) AS x FROM u),
a AS (SELECT page_id, CASE WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN x WHEN x LIKE '//%' THEN scheme || ':' || x WHEN x LIKE '/%' THEN scheme || '://' || host || x
  WHEN x LIKE '#%' THEN url ELSE scheme || '://' || host || regexp_replace(path, '[^/]*$', '') || x END AS x FROM h WHERE NOT regexp_matches(x, '(?i)^(javascript|mailto|tel):')),
s AS (SELECT page_id, regexp_extract(x, '^([A-Za-z]+:)', 1) AS scheme, regexp_extract(x, '^[A-Za-z]+://([^/?#]*)', 1) AS host, regexp_extract(x, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM a)
SELECT page_id, count(DISTINCT path) AS n FROM s WHERE lower(host) = 'ththre.example.com' AND NOT regexp_matches(lower(path), '/({_FOLDERS})/') AND NOT regexp_matches(lower(path), '\.({_SUFFIXES})$') GROUP BY page_id""")
def link_extract(spark, sf):
    links = U.links(F.col("html"), F.col("url"), "http://ththre.example.com/")
    out = table(spark, sf, "pages", busy=True).select("page_id", F.size(F.array_distinct(F.transform(links, U.path))).cast("long").alias("n"))
    return out.filter("n > 0")


@query(rf"WITH {_URLSQL} SELECT page_id, array_to_string(list_filter(list_transform(string_split(path, '/'), lambda x: regexp_replace(x, '\.[^.]*$', '')), lambda x: x <> ''), '>') AS crumbs FROM u")
def url_breadcrumb(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(U.breadcrumb(F.col("url")), ">").alias("crumbs"))


@query(rf"WITH {_URLSQL}, n AS (SELECT page_id, regexp_replace(regexp_replace(host, '^(api|docs?|www)\.', ''), '\.(com|dev|io|net|org)$', '') AS h FROM u) SELECT page_id, coalesce(nullif(regexp_replace(string_split(h, '.')[1], '[^a-z0-9-]', '', 'g'), ''), 'unknown') AS name FROM n")
def software_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.software_name(F.col("url")).alias("name"))


@query(f"WITH {_URLSQL} SELECT host, count(*) AS n FROM u GROUP BY host")
def host_count(spark, sf):
    return table(spark, sf, "pages").groupBy(U.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query(f"WITH {_URLSQL} SELECT page_id, NOT (starts_with(path, '/en/') OR starts_with(path, '/fr/1')) AS allowed FROM u")
def robots_predicate(spark, sf):
    rules = F.array(F.lit("/en/"), F.lit("/fr/1"))
    return table(spark, sf, "pages").select("page_id", U.robots_allows(U.path(F.col("url")), rules).alias("allowed"))


@query(f"WITH {_URLSQL} SELECT page_id FROM u WHERE NOT (page_id % 2 = 0 AND starts_with(path, '/en/'))")
def robots_gate(spark, sf):
    p = table(spark, sf, "pages").withColumn("url", F.regexp_replace("url", "^(https?://)", F.concat(F.lit("$1p"), F.col("page_id").cast("string"), F.lit("."))))
    text_ = F.when(F.col("page_id") % 2 == 0, "User-agent: *\nDisallow: /en/\nDisallow:\nUser-agent: other\nDisallow: /").otherwise("User-agent: other\nDisallow: /")
    return web.robots_gate(p.select("page_id", "url"), web.robots(p.select(U.host(F.col("url")).alias("host"), text_.alias("robots")))).select("page_id")


_STRIP = "trim(regexp_replace(regexp_replace(regexp_extract(html, '{}', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))".replace("\\\\", "\\")


@query(f"""WITH t AS (SELECT page_id, {_STRIP.format('(?is)<h1[^>]*>(.*?)</h1>')} AS h1, trim(regexp_replace({_STRIP.format('(?is)<title[^>]*>(.*?)</title>')}, '( — | \\| | - ).*$', '')) AS ti FROM pages)
SELECT page_id, CASE WHEN h1 <> '' THEN h1 WHEN ti <> '' THEN ti ELSE 'Untitled' END AS title FROM t""")
def page_title(spark, sf):
    return table(spark, sf, "pages", busy=True).select("page_id", extract.title(F.col("html")).alias("title"))


@query("""WITH h AS (SELECT page_id, html || CASE page_id % 5 WHEN 0 THEN '<pre class="x"><code>' WHEN 1 THEN '<link href="s" rel="sitemap">' WHEN 2 THEN 'Sphinx' WHEN 3 THEN 'Enterprise login' ELSE '' END AS html FROM pages)
SELECT page_id, round(greatest(0, least(1, regexp_matches(html, '(?i)<link[^>]+rel="sitemap"[^<>]*>')::INT * 0.15::DOUBLE + regexp_matches(html, '(?i)<h[12][^>]*>')::INT * 0.25::DOUBLE
 + regexp_matches(html, '(?i)<pre[^>]*><code')::INT * 0.25::DOUBLE + regexp_matches(html, '(?i)<nav|class=[''"](?:sidebar|toc|menu)[''"]')::INT * 0.15::DOUBLE
 + regexp_matches(html, '(?i)mkdocs|sphinx|docusaurus|readthedocs|gitbook')::INT * 0.1::DOUBLE - 0.2::DOUBLE * (contains(lower(html), 'pricing')::INT + contains(lower(html), 'enterprise')::INT
 + contains(lower(html), 'signup')::INT + contains(lower(html), 'sign-up')::INT + contains(lower(html), 'login')::INT))), 6) AS score FROM h""")
def doc_score(spark, sf):
    extra = F.array(*[F.lit(x) for x in ('<pre class="x"><code>', '<link href="s" rel="sitemap">', "Sphinx", "Enterprise login", "")])
    html = F.concat("html", F.element_at(extra, (F.col("page_id") % 5 + 1).cast("int")))
    return table(spark, sf, "pages", busy=True).select("page_id", six(extract.doc_score(html)).alias("score"))


@query(r"""WITH h AS (SELECT page_id, '<a href="/d/' || page_id % 4 || '.' || page_id % 3 || '/x"><a href="/d/1.2/y">' || html AS html FROM pages),
e AS (SELECT page_id, regexp_extract_all(html, 'href="[^"]*?/([0-9]+(?:\.[0-9]+)*)/[^"]*"', 1) AS v FROM h)
SELECT page_id, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), ',') AS versions FROM e""")
def page_versions(spark, sf):
    html = F.concat(F.lit('<a href="/d/'), F.col("page_id") % 4, F.lit("."), F.col("page_id") % 3, F.lit('/x"><a href="/d/1.2/y">'), F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.array_join(V.in_links(html), ",").alias("versions"))


@query(r"""WITH s AS (SELECT DISTINCT o_orderpriority AS p FROM orders), x AS (SELECT p, '<select id="version"><option value="/v' || substr(p, 1, 1) || '.0/">a<option value="latest">b<option value="2.1">c<option value="2.1">c</select>' AS html FROM s)
SELECT p, 'v' || substr(p, 1, 1) || '.0,2.1' AS versions FROM x""")
def version_dropdown(spark, sf):
    p = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("p")).distinct()
    html = F.concat(F.lit('<select id="version"><option value="/v'), F.substring("p", 1, 1), F.lit('.0/">a<option value="latest">b<option value="2.1">c<option value="2.1">c</select>'))
    return p.select("p", F.array_join(V.in_dropdown(html), ",").alias("versions"))


@query(r"""WITH v AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'v' WHEN 1 THEN '' WHEN 2 THEN 'x' ELSE '' END || p_size || '.' || p_partkey % 9 || CASE p_partkey % 3 WHEN 0 THEN '-rc' WHEN 1 THEN '' ELSE '.beta1' END AS version FROM part)
SELECT p_partkey, version, regexp_matches(version, '(?i)^v?\d+(\.\d+)*([-.]?(alpha|beta|rc|pre|dev|stable))?$') AS is_version FROM v""")
def version_predicate(spark, sf):
    lead = F.element_at(F.array(*[F.lit(x) for x in ("v", "", "x", "", "")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    end = F.element_at(F.array(*[F.lit(x) for x in ("-rc", "", ".beta1")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    v = F.concat(lead, F.col("p_size"), F.lit("."), F.col("p_partkey") % 9, end)
    return table(spark, sf, "part").select("p_partkey", v.alias("version"), V.looks_like(v).alias("is_version"))


@query(r"""WITH v AS (SELECT DISTINCT p_size || '.' || p_partkey % 4 || CASE p_partkey % 3 WHEN 0 THEN '-alpha' ELSE '' END AS version FROM part),
k AS (SELECT version, regexp_extract(version, '^(\d+)', 1)::BIGINT AS a, regexp_extract(version, '^\d+\.(\d+)', 1)::BIGINT AS b, regexp_extract(version, '([a-zA-Z-][a-zA-Z0-9._-]*)$', 1) AS s FROM v)
SELECT version, row_number() OVER (ORDER BY a, b, s = '', s) AS place FROM k""")
def version_sort(spark, sf):
    v = F.concat(F.col("p_size"), F.lit("."), F.col("p_partkey") % 4, F.when(F.col("p_partkey") % 3 == 0, "-alpha").otherwise(""))
    d = table(spark, sf, "part").select(v.alias("version")).distinct()
    return d.select("version", F.row_number().over(W.orderBy(V.key(F.col("version")))).cast("long").alias("place"))


@query(r"""WITH v AS (SELECT p_brand AS software, p_size AS a, p_partkey % 4 AS b FROM part) SELECT software, max(a) || '.' || max(b) FILTER (WHERE a = m) AS latest FROM (SELECT *, max(a) OVER (PARTITION BY software) AS m FROM v) GROUP BY software""")
def latest_version(spark, sf):
    v = F.concat(F.col("p_size"), F.lit("."), F.col("p_partkey") % 4)
    return table(spark, sf, "part").select(F.col("p_brand").alias("software"), v.alias("v")).groupBy("software").agg(F.max_by("v", V.key(F.col("v"))).alias("latest"))


# -- classification

_PATHS = ["/docs/tutorial/a", "/docs/apis/b", "/faq/", "/config/x", "/other", "/guides/install", "/examples/e", "/changelog/1"]
_TITLES = ["Tutorial: start", "API of x", "FAQ", "Settings", "Plain", "How to install", "Sample", "Release 2"]


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda xs, c: F.element_at(F.array(*[F.lit(x) for x in xs]), (c % len(xs) + 1).cast("int"))
    fenced = lambda x, k: F.when((k + 1) % 7 == 4, "```sql").when((k + 1) % 7 == 0, "```").otherwise(x)
    d, i = table(spark, sf, "documents", busy=True), F.col("doc_id")
    # whole texts; two lines of each seven are code, in _joined()'s blocks there are none
    d = d.select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), fenced), "\n").alias("markdown"))
    return d.select(
        "doc_id", F.concat(F.lit("https://x.org"), pick(_PATHS, i)).alias("url"), pick(_TITLES, i + (i / 8).cast("long") % 2).alias("title"),
        F.array(pick(["Step 1", "Parameters", "Notes"], i)).alias("headings"), "markdown",
        text.code_blocks(F.col("markdown")).alias("code_blocks"),
        F.array(pick(["Tutorial", "Home", "FAQ"], i)).alias("breadcrumb"), F.create_map(F.lit("page:class"), pick(["faq", "none"], i)).alias("raw_metadata"),
    )


def _classify_sql() -> str:
    """The six signals spelt out: for each type the weighted sum and the place of its first signal, then the best."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    cycle = lambda xs, i: "CASE (" + i + f") % {len(xs)} " + " ".join(f"WHEN {k} THEN {quote(x)}" for k, x in enumerate(xs)) + " END"
    some = lambda column, words: "(" + " OR ".join(f"contains({column}, {quote(w)})" for w in words.split(";")) + ")"
    one = lambda test: f"CASE WHEN {test} THEN 1.0::DOUBLE END"
    high, mid = "ratio > 0.4", "ratio <= 0.4 AND ratio > 0.1"
    code = {
        "examples": f"CASE WHEN {high} THEN least(ratio, 1.0) END", "api_reference": f"CASE WHEN {high} THEN ratio * 0.7 END", "tutorial": f"CASE WHEN {mid} THEN ratio * 1.5 END",
        "guide": f"CASE WHEN {mid} THEN ratio WHEN ratio <= 0.1 THEN 1 - ratio END", "concepts": "CASE WHEN ratio <= 0.1 THEN 1 - ratio END",
    }
    rows = []
    for k, kind in enumerate(classify.PAGE_TYPES):
        values = [one(some("path", classify._FOLDERS[kind])), one(some("title", classify._TITLES[kind]))]
        values.append(one(f"regexp_matches(heading, {quote('(?i)' + classify._HEADINGS[kind])})") if kind in classify._HEADINGS else "NULL")
        values += [code.get(kind, "NULL"), one(some("crumbs", classify._TITLES[kind])), one("meta = 'page:class:faq'") if kind == "faq" else "NULL"]
        total = " + ".join(f"coalesce({v}, 0::DOUBLE) * {w}::DOUBLE" for v, w in zip(values, (0.30, 0.25, 0.20, 0.10, 0.10, 0.05)))
        first = "CASE " + " ".join(f"WHEN ({v}) IS NOT NULL THEN {n}" for n, v in enumerate(values)) + " ELSE 99 END"
        rows.append(f"SELECT doc_id, {quote(kind)} AS kind, {total} AS s, {first} * 100 + {k} AS o FROM f")
    lines = "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 7 = 4 THEN '```sql' WHEN i % 7 = 0 THEN '```' ELSE x END), chr(10))"
    blocks = r"list_transform(regexp_extract_all(markdown, '(?s)`{3}\w*\n(.*?)`{3}', 1), lambda x: length(regexp_replace(regexp_replace(x, '^\n+', ''), '\n+$', '')))"
    return f"""WITH m AS (SELECT doc_id, {lines} AS markdown FROM documents),
f AS (SELECT doc_id, lower({cycle(_PATHS, "doc_id")}) AS path, lower({cycle(_TITLES, "doc_id + doc_id // 8 % 2")}) AS title, {cycle(["Step 1", "Parameters", "Notes"], "doc_id")} AS heading,
 lower({cycle(["Tutorial", "Home", "FAQ"], "doc_id")}) AS crumbs, 'page:class:' || {cycle(["faq", "none"], "doc_id")} AS meta, coalesce(list_sum({blocks}), 0)::DOUBLE / greatest(length(markdown), 1) AS ratio FROM m),
a AS ({" UNION ALL ".join(rows)}), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, o) AS r FROM a)
SELECT doc_id, CASE WHEN s >= 0.70 THEN kind ELSE 'unknown' END AS page_type, round(CASE WHEN s >= 0.70 THEN least(s, 1.0) ELSE 0 END, 6) AS confidence FROM b WHERE r = 1"""


@query(_classify_sql())
def classify_pages(spark, sf):
    return classify.classify(_typed(spark, sf)).select("doc_id", "page_type", six("confidence").alias("confidence"))


@query("""WITH u AS (SELECT doc_id, 'https://x.org/' || CASE doc_id % 4 WHEN 0 THEN 'a/learn/' WHEN 1 THEN 'ref/16/' WHEN 2 THEN 'faq/' ELSE 'x/' END || doc_id AS url FROM documents)
SELECT doc_id, CASE WHEN url LIKE '%/learn/%' THEN 'tutorial' WHEN url LIKE '%/ref/%/%' THEN 'api_reference' WHEN url LIKE '%/faq/%' THEN 'faq' END AS page_type FROM u""")
def hint_join(spark, sf):
    lead = F.element_at(F.array(*[F.lit(x) for x in ("a/learn/", "ref/16/", "faq/", "x/")]), (F.col("doc_id") % 4 + 1).cast("int"))
    url = F.concat(F.lit("https://x.org/"), lead, F.col("doc_id"))
    hints = {"faq_paths": ["*/faq/*"], "reference_paths": ["*/ref/{version}/*"], "tutorial_paths": ["*/learn/*"]}
    return table(spark, sf, "documents").select("doc_id", classify.hinted(url, hints).alias("page_type"))


# -- chunking and the whole page pipeline (no SQL says these; they are tested against models)

@query()
def extract_markdown(spark, sf):
    out = extract.extract(table(spark, sf, "pages", busy=True))
    return out.select("page_id", "title", F.md5("markdown").alias("digest"), F.length("markdown").alias("n_chars"), F.size("headings").alias("n_headings"), F.col("raw_metadata")["extraction_method"].alias("method"))


@query()
def chunk_pages(spark, sf):
    pages = _joined(spark, sf).withColumn("title", F.lit("t")).withColumn("page_type", F.element_at(F.array(*[F.lit(x) for x in ("tutorial", "examples", "guide", "configuration")]), (F.col("doc_id") % 4 + 1).cast("int")))
    out = chunking.chunk_pages(pages, 128, 256, 32, 16)
    return out.select("doc_id", "chunk_index", "total_chunks", "has_code", F.length("content").alias("n_chars"), F.md5("content").alias("digest"))


@query()
def index_pages(spark, sf):
    pages = classify.classify(extract.extract(table(spark, sf, "pages", busy=True)))
    chunks = chunking.chunk_pages(pages).withColumn("chunk_id", ids.chunk_id(F.lit("sw"), F.lit("1"), F.col("url"), F.col("section_heading"), F.col("chunk_index")))
    out = embed.embed_texts(chunks, "hash-8")
    return out.select("page_id", "chunk_id", "page_type", "chunk_index", ids.content_hash(F.col("content")).alias("content_hash"), six(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)).alias("vector_sum"))


@query("""WITH s AS (SELECT doc_id, sha256(text) AS h FROM documents), b AS (SELECT doc_id, list_transform(range(8), lambda k: (instr('0123456789abcdef', substr(h, 2 * k + 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr(h, 2 * k + 2, 1)) - 1) AS v FROM s)
SELECT doc_id, round(list_sum(v) / 255.0::DOUBLE, 4) AS total FROM b""")
def embed_hash(spark, sf):
    out = embed.embed_texts(table(spark, sf, "documents", busy=True), "hash-8", "text")
    return out.select("doc_id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


# -- change detection and state

_STATE = """sm AS (SELECT 'u/' || doc_id AS loc, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE (n_chars % 3)::VARCHAR END AS lastmod FROM documents WHERE doc_id % 7 <> 0),
st AS (SELECT 'u/' || doc_id AS url, (n_chars % 3 + (doc_id % 5 = 0)::INT)::VARCHAR AS last_modified FROM documents WHERE doc_id % 11 <> 0)"""


@query(f"""WITH {_STATE} SELECT coalesce(loc, url) AS url, CASE WHEN url IS NULL THEN 'new' WHEN loc IS NULL THEN 'removed' WHEN lastmod = last_modified AND lastmod <> '' THEN 'unchanged' ELSE 'changed' END AS change_type
FROM sm FULL JOIN st ON loc = url""")
def detect_changes(spark, sf):
    d, url = table(spark, sf, "documents"), F.concat(F.lit("u/"), F.col("doc_id"))
    sm = d.filter("doc_id % 7 <> 0").select(url.alias("loc"), F.when(F.col("doc_id") % 6 != 0, (F.col("n_chars") % 3).cast("string")).alias("lastmod"), F.lit(0).alias("seq"))
    st = d.filter("doc_id % 11 <> 0").select(url.alias("url"), (F.col("n_chars") % 3 + (F.col("doc_id") % 5 == 0).cast("long")).cast("string").alias("last_modified"))
    return changes.detect_changes(sm, st).select("url", "change_type")


@query("""WITH n AS (SELECT source AS page_url, 'c' || doc_id AS chunk_id, md5(text) AS h FROM documents WHERE doc_id % 4 <> 0),
o AS (SELECT source AS page_url, 'c' || doc_id AS chunk_id, md5(CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE text END) AS h FROM documents WHERE doc_id % 3 <> 0)
SELECT coalesce(n.page_url, o.page_url) AS page_url, coalesce(n.chunk_id, o.chunk_id) AS chunk_id, CASE WHEN o.h IS NULL THEN 'add' WHEN n.h IS NULL THEN 'remove' WHEN n.h = o.h THEN 'unchanged' ELSE 'updated' END AS action
FROM n FULL JOIN o ON n.page_url = o.page_url AND n.chunk_id = o.chunk_id""")
def chunk_diff(spark, sf):
    d = table(spark, sf, "documents").withColumn("page_url", F.col("source")).withColumn("chunk_id", F.concat(F.lit("c"), F.col("doc_id")))
    old = d.filter("doc_id % 3 <> 0").withColumn("content_hash", F.md5(F.when(F.col("doc_id") % 9 == 0, "x").otherwise(F.col("text"))))
    return changes.diff_chunks(d.filter("doc_id % 4 <> 0").withColumn("content_hash", F.md5("text")), old)


@query("""WITH c AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 3 = 0) SELECT doc_id, c.h IS NOT NULL AS hit FROM documents LEFT JOIN c ON md5(text) = c.h""")
def cache_split(spark, sf):
    d = table(spark, sf, "documents").withColumn("content_hash", F.md5("text"))
    cache = d.filter("doc_id % 3 = 0").select("content_hash").distinct().select(F.lit("m").alias("model_name"), "content_hash", F.array(F.lit(1.0).cast("float")).alias("vector"))
    return changes.cache_split(d, cache, "m").select("doc_id", F.col("cached_vector").isNotNull().alias("hit"))


@query("SELECT DISTINCT o_custkey AS url FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 3 = 0)")
def enqueue_unseen(spark, sf):
    links = table(spark, sf, "orders").select(F.col("o_custkey").alias("url"))
    return changes.unseen(links, table(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("url")))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def fetched_semi(spark, sf):
    c = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", six("value").alias("value"))
    return changes.latest(e, ["user_id"], "event_id")


@query("""WITH a AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 5 <> 0), b AS (SELECT c_custkey, 'new' AS c_name, 0.0::DOUBLE AS c_acctbal FROM customer WHERE c_custkey % 3 = 0)
SELECT * FROM a WHERE c_custkey NOT IN (SELECT c_custkey FROM b) UNION ALL SELECT * FROM b""")
def merge_state(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    return changes.upsert(c.filter("c_custkey % 5 <> 0"), new, ["c_custkey"])


@query("SELECT 'u/' || doc_id AS url, CASE WHEN doc_id % 2 = 0 THEN 'unchanged' ELSE 'changed' END AS change_type FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 3 <> 0")
def conditional_fetch(spark, sf):
    d = table(spark, sf, "documents").withColumn("url", F.concat(F.lit("u/"), F.col("doc_id")))
    answers = d.filter("doc_id % 3 <> 0").select("url", F.when(F.col("doc_id") % 2 == 0, 304).otherwise(200).alias("status_code"))
    return changes.without_sitemap(d.filter("doc_id % 5 <> 0"), answers).select("url", "change_type")


@query("SELECT s.n_name AS software, count(v.s_suppkey) AS versions, coalesce(sum(v.s_acctbal::DECIMAL(18,2)), 0)::DOUBLE AS chunks, max(v.s_name) AS last FROM nation s LEFT JOIN supplier v ON s.n_nationkey = v.s_nationkey GROUP BY s.n_name")
def software_listing(spark, sf):
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    sums = s.groupBy("s_nationkey").agg(F.count("*").alias("versions"), F.sum(F.col("s_acctbal").cast("decimal(18,2)")).alias("chunks"), F.max("s_name").alias("last"))
    out = n.join(sums, n["n_nationkey"] == sums["s_nationkey"], "left")
    return out.select(F.col("n_name").alias("software"), F.coalesce("versions", F.lit(0)).alias("versions"), F.coalesce("chunks", F.lit(0)).cast("double").alias("chunks"), "last")


@query("SELECT o_orderkey AS url, o_custkey AS depth FROM orders WHERE o_orderstatus = 'O' ORDER BY o_custkey, o_orderpriority, o_orderkey LIMIT 50")
def frontier_pop(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("url"), F.col("o_custkey").alias("depth"), F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"))
    return changes.frontier_next(o, 50).select("url", "depth")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def queue_stats(spark, sf):
    return crawl.queue_stats(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status")))


@query("SELECT source AS software, count(DISTINCT lang) AS versions, count(*) AS pages, coalesce(sum(n_chars), 0)::BIGINT AS chunks FROM documents GROUP BY source")
def software_stats(spark, sf):
    by = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("pages"), F.sum("n_chars").alias("chunks"))
    return by.groupBy(F.col("source").alias("software")).agg(F.count("*").alias("versions"), F.sum("pages").alias("pages"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


@query("SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS started FROM events WHERE user_id % 2 = 0 ORDER BY ts DESC, event_id LIMIT 20")
def runs_topn(spark, sf):
    e = table(spark, sf, "events").filter("user_id % 2 = 0").orderBy(F.desc("ts"), "event_id").limit(20)
    return e.select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("started"))


@query("SELECT o_custkey, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'failed' WHEN bool_or(o_orderstatus = 'F') THEN 'partial' ELSE 'completed' END AS status FROM orders GROUP BY o_custkey")
def status_rollup(spark, sf):
    bad = F.col("o_orderstatus") == "F"
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.when(F.bool_and(bad), "failed").when(F.bool_or(bad), "partial").otherwise("completed").alias("status"))


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), six(F.percentile("value", 0.5)).alias("p50"), six(F.percentile("value", 0.99)).alias("p99"))


@query("SELECT lang, count(DISTINCT md5(text)) AS n FROM documents GROUP BY lang")
def cache_count(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.countDistinct(F.md5("text")).alias("n"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk_index, count(*) OVER (PARTITION BY source) AS total_chunks FROM documents")
def chunk_numbers(spark, sf):
    return changes.numbered(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "total_chunks")


@query("SELECT doc_id, lag(md5(text)) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM documents")
def previous_chunk(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.lag(F.md5("text")).over(W.partitionBy("source").orderBy("doc_id")).alias("before"))


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    out = table(spark, sf, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


@query("SELECT loc AS url FROM (SELECT 'u/' || doc_id AS loc FROM documents WHERE doc_id % 7 <> 0) EXCEPT SELECT 'u/' || doc_id FROM documents WHERE doc_id % 11 <> 0")
def removed_urls(spark, sf):
    url = F.concat(F.lit("u/"), F.col("doc_id")).alias("url")
    d = table(spark, sf, "documents")
    return d.filter("doc_id % 7 <> 0").select(url).join(d.filter("doc_id % 11 <> 0").select(url), "url", "left_anti").distinct()


# -- sources

@query("SELECT 'https://x.org/' || page_id || '?a=1&b=2' AS loc, CASE WHEN page_id % 3 <> 0 THEN '2024-01-0' || page_id % 9 + 1 END AS lastmod, CASE page_id % 4 WHEN 0 THEN 0.5::DOUBLE END AS priority FROM pages WHERE page_id % 10 <> 0")
def sitemap_parse(spark, sf):
    i = F.col("page_id")
    loc = F.when(i % 10 == 0, "").otherwise(F.concat(F.lit("https://x.org/"), i, F.lit("?a=1&amp;b=2")))
    last = F.when(i % 3 != 0, F.concat(F.lit("<lastmod>2024-01-0"), i % 9 + 1, F.lit("</lastmod>"))).otherwise("")
    pri = F.when(i % 4 == 0, "<priority>0.5</priority>").when(i % 4 == 1, "<priority>high</priority>").otherwise("")
    one = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://s"><url>\n<loc> '), loc, F.lit(" </loc>"), last, pri, F.lit("</url></urlset>"))
    return web.sitemap(table(spark, sf, "pages").select(one.alias("xml"))).select("loc", "lastmod", "priority")


@query("SELECT 'https://x.org/s' || page_id || '.xml' AS loc FROM pages")
def sitemap_index(spark, sf):
    one = F.concat(F.lit("<sitemapindex><sitemap><loc>https://x.org/s"), F.col("page_id"), F.lit(".xml</loc></sitemap></sitemapindex>"))
    return web.sitemap_index(table(spark, sf, "pages").select(one.alias("xml")))


@query("""WITH t(n, u) AS (VALUES (0, 'https://docs.{}.com/'), (1, 'https://{}.readthedocs.io/'), (2, 'https://{}.readthedocs.io/en/latest/'), (3, 'https://www.{}.org/docs/'), (4, 'https://{}.org/documentation/'))
SELECT lower(n_name) AS name, n::BIGINT AS seq, replace(u, '{}', lower(n_name)) AS url FROM nation, t""")
def heuristic_candidates(spark, sf):
    return discovery.candidates(table(spark, sf, "nation").select(F.lower("n_name").alias("name"))).select("name", F.col("seq").cast("long").alias("seq"), "url")


@query("""SELECT name, CASE WHEN name = 'sw' THEN 'Soft Ware' ELSE upper(substr(name, 1, 1)) || lower(substr(name, 2)) END AS display_name, CASE WHEN name = 'sw' THEN '2' ELSE 'latest' END AS latest_version
FROM (SELECT lower(r_name) AS name FROM region WHERE r_name NOT LIKE '% %' UNION ALL SELECT 'sw')""")
def discover(spark, sf):
    names = table(spark, sf, "region").filter("r_name not like '% %'").select(F.lower("r_name").alias("input"))
    reg = spark.createDataFrame([("sw", "Soft Ware", "https://sw.org/", None, None, "explicit", ["2", "1"], "2", {}, [], [], {})], web.REGISTRY_SCHEMA)
    out = discovery.resolve(names.unionByName(spark.createDataFrame([("sw",)], "input string")), reg)
    return out.select("name", "display_name", "latest_version")


# -- evaluation: relevant are the vectors of the query's label

@query(f"""WITH {_BATCH}, x AS (SELECT label, vec_id FROM embeddings WHERE vec_id % 5 = 0), h AS (SELECT r.qid, r.rank, r.vec_id IN (SELECT vec_id FROM x WHERE x.label = r.qlabel) AS hit, r.qlabel FROM r WHERE rank <= 10)
SELECT qid, round(count(*) FILTER (WHERE hit AND rank <= 5) / (SELECT count(*) FROM x WHERE x.label = h.qlabel)::DOUBLE, 6) AS recall_5,
 round(coalesce(1.0 / min(rank) FILTER (WHERE hit), 0), 6) AS mrr FROM h GROUP BY qid, qlabel""")
def retrieval_metrics(spark, sf):
    e = table(spark, sf, "embeddings")
    want = e.filter("vec_id % 5 = 0").groupBy("label").agg(F.collect_list(F.col("vec_id").cast("string")).alias("expected"))
    questions = e.filter("vec_id % 25 = 0").join(want, "label").select(F.col("vec_id").alias("qid"), "expected")
    hits = _batch(spark, sf, 10).select("qid", "rank", F.col("vec_id").cast("string").alias("chunk_id"))
    return evaluate.evaluate(questions, hits).select("qid", six("recall_5").alias("recall_5"), six("mrr").alias("mrr"))


@query("""SELECT CASE WHEN GROUPING(quality) = 0 THEN 'q' || quality END AS category, CASE WHEN GROUPING(toxic) = 0 THEN 't' || toxic END AS difficulty, count(*) AS n, round(avg((doc_id % 10) / 10.0::DOUBLE), 6) AS mrr
FROM labels GROUP BY GROUPING SETS ((quality), (toxic), ())""")
def eval_summary(spark, sf):
    rows = table(spark, sf, "labels").select(F.concat(F.lit("q"), "quality").alias("category"), F.concat(F.lit("t"), "toxic").alias("difficulty"), (F.col("doc_id") % 10 / 10.0).alias("mrr"))
    return evaluate.summary(rows, ("mrr",)).select("category", "difficulty", "n", six("mrr").alias("mrr"))


@query()
def pipeline_status(spark, sf):
    """The driver-side roll-up of three runs."""
    rows = [("a", engine.roll_up(["failed", "failed"])), ("b", engine.roll_up(["failed", "completed"])), ("c", engine.roll_up(["completed"]))]
    return spark.createDataFrame(rows, "run string, status string")


# -- the state of an index: selects, logs, deletes and what updates leave, over rows made of the tables

_LINKS_OF_OWN_HOST = rf"""WITH {_URLSQL}, h AS (SELECT page_id, url, scheme, host, path, unnest(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1)) AS x FROM u),
a AS (SELECT page_id, host AS own, CASE WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN x WHEN x LIKE '//%' THEN scheme || ':' || x WHEN x LIKE '/%' THEN scheme || '://' || host || x
  WHEN x LIKE '#%' THEN url ELSE scheme || '://' || host || regexp_replace(path, '[^/]*$', '') || x END AS x FROM h WHERE NOT regexp_matches(x, '(?i)^(javascript|mailto|tel):')),
s AS (SELECT page_id, own, regexp_extract(x, '^[A-Za-z]+://([^/?#]*)', 1) AS host, regexp_extract(x, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM a)
SELECT page_id, count(DISTINCT path) AS n FROM s WHERE lower(host) = lower(own) AND NOT regexp_matches(lower(path), '/({_FOLDERS})/') AND NOT regexp_matches(lower(path), '\.({_SUFFIXES})$') GROUP BY page_id"""


@query(_LINKS_OF_OWN_HOST)
def own_host_links(spark, sf):
    """Links of every page to its own host."""
    links = U.links(F.col("html"), F.col("url"), F.col("url"))
    out = table(spark, sf, "pages", busy=True).select("page_id", F.size(F.array_distinct(F.transform(links, U.path))).cast("long").alias("n"))
    return out.filter("n > 0")


@query("SELECT page_id, regexp_matches(p, '^/en/.*$') AS deep, regexp_matches(p, '^/[^/]*/[^/]$') AS short, regexp_matches(p, '^/..[/].*$') AND NOT contains(substr(p, 2, 2), '/') AS two FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)")
def glob_match(spark, sf):
    p = U.path(F.col("url"))
    fits = lambda glob: p.rlike(U.glob_regex(glob))
    return table(spark, sf, "pages").select("page_id", fits("/en/**").alias("deep"), fits("/*/?").alias("short"), fits("/??/**").alias("two"))


@query("SELECT user_id AS run_id, max(event_id) AS last_event, arg_max(event_type, event_id) AS status, count(*) AS n FROM events GROUP BY 1")
def run_log_latest(spark, sf):
    """A run log of several rows a run, as one row a run: the last one."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("last_event"), F.col("event_type").alias("status"))
    return changes.latest(e, ["run_id"], "last_event").join(e.groupBy("run_id").agg(F.count("*").alias("n")), "run_id")


@query("SELECT o_orderkey AS url, CASE WHEN o_orderkey % 4 = 0 THEN 'completed' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'failed' END AS status FROM orders")
def queue_update(spark, sf):
    q = table(spark, sf, "orders").select(F.col("o_orderkey").alias("url"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("failed").alias("status"))
    return changes.upsert(q, q.filter("url % 4 = 0").withColumn("status", F.lit("completed")), ["url"])


@query("SELECT s_suppkey AS url, s_nationkey AS depth FROM supplier WHERE s_suppkey % 3 <> 0 ORDER BY s_nationkey, s_name, s_suppkey LIMIT 25")
def page_cap(spark, sf):
    q = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("url"), F.col("s_nationkey").alias("depth"), F.col("s_name").alias("priority"), F.when(F.col("s_suppkey") % 3 != 0, "pending").otherwise("completed").alias("status"))
    return changes.frontier_next(q, 25).select("url", "depth")


@query("SELECT r_name AS software, CASE WHEN r_regionkey % 2 = 0 THEN 'v' || r_regionkey ELSE 'v0' END AS latest_version, CASE WHEN r_regionkey % 2 = 1 THEN 'kept' END AS note FROM region")
def latest_marker(spark, sf):
    """The marker in a software's settings, written and read back."""
    was = F.when(F.col("r_regionkey") % 2 == 1, F.lit('{"latest_version": "v0", "note": "kept"}'))
    r = table(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("software"), was.alias("s"))
    new = F.to_json(F.create_map(F.lit("latest_version"), F.concat(F.lit("v"), F.col("r_regionkey"))))
    r = r.withColumn("s", F.when(F.col("r_regionkey") % 2 == 0, new).otherwise(F.col("s")))
    return r.select("software", F.get_json_object("s", "$.latest_version").alias("latest_version"), F.get_json_object("s", "$.note").alias("note"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(date_trunc('day', ts)) ELSE 0 END AS micros FROM events")
def decode_timestamps(spark, sf):
    k = F.col("event_id") % 3
    stored = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).when(k == 1, F.date_format("ts", "yyyy-MM-dd")).otherwise("no time")
    return table(spark, sf, "events").select("event_id", F.unix_micros(backends.decode_timestamp(stored)).alias("micros"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS title, CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE lang END AS page_type, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE n_chars END AS chunk_index FROM documents")
def decode_metadata(spark, sf):
    blob = F.when(F.col("doc_id") % 5 == 0, "not json").otherwise(F.to_json(F.struct(F.col("source").alias("title"), F.col("lang").alias("page_type"), F.col("n_chars").alias("chunk_index"))))
    m = table(spark, sf, "documents").select("doc_id", backends.decode_metadata(blob).alias("m"))
    return m.select("doc_id", "m.title", "m.page_type", F.col("m.chunk_index").cast("long").alias("chunk_index"))


@query("SELECT event_type AS url, count(*) AS n, count(*) FILTER (WHERE ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-10 12:00:00') AS fresh FROM events GROUP BY 1")
def cached_responses(spark, sf):
    """Responses and those of them that have not expired."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("url"), (F.col("ts") + F.expr("INTERVAL 168 HOURS")).alias("expires_at"))
    return e.groupBy("url").agg(F.count("*").alias("n"), F.count_if(F.col("expires_at") > F.lit("2024-01-10 12:00:00").cast("timestamp")).alias("fresh"))


@query("""WITH c AS (SELECT source AS software, lang AS version, doc_id FROM documents WHERE NOT (source = 'src1') AND NOT (source = 'src2' AND lang = 'en'))
SELECT software, count(DISTINCT version) AS versions, count(*) AS chunks FROM c GROUP BY software""")
def cascading_delete(spark, sf):
    """What is left after one software and one version of another are deleted."""
    c = table(spark, sf, "documents").select(F.col("source").alias("software"), F.col("lang").alias("version"), "doc_id")
    gone = spark.createDataFrame([("src2", "en")], "software string, version string")
    left = c.filter(F.col("software") != "src1").join(F.broadcast(gone), ["software", "version"], "left_anti")
    return left.groupBy("software").agg(F.count_distinct("version").alias("versions"), F.count("*").alias("chunks"))


@query("SELECT doc_id, n_chars FROM documents WHERE source = 'src3' AND lang = 'en' AND doc_id BETWEEN 10 AND 5000")
def state_select(spark, sf):
    return table(spark, sf, "documents").filter((F.col("source") == "src3") & (F.col("lang") == "en") & F.col("doc_id").between(10, 5000)).select("doc_id", "n_chars")


@query(f"""WITH {_STATE}, d AS (SELECT coalesce(loc, url) AS url, lastmod, last_modified, CASE WHEN url IS NULL THEN 'new' WHEN loc IS NULL THEN 'removed' WHEN lastmod = last_modified AND lastmod <> '' THEN 'unchanged' ELSE 'changed' END AS c FROM sm FULL JOIN st ON loc = url)
SELECT url, CASE WHEN c = 'unchanged' THEN last_modified ELSE lastmod END AS last_modified FROM d WHERE c <> 'removed'""")
def incremental_update(spark, sf):
    """The page state after a sitemap's changes were taken over."""
    d, url = table(spark, sf, "documents"), F.concat(F.lit("u/"), F.col("doc_id"))
    sm = d.filter("doc_id % 7 <> 0").select(url.alias("loc"), F.when(F.col("doc_id") % 6 != 0, (F.col("n_chars") % 3).cast("string")).alias("lastmod"), F.lit(0).alias("seq"))
    st = d.filter("doc_id % 11 <> 0").select(url.alias("url"), (F.col("n_chars") % 3 + (F.col("doc_id") % 5 == 0).cast("long")).cast("string").alias("last_modified"))
    delta = changes.detect_changes(sm, st)
    kept = st.join(delta.filter("change_type = 'removed'").select("url"), "url", "left_anti")
    return changes.upsert(kept, delta.filter("change_type in ('new', 'changed')").select("url", F.col("lastmod").alias("last_modified")), ["url"])


@query("SELECT count(*) AS done, count(DISTINCT text) AS embedded, count(DISTINCT text) FILTER (WHERE doc_id % 3 = 0) AS cached FROM documents")
def embed_once(spark, sf):
    """Rows with vectors, texts that were embedded, and how many a second run finds in the cache of the first's third."""
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"), F.md5("text").alias("content_hash"))
    none = spark.createDataFrame([], "model_name string, content_hash string, vector array<float>, created_at timestamp")
    done, new = embed.embed_chunks(d, none, "hash-8")
    hits = changes.cache_split(d.filter("doc_id % 3 = 0").select("content_hash").distinct(), new.drop("created_at"), "hash-8").filter("cached_vector is not null")
    counted = lambda df, name: df.agg(F.count("*").alias(name))
    return counted(done, "done").crossJoin(counted(new, "embedded")).crossJoin(counted(hits, "cached"))  # three single rows


_BRANDS = "SELECT p_brand AS name, p_size AS a, p_partkey AS k FROM part"


@query(f"WITH b AS ({_BRANDS}) SELECT name, string_agg(v, ',' ORDER BY a DESC) AS versions FROM (SELECT DISTINCT name, a, 'v' || a AS v FROM b WHERE k % 3 <> 0) GROUP BY name")
def versions_of_sitemap(spark, sf):
    p = table(spark, sf, "part")
    base = F.concat(F.lit("https://x.org/"), F.replace("p_brand", F.lit("#"), F.lit("-")))
    urls = p.filter("p_partkey % 3 <> 0").select(F.col("p_brand").alias("name"), F.concat(base, F.lit("/v"), F.col("p_size"), F.lit("/intro")).alias("loc"))
    urls = urls.unionByName(p.select(F.col("p_brand").alias("name"), F.concat(base, F.when(F.col("p_size") == 1, "").otherwise(F.concat(F.lit("/guide/"), F.col("p_size")))).alias("loc")))
    out = discovery.detect(p.select(F.col("p_brand").alias("name"), base.alias("base_url")).distinct(), "sitemap", urls=urls)
    return out.select("name", F.array_join("versions", ",").alias("versions"))


@query("SELECT lower(n_name) AS name, array_to_string(list_filter(['3', '2', '1'], lambda v: (n_nationkey + v::INT) % 3 <> 0), ',') AS versions FROM nation")
def versions_by_url(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", F.lower("n_name").alias("name"))
    entries = n.select("name", F.lit(None).cast("string").alias("version_pattern"), F.concat(F.lit("https://"), F.col("name"), F.lit(".org")).alias("base_url"), F.array(*[F.lit(v) for v in "321"]).alias("known_versions"))
    v = n.select("n_nationkey", "name", F.explode(F.array(*[F.lit(v) for v in "1234"])).alias("v"))
    fetches = v.select(F.concat(F.lit("https://"), F.col("name"), F.lit(".org/"), F.col("v"), F.lit("/")).alias("url"), F.when((F.col("n_nationkey") + F.col("v").cast("int")) % 3 == 0, 404).otherwise(200).alias("status_code"))
    return discovery.detect(entries, "url_enumeration", fetches=fetches).select("name", F.array_join("versions", ",").alias("versions"))


@query("SELECT lower(r_name) AS name, '2,1' AS versions FROM region")
def versions_known(spark, sf):
    entries = table(spark, sf, "region").select(F.lower("r_name").alias("name"), F.array(F.lit("2"), F.lit("1")).alias("known_versions"))
    return discovery.detect(entries, "explicit").select("name", F.array_join("versions", ",").alias("versions"))


@query("SELECT r_name AS host, 'v' || r_regionkey || ',v9' AS versions FROM region WHERE r_regionkey <> 2")
def versions_of_dropdown(spark, sf):
    r = table(spark, sf, "region")
    url = F.concat(F.lit("https://"), F.col("r_regionkey"), F.lit(".org"))
    html = F.concat(F.lit('<select class="version"><option value="v'), F.col("r_regionkey"), F.lit('">v'), F.col("r_regionkey"), F.lit('</option><option value="v9">v9</option></select>'))
    pages = r.filter("r_regionkey <> 2").select(url.alias("url"), html.alias("html"))
    return discovery.detect(r.select(F.col("r_name").alias("name"), url.alias("base_url")), "dropdown_scraping", fetches=pages).select(F.col("name").alias("host"), F.array_join("versions", ",").alias("versions"))


@query("SELECT 'https://x.org/p' || p_partkey AS loc FROM part WHERE p_size < 20 UNION ALL SELECT 'https://x.org/root' AS loc")
def sitemap_tree(spark, sf):
    """All URLs under a root sitemap that is an index of one sitemap for each size below 20."""
    p = table(spark, sf, "part").filter("p_size < 20")
    name = F.concat(F.lit("https://x.org/s"), F.col("p_size"), F.lit(".xml"))
    one = F.concat(F.lit("<url><loc>https://x.org/p"), F.col("p_partkey"), F.lit("</loc></url>"))
    maps = p.groupBy(name.alias("url")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(one), ""), F.lit("</urlset>")).alias("xml"))
    child = F.concat(F.lit("<sitemap><loc>"), F.col("url"), F.lit("</loc></sitemap>"))
    root = maps.agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(child), ""), F.lit("<sitemap><loc>https://x.org/gone.xml</loc></sitemap></sitemapindex><url><loc>https://x.org/root</loc></url>")).alias("xml"))
    store = maps.unionByName(root.select(F.lit("https://x.org/sitemap.xml").alias("url"), "xml"))
    return web.sitemap_tree(store, "https://x.org/sitemap.xml").select("loc")


@query("SELECT lower(n_name) AS host, CASE WHEN n_nationkey % 2 = 0 THEN '/private/,/tmp' ELSE '/tmp' END AS disallowed, CASE WHEN n_nationkey % 3 = 0 THEN 1.5::DOUBLE END AS crawl_delay, 'https://x.org/s.xml' AS sitemaps FROM nation")
def robots_parse(spark, sf):
    n = table(spark, sf, "nation")
    own = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "Disallow: /private/ # ours\n").otherwise(""), F.lit("Disallow: /tmp\n"), F.when(F.col("n_nationkey") % 3 == 0, "Crawl-delay: 1.5\n").otherwise(""))
    robots = F.concat(F.lit("User-agent: other\nDisallow: /x\n\nUser-agent: *\n"), own, F.lit("Disallow:\nUser-agent: third\nDisallow: /y\nSitemap: https://x.org/s.xml"))
    out = web.robots(n.select(F.lower("n_name").alias("host"), robots.alias("robots")))
    return out.select("host", F.array_join("disallowed", ",").alias("disallowed"), "crawl_delay", F.array_join("sitemaps", ",").alias("sitemaps"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'c++' WHEN 2 THEN 'sql' END AS language FROM documents")
def class_language(spark, sf):
    css = F.element_at(F.array(*[F.lit(x) for x in ("code language-Python", "language-c++ wide", "highlight-SQL notranslate", "plain")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", text.class_language(css).alias("language"))


@query("SELECT DISTINCT software, version FROM (SELECT source AS software, lang AS version FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT source, 'latest' FROM documents)")
def versions_union(spark, sf):
    d = table(spark, sf, "documents")
    known = d.filter("doc_id % 2 = 0").select(F.col("source").alias("software"), F.col("lang").alias("version"))
    return known.unionByName(d.select(F.col("source").alias("software"), F.lit("latest").alias("version"))).distinct()


@query("SELECT url, min(depth) AS depth FROM (SELECT regexp_extract(url, '^([^?]*)', 1) AS url, (page_id % 5)::INT AS depth FROM pages) GROUP BY url")
def stream_first_seen(spark, sf):
    """The stateful filter of a streamed frontier, over the pages' URLs as a stream."""
    ensure_importable(spark)
    pages = spark.readStream.schema("page_id long, url string, html string").parquet(f"{sf.rstrip('/')}/pages.parquet*")
    urls = pages.select(F.regexp_extract("url", r"^([^?]*)", 1).alias("url"), (F.col("page_id") % 5).cast("int").alias("depth"))
    return updates.to_completion(updates.first_seen(urls), f"first_seen_{uuid.uuid4().hex}")
