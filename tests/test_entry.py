"""The entry module: it imports without the optional parts, and queries equal their SQL."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from paperloom import queries

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(df, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(sql).df()
    got = df.toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    text = lambda x: sorted(map(tuple, x[columns].astype(str).to_numpy().tolist()))
    assert text(got) == text(want)


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    same(queries.QUERIES[name](spark, str(DATA)), queries.ORACLES[name])


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 10
    for name in set(queries.QUERIES) - set(queries.ORACLES):
        assert queries.QUERIES[name](spark, str(DATA)).count() > 0


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", ["vector_topk_filtered_batch", "vector_topk_l2_batch"])
def test_every_hundredth_vector_is_a_query(spark, name):
    wanted = {r.vec_id for r in queries.table(spark, str(DATA), "embeddings").filter("vec_id % 100 = 0").collect()}
    assert {r.qid for r in queries.QUERIES[name](spark, str(DATA)).collect()} == wanted


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_pages_are_classified_by_whole_texts(spark):
    rows = queries._typed(spark, str(DATA)).collect()
    share = [sum(len(b.content) for b in r.code_blocks) / max(len(r.markdown), 1) for r in rows if r.markdown]
    assert any(len(r.code_blocks) > 1 for r in rows) and sum(x > 0.1 for x in share) > len(share) / 20
    assert all(b.content in r.markdown for r in rows for b in r.code_blocks or [])


def test_entry_imports_without_optional_parts(tmp_path):
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['paperloom.llm'] = None\nimport __spark_entry__ as e\nassert len(e.queries()) > 50 and not any(n.startswith('op') for n in e.queries()) and len(e.oracle_sql()) > 40"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_headings_equal_sql_on_odd_lines(spark, tmp_path):
    texts = ["call 8970", "0 a\nb\nc\n3 d 33", "\n".join(f"{i} x {i}" for i in range(24)), " a  \n\n\n\u00a0b\u3000", "a\r\nb\r\nc\r\nd\r", "\x0b\n\n\n\x85e\u2028f", " \n\n\n\t\t", "#a\n## b\n# \r", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' as source").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.ORACLES["headings"]).fetchall()
    got = [tuple(r) for r in queries.headings(spark, str(tmp_path)).collect()]
    assert len(want) == 7 and sorted(got) == sorted(want)
