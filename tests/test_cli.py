"""The command line and the SQL functions."""

import json

from paperloom import cli
from paperloom.plans import sql


def test_commands(spark, tmp_path, capsys):
    spark.createDataFrame([("https://x.org/a", "<title>Joins</title><main><p>hash join and merge join</p></main>"), ("https://x.org/b", "<title>Sorts</title><main><p>external sort</p></main>")], "url string, html string").write.parquet(f"{tmp_path}/pages")
    run = lambda *a: (cli.main(["--data-dir", f"{tmp_path}/kb", *a], spark), capsys.readouterr())
    assert json.loads(run("config")[1].out)["general"]["data_dir"] == f"{tmp_path}/kb"
    lines = run("config", "--source")[1].out.splitlines()
    assert f'general.data_dir  "{tmp_path}/kb"  override' in lines and any(x.endswith("  default") for x in lines)
    code, out = run("index", "sw", "--version", "1", "--pages", f"{tmp_path}/pages")
    assert code == 0 and "completed, 2 pages, 2 chunks" in out.out
    assert json.loads(run("stats", "sw")[1].out)["chunks"] == 2 and "sw" in run("list")[1].out
    hit = json.loads(run("search", "join", "sw", "--version", "1", "-k", "1", "--json")[1].out)
    assert hit["title"] in ("Joins", "Sorts") and "score" in hit
    assert run("delete", "sw")[0] == 0 and run("stats", "sw")[0] == 1
    assert cli.shortened("x" * 100) == "x" * 77 + "..."


def test_sql_functions(spark):
    sql.register(spark)
    spark.createDataFrame([("# A\nsome text\n## B\nmore", "T", "guide")], "markdown string, title string, page_type string").createOrReplaceTempView("md")
    rows = spark.sql("SELECT c.* FROM md, LATERAL chunk_markdown(markdown, title, page_type) c").collect()
    assert [r.section_heading for r in rows] == ["A"] and "more" in rows[0].content
    assert spark.sql("SELECT token_count('a b, c') AS n, content_hash(' A  b') = content_hash('a b') AS same").first() == (4, True)
