from pyspark.sql import functions as F

from tidemark.sources import extract as X
from tidemark.sources import html as H

PAGE = "<div id='main'><p>a text of more than <b>twenty</b> characters <a href='/x'>here</a></p><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td><a href='l'>2</a></td></tr></table><h2><a href='/p'>post</a></h2></div>"


def test_several_rules_in_one_parse(spark, sf_dir, monkeypatch):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = X.extracted(pages, "news,links,main").cache()
    assert found.columns[:3] == pages.columns
    for rule in ("news", "links", "main"):
        got = found.filter(F.col("rule") == rule).select(F.col("page_id").cast("string"), "pos", "text", "href")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, H.blocks(pages, X.BLOCKS[rule]).collect()))
    assert found.select("rule").distinct().count() == 3
    plan = X.extracted(pages, "news,links,main")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPythonUDTF") == 1


def test_all_rules_null_pages_and_sql(spark):
    df = spark.createDataFrame([(1, PAGE, "kept"), (2, None, "kept"), (3, "", "kept")], "pos_id int, page string, other string")
    got = X.extracted(df, ",".join([*X.BLOCKS, *X.TABLES, X.POSTS]), "page").collect()
    assert {r.pos_id for r in got} == {1} and {r.other for r in got} == {"kept"}
    assert {r.rule for r in got} >= {"news", "links", "main", "table", "table_links", "posts"}
    assert [[(c.name, c.value) for c in r.cells] for r in got if r.rule == "table_links"] == [[("A", "1"), ("B", "2"), ("_link", "l")]]
    assert [(r.text, r.href, r.id) for r in got if r.rule == "posts"] == [("post", "/p", "/p")]
    X.register(spark)
    df.createOrReplaceTempView("pages_given")
    told = spark.sql("SELECT pos_id, e.rule, e.text FROM pages_given, LATERAL tidemark_extract(page, 'links') e").collect()
    assert [tuple(r) for r in told] == [(1, "links", "here"), (1, "links", "2"), (1, "links", "post")]
