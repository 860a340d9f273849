"""Sources, text helpers, sinks and streams over node tables."""

import pytest
from pyspark.sql import functions as F

from canopyq import session
from canopyq.functions import text
from canopyq.html import tree
from canopyq.sources import pages
from canopyq.streaming.pages import find_stream

HTML = '<html id="x"><p>foo<b>bar</b>baz <i> q</i></p><br><p></p> <p>a&amp;b</p></html>'


@pytest.fixture(scope="module")
def nodes(spark):
    df = pages.html_nodes(spark.createDataFrame([(1, HTML)], "id long, html string"), "id", "html").persist()
    yield df
    df.unpersist()


def elements(nodes, name):
    return nodes.filter("kind = 'element'").filter(F.col("name") == name)


def test_parse_modes(spark):
    df = spark.createDataFrame([(1, "<a></a>", "x"), (2, "<a></b>", "y"), (3, None, "z"), (4, "", "w"), (1, "<a></a>", "again")], "id int, html string, kind string")
    assert sorted(r.doc_id for r in pages.html_nodes(df, "id", "html").collect()) == [1, 1, 1, 1]
    assert sorted((r.doc_id, r.error_code) for r in pages.parse_errors(df, "id", "html").collect()) == [(2, "EndTagMismatch"), (4, "MissingRootNode")]
    assert {r.doc_id for r in pages.html_nodes(df, "id", "html", "void").collect()} == {1, 2}
    with pytest.raises(Exception, match="EndTagMismatch|MissingRootNode"):
        pages.html_nodes(df, "id", "html", mode="FAILFAST").collect()
    with pytest.raises(ValueError, match="mode"):
        pages.html_nodes(df, "id", "html", mode="?")
    assert pages.html_nodes(df.limit(0), "id", "html").collect() == []


def test_table_function(spark):
    pages.register(spark)
    spark.createDataFrame([(1, HTML), (2, "<a></b>"), (3, None)], "id long, html string").createOrReplaceTempView("some_pages")
    got = spark.sql("SELECT id, count(*) n FROM some_pages, LATERAL html_nodes(html, 'error') GROUP BY id").collect()
    assert [(r.id, r.n) for r in got] == [(1, len(tree.rows(tree.build(HTML))))]


def test_texts(nodes):
    p = elements(nodes, "p")
    assert sorted(r.text_content for r in text.text_content(nodes, p).collect()) == ["", "a&b", "foobarbaz  q"]
    assert sorted(str(r.text) for r in text.text(nodes, p).collect()) == ["None", "a&b", "foo"]
    assert sorted(str(r.text) for r in text.get_text(nodes, p).collect()) == ["None", "a&b", "foo baz "]
    assert sorted(str(r.text) for r in text.get_all_text(nodes, p).collect()) == ["None", "a&b", "foo bar baz  q"]
    assert text.itertext(nodes, p).count() == 5
    attribute = nodes.filter("kind = 'attribute'")
    assert [r.text_content for r in text.text_content(nodes, attribute).collect()] == [""]
    assert text.text_content(nodes, p.limit(0)).collect() == []


def test_neighbours(nodes):
    assert text.children(nodes, elements(nodes, "html")).count() == 6
    assert [r.name for r in text.parent(nodes, elements(nodes, "b")).collect()] == ["p"]
    assert text.parent(nodes, nodes.filter("kind = 'document'")).count() == 0
    assert [(r.name, r.value) for r in text.attributes(nodes, elements(nodes, "html")).collect()] == [("id", "x")]
    assert [r[0] for r in elements(nodes, "html").select(text.get_attribute("id")).collect()] == ["x"]
    shown = {r[0] for r in nodes.select(text.display()).collect()}
    assert {"document", '<html id="x">', 'id="x"', "foo"} <= shown


def test_strings(spark):
    df = spark.createDataFrame([("  a \t b ",), ("<&>\"'",), (None,)], "v string")
    assert [r[0] for r in df.select(text.trim_internal_whitespace(F.col("v"))).collect()] == ["a b", "<&>\"'", None]
    assert [r[0] for r in df.select(text.escaped(F.col("v"))).collect()][1:] == ["&lt;&amp;&gt;&quot;&#39;", None]


def test_sinks(nodes):
    standard = '<html id="x"><p>foo<b>bar</b>baz <i> q</i></p><br><p></p> <p>a&amp;b</p></html>'
    assert text.to_html(nodes).first().html == standard
    assert text.to_html(nodes.unionByName(nodes)).collect()[0].html == standard
    assert text.to_html(nodes, "ignore_whitespace").first().html == standard.replace("</p> <p>", "</p><p>")
    indented = text.to_html(nodes, "indented").first().html
    assert indented.splitlines()[:4] == ['<html id="x">', "    <p>", "        foo", "        <b>"]
    assert tree.rows(tree.build(standard))[3][4] == "p"
    with pytest.raises(ValueError, match="form"):
        text.to_html(nodes, "other")


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, '<a href="u">x</a>'), (2, "<p></p>")], "id long, html string").write.parquet(str(source))
    out: list = []
    stream = spark.readStream.schema("id long, html string").parquet(str(source))
    find_stream(stream, "id", "html", "//a/@href", lambda df, _: out.extend(df.collect()), str(tmp_path / "checkpoint")).awaitTermination(60)
    assert [(r.doc_id, r.value) for r in out] == [(1, "u")]


def test_session_settings(spark):
    session.tuned(spark)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "false"
    assert session.cut(spark.range(3)).count() == 3
    assert session.shipped(spark) is spark


def test_joins_of_a_partitioned_table_add_no_shuffle(spark, nodes):
    from canopyq import api

    session.tuned(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = nodes.repartition(4, "doc_id").persist()
        kept.count()
        plan = api.find(kept, "//p/b", ordered=False)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan.split("InMemoryRelation")[0]
        kept.unpersist()
        pages.save_nodes(nodes, "saved_nodes", buckets=4, mode="overwrite")
        found = api.find(spark.table("saved_nodes"), "//p/b", ordered=False)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == api.find(nodes, "//p/b").count() == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_entry_names_agree():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_handlers_are_sent_to_the_workers(spark):
    df = spark.createDataFrame([(1, "<html><p><b>x</p></html>")], "id long, html string")
    ignore = lambda names, tag: names[::-1].index(tag) + 1 if tag in names else 0
    assert [r.name for r in pages.html_nodes(df, "id", "html", ignore).filter("kind = 'element'").orderBy("node_id").collect()] == ["html", "p", "b"]
    assert pages.parse_errors(df, "id", "html", lambda names, tag: None).first().error_code == "EndTagMismatch"
