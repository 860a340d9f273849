"""Main body of pages: what recurs over the pages of a host goes, what is the page's own stays."""

import pytest

from canopyq.html import tree
from canopyq.llm import boilerplate

SCHEMA = "doc_id long, node_id int, parent_id int, kind string, name string, value string, only_whitespace boolean, attrs map<string,string>, site string"
MENU = "<nav class='n'><ul><li><a>Home</a></li><li><a>News</a></li><li><a>Shop</a></li></ul></nav>"
FOOT = "<footer><small>All rights reserved by us</small><a>Help</a></footer>"


def table(spark, pages, site="h.test"):
    """pages: html, or (html, site)."""
    rows = []
    for doc, page in enumerate(pages, 1):
        html, host = page if isinstance(page, tuple) else (page, site)
        for r in tree.rows(tree.build(html, "close")):
            rows.append((doc, r[0], r[1], r[2], r[4], r[5], r[6], r[9], host))
    return spark.createDataFrame(rows, SCHEMA)


def kept(nodes, **options):
    found = boilerplate.main_text_nodes(nodes, **options)
    return sorted(r.value for r in found.join(nodes.dropDuplicates(["doc_id", "node_id"]), ["doc_id", "node_id"]).collect())


def bodies(n, page):
    return [page.format(f"The {w} bridge of page {w} was built by {w} workers.", f"It carries {w} carts over the {w} river each day.") for w in ("old", "new", "red", "tall", "long", "grey")[:n]]


@pytest.mark.parametrize(
    "page",
    [
        "<html><body>MENU<h1>{0}</h1><div class='content'><p>{0}</p><p>{1}</p></div>FOOT</body></html>",
        "<html><body>MENU<div class='content'><p>{0}</p><p>{1}</p></div>FOOT</body></html>",
        "<html><body>MENU<main><p>{0}</p><section><h2>Introduction</h2><p>{1}</p></section></main>FOOT</body></html>",
        "<html><body>MENU<section><h2>Introduction</h2><p>{0}</p></section><section><h2>Summary</h2><p>{1}</p></section>FOOT</body></html>",
        "<html><body>MENU<div><h1>{0}</h1></div><div><p>{1}</p></div>FOOT</body></html>",
    ],
)
def test_bodies_of_their_own_stay_in_any_box(spark, page):
    page = page.replace("MENU", MENU).replace("FOOT", FOOT)
    got = kept(table(spark, bodies(5, page)))
    for html in bodies(5, "{0}|{1}"):
        for sentence in html.split("|"):
            assert ("{0}" not in page or sentence in got) and sentence.replace("|", "") in got
    assert not {"Home", "News", "Shop", "Help", "All rights reserved by us"} & set(got)


def test_what_stands_before_the_headline_stays_unless_it_recurs(spark):
    page = "<html><body>" + MENU + "<div class='lead'><p>{1}</p></div><h1>{0}</h1><p>{0}</p></body></html>"
    got = kept(table(spark, bodies(4, page)))
    assert len(got) == 12


def test_a_side_block_inside_the_body_goes_alone(spark):
    page = "<html><body><div id='wrap'><h1>{0}</h1><p>{1}</p><aside><h4>Read also</h4><p>About {0}</p></aside><p>{0}</p></div></body></html>"
    got = kept(table(spark, bodies(4, page)))
    assert "Read also" not in got and not any(t.startswith("About") for t in got) and len(got) == 12


def test_two_pages_are_not_many(spark):
    pages = bodies(2, "<html><body>" + MENU + "<p>{0}</p></body></html>")
    assert "Home" in kept(table(spark, pages)) and "Home" not in kept(table(spark, pages), least_pages=2)


def test_hosts_count_where_pages_of_one_do_not(spark):
    pages = [(html, f"h{k}.test") for k, html in enumerate(bodies(4, "<html><body>" + MENU + "<h1>{0}</h1><p>{1}</p></body></html>"))]
    got = kept(table(spark, pages))
    assert "Home" not in got and len(got) == 8


def test_a_shuffle_join_gives_what_a_broadcast_gives(spark):
    nodes = table(spark, bodies(6, "<html><body>" + MENU + "<h1>{0}</h1><p>{1}</p>" + FOOT + "</body></html>"))
    assert kept(nodes) == kept(nodes, most_broadcast=0) and len(kept(nodes)) == 12


def test_odd_rows(spark):
    pages = [*bodies(3, "<html><body>" + MENU + "<h1>{0}</h1><p>{1}</p></body></html>"), ("<html><body><p>Alone</p></body></html>", None), "<html></html>"]
    nodes = table(spark, pages)
    twice = nodes.union(nodes)
    assert kept(twice) == kept(nodes) and "Alone" in kept(nodes)
    clash = nodes.selectExpr("*", "1 as h", "2 as hashes", "3 as tree", "'x' as t")
    assert kept(clash) == kept(nodes)
    lost = nodes.selectExpr("doc_id", "node_id", "parent_id", "kind", "if(kind = 'element', name, null) as name", "if(kind = 'text', null, value) as value", "only_whitespace", "attrs", "site")
    assert kept(lost) == []
    assert boilerplate.main_text_nodes(nodes.filter("false")).count() == 0


def test_a_very_long_text_stays_whole(spark):
    long = " ".join(f"Sentence {k} of a text that is long." for k in range(20_000))
    pages = [*bodies(3, "<html><body>" + MENU + "<h1>{0}</h1><p>{1}</p></body></html>"), f"<html><body>{MENU}<div><p>{long}</p></div></body></html>"]
    assert long in kept(table(spark, pages))
