"""Queries of the core, and SQL that gives the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyq import api, further
from canopyq.functions import text
from canopyq.operators import packed
from canopyq.session import table, tuned
from canopyq.sources import pages

Query = Callable[[SparkSession, str], DataFrame]

#: The node table with rows of repeated deliveries once.
N = "WITH n AS (SELECT DISTINCT ON (doc_id, node_id) * FROM nodes) "
#: Columns that queries for nodes give.
COLUMNS = ["doc_id", "node_id", "name", "value"]
_cols = "x.doc_id, x.node_id, x.name, x.value"
_up = "JOIN n p ON p.doc_id = x.doc_id AND p.node_id = x.parent_id"
_in = "x.doc_id = a.doc_id AND x.node_id > a.node_id AND x.node_id <= a.last_desc"
_el = "x.kind = 'element'"
_named = "kind IN ('element', 'attribute')"


def _rank(where: str, order: str = "x.node_id") -> str:
    return f"(SELECT x.*, row_number() OVER (PARTITION BY x.doc_id, x.parent_id ORDER BY {order}) r, count(*) OVER (PARTITION BY x.doc_id, x.parent_id) c FROM n x WHERE {where})"


_string = "coalesce((SELECT string_agg(t.value, '' ORDER BY t.node_id) FROM n t WHERE t.kind = 'text' AND t.doc_id = x.doc_id AND t.node_id > x.node_id AND t.node_id <= x.last_desc), '')"

#: XPath and its SQL, by name.
PATHS: dict[str, tuple[str, str]] = {
    "links": ("//a/@href", f"SELECT {_cols} FROM n x {_up} WHERE x.kind = 'attribute' AND x.name = 'href' AND p.kind = 'element' AND p.name = 'a'"),
    "titles": ("//title/text()", f"SELECT {_cols} FROM n x {_up} WHERE x.kind = 'text' AND p.kind = 'element' AND p.name = 'title'"),
    "root_element": ("/html", f"SELECT {_cols} FROM n x WHERE x.parent_id = 0 AND x.node_id > 0 AND x.name = 'html'"),
    "root_node": ("/", f"SELECT {_cols} FROM n x WHERE x.kind = 'document'"),
    "lang": ("/html/@lang", f"SELECT {_cols} FROM n x {_up} WHERE x.kind = 'attribute' AND x.name = 'lang' AND p.parent_id = 0 AND p.name = 'html'"),
    "attribute_star": ("/html/attribute::*", f"SELECT {_cols} FROM n x {_up} WHERE x.kind = 'attribute' AND p.parent_id = 0 AND p.name = 'html'"),
    "all_attributes": ("//@*", f"SELECT {_cols} FROM n x WHERE x.kind = 'attribute'"),
    "all_text": ("//text()", f"SELECT {_cols} FROM n x WHERE x.kind = 'text'"),
    "child_names_match_attributes": ("//title", f"SELECT {_cols} FROM n x WHERE x.{_named} AND x.name = 'title'"),
    "child_star": ("//ul/*", f"SELECT {_cols} FROM n x {_up} WHERE {_el} AND p.kind = 'element' AND p.name = 'ul'"),
    "child_node": ("//p/node()", f"SELECT {_cols} FROM n x {_up} WHERE x.kind <> 'attribute' AND p.kind = 'element' AND p.name = 'p'"),
    "any_attribute_test": ("//figure/attribute()", f"SELECT {_cols} FROM n x {_up} WHERE p.name = 'figure' AND p.kind = 'element'"),
    "element_test": ("//section/element(h3)", f"SELECT {_cols} FROM n x {_up} WHERE {_el} AND x.name = 'h3' AND p.name = 'section' AND p.kind = 'element'"),
    "descendants": ("//section//a", f"SELECT DISTINCT {_cols} FROM n x JOIN n a ON {_in} WHERE x.name = 'a' AND x.{_named} AND a.name = 'section' AND a.kind = 'element'"),
    "descendant_or_self": ("//ul/descendant-or-self::li", f"SELECT DISTINCT {_cols} FROM n x JOIN n a ON {_in} WHERE x.name = 'li' AND x.kind = 'element' AND a.name = 'ul' AND a.kind = 'element'"),
    "parents": ("//a/parent::li", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'li' AND EXISTS (SELECT 1 FROM n c WHERE c.doc_id = x.doc_id AND c.parent_id = x.node_id AND c.kind = 'element' AND c.name = 'a')"),
    "dot_dot": ("//h1/..", f"SELECT {_cols} FROM n x WHERE EXISTS (SELECT 1 FROM n c WHERE c.doc_id = x.doc_id AND c.parent_id = x.node_id AND c.node_id > 0 AND c.kind = 'element' AND c.name = 'h1')"),
    "ancestors": ("//h1/ancestor::*", f"SELECT {_cols} FROM n x WHERE {_el} AND EXISTS (SELECT 1 FROM n c WHERE c.doc_id = x.doc_id AND c.node_id > x.node_id AND c.node_id <= x.last_desc AND c.kind = 'element' AND c.name = 'h1')"),
    "next_sibling": ("//h1/following-sibling::p", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'p' AND EXISTS (SELECT 1 FROM n c WHERE c.doc_id = x.doc_id AND c.parent_id = x.parent_id AND c.node_id < x.node_id AND c.kind = 'element' AND c.name = 'h1')"),
    "previous_sibling": ("//table/preceding-sibling::h1", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'h1' AND EXISTS (SELECT 1 FROM n c WHERE c.doc_id = x.doc_id AND c.parent_id = x.parent_id AND c.node_id > x.node_id AND c.kind = 'element' AND c.name = 'table')"),
    "following": ("//h1/following::figure", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'figure' AND EXISTS (SELECT 1 FROM n c WHERE c.doc_id = x.doc_id AND c.last_desc < x.node_id AND c.kind = 'element' AND c.name = 'h1')"),
    "preceding": ("//footer/preceding::h2", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'h2' AND EXISTS (SELECT 1 FROM n c WHERE c.doc_id = x.doc_id AND c.node_id > x.last_desc AND c.kind = 'element' AND c.name = 'footer')"),
    "self": ("//section/self::section", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'section'"),
    "second_item": ("//ul/li[2]", f"SELECT {_cols} FROM {_rank('x.' + _named + chr(32) + 'AND x.name = ' + chr(39) + 'li' + chr(39))} x {_up} WHERE x.r = 2 AND p.kind = 'element' AND p.name = 'ul'"),
    "every_second_p": ("//p[2]", f"SELECT {_cols} FROM {_rank('x.' + _named + chr(32) + 'AND x.name = ' + chr(39) + 'p' + chr(39))} x WHERE x.r = 2"),
    "last_item": ("//ul/li[last()]", f"SELECT {_cols} FROM {_rank('x.' + _named + chr(32) + 'AND x.name = ' + chr(39) + 'li' + chr(39))} x {_up} WHERE x.r = x.c AND p.kind = 'element' AND p.name = 'ul'"),
    "later_items": ("//ol/li[position()>1]", f"SELECT {_cols} FROM {_rank('x.' + _named + chr(32) + 'AND x.name = ' + chr(39) + 'li' + chr(39))} x {_up} WHERE x.r > 1 AND p.kind = 'element' AND p.name = 'ol'"),
    "shared_position": ("//ul/li[a][1]", f"SELECT {_cols} FROM {_rank('x.' + _named + chr(32) + 'AND x.name = ' + chr(39) + 'li' + chr(39))} x {_up} WHERE x.r = 1 AND p.kind = 'element' AND p.name = 'ul' AND EXISTS (SELECT 1 FROM n c WHERE c.doc_id = x.doc_id AND c.parent_id = x.node_id AND c.name = 'a')"),
    "second_of_document": ("(//p)[2]", f"SELECT {_cols} FROM (SELECT x.*, row_number() OVER (PARTITION BY doc_id ORDER BY node_id) r FROM n x WHERE x.{_named} AND x.name = 'p') x WHERE x.r = 2"),
    "attribute_equals": ("//p[@class='ad']/text()", f"SELECT {_cols} FROM n x {_up} WHERE x.kind = 'text' AND p.kind = 'element' AND p.name = 'p' AND p.attrs['class'] = 'ad'"),
    "attribute_exists": ("//img[@alt][@data-sizes]", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'img' AND list_contains(map_keys(x.attrs), 'alt') AND list_contains(map_keys(x.attrs), 'data-sizes')"),
    "attribute_differs": ("//div[@class!='user']", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'div' AND x.attrs['class'] <> 'user'"),
    "without_attribute": ("//div[not(@class)]", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'div' AND NOT list_contains(map_keys(x.attrs), 'class')"),
    "across_types": ("//a[@href>1]", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'a' AND list_contains(map_keys(x.attrs), 'href')"),
    "links_containing": ("//a[contains(@href,'tag')]/@href", f"SELECT {_cols} FROM n x {_up} WHERE x.kind = 'attribute' AND x.name = 'href' AND p.name = 'a' AND contains(p.attrs['href'], 'tag')"),
    "starts_with": ("//a[starts-with(@href, '/c')]", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'a' AND starts_with(x.attrs['href'], '/c')"),
    "string_value_equals": ("//button[.='Accept all']", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'button' AND {_string} = 'Accept all'"),
    "normalized": ("//h1[string-length(normalize-space(.))>20]", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'h1' AND length(trim(regexp_replace({_string}, '[\\t-\\r \\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))) > 20"),
    "with_child": ("//section[h3]/p", f"SELECT {_cols} FROM n x {_up} WHERE x.{_named} AND x.name = 'p' AND p.kind = 'element' AND p.name = 'section' AND EXISTS (SELECT 1 FROM n c WHERE c.doc_id = p.doc_id AND c.parent_id = p.node_id AND c.name = 'h3')"),
    "without_child": ("//li[not(a)]", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'li' AND NOT EXISTS (SELECT 1 FROM n c WHERE c.doc_id = x.doc_id AND c.parent_id = x.node_id AND c.name = 'a')"),
    "both": ("//li[a and not(@class)]", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'li' AND NOT list_contains(map_keys(x.attrs), 'class') AND EXISTS (SELECT 1 FROM n c WHERE c.doc_id = x.doc_id AND c.parent_id = x.node_id AND c.name = 'a')"),
    "counted": ("//ul[count(li)>3]", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'ul' AND (SELECT count(*) FROM n c WHERE c.doc_id = x.doc_id AND c.parent_id = x.node_id AND c.name = 'li') > 3"),
    "absolute_in_predicate": ("//a[contains(@href, /html/@lang)]", f"SELECT {_cols} FROM n x JOIN (SELECT DISTINCT a.doc_id, a.value FROM n a JOIN n h ON h.doc_id = a.doc_id AND h.node_id = a.parent_id WHERE a.kind = 'attribute' AND a.name = 'lang' AND h.parent_id = 0 AND h.name = 'html') l ON l.doc_id = x.doc_id WHERE {_el} AND x.name = 'a' AND contains(coalesce(x.attrs['href'], ''), coalesce(l.value, ''))"),
    "some": ("//ul[some $x in li satisfies $x/@class='x']", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'ul' AND EXISTS (SELECT 1 FROM n c WHERE c.doc_id = x.doc_id AND c.parent_id = x.node_id AND c.kind = 'element' AND c.name = 'li' AND c.attrs['class'] = 'x')"),
    "every": ("//ul[every $x in li satisfies $x/a]", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'ul' AND NOT EXISTS (SELECT 1 FROM n c WHERE c.doc_id = x.doc_id AND c.parent_id = x.node_id AND c.name = 'li' AND NOT EXISTS (SELECT 1 FROM n d WHERE d.doc_id = c.doc_id AND d.parent_id = c.node_id AND d.name = 'a'))"),
    "union": ("//h1 | //h2", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name IN ('h1', 'h2')"),
    "comma": ("//h3, //h3, //h4", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name IN ('h3', 'h4')"),
    "intersect": ("//section/p intersect //p[@class]", f"SELECT {_cols} FROM n x {_up} WHERE {_el} AND x.name = 'p' AND p.kind = 'element' AND p.name = 'section' AND list_contains(map_keys(x.attrs), 'class')"),
    "except": ("//p except //section/p", f"SELECT {_cols} FROM n x {_up} WHERE {_el} AND x.name = 'p' AND NOT (p.kind = 'element' AND p.name = 'section')"),
    "for": ("for $x in //ul return $x/li", f"SELECT {_cols} FROM n x {_up} WHERE x.{_named} AND x.name = 'li' AND p.kind = 'element' AND p.name = 'ul'"),
    "let": ("let $x := //ol return $x/li", f"SELECT {_cols} FROM n x {_up} WHERE x.{_named} AND x.name = 'li' AND p.kind = 'element' AND p.name = 'ol'"),
    "if": ("if (//h1) then //h1 else //h2", f"SELECT {_cols} FROM n x WHERE {_el} AND (x.name = 'h1' OR x.name = 'h2' AND NOT EXISTS (SELECT 1 FROM n c WHERE c.doc_id = x.doc_id AND c.kind = 'element' AND c.name = 'h1'))"),
    "simple_map": ("//tr ! td[1]", f"SELECT {_cols} FROM {_rank('x.' + _named + chr(32) + 'AND x.name = ' + chr(39) + 'td' + chr(39))} x {_up} WHERE x.r = 1 AND p.kind = 'element' AND p.name = 'tr'"),
    "fn_root": ("/html/body/fn:root()", f"SELECT {_cols} FROM n x WHERE x.kind = 'document' AND EXISTS (SELECT 1 FROM n c JOIN n h ON h.doc_id = c.doc_id AND h.node_id = c.parent_id WHERE c.doc_id = x.doc_id AND c.name = 'body' AND c.kind = 'element' AND h.name = 'html' AND h.parent_id = 0)"),
    "treat": ("/html treat as node()?", f"SELECT {_cols} FROM n x WHERE x.parent_id = 0 AND x.node_id > 0 AND x.name = 'html'"),
    "path_alternatives": ("//ul/(li|p)/a", f"SELECT {_cols} FROM n x {_up} JOIN n g ON g.doc_id = p.doc_id AND g.node_id = p.parent_id WHERE {_el} AND x.name = 'a' AND p.kind = 'element' AND p.name IN ('li', 'p') AND g.kind = 'element' AND g.name = 'ul'"),
}

#: XPath that gives a value for each document, and the value in SQL over d, the documents.
VALUES: dict[str, tuple[str, str]] = {
    "count_p": ("count(//p)", "CAST((SELECT count(*) FROM n c WHERE c.doc_id = d.doc_id AND c.name = 'p') AS VARCHAR)"),
    "arithmetic": ("count(//li) * 2 - 1", "CAST((SELECT count(*) FROM n c WHERE c.doc_id = d.doc_id AND c.name = 'li') * 2 - 1 AS VARCHAR)"),
    "concatenation": ("'lang ' || /html/@lang", "'lang ' || coalesce((SELECT any_value(a.value) FROM n a JOIN n h ON h.doc_id = a.doc_id AND h.node_id = a.parent_id WHERE a.doc_id = d.doc_id AND a.kind = 'attribute' AND a.name = 'lang' AND h.parent_id = 0 AND h.name = 'html'), '')"),
    "exists_h1": ("exists(//h1)", "CAST(EXISTS (SELECT 1 FROM n c WHERE c.doc_id = d.doc_id AND c.kind = 'element' AND c.name = 'h1') AS VARCHAR)"),
    "instance_of": ("//h1 instance of element()", "CAST((SELECT count(*) FROM n c WHERE c.doc_id = d.doc_id AND c.kind = 'element' AND c.name = 'h1') = 1 AS VARCHAR)"),
    "castable": ("/html/@lang castable as xs:integer", "'false'"),
}


def _path(expression: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return api.find(table(tuned(spark), sf_dir, "nodes"), expression, ordered=False, repeated=True).select(*COLUMNS)

    return run


def _value(expression: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return api.find(table(tuned(spark), sf_dir, "nodes"), expression, ordered=False, repeated=True).select("doc_id", "value")

    return run


def _once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node table with rows of repeated deliveries once, for helpers that want it so."""
    return table(tuned(spark), sf_dir, "nodes").dropDuplicates(["doc_id", "node_id"])


def _elements(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, "nodes").filter("kind = 'element'").filter(F.col("name") == name)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page once: a page delivered again has the same text."""
    return table(spark, sf_dir, "pages").groupBy("page_id").agg(F.max_by("html", "ingested_at").alias("html"))


def parse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.html_nodes(_pages(spark, sf_dir), "page_id", "html", "close").drop("value", "only_whitespace", "attrs")


def parse_void(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, nodes and depth under the policy that lets any end tag close the current element."""
    nodes = pages.html_nodes(_pages(spark, sf_dir), "page_id", "html", "void")
    return nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("level").alias("depth"))


def parse_strict_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.parse_errors(_pages(spark, sf_dir), "page_id", "html", "error").groupBy("error_code").agg(F.count(F.lit(1)).alias("n"))


def page_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.parse_errors(_pages(spark, sf_dir), "page_id", "html", "close")


def find_on_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsing and a query in one plan."""
    nodes = pages.html_nodes(_pages(tuned(spark), sf_dir), "page_id", "html", "close")
    return api.find(nodes, "//nav//a", ordered=False).select("doc_id", "node_id", "name")


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.to_html(table(spark, sf_dir, "nodes"))


def round_trip_indented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.to_html(table(spark, sf_dir, "nodes"), "indented")


def relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(tuned(spark), sf_dir, "nodes")
    return api.apply_to_items(nodes, _elements(spark, sf_dir, "ul"), "//a", repeated=True).select("doc_id", "item_id", "node_id")


def h1_text_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.text_content(table(spark, sf_dir, "nodes"), _elements(spark, sf_dir, "h1"))


def p_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.text(_once(spark, sf_dir), _elements(spark, sf_dir, "p"))


def li_itertext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.itertext(_once(spark, sf_dir), _elements(spark, sf_dir, "li"))


def p_get_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.get_text(table(spark, sf_dir, "nodes"), _elements(spark, sf_dir, "p"))


def p_get_all_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.get_all_text(table(spark, sf_dir, "nodes"), _elements(spark, sf_dir, "p"))


def ul_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.children(_once(spark, sf_dir), _elements(spark, sf_dir, "ul")).select("doc_id", "item_id", "node_id")


def a_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.parent(_once(spark, sf_dir), _elements(spark, sf_dir, "a")).select("doc_id", "item_id", "node_id")


def img_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.attributes(table(spark, sf_dir, "nodes"), _elements(spark, sf_dir, "img"))


def escaped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nodes").filter("kind = 'text' and value is not null").dropDuplicates(["doc_id", "node_id"])
    return nodes.select("doc_id", "node_id", text.escaped(F.col("value")).alias("escaped"))


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nodes").filter("kind = 'element'").select("doc_id", "node_id", "name").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("pages"))


def tags_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "nodes").filter("kind = 'element' and site is not null").select("doc_id", "node_id", "name", "site").distinct()
    return e.rollup("site", "name").agg(F.count(F.lit(1)).alias("n"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.packed_attributes(table(spark, sf_dir, "nodes"))


_SPACED = "list_reduce(list(x.value ORDER BY x.node_id), lambda a, b: CASE WHEN regexp_matches(a, '[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]$') OR regexp_matches(b, '^[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]') THEN a || b ELSE a || ' ' || b END)"
_OTHERS: dict[str, tuple[Query, str | None]] = {
    "parse_pages": (parse_pages, N + "SELECT doc_id, node_id, parent_id, kind, kind_rank, name, level, last_desc FROM n"),
    "page_errors": (page_errors, "SELECT DISTINCT doc_id, error_code, error_msg FROM parse_errors"),
    "parse_void": (parse_void, None),
    "parse_strict_errors": (parse_strict_errors, None),
    "find_on_pages": (find_on_pages, N + f"SELECT DISTINCT x.doc_id, x.node_id, x.name FROM n x JOIN n a ON {_in} WHERE x.name = 'a' AND {_el} AND a.name = 'nav' AND a.kind = 'element'"),
    "round_trip": (round_trip, further.written()),
    "round_trip_indented": (round_trip_indented, further.written(" AND NOT coalesce(only_whitespace, false)", True)),
    "relative": (relative, N + f"SELECT DISTINCT x.doc_id, a.node_id AS item_id, x.node_id FROM n x JOIN n a ON {_in} WHERE x.name = 'a' AND {_el} AND a.name = 'ul' AND a.kind = 'element'"),
    "h1_text_content": (h1_text_content, N + f"SELECT x.doc_id, x.node_id AS item_id, {_string} AS text_content FROM n x WHERE {_el} AND x.name = 'h1'"),
    "p_text": (p_text, N + f"SELECT x.doc_id, x.node_id AS item_id, (SELECT arg_min(t.value, t.node_id) FROM n t WHERE t.doc_id = x.doc_id AND t.parent_id = x.node_id AND t.kind = 'text') AS text FROM n x WHERE {_el} AND x.name = 'p'"),
    "li_itertext": (li_itertext, N + f"SELECT x.doc_id, a.node_id AS item_id, x.node_id, x.value FROM n x JOIN n a ON {_in} WHERE x.kind = 'text' AND x.value IS NOT NULL AND a.kind = 'element' AND a.name = 'li'"),
    "p_get_text": (p_get_text, N + f"SELECT a.doc_id, a.node_id AS item_id, t.text FROM n a LEFT JOIN (SELECT x.doc_id, x.parent_id, {_SPACED} AS text FROM n x WHERE x.kind = 'text' AND x.value IS NOT NULL GROUP BY 1, 2) t ON t.doc_id = a.doc_id AND t.parent_id = a.node_id WHERE a.kind = 'element' AND a.name = 'p'"),
    "p_get_all_text": (p_get_all_text, N + f"SELECT a.doc_id, a.node_id AS item_id, t.text FROM n a LEFT JOIN (SELECT a.doc_id, a.node_id, {_SPACED} AS text FROM n x JOIN n a ON {_in} WHERE x.kind = 'text' AND x.value IS NOT NULL AND a.kind = 'element' AND a.name = 'p' GROUP BY 1, 2) t ON t.doc_id = a.doc_id AND t.node_id = a.node_id WHERE a.kind = 'element' AND a.name = 'p'"),
    "ul_children": (ul_children, N + f"SELECT x.doc_id, x.parent_id AS item_id, x.node_id FROM n x {_up} WHERE p.kind = 'element' AND p.name = 'ul' AND x.node_id > 0"),
    "a_parent": (a_parent, N + f"SELECT x.doc_id, x.node_id AS item_id, x.parent_id AS node_id FROM n x WHERE {_el} AND x.name = 'a'"),
    "img_attributes": (img_attributes, N + f"SELECT x.doc_id, x.node_id AS item_id, unnest(map_keys(x.attrs)) AS name, unnest(map_values(x.attrs)) AS value FROM n x WHERE {_el} AND x.name = 'img'"),
    "escaped_texts": (escaped_texts, N + "SELECT doc_id, node_id, replace(replace(replace(replace(replace(value, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM n WHERE kind = 'text' AND value IS NOT NULL"),
    "tag_counts": (tag_counts, N + "SELECT name, count(*) AS n, count(DISTINCT doc_id) AS pages FROM n WHERE kind = 'element' GROUP BY 1"),
    "tags_by_site": (tags_by_site, N + "SELECT site, name, count(*) AS n FROM n WHERE kind = 'element' AND site IS NOT NULL GROUP BY ROLLUP (site, name)"),
    "p5_found": (p5_found, None),
}


def queries() -> dict[str, Query]:
    out = {name: _path(e) for name, (e, _) in PATHS.items()}
    out |= {name: _value(e) for name, (e, _) in VALUES.items()}
    return out | {name: q for name, (q, _) in _OTHERS.items()} | further.queries()


def oracle_sql() -> dict[str, str]:
    out = {name: N + sql for name, (_, sql) in PATHS.items()}
    out |= {name: N + f"SELECT d.doc_id, {sql} AS value FROM n d WHERE d.kind = 'document'" for name, (_, sql) in VALUES.items()}
    return out | {name: sql for name, (_, sql) in _OTHERS.items() if sql} | further.oracle_sql()
