"""Further queries of the core and their SQL: the rest of the path language, values, entry points, sinks, windows and joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopyq import api
from canopyq.functions import text
from canopyq.html.tree import VOID
from canopyq.operators import joins
from canopyq.session import table, tuned, with_checkpoint_dir
from canopyq.sources import pages
from canopyq.streaming import windows
from canopyq.streaming.pages import find_stream

Query = Callable[[SparkSession, str], DataFrame]

#: The node table with rows of repeated deliveries once.
N = "WITH n AS (SELECT DISTINCT ON (doc_id, node_id) * FROM nodes) "
COLUMNS = ["doc_id", "node_id", "name", "value"]
_cols = "x.doc_id, x.node_id, x.name, x.value"
_up = "JOIN n p ON p.doc_id = x.doc_id AND p.node_id = x.parent_id"
_el = "x.kind = 'element'"
_named = "kind IN ('element', 'attribute')"
_items = "(SELECT count(*) FROM n c WHERE c.doc_id = x.doc_id AND c.parent_id = x.node_id AND c.name = 'li')"
_first_p = "(SELECT min(c.node_id) FROM n c WHERE c.doc_id = x.doc_id AND c.parent_id = x.parent_id AND c.name = 'p')"


def _string(x: str) -> str:
    return f"coalesce((SELECT string_agg(t.value, '' ORDER BY t.node_id) FROM n t WHERE t.kind = 'text' AND t.doc_id = {x}.doc_id AND t.node_id > {x}.node_id AND t.node_id <= {x}.last_desc), '')"


def _of(where: str) -> str:
    return f"(SELECT count(*) FROM n c WHERE c.doc_id = d.doc_id AND {where})"


#: XPath for nodes and its SQL, by name.
PATHS: dict[str, tuple[str, str]] = {
    "or": ("//li[a or @class]", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'li' AND (list_contains(map_keys(x.attrs), 'class') OR EXISTS (SELECT 1 FROM n c WHERE c.doc_id = x.doc_id AND c.parent_id = x.node_id AND c.name = 'a'))"),
    "value_eq": ("//div[@class eq 'user']", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'div' AND x.attrs['class'] = 'user'"),
    "value_ne": ("//div[@class ne 'user']", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'div' AND x.attrs['class'] <> 'user'"),
    **{
        name: (f"//ul[count(li) {op} 3]", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'ul' AND {_items} {sql} 3")
        for name, op, sql in (("at_most", "<=", "<="), ("at_least", ">=", ">="), ("value_lt", "lt", "<"), ("value_le", "le", "<="), ("value_gt", "gt", ">"), ("value_ge", "ge", ">="))
    },
    "less_across_types": ("//a[1<=@href]", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'a' AND list_contains(map_keys(x.attrs), 'href')"),
    "node_is": ("//p[.. is /html/body]", f"SELECT {_cols} FROM n x {_up} WHERE {_el} AND x.name = 'p' AND p.node_id = (SELECT min(b.node_id) FROM n b JOIN n h ON h.doc_id = b.doc_id AND h.node_id = b.parent_id WHERE b.doc_id = x.doc_id AND b.name = 'body' AND b.kind = 'element' AND h.parent_id = 0 AND h.name = 'html')"),
    "node_before": ("//h2[. << ../p[1]]", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'h2' AND x.node_id < {_first_p}"),
    "node_after": ("//h2[. >> ../p[1]]", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'h2' AND x.node_id > {_first_p}"),
    "any_prefix": ("//*:li", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'li'"),
    "uri_name": ("//Q{}h1", f"SELECT {_cols} FROM n x WHERE x.{_named} AND x.name = 'h1'"),
    "ancestor_or_self": ("//h1/ancestor-or-self::*", f"SELECT DISTINCT {_cols} FROM n x JOIN n a ON a.doc_id = x.doc_id AND a.node_id >= x.node_id AND a.node_id <= x.last_desc WHERE {_el} AND a.kind = 'element' AND a.name = 'h1'"),
    "document_test": ("/self::document-node()", f"SELECT {_cols} FROM n x WHERE x.kind = 'document'"),
    "document_of_element": ("/self::document-node(element(html))", f"SELECT {_cols} FROM n x WHERE x.kind = 'document' AND EXISTS (SELECT 1 FROM n r WHERE r.doc_id = x.doc_id AND r.parent_id = 0 AND r.node_id > 0 AND r.kind = 'element' AND r.name = 'html')"),
    "named_attribute_test": ("//a/attribute(href)", f"SELECT {_cols} FROM n x {_up} WHERE x.kind = 'attribute' AND x.name = 'href' AND p.kind = 'element' AND p.name = 'a'"),
    "typed_attribute_test": ("//img/attribute(*, xs:untypedAtomic)", f"SELECT {_cols} FROM n x {_up} WHERE x.kind = 'attribute' AND p.kind = 'element' AND p.name = 'img'"),
    "typed_element_test": ("//section/element(*, xs:untyped)", f"SELECT {_cols} FROM n x {_up} WHERE {_el} AND p.kind = 'element' AND p.name = 'section'"),
    "kinds_html_has_not": ("//comment() | //processing-instruction() | //namespace-node() | //html/namespace::*", f"SELECT {_cols} FROM n x WHERE false"),
    "comment_in_expression": ("//h1(: the (: only :) headline :)/text()", f"SELECT {_cols} FROM n x {_up} WHERE x.kind = 'text' AND p.kind = 'element' AND p.name = 'h1'"),
    "with_descendant": ("//section[.//a]", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'section' AND EXISTS (SELECT 1 FROM n a WHERE a.doc_id = x.doc_id AND a.node_id > x.node_id AND a.node_id <= x.last_desc AND a.name = 'a')"),
    "two_variables": ("//ul[some $x in li, $y in li satisfies $x << $y]", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'ul' AND (SELECT count(*) FROM n c WHERE c.doc_id = x.doc_id AND c.parent_id = x.node_id AND c.kind = 'element' AND c.name = 'li') > 1"),
    "variable_in_predicate": ("for $x in //ul return //li[.. is $x]", f"SELECT {_cols} FROM n x {_up} WHERE {_el} AND x.name = 'li' AND p.kind = 'element' AND p.name = 'ul'"),
    "contains_in_any": ("//*[contains(., 'Read also')]", f"SELECT {_cols} FROM n x WHERE {_el} AND contains({_string('x')}, 'Read also')"),
    "array_of_nodes": ("[//h1, //h2]?2", f"SELECT {_cols} FROM n x WHERE x.{_named} AND x.name = 'h2'"),
    "map_of_nodes": ("map{'a': //h1, 'b': //h2}?a", f"SELECT {_cols} FROM n x WHERE x.{_named} AND x.name = 'h1'"),
    "unprefixed_root": ("/html/body/root()", f"SELECT {_cols} FROM n x WHERE x.kind = 'document' AND EXISTS (SELECT 1 FROM n c JOIN n h ON h.doc_id = c.doc_id AND h.node_id = c.parent_id WHERE c.doc_id = x.doc_id AND c.name = 'body' AND c.kind = 'element' AND h.name = 'html' AND h.parent_id = 0)"),
}

#: XPath by the rules of W3C, and its SQL.
SPEC: dict[str, tuple[str, str]] = {
    "any_equals": ("//ul[li/a/@href='#s5']", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'ul' AND EXISTS (SELECT 1 FROM n l JOIN n a ON a.doc_id = l.doc_id AND a.parent_id = l.node_id WHERE l.doc_id = x.doc_id AND l.parent_id = x.node_id AND l.kind = 'element' AND l.name = 'li' AND a.kind = 'element' AND a.name = 'a' AND a.attrs['href'] = '#s5')"),
    "any_of_several": ("//ul[li/a=('Home', 'News')]", f"SELECT {_cols} FROM n x WHERE {_el} AND x.name = 'ul' AND EXISTS (SELECT 1 FROM n l JOIN n y ON y.doc_id = l.doc_id AND y.parent_id = l.node_id WHERE l.doc_id = x.doc_id AND l.parent_id = x.node_id AND l.kind = 'element' AND l.name = 'li' AND y.kind = 'element' AND y.name = 'a' AND {_string('y')} IN ('Home', 'News'))"),
    "predicates_in_turn": ("//ul/li[a][1]", f"SELECT {_cols} FROM (SELECT x.*, row_number() OVER (PARTITION BY x.doc_id, x.parent_id ORDER BY x.node_id) r FROM n x WHERE {_el} AND x.name = 'li' AND EXISTS (SELECT 1 FROM n c WHERE c.doc_id = x.doc_id AND c.parent_id = x.node_id AND c.kind = 'element' AND c.name = 'a')) x {_up} WHERE x.r = 1 AND p.kind = 'element' AND p.name = 'ul'"),
}

#: XPath that gives a value for each document, and the value in SQL over d, the documents.
VALUES: dict[str, tuple[str, str]] = {
    "cast": ("count(//p) cast as xs:string", f"CAST({_of('c.name = ' + chr(39) + 'p' + chr(39))} AS VARCHAR)"),
    "unary": ("-count(//p)", "CAST(-" + _of("c.name = 'p'") + " AS VARCHAR)"),
    "whole_division": ("count(//li) idiv 3", "CAST(" + _of("c.name = 'li'") + " // 3 AS VARCHAR)"),
    "division": ("count(//li) * 2 div 2", "CAST(" + _of("c.name = 'li'") + " AS VARCHAR)"),
    "remainder": ("count(//li) mod 3", "CAST(" + _of("c.name = 'li'") + " % 3 AS VARCHAR)"),
    "sum_of_parts": ("count(//p) + count(//li)", "CAST(" + _of("c.name IN ('p', 'li')") + " AS VARCHAR)"),
    "arrow": ("//p => count()", "CAST(" + _of("c.name = 'p'") + " AS VARCHAR)"),
    "function_by_uri": ("Q{http://www.w3.org/2005/xpath-functions}count(//p)", "CAST(" + _of("c.name = 'p'") + " AS VARCHAR)"),
    "total": ("sum(//ul/count(li))", "CAST((SELECT count(*) FROM n c JOIN n u ON u.doc_id = c.doc_id AND u.node_id = c.parent_id WHERE c.doc_id = d.doc_id AND c.name = 'li' AND u.name = 'ul' AND u.kind = 'element') AS VARCHAR)"),
    "joined": ("string-join(//h2/text(), '|')", "coalesce((SELECT string_agg(coalesce(x.value, ''), '|' ORDER BY x.node_id) FROM n x JOIN n p ON p.doc_id = x.doc_id AND p.node_id = x.parent_id WHERE x.doc_id = d.doc_id AND x.kind = 'text' AND p.kind = 'element' AND p.name = 'h2'), '')"),
    "some_occurrences": ("//h1 instance of element()+", "CAST(" + _of("c.kind = 'element' AND c.name = 'h1'") + " >= 1 AS VARCHAR)"),
    "any_occurrences": ("//h1 instance of element()*", "'true'"),
    "atomic_type": ("count(//p) instance of xs:integer", "'true'"),
    "function_type": ("//body instance of function(*)", "'false'"),
    "name_of_path": ("name(/*)", "coalesce((SELECT min_by(c.name, c.node_id) FROM n c WHERE c.doc_id = d.doc_id AND c.parent_id = 0 AND c.kind = 'element'), '')"),
    "array_lookup": ("[1, 2, 3]?2", "'2'"),
    "map_lookup": ("map{'a': 1, 'b': 2}?b", "'2'"),
    "inline_function": ("(function($x) { $x * 2 })(4)", "'8'"),
    "function_over_nodes": ("(function($x) { count($x) })(//p)", "CAST(" + _of("c.name = 'p'") + " AS VARCHAR)"),
    "named_function_over_nodes": ("count#1(//p)", "CAST(" + _of("c.name = 'p'") + " AS VARCHAR)"),
    "partial_application": ("let $f := contains(?, '-') return $f(string(/html/@lang))", "CAST(contains(coalesce((SELECT any_value(a.value) FROM n a JOIN n h ON h.doc_id = a.doc_id AND h.node_id = a.parent_id WHERE a.doc_id = d.doc_id AND a.kind = 'attribute' AND a.name = 'lang' AND h.parent_id = 0 AND h.name = 'html'), ''), '-') AS VARCHAR)"),
    "named_function": ("(string-length#1)('abc')", "'3'"),
}

#: XPath that gives several values for each document, and a SELECT of doc_id and value.
SEVERAL: dict[str, tuple[str, str]] = {
    "range": ("1 to count(//h2)", "SELECT d.doc_id, CAST(unnest(range(1, 1 + " + _of("c.name = 'h2'") + ")) AS VARCHAR) AS value FROM n d WHERE d.kind = 'document'"),
    "constant_range": ("1 to 3", "SELECT d.doc_id, CAST(unnest([1, 2, 3]) AS VARCHAR) AS value FROM n d WHERE d.kind = 'document'"),
    **{
        name: (expression, f"SELECT DISTINCT x.doc_id, CAST({_items} AS VARCHAR) AS value FROM n x WHERE {_el} AND x.name = 'ul'")
        for name, expression in (("map_to_values", "//ul ! count(li)"), ("for_values", "for $x in //ul return count($x/li)"), ("last_step_value", "//ul/count(li)"))
    },
    "data": ("//h2/data(.)", f"SELECT DISTINCT x.doc_id, {_string('x')} AS value FROM n x WHERE {_el} AND x.name = 'h2'"),
    "distinct_values": ("distinct-values(//*/name(.))", f"SELECT DISTINCT x.doc_id, x.name AS value FROM n x WHERE {_el}"),
    "tokens": ("//div/tokenize(@class, '-')", f"SELECT DISTINCT x.doc_id, unnest(string_split(x.attrs['class'], '-')) AS value FROM n x WHERE {_el} AND x.name = 'div' AND x.attrs['class'] <> ''"),
}


def _find(expression: str, columns: list[str], spec: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return api.find(table(tuned(spark), sf_dir, "nodes"), expression, ordered=False, spec=spec, repeated=True).select(*columns)

    return run


def _once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(tuned(spark), sf_dir, "nodes").dropDuplicates(["doc_id", "node_id"])


def _elements(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, "nodes").filter("kind = 'element'").filter(F.col("name") == name)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy("page_id").agg(F.max_by("html", "ingested_at").alias("html"))


def parsed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded texts and attribute values of the pages; those that the node table has lost are left out."""
    made = pages.html_nodes(_pages(spark, sf_dir), "page_id", "html", "close").filter("kind in ('text', 'attribute')")
    kept = table(spark, sf_dir, "nodes").filter("kind in ('text', 'attribute') and value is not null").select("doc_id", "node_id").distinct()
    return made.join(kept, ["doc_id", "node_id"], "left_semi").select("doc_id", "node_id", "name", "value", "only_whitespace")


def parsed_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pages.html_nodes(_pages(spark, sf_dir), "page_id", "html", "close").filter("kind = 'element'")
    return made.select("doc_id", "node_id", F.explode("attrs").alias("name", "value"))


def sorted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each item in its document's result, as the rows come out sorted."""
    found = api.find(table(tuned(spark), sf_dir, "nodes"), "//h1 | //h1/text() | //h1/@*", repeated=True).withColumn("at", F.monotonically_increasing_id())
    return found.select("doc_id", "node_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")).alias("place"))


def elements_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.find_elements(table(tuned(spark), sf_dir, "nodes"), "//section/element()", repeated=True).select(*COLUMNS)


def attributes_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.find_attributes(table(tuned(spark), sf_dir, "nodes"), "//img/@alt", repeated=True).select(*COLUMNS)


def elements_of_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.find_elements_from_items(table(tuned(spark), sf_dir, "nodes"), _elements(spark, sf_dir, "ul"), "/li", repeated=True).select("doc_id", "item_id", "node_id")


def relative_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.apply_to_items(table(tuned(spark), sf_dir, "nodes"), _elements(spark, sf_dir, "ul"), "li/a", repeated=True).select("doc_id", "item_id", "node_id")


def evaluation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which a comparison meets more than one item."""
    return api.errors(table(tuned(spark), sf_dir, "nodes"), "//ul[li/a/@href='x']", repeated=True)


def item_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two results put together as one set: its length for each document."""
    nodes = table(tuned(spark), sf_dir, "nodes")
    a, b = (api.find(nodes, e, ordered=False, repeated=True) for e in ("//h1 | //h2", "//h2 | //h3"))
    return a.unionByName(b).dropDuplicates(["doc_id", "node_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def class_of_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(spark, sf_dir, "ul").dropDuplicates(["doc_id", "node_id"]).select("doc_id", "node_id", text.get_attribute("class").alias("value"))


def displayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, attributes, documents and elements without attributes as strings."""
    return _once(spark, sf_dir).filter("kind <> 'element' or cardinality(attrs) = 0").select("doc_id", "node_id", text.display().alias("shown"))


def trimmed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _once(spark, sf_dir).filter("kind = 'text' and value is not null")
    return t.select("doc_id", "node_id", text.trim_internal_whitespace(F.col("value")).alias("trimmed"))


def written_without_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.to_html(table(spark, sf_dir, "nodes"), "ignore_whitespace")


def read_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as strings and parsed again: elements are as many as before. Attribute values are written as they are, so those with quotes are not the same again."""
    again = pages.html_nodes(text.to_html(table(spark, sf_dir, "nodes")), "doc_id", "html", "close")
    return again.filter("kind = 'element'").groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"))


def lateral_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function in SQL."""
    pages.register(spark)
    _pages(spark, sf_dir).createOrReplaceTempView("pages_once")
    return spark.sql("SELECT p.page_id AS doc_id, x.node_id, x.name FROM pages_once p, LATERAL html_nodes(p.html, 'close') x WHERE x.kind = 'element'")


def tags_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "nodes").filter("kind = 'element'").select("doc_id", "node_id", "name", "level").distinct()
    return e.cube("name", "level").agg(F.count(F.lit(1)).alias("n"))


def top_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten commonest element names, ties by name: a top-k report, so the limit is the result."""
    e = table(spark, sf_dir, "nodes").filter("kind = 'element'").select("doc_id", "node_id", "name").distinct()
    return e.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "name").limit(10)


def top_tags_of_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three commonest names of each site, with rank, the count before and the running sum."""
    e = table(spark, sf_dir, "nodes").filter("kind = 'element' and site is not null").select("doc_id", "node_id", "name", "site").distinct().groupBy("site", "name").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("site").orderBy(F.col("n").desc(), "name")
    ranked = e.withColumn("place", F.row_number().over(by)).withColumn("rank", F.rank().over(Window.partitionBy("site").orderBy(F.col("n").desc())))
    ranked = ranked.withColumn("before", F.lag("n").over(by)).withColumn("running", F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.filter("place <= 3")


def approximate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each element name, and whether an approximate count is within a tenth of that."""
    e = table(spark, sf_dir, "nodes").filter("kind = 'element'").groupBy("name").agg(F.countDistinct("doc_id").alias("pages"), F.approx_count_distinct("doc_id", 0.01).alias("near"))
    return e.select("name", "pages", (F.abs(F.col("near") - F.col("pages")) <= F.greatest(F.lit(1.0), F.col("pages") * 0.1)).alias("close"))


def pages_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pages_by_window(table(spark, sf_dir, "pages"), "fetched_at", "site")


def pages_by_sliding_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pages_by_window(table(spark, sf_dir, "pages"), "fetched_at", "site", "2 days", "1 day")


def last_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error event with the latest click of its user before it."""
    e = table(spark, sf_dir, "events")
    errors = e.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    found = joins.as_of_join(errors, e.filter("event_type = 'click'").select("user_id", "ts"), "user_id", "ts", ["ts"])
    return found.select("event_id", F.col("right_ts").alias("clicked"))


def overlapping_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections and lists of a page whose spans of nodes overlap."""
    e = _once(spark, sf_dir).filter("kind = 'element'").select("doc_id", "node_id", "last_desc", "name")
    found = joins.interval_join(e.filter("name = 'section'"), e.filter("name = 'ul'"), "doc_id", ("node_id", "last_desc"), ("node_id", "last_desc"), 64)
    return found.select(F.col("l.doc_id").alias("doc_id"), F.col("l.node_id").alias("section_id"), F.col("r.node_id").alias("list_id"))


def event_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date, mathematical and JSON functions over events."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", F.year("ts").alias("year"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.floor(F.sqrt(F.abs("value"))).cast("long").alias("root"), k.alias("k"))


def _page_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table as a stream of its files."""
    pages_table = table(spark, sf_dir, "pages")
    folder, _, name = pages_table.inputFiles()[0].rpartition("/")
    only = name if folder.endswith(sf_dir.rstrip("/").rpartition("/")[2]) else "*"
    return spark.readStream.schema(pages_table.schema).option("pathGlobFilter", only).parquet(folder)


def _shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the checkpoint folder of the session."""
    with_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4()}"


def streamed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the pages read as a stream, written batch by batch under their number."""
    folder = _shared_folder(tuned(spark), "links")
    sink = lambda found, batch: found.select("doc_id", "node_id").write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")
    query = find_stream(_page_stream(spark, sf_dir), "page_id", "html", "//a/@href", sink, f"{folder}/state", repeated=True)
    query.awaitTermination()
    return spark.read.schema("doc_id long, node_id int").parquet(f"{folder}/out").select("doc_id", "node_id").distinct()


def streamed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each day and site, counted over a stream with state; each batch gives all windows so far."""
    folder = _shared_folder(spark, "days")
    counts = windows.pages_by_window(_page_stream(spark, sf_dir), "fetched_at", "site")
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out")
    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "site", "n")


_attribute = "' ' || e.key || '=\"' || coalesce(e.value, '') || '\"'"
_escaped = "replace(replace(replace(replace(replace(value, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_void = ", ".join(f"'{v}'" for v in sorted(VOID))


def written(condition: str = "", indented: bool = False) -> str:
    """SQL for documents as strings from the node table, with a condition on texts; indented: a line for each tag and trimmed text."""
    opening = f"'<' || name || coalesce(array_to_string(list_transform(map_entries(attrs), lambda e: {_attribute}), ''), '') || '>'"
    begin = f"SELECT doc_id, node_id AS place, -2147483648 AS nested, CASE WHEN kind = 'element' THEN {opening} ELSE {_escaped} END AS s FROM n WHERE kind = 'element' OR kind = 'text' AND value IS NOT NULL{condition}"
    end = f"SELECT doc_id, last_desc, -node_id, '</' || name || '>' FROM n WHERE kind = 'element' AND name NOT IN ({_void})"
    if indented:
        line = "repeat('    ', level - 1) || "
        begin = begin.replace("THEN '<'", f"THEN {line}'<'").replace("|| '>' ELSE", "|| '>' || chr(10) ELSE").replace(_escaped, line + _escaped.replace("value", r"trim(value, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))", 1) + " || chr(10)")
        end = end.replace("'</'", line + "'</'").replace("'>' FROM", "'>' || chr(10) FROM")
    return f"{N}, p AS ({begin} UNION ALL {end}) SELECT doc_id, string_agg(s, '' ORDER BY place, nested) AS html FROM p GROUP BY doc_id"


_WHITE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_TOP = "SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, name) AS place, rank() OVER (PARTITION BY site ORDER BY n DESC) AS rank, lag(n) OVER (PARTITION BY site ORDER BY n DESC, name) AS before, CAST(sum(n) OVER (PARTITION BY site ORDER BY n DESC, name ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM e"
_ERRORS = "SELECT u.doc_id, u.node_id FROM n u JOIN n l ON l.doc_id = u.doc_id AND l.parent_id = u.node_id JOIN n a ON a.doc_id = l.doc_id AND a.parent_id = l.node_id JOIN n h ON h.doc_id = a.doc_id AND h.parent_id = a.node_id WHERE u.kind = 'element' AND u.name = 'ul' AND l.name = 'li' AND a.name = 'a' AND h.kind = 'attribute' AND h.name = 'href' GROUP BY 1, 2 HAVING count(*) > 1"

OTHERS: dict[str, tuple[Query, str]] = {
    "parsed_values": (parsed_values, N + "SELECT doc_id, node_id, name, value, only_whitespace FROM n WHERE kind IN ('text', 'attribute') AND value IS NOT NULL"),
    "parsed_attributes": (parsed_attributes, N + "SELECT doc_id, node_id, unnest(map_keys(attrs)) AS name, unnest(map_values(attrs)) AS value FROM n WHERE kind = 'element'"),
    "sorted_items": (sorted_items, N + f"SELECT x.doc_id, x.node_id, row_number() OVER (PARTITION BY x.doc_id ORDER BY x.kind_rank, x.node_id) AS place FROM n x {_up} WHERE x.kind = 'element' AND x.name = 'h1' OR x.kind IN ('text', 'attribute') AND p.kind = 'element' AND p.name = 'h1' OR x.kind = 'attribute' AND x.name = 'h1'"),
    "elements_found": (elements_found, N + f"SELECT {_cols} FROM n x {_up} WHERE {_el} AND p.kind = 'element' AND p.name = 'section'"),
    "attributes_found": (attributes_found, N + f"SELECT {_cols} FROM n x {_up} WHERE x.kind = 'attribute' AND x.name = 'alt' AND p.kind = 'element' AND p.name = 'img'"),
    "elements_of_items": (elements_of_items, N + f"SELECT x.doc_id, x.parent_id AS item_id, x.node_id FROM n x {_up} WHERE {_el} AND x.name = 'li' AND p.kind = 'element' AND p.name = 'ul'"),
    "relative_step": (relative_step, N + f"SELECT x.doc_id, p.parent_id AS item_id, x.node_id FROM n x {_up} JOIN n u ON u.doc_id = p.doc_id AND u.node_id = p.parent_id WHERE {_el} AND x.name = 'a' AND p.kind = 'element' AND p.name = 'li' AND u.kind = 'element' AND u.name = 'ul'"),
    "evaluation_errors": (evaluation_errors, N + f"SELECT DISTINCT doc_id, 'XPTY0004' AS error_code, 'an operand has more than one item' AS error_msg FROM ({_ERRORS})"),
    "item_sets": (item_sets, N + "SELECT doc_id, count(*) AS n FROM n WHERE kind = 'element' AND name IN ('h1', 'h2', 'h3') GROUP BY 1"),
    "class_of_lists": (class_of_lists, N + "SELECT doc_id, node_id, attrs['class'] AS value FROM n WHERE kind = 'element' AND name = 'ul'"),
    "displayed": (displayed, N + "SELECT doc_id, node_id, CASE kind WHEN 'document' THEN 'document' WHEN 'element' THEN '<' || name || '>' WHEN 'attribute' THEN name || '=\"' || coalesce(value, '') || '\"' ELSE coalesce(value, '') END AS shown FROM n WHERE kind <> 'element' OR cardinality(attrs) = 0"),
    "trimmed_texts": (trimmed_texts, N + f"SELECT doc_id, node_id, trim(regexp_replace(value, '{_WHITE}', ' ', 'g')) AS trimmed FROM n WHERE kind = 'text' AND value IS NOT NULL"),
    "written_without_blanks": (written_without_blanks, written(" AND NOT only_whitespace")),
    "read_again": (read_again, N + "SELECT doc_id, name, count(*) AS n FROM n WHERE kind = 'element' GROUP BY 1, 2"),
    "lateral_nodes": (lateral_nodes, N + "SELECT doc_id, node_id, name FROM n WHERE kind = 'element'"),
    "tags_cube": (tags_cube, N + "SELECT name, level, count(*) AS n FROM n WHERE kind = 'element' GROUP BY CUBE (name, level)"),
    "top_tags": (top_tags, N + "SELECT name, count(*) AS n FROM n WHERE kind = 'element' GROUP BY 1 ORDER BY n DESC, name LIMIT 10"),
    "top_tags_of_sites": (top_tags_of_sites, N.rstrip() + f", e AS (SELECT site, name, count(*) AS n FROM n WHERE kind = 'element' AND site IS NOT NULL GROUP BY 1, 2) SELECT * FROM ({_TOP}) WHERE place <= 3"),
    "approximate_pages": (approximate_pages, N + "SELECT name, count(DISTINCT doc_id) AS pages, true AS close FROM n WHERE kind = 'element' GROUP BY 1"),
    "streamed_links": (streamed_links, N + f"SELECT x.doc_id, x.node_id FROM n x {_up} WHERE x.kind = 'attribute' AND x.name = 'href' AND p.kind = 'element' AND p.name = 'a'"),
    "streamed_days": (streamed_days, "SELECT CAST(date_trunc('day', fetched_at) AS TIMESTAMP) AS start, site, count(*) AS n FROM pages WHERE fetched_at IS NOT NULL GROUP BY 1, 2"),
    "pages_by_day": (pages_by_day, "SELECT CAST(date_trunc('day', fetched_at) AS TIMESTAMP) AS start, site, count(*) AS n FROM pages WHERE fetched_at IS NOT NULL GROUP BY 1, 2"),
    "pages_by_sliding_days": (pages_by_sliding_days, "SELECT CAST(date_trunc('day', fetched_at) AS TIMESTAMP) - to_days(k) AS start, site, count(*) AS n FROM pages, (VALUES (0), (1)) v(k) WHERE fetched_at IS NOT NULL GROUP BY 1, 2"),
    "last_click": (last_click, "SELECT e.event_id, (SELECT max(c.ts) FROM events c WHERE c.event_type = 'click' AND c.user_id = e.user_id AND c.ts <= e.ts) AS clicked FROM events e WHERE e.event_type = 'error'"),
    "overlapping_elements": (overlapping_elements, N + "SELECT s.doc_id, s.node_id AS section_id, u.node_id AS list_id FROM n s JOIN n u ON u.doc_id = s.doc_id AND u.node_id <= s.last_desc AND s.node_id <= u.last_desc WHERE s.kind = 'element' AND s.name = 'section' AND u.kind = 'element' AND u.name = 'ul'"),
    "event_scalars": (event_scalars, "SELECT event_id, CAST(year(ts) AS INTEGER) AS year, strftime(ts, '%Y-%m-%d') AS day, CAST(floor(sqrt(abs(value))) AS BIGINT) AS root, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"),
}


def queries() -> dict[str, Query]:
    out = {name: _find(e, COLUMNS) for name, (e, _) in PATHS.items()}
    out |= {name: _find(e, COLUMNS, True) for name, (e, _) in SPEC.items()}
    out |= {name: _find(e, ["doc_id", "value"]) for name, (e, _) in (VALUES | SEVERAL).items()}
    return out | {name: q for name, (q, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: N + sql for name, (_, sql) in (PATHS | SPEC | SEVERAL).items()}
    out |= {name: N + f"SELECT d.doc_id, {sql} AS value FROM n d WHERE d.kind = 'document'" for name, (_, sql) in VALUES.items()}
    return out | {name: sql for name, (_, sql) in OTHERS.items()}
