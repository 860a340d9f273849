"""Texts, attributes and neighbours of nodes, and documents as strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyq.html.lexer import WHITE
from canopyq.html.tree import VOID
from canopyq.plans.strings import CELL, string_values

FORMATS = ("standard", "ignore_whitespace", "indented")
_white = f"[{WHITE}]"


def itertext(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, node_id, value: the text nodes below each item (doc_id, node_id), attributes skipped. A null text counts as lost and is left out."""
    start = items.select("doc_id", F.col("node_id").alias("item_id")).distinct()
    own = nodes.select("doc_id", F.col("node_id").alias("item_id"), F.col("last_desc").alias("z"), F.col("kind").alias("k")).distinct()
    start = start.join(own, ["doc_id", "item_id"]).filter("k in ('element', 'document')")
    texts = nodes.filter("kind = 'text' and value is not null").select("doc_id", "node_id", "value").distinct()
    # an item meets only texts in the cells of ids that its span covers
    start = start.withColumn("cell", F.explode(F.sequence(F.floor(F.col("item_id") / CELL), F.floor(F.col("z") / CELL))))
    texts = texts.withColumn("cell", F.floor(F.col("node_id") / CELL))
    return start.join(texts, ["doc_id", "cell"]).filter("node_id > item_id and node_id <= z").select("doc_id", "item_id", "node_id", "value")


def _ordered(values: Column, order: Column) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), values.alias("v")))), lambda x: x["v"])


def text_content(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, text_content of each item: its texts put together without a separator; "" for attributes and for items without text."""
    start = items.select("doc_id", F.col("node_id").alias("item_id")).distinct()
    own = nodes.select("doc_id", F.col("node_id").alias("item_id"), F.col("last_desc").alias("nlast"), "kind", F.when(F.col("kind") == "text", F.col("value")).alias("own"))
    start = start.join(own.dropDuplicates(["doc_id", "item_id"]), ["doc_id", "item_id"], "left")
    texts = nodes.filter("kind = 'text'").select("doc_id", "node_id", "value").dropDuplicates(["doc_id", "node_id"])
    below = string_values(texts, start.filter("kind in ('element', 'document')").select("doc_id", F.col("item_id").alias("nid"), "nlast")).withColumnRenamed("nid", "item_id")
    return start.join(below, ["doc_id", "item_id"], "left").select("doc_id", "item_id", F.coalesce("own", "text", F.lit("")).alias("text_content"))


def text(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, text: the first text that is a child of each item; null if it has none. Of a document, that of its root."""
    start = items.select("doc_id", F.col("node_id").alias("item_id")).distinct()
    # the root of a document is node 1
    start = start.withColumn("of", F.when(F.col("item_id") == 0, 1).otherwise(F.col("item_id")))
    child = nodes.filter("kind = 'text'").select("doc_id", F.col("parent_id").alias("of"), "node_id", "value").groupBy("doc_id", "of").agg(F.min_by("value", "node_id").alias("text"))
    return start.join(child, ["doc_id", "of"], "left").select("doc_id", "item_id", "text")


def _spaced(parts: Column) -> Column:
    """Texts put together with one space where no white space separates them already."""
    apart = lambda a, x: a.rlike(f"{_white}$") | x.rlike(f"^{_white}")
    join = lambda a, x: F.when(a.isNull(), x).when(apart(a, x), F.concat(a, x)).otherwise(F.concat(a, F.lit(" "), x))
    return F.aggregate(parts, F.lit(None).cast("string"), join)


def get_text(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, text: the texts that are children of each element, with one space where no white space separates them; null if there is none."""
    start = items.select("doc_id", F.col("node_id").alias("item_id")).distinct()
    child = nodes.filter("kind = 'text' and value is not null").select("doc_id", F.col("parent_id").alias("item_id"), "node_id", "value").distinct()
    joined = start.join(child, ["doc_id", "item_id"]).groupBy("doc_id", "item_id").agg(_spaced(_ordered(F.col("value"), F.col("node_id"))).alias("text"))
    return start.join(joined, ["doc_id", "item_id"], "left")


def get_all_text(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """As ``get_text``, of all texts below each element."""
    start = items.select("doc_id", F.col("node_id").alias("item_id")).distinct()
    joined = itertext(nodes, items).groupBy("doc_id", "item_id").agg(_spaced(_ordered(F.col("value"), F.col("node_id"))).alias("text"))
    return start.join(joined, ["doc_id", "item_id"], "left")


def children(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """item_id and the node columns of the children of each item; attributes are children of their element."""
    start = items.select("doc_id", F.col("node_id").alias("item_id")).distinct()
    return start.join(nodes.withColumn("item_id", F.col("parent_id")).filter("node_id > 0"), ["doc_id", "item_id"])


def parent(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """item_id and the node columns of the parent of each item; a document has none."""
    start = items.select("doc_id", F.col("node_id").alias("item_id")).distinct()
    own = nodes.filter("node_id > 0").select("doc_id", F.col("node_id").alias("item_id"), F.col("parent_id").alias("up")).distinct()
    return start.join(own, ["doc_id", "item_id"]).join(nodes.withColumn("up", F.col("node_id")), ["doc_id", "up"]).drop("up")


def attributes(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, name, value: one row per attribute of each element."""
    start = items.select("doc_id", F.col("node_id").alias("item_id")).distinct()
    own = nodes.filter("kind = 'element'").select("doc_id", F.col("node_id").alias("item_id"), "attrs").dropDuplicates(["doc_id", "item_id"])
    return start.join(own, ["doc_id", "item_id"]).select("doc_id", "item_id", F.explode("attrs").alias("name", "value"))


def get_attribute(name: str) -> Column:
    """The value of an attribute of an element row, or null."""
    return F.try_element_at("attrs", F.lit(name))


def escaped(value: Column) -> Column:
    """The five signs that need it as character references."""
    for sign, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        value = F.replace(value, F.lit(sign), F.lit(ref))
    return value


def trim_internal_whitespace(value: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(value, f"{_white}+", " "))


def display() -> Column:
    """A node row as a string."""
    name, value = F.coalesce("name", F.lit("")), F.coalesce("value", F.lit(""))
    tag = F.concat(F.lit("<"), name, F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), e["value"], F.lit('"'))), ""), F.lit(">"))
    return F.when(F.col("kind") == "document", F.lit("document")).when(F.col("kind") == "element", tag).when(F.col("kind") == "attribute", F.concat(name, F.lit('="'), value, F.lit('"'))).otherwise(value)


def to_html(nodes: DataFrame, form: str = "standard") -> DataFrame:
    """doc_id, html: each document as a string. Text is escaped, attribute values are not, void elements have no end tag.

    ``ignore_whitespace`` leaves out blank texts; ``indented`` writes a line per tag and trimmed text, four spaces a level. Documents whose rows are
    repeated are written once; null texts are left out.
    """
    if form not in FORMATS:
        raise ValueError(f"form is one of {FORMATS}")
    name = F.coalesce("name", F.lit(""))
    attrs = F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), F.coalesce(e["value"], F.lit("")), F.lit('"'))), "")
    value = F.btrim("value", F.lit(" \t\r\n\f\v")) if form == "indented" else F.col("value")
    opening = F.when(F.col("kind") == "element", F.concat(F.lit("<"), name, F.coalesce(attrs, F.lit("")), F.lit(">"))).otherwise(escaped(value))
    closing = F.concat(F.lit("</"), name, F.lit(">"))
    if form == "indented":
        opening, closing = (F.concat(F.repeat(F.lit("    "), F.col("level") - 1), s, F.lit("\n")) for s in (opening, closing))
    # an element's end tag stands after its last node; of elements that end together the inner one ends first
    piece = lambda at, inner, s: F.struct(at.alias("at"), inner.alias("inner"), s.alias("s"))
    begin = piece(F.col("node_id"), F.lit(-(1 << 31)), opening)
    end = piece(F.col("last_desc"), -F.col("node_id"), closing)
    ends = (F.col("kind") == "element") & ~F.col("name").isin(*sorted(VOID))
    rows = nodes.filter("kind = 'element' or kind = 'text' and value is not null" + ("" if form == "standard" else " and not coalesce(only_whitespace, false)"))
    rows = rows.dropDuplicates(["doc_id", "node_id"])
    pieces = rows.select("doc_id", F.explode(F.when(ends, F.array(begin, end)).otherwise(F.array(begin))).alias("p"))
    return pieces.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["s"]), "").alias("html"))


__all__ = ["attributes", "children", "display", "escaped", "get_all_text", "get_attribute", "get_text", "itertext", "parent", "text", "text_content", "to_html", "trim_internal_whitespace"]
