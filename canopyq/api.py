"""Queries over node tables by XPath."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyq.plans.compiler import ATOMIC_RANK, NODE, TYPE_NAMES, Compiler, Seq, UnsupportedError
from canopyq.xpath import constant, parser, rewrite

MODES = ("FAILFAST", "PERMISSIVE")
#: Columns of a result; item_type is an atomic type, and null for nodes.
RESULT = ["doc_id", "kind_rank", "node_id", "kind", "name", "value", "item_type"]


@functools.lru_cache(maxsize=1024)
def compiled(expression: str, lenient: bool = False) -> tuple:
    return rewrite.reduced(parser.parse(expression, lenient))


def _check(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")


def _constant(t: tuple, ctx: Seq, keys: list[str]) -> DataFrame | None:
    """The rows of an expression that reads no document: the same items for each context."""
    try:
        items = constant.unique(constant.evaluate(t, {}))
    except constant.NotConstant:
        return None
    if not all(map(constant.is_atomic, items)):
        raise UnsupportedError("arrays, maps and functions are no results")
    fields = "array<struct<value:string,item_type:string>>"
    values = F.array(*[F.struct(F.lit(constant.text(i)).alias("value"), F.lit(TYPE_NAMES[i[0]]).alias("item_type")) for i in items]).cast(fields)
    row = [F.lit(ATOMIC_RANK).cast("byte").alias("kind_rank"), F.lit(None).cast("int").alias("node_id"), F.lit("atomic").alias("kind"), F.lit(None).cast("string").alias("name")]
    return ctx.df.select(*keys, *row, F.inline(values))


def _run(c: Compiler, t: tuple, ctx: Seq, keys: list[str]) -> DataFrame:
    if (fixed := _constant(t, ctx, keys)) is not None:
        return fixed
    if c.gives_nodes(t):
        out = c.distinct(c.seq(t, ctx)).df
        return out.select(*keys, "kind_rank", "node_id", "kind", "name", "value", F.lit(None).cast("string").alias("item_type"))
    items = t[1] if t[0] == "seq" else [t]
    parts = []
    for item in items:
        if c.gives_nodes(item):
            parts.append(_run(c, item, ctx, keys))
            continue
        row = [F.lit(ATOMIC_RANK).cast("byte").alias("kind_rank"), F.lit(None).cast("int").alias("node_id"), F.lit("atomic").alias("kind"), F.lit(None).cast("string").alias("name")]
        for df, ty in c.atoms(item, ctx):
            parts.append(df.select(*keys, *row, F.col("v").alias("value"), F.lit(TYPE_NAMES[ty]).alias("item_type")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # the items of a document are a set
    return out.dropDuplicates() if len(parts) > 1 or t[0] in ("path", "map", "for", "if", "let", "paren", "call", "arrow") else out


def find(nodes: DataFrame, expression: str, *, ordered: bool = True, mode: str = "FAILFAST", spec: bool = False, lenient: bool = False, repeated: bool = False) -> DataFrame:
    """The items that an expression gives for each document of a node table: doc_id, kind_rank, node_id, kind, name, value, item_type.

    Items of a document are a set. ``ordered`` sorts by document, then kind (elements, texts, attributes, atomic values), then document order. An
    evaluation error ends the job, or with ``PERMISSIVE`` leaves its document out (see ``errors``). ``lenient`` ignores text after a whole
    expression. ``repeated`` says that rows of ``nodes`` may be there more than once. Only ``doc_id`` and the node columns of ``nodes`` are read; an empty table gives an empty result.
    """
    _check(mode)
    c = Compiler(nodes, spec=spec, permissive=mode == "PERMISSIVE", repeated=repeated)
    out = _run(c, compiled(expression, lenient), c.documents(), ["doc_id"])
    for e in c.errors:
        out = out.join(e.select("doc_id").distinct(), "doc_id", "left_anti")
    out = out.select(*RESULT)
    return out.orderBy("doc_id", "kind_rank", "node_id", "value") if ordered else out


def errors(nodes: DataFrame, expression: str, *, spec: bool = False, repeated: bool = False) -> DataFrame:
    """doc_id, error_code, error_msg of the documents in which an expression fails."""
    c = Compiler(nodes, spec=spec, permissive=True, repeated=repeated)
    _run(c, compiled(expression), c.documents(), ["doc_id"])
    empty = nodes.filter(F.lit(False)).select("doc_id", F.lit("").alias("error_code"), F.lit("").alias("error_msg"))
    for e in c.errors:
        empty = empty.unionByName(e)
    return empty.distinct()


def _only(df: DataFrame, kind: str) -> DataFrame:
    ok = F.when(F.col("kind") != kind, F.raise_error(F.concat(F.lit(f"a result is no {kind} but "), F.col("kind")))).otherwise(F.lit(True))
    return df.filter(ok)


def find_elements(nodes: DataFrame, expression: str, **options) -> DataFrame:
    """As ``find``; the job fails if a result is not an element."""
    return _only(find(nodes, expression, **options), "element")


def find_attributes(nodes: DataFrame, expression: str, **options) -> DataFrame:
    """As ``find``; the job fails if a result is not an attribute."""
    return _only(find(nodes, expression, **options), "attribute")


def apply_to_items(nodes: DataFrame, items: DataFrame, expression: str, *, mode: str = "FAILFAST", spec: bool = False, repeated: bool = False) -> DataFrame:
    """The items that an expression gives for each of many nodes: item_id and the columns of ``find``, in no order.

    ``items`` has doc_id and node_id, rows may repeat. A leading / or // is relative to the item, in nested predicates to the candidate.
    """
    _check(mode)
    c = Compiler(nodes, spec=spec, root_level=False, permissive=mode == "PERMISSIVE", repeated=repeated)
    start = c.once(items.select("doc_id", "node_id").distinct().join(nodes.select("doc_id", *NODE), ["doc_id", "node_id"])).withColumn("ck", F.col("node_id"))
    out = _run(c, compiled(expression), Seq(start, ["doc_id", "ck"]), ["doc_id", "ck"])
    for e in c.errors:
        out = out.join(e.select("doc_id").distinct(), "doc_id", "left_anti")
    return out.select(F.col("ck").alias("item_id"), *RESULT)


def find_elements_from_items(nodes: DataFrame, items: DataFrame, expression: str, **options) -> DataFrame:
    """As ``apply_to_items``; the job fails if a result is not an element."""
    return _only(apply_to_items(nodes, items, expression, **options), "element")
