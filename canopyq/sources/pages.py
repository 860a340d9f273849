"""Node tables from HTML text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyq.html import tree

MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")
NODES = "doc_id long, node_id int, parent_id int, kind string, kind_rank byte, name string, value string, only_whitespace boolean, level int, last_desc int, attrs map<string,string>"
#: Nodes of an output batch, so that one does not outgrow a worker.
BATCH_ROWS = 20_000

_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("kind", pa.string()), ("kind_rank", pa.int8()), ("name", pa.string()), ("value", pa.string())]
    + [("only_whitespace", pa.bool_()), ("level", pa.int32()), ("last_desc", pa.int32()), ("attrs", pa.map_(pa.string(), pa.string())), ("error_code", pa.string()), ("error_msg", pa.string())]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    arrays = [pa.array([list(x.items()) if x is not None else None for x in c] if f.name == "attrs" else list(c), f.type) for c, f in zip(columns, _ARROW, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def _parse(mismatch: str | tree.Handler, failfast: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for b in batches:
            for doc, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if html is None:
                    continue
                try:
                    out += [(doc, *r, None, None) for r in tree.rows(tree.build(html, mismatch))]
                except tree.ParseError as e:
                    if failfast:
                        raise ValueError(f"document {doc}: {e.code}: {e}") from e
                    out.append((doc, *[None] * 10, e.code, str(e)))
                if len(out) >= BATCH_ROWS:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    return run


def parsed(pages: DataFrame, id_column: str, html_column: str, mismatch: str | tree.Handler = "error", mode: str = "PERMISSIVE") -> DataFrame:
    """Node rows of each page, and a row with error_code and error_msg alone for a page that does not parse.

    ``mismatch`` is the policy for end tags that do not match (error, void, close), or a function that decides (see ``tree.build``) and is sent to the workers. ``FAILFAST`` ends the job at the first bad page. A null text has
    neither nodes nor an error; an empty one has no root and is an error. A page given twice has its rows twice. Other columns of ``pages``
    are not read. Works on streams too: it is a map.
    """
    if mismatch not in tree.POLICIES and not callable(mismatch) or mode not in MODES:
        raise ValueError(f"mismatch is one of {tree.POLICIES} or a function, mode one of {MODES}")
    rows = pages.select(F.col(id_column).cast("long").alias("doc_id"), F.col(html_column).alias("html"))
    schema = NODES + ", error_code string, error_msg string"
    return rows.mapInArrow(_parse(mismatch, mode == "FAILFAST"), schema)


def html_nodes(pages: DataFrame, id_column: str, html_column: str, mismatch: str | tree.Handler = "error", mode: str = "PERMISSIVE") -> DataFrame:
    """The node table of the pages that parse (see ``parsed``)."""
    return parsed(pages, id_column, html_column, mismatch, mode).filter("error_code is null").drop("error_code", "error_msg")


def parse_errors(pages: DataFrame, id_column: str, html_column: str, mismatch: str | tree.Handler = "error") -> DataFrame:
    """doc_id, error_code, error_msg of the pages that do not parse."""
    return parsed(pages, id_column, html_column, mismatch).filter("error_code is not null").select("doc_id", "error_code", "error_msg")


def save_nodes(nodes: DataFrame, name: str, buckets: int = 200, mode: str = "errorifexists") -> None:
    """Write a node table in buckets of whole documents, sorted; with the settings of ``session.tuned`` steps over it add no shuffle.

    A bucket should fit an executor: at 100 TB, tens of thousands of them. Hot sites do no harm, as documents are spread by their ids.
    """
    nodes.repartition(buckets, "doc_id").write.mode(mode).bucketBy(buckets, "doc_id").sortBy("doc_id", "node_id").saveAsTable(name)


class _Nodes:
    def eval(self, html: str, mismatch: str = "error"):
        if html is not None:
            try:
                yield from (r for r in tree.rows(tree.build(html, mismatch)))
            except tree.ParseError:
                return


def register(spark: SparkSession) -> None:
    """The SQL table function html_nodes(html, mismatch), for LATERAL joins."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("html_nodes", udtf(_Nodes, returnType=NODES.partition(", ")[2]))
