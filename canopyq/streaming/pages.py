"""Queries over streams of pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from canopyq import api
from canopyq.sources.pages import html_nodes


def find_stream(
    pages: DataFrame, id_column: str, html_column: str, expression: str, sink: Callable[[DataFrame, int], None], checkpoint: str, *, mismatch: str = "close", available_now: bool = True, **options
) -> StreamingQuery:
    """Run an expression over each batch of a stream of pages and hand its result to ``sink(result, batch_id)``.

    A page is whole in its batch, so results are those of a batch query. Windows over rows are not allowed on streams, hence a batch at a time. A sink
    that writes a batch under its id gets every batch exactly once after a restart from ``checkpoint``, a folder that all executors share.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        nodes = html_nodes(batch, id_column, html_column, mismatch).repartition("doc_id").persist()
        try:
            sink(api.find(nodes, expression, ordered=False, **options), batch_id)
        finally:
            nodes.unpersist()

    writer = pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
