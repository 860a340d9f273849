"""Nodes whose value looks the same as its usual form but is written with other characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyq.llm import lookalike, mojibake


def both_counts(values: DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """Counts of class members in all values and of character pairs in the text ones, in one pass over kind and value; both are bounded whatever the corpus."""
    members = [m for c in lookalike.classes() for m in c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, total = lookalike.MemberCounts(members), np.zeros(2 * mojibake.CELLS, dtype=np.int64)
        for b in batches:
            kinds, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            counter.add([t for t in texts if t])
            total += mojibake.pair_counts([t for k, t in zip(kinds, texts, strict=True) if t and k == "text"])
        found, at = counter.counts(), np.flatnonzero(total)
        names = [pa.array(list(found), pa.string()), pa.nulls(len(found), pa.int32()), pa.array(list(found.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(names, names=["member", "cell", "n"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["member", "cell", "n"])

    rows = values.select("kind", "value").mapInArrow(run, "member string, cell int, n long").groupBy("member", "cell").agg(F.sum("n").alias("n")).toArrow()
    named = rows.column("member").is_valid().to_numpy()
    n = rows.column("n").to_numpy()
    pairs = np.zeros(2 * mojibake.CELLS, dtype=np.int64)
    pairs[rows.column("cell").filter(pa.array(~named)).to_numpy()] = n[~named]
    return dict(zip(rows.column("member").filter(pa.array(named)).to_pylist(), n[named].tolist(), strict=True)), pairs


def lookalike_nodes(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, form of each text or attribute node that is not in its one consistent form, once.

    Garbled text nodes (see ``mojibake``) are left out: their odd characters stand for bytes, not for look-alikes. Null and empty values are never
    cases, nor are values of an empty table.
    """
    values = nodes.filter("kind in ('text', 'attribute') and value is not null").select("doc_id", "node_id", "kind", "value")
    members, pairs = both_counts(values)
    counted = tuple(sorted(members.items()))
    counts = values.sparkSession.sparkContext.broadcast(counted)
    table = values.sparkSession.sparkContext.broadcast(pairs.astype(np.float32).tobytes())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewrite = lookalike.rewriter(counts.value).form
        garbled = mojibake.repairer(table.value).garbled
        for f in frames:
            form = [rewrite(t) for t in f["value"]]
            found = [new != old and (kind == "attribute" or not garbled(old)) for new, old, kind in zip(form, f["value"], f["kind"], strict=True)]
            yield f[["doc_id", "node_id"]].assign(form=form)[found]

    # a page delivered again has the same rows: the few candidates are made unique, not the table
    may = values.filter(lookalike.may_change(F.col("value"), lookalike.rewriter(counted).odd))
    return may.mapInPandas(run, "doc_id long, node_id int, form string").dropDuplicates(["doc_id", "node_id"])
