"""Encoding of a whole corpus with a public byte-level BPE tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyq.llm import bpe

#: Characters beyond which a text is cut into blocks that are encoded in parallel.
LONG_CHARS = 8192
#: Characters of such a block.
BLOCK_CHARS = 4096


def _encoder(path: str, ids_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            ids = [bpe.text_ids(path, t) if t else [] for t in texts]
            last = pa.array(ids, pa.list_(pa.int32())) if ids_too else pa.array([len(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], last], names=[*b.schema.names[:-1], "ids" if ids_too else "n_tokens"])

    return run


def _blocks(path: str, size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for h, text in zip(f["h"], f["text"], strict=True):
                parts = bpe.cuts(text, size)
                yield pd.DataFrame({"h": h, "n": range(len(parts)), "part": [p for p, _ in parts], "inside": [i for _, i in parts]})

    return run


def _encode_blocks(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = [bpe.block(path, p) for p in f["part"]]
            yield pd.DataFrame(
                {"h": f["h"], "n": f["n"], "inside": f["inside"], "ids": [d.ids for d in done], "head": [d.head for d in done], "tail": [d.tail for d in done], "pieces": [d.pieces for d in done]}
            )

    return run


def _unite(path: str):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("n")
        blocks = [bpe.Block(list(i), int(a), int(z), int(p)) for i, a, z, p in zip(f["ids"], f["head"], f["tail"], f["pieces"], strict=True)]
        return pd.DataFrame({"h": [f["h"].iloc[0]], "ids": [bpe.tree(path, blocks, list(f["inside"]))]})

    return run


def encode(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None, ids: bool = True, long_chars: int = LONG_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep`` and ``ids`` (array of int), or ``n_tokens`` where ``ids`` is false.

    No special tokens are added, and their strings count as ordinary text. A null or empty text has no ids; a blank text is encoded as
    it is. Repeated rows come out as often as they came in; other columns of ``docs`` are not read. A text of more than ``long_chars``
    characters is cut into blocks that are spread over the tasks, encoded there, and put together as a tree (see ``bpe``). Each distinct
    long text is encoded once. ``keep`` may not name the output column; a ValueError says so.
    """
    out = "ids" if ids else "n_tokens"
    if out in keep or {"__text", "__h", "__ids"} & set(keep):
        raise ValueError(f"keep may not hold {out}, __text, __h or __ids")
    path = path or bpe.default_path()
    docs = docs.select(*keep, F.col(text).alias("__text"))
    of = {f.name: f for f in docs.schema.fields}
    schema = T.StructType([*(of[k] for k in keep), T.StructField(out, T.ArrayType(T.IntegerType()) if ids else T.LongType())])
    is_long = F.length("__text") > long_chars
    short = docs.filter(F.col("__text").isNull() | ~is_long).mapInArrow(_encoder(path, ids), schema)
    long = docs.filter(is_long).withColumn("__h", F.sha2("__text", 256))
    blocks = long.select(F.col("__h").alias("h"), F.col("__text").alias("text")).dropDuplicates(["h"]).mapInPandas(_blocks(path, block_chars), "h string, n int, part string, inside boolean")
    blocks = blocks.repartition(F.col("h"), F.col("n"))
    encoded = blocks.mapInPandas(_encode_blocks(path), "h string, n int, inside boolean, ids array<int>, head int, tail int, pieces int")
    whole = encoded.groupBy("h").applyInPandas(_unite(path), "h string, ids array<int>")
    value = F.col("__ids") if ids else F.size("__ids").cast("long")
    # the long texts themselves stay behind: only their hashes meet the ids
    joined = long.select(*keep, "__h").join(whole.select(F.col("h").alias("__h"), F.col("ids").alias("__ids")), "__h")
    return short.unionByName(joined.select(*keep, value.alias(out)))


def decoded(rows: DataFrame, keep: list[str], ids: str = "ids", path: str | None = None) -> DataFrame:
    """The texts that lists of ids stand for: the columns ``keep`` and ``text``. An empty list is an empty text, a null one is null. It is the way back that ``encode`` is checked by."""
    path = path or bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.load(path)
        for b in batches:
            texts = [None if i is None else enc.decode(i, errors="strict") for i in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*b.schema.names[:-1], "text"])

    rows = rows.select(*keep, F.col(ids).alias("__ids"))
    return rows.mapInArrow(run, rows.drop("__ids").schema.add("text", "string"))
