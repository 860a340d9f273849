"""String values of elements: the text of a document is put together once, and each element takes its stretch of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ids of a cell: joins of spans with nodes of a document meet by cells of ids, so few pairs are compared that do not match.
CELL = 64


def string_values(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc_id, nid, text: all text below each node of ``ranges`` (doc_id, nid, nlast; each once), in document order. ``texts`` has doc_id, node_id, value, each once; null texts count as "".

    One window over a document in its order tells how many characters come before each end of a range, so a text is not repeated for each element
    around it, and no pair of nodes is compared.
    """
    t = texts.select("doc_id", F.col("node_id").alias("at"), F.coalesce("value", F.lit("")).alias("v"))
    moves = t.select("doc_id", "at", F.lit(1).alias("phase"), F.length("v").cast("long").alias("n"), F.lit(None).cast("int").alias("nid"))
    begins = ranges.select("doc_id", F.col("nid").alias("at"), F.lit(0).alias("phase"), F.lit(0).cast("long").alias("n"), "nid")
    ends = ranges.select("doc_id", F.col("nlast").alias("at"), F.lit(2).alias("phase"), F.lit(0).cast("long").alias("n"), "nid")
    by = Window.partitionBy("doc_id").orderBy("at", "phase").rowsBetween(Window.unboundedPreceding, 0)
    before = moves.unionByName(begins).unionByName(ends).withColumn("sum", F.sum("n").over(by)).filter("nid is not null")
    spans = before.groupBy("doc_id", "nid").agg(F.min("sum").alias("a"), F.max("sum").alias("z"))
    whole = t.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]), "").alias("whole"))
    held = spans.join(whole, "doc_id", "left")
    return held.select("doc_id", "nid", F.coalesce(F.substring("whole", (F.col("a") + 1).cast("int"), (F.col("z") - F.col("a")).cast("int")), F.lit("")).alias("text"))
