"""Joins on order rather than equality: the latest row before, and intervals that overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of_join(left: DataFrame, right: DataFrame, by: str, on: str, values: list[str]) -> DataFrame:
    """The rows of ``left`` with the ``values`` (named right_..) of the latest row of ``right`` with the same ``by`` that is not later in ``on``; null if there is none.

    Both sides go through one window in order, so no pairs are made. Of right rows at the same time one of the greatest values counts. Rows whose ``by`` or
    ``on`` is null match nothing and stay; equal rows stay as often as they are. Right rows with such nulls are left out.
    """
    keys = {f"right_{v}" for v in values}
    if keys & set(left.columns):
        raise ValueError(f"left has columns {sorted(keys & set(left.columns))}")
    held = F.struct(*[F.col(v).alias(f"right_{v}") for v in values])
    r = right.filter(F.col(by).isNotNull() & F.col(on).isNotNull()).select(F.col(by).alias("__by"), F.col(on).alias("__on"), F.lit(0).alias("__side"), held.alias("__held"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("__row"))
    rows = left.select(F.col(by).alias("__by"), F.col(on).alias("__on"), F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__held"].dataType).alias("__held"), F.struct(*left.columns).alias("__row"))
    known = rows.filter(F.col("__by").isNotNull() & F.col("__on").isNotNull())
    window = Window.partitionBy("__by").orderBy("__on", "__side", "__held").rowsBetween(Window.unboundedPreceding, 0)
    found = r.unionByName(known).withColumn("__held", F.last("__held", ignorenulls=True).over(window)).filter("__side = 1")
    alone = rows.filter(F.col("__by").isNull() | F.col("__on").isNull())
    return found.unionByName(alone).select("__row.*", "__held.*")


def interval_join(left: DataFrame, right: DataFrame, by: str, left_span: tuple[str, str], right_span: tuple[str, str], width: int) -> DataFrame:
    """Pairs of rows with the same ``by`` whose closed spans of whole numbers overlap; columns as l (struct) and r (struct).

    Spans are cut into cells of ``width``: rows meet by equality of key and cell, and a pair counts in the cell where the later of both begins, so each comes out once.
    A width near the usual length of a span keeps both copies and pairs few. Spans with nulls, or that end before they begin, match nothing.
    """
    if width < 1:
        raise ValueError("width is at least 1")

    def cells(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        a, z = (F.col(c).cast("long") for c in span)
        ok = df.filter(a <= z)
        return ok.select(F.col(by).alias("__by"), a.alias(f"__{name}a"), z.alias(f"__{name}z"), F.struct(*df.columns).alias(name), F.explode(F.sequence(F.floor(a / width), F.floor(z / width))).alias("__cell"))

    pairs = cells(left, left_span, "l").join(cells(right, right_span, "r"), ["__by", "__cell"])
    begin = F.greatest("__la", "__ra")
    return pairs.filter((begin <= F.least("__lz", "__rz")) & (F.floor(begin / width) == F.col("__cell"))).select("l", "r")
