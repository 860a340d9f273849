"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopyq.llm import boilerplate, consistency, encoding, mixing, mojibake, residue, sentences
from canopyq.session import table


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.lookalike_nodes(table(spark, sf_dir, "nodes"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_forms(spark, sf_dir).select("doc_id", "node_id")


def p2_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_nodes(table(spark, sf_dir, "nodes"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_kinds(spark, sf_dir).select("doc_id", "node_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.main_text_nodes(table(spark, sf_dir, "nodes"))


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled_nodes(table(spark, sf_dir, "nodes"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_restored(spark, sf_dir).select("doc_id", "node_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(table(spark, sf_dir, "documents"), ["doc_id"])


def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that the ids of all documents stand for."""
    return encoding.decoded(p6_ids(spark, sf_dir), ["doc_id"])


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p7_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split_sentences(table(spark, sf_dir, "documents"), ["doc_id"])


#: White space, as sentence units leave it out.
WHITE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def p8_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters but white space that the units of each document hold, and their order: no unit begins before the one before it ends."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    units = p8_found(spark, sf_dir).join(docs, "doc_id")
    held = F.length(F.regexp_replace(F.expr("substring(text, sent_start + 1, sent_end - sent_start)"), WHITE, "")).cast("long")
    before = F.lag("sent_end").over(Window.partitionBy("doc_id").orderBy("sent_start"))
    units = units.select("doc_id", held.alias("held"), (F.col("sent_start") >= F.coalesce(before, F.lit(0))).alias("apart"))
    return units.groupBy("doc_id").agg(F.sum("held").alias("characters"), F.every("apart").alias("apart"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_of_them = (p1_found, p1_forms, p2_found, p2_kinds, p3_found, p4_found, p4_restored, p6_ids, p6_texts, p7_shares, p7_selected, p8_found, p8_covered)
    return {q.__name__: q for q in all_of_them}


def oracle_sql() -> dict[str, str]:
    """What SQL can tell of these operators: ids stand for the whole texts, and units hold all characters but white space, once."""
    bare = f"regexp_replace(text, '{WHITE}', '', 'g')"
    return {
        "p6_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p8_covered": f"SELECT doc_id, length({bare}) AS characters, true AS apart FROM documents WHERE length({bare}) > 0",
    }
