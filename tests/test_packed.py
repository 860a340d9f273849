"""Splitting of packed fields against a splitter that walks each field by itself."""

import random

import pytest
from pyspark.sql import functions as F

from canopyq.operators import packed


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ('page; "red; dark"|x', ["page", "red; dark", "x"]),
        ("&quot;Q&amp;A, live&quot;, a", ["Q&amp;A, live", "a"]),
        ("salt &amp; pepper;b", ["salt &amp; pepper", "b"]),
        ('["39,5", "12 x 8"]', ["39,5", "12 x 8"]),
        ("39,5;;0,75;", ["39,5", "0,75"]),
        ("S/M / XL / 3/4", ["S/M", "XL", "3/4"]),
        ("#a #b", ["#a", "#b"]),
        ("cook's note\tx\ny", ["cook's note", "x", "y"]),
        ("'top|side' · b", ["top|side", "b"]),
        ("花；茶，灯、水", ["花", "茶", "灯", "水"]),
        ("  one value  ", ["one value"]),
        ("&#39;x&#39;", ["x"]),
        ("x / ", ["x"]),
        ("", []),
        (" ; , ", []),
        ('"', []),
        ("a\\\"b", ["a\\\"b"]),
    ],
)
def test_resolve(value, want):
    toks, skeleton = packed.symbols(value)
    assert "".join(toks) == value
    assert ["".join(toks[a:b]) for a, b in packed.resolve(skeleton, False)] == want


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("Sarnath, Ludo", ["Sarnath, Ludo"]),
        ("Jorun Iskander,Velda Vesk", ["Jorun Iskander", "Velda Vesk"]),
        ("Telisse, Piran ; Sable Marrick", ["Telisse, Piran", "Sable Marrick"]),
        ('"Vesk, Oren", "Pellow, Ludo"', ["Vesk, Oren", "Pellow, Ludo"]),
        ("Vesk, Oren, Pellow, Ludo", ["Vesk, Oren", "Pellow, Ludo"]),
    ],
)
def test_names(value, want):
    toks, skeleton = packed.symbols(value)
    assert ["".join(toks[a:b]) for a, b in packed.resolve(skeleton, True)] == want


@pytest.mark.parametrize("most_broadcast", [0, 50_000])
def test_spark_agrees_with_direct_splitting(spark, most_broadcast):
    rng = random.Random(5)
    bits = ["a", "bc ", '"', "'", "&quot;", ",", ";", " ", "|", "\t", "\n", "3", "0,5", "[", "]", "#x", " / ", "、", "&amp;", "é", " "]
    rows = [(k % 40, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14))), rng.random() < 0.4, "clash") for k in range(300)]
    rows += [(900, None, False, "x"), (901, "", False, "x"), (902, "  ", True, "x"), (903, "z" * 50_000 + ";y", False, "x"), (904, "a;b", None, "x")]
    df = spark.createDataFrame(rows, "id int, v string, names boolean, item string")
    got = sorted((r.id, r.pos, r.item) for r in packed.split_packed(df, ["id"], "v", F.col("names"), most_broadcast).collect())
    want = []
    for k, v, names, _ in rows:
        if v is not None:
            toks, skeleton = packed.symbols(v)
            want += [(k, i, "".join(toks[a:b])) for i, (a, b) in enumerate(packed.resolve(skeleton, bool(names)))]
    assert got == sorted(want)


def test_clashing_names_and_empty_tables(spark):
    df = spark.createDataFrame([], "id int, v string")
    assert packed.split_packed(df, ["id"], "v", F.lit(False)).collect() == []
    with pytest.raises(ValueError, match="pos"):
        packed.split_packed(df.withColumnRenamed("id", "pos"), ["pos"], "v", F.lit(False))


def test_attributes_of_pages(spark):
    rows = [
        (1, 1, 0, "element", "META", None, {"name": "Keywords"}), (1, 2, 1, "attribute", "name", "Keywords", None), (1, 3, 1, "attribute", "content", "a, b", None),
        (1, 4, 0, "element", "meta", None, {"name": "description"}), (1, 5, 4, "attribute", "content", "c, d", None),
        (1, 6, 0, "element", "div", None, {}), (1, 7, 6, "attribute", "data-authors", "Vesk, Oren", None), (1, 8, 6, "attribute", "data-tags", None, None), (1, 9, 6, "attribute", "alt", "x;y", None),
    ]
    nodes = spark.createDataFrame(rows, "doc_id long, node_id int, parent_id int, kind string, name string, value string, attrs map<string,string>")
    got = packed.packed_attributes(nodes.unionByName(nodes))
    assert [f.simpleString() for f in got.schema] == ["doc_id:bigint", "node_id:int", "pos:int", "item:string"]
    assert sorted(map(tuple, got.collect())) == [(1, 3, 0, "a"), (1, 3, 1, "b"), (1, 7, 0, "Vesk, Oren")]
