"""Registered queries against their SQL, on the smallest given tables."""

from pathlib import Path

import pytest

import __spark_entry__
from canopyq import queries

DATA = Path("/root/testdata/sf0.001")
NAMES = ("links", "second_item", "shared_position", "string_value_equals", "absolute_in_predicate", "every", "if", "arithmetic", "page_errors", "parse_pages", "p_get_all_text", "tags_by_site", "relative", "round_trip", "round_trip_indented", "parsed_values", "sorted_items", "evaluation_errors", "any_of_several", "two_variables", "node_is", "range", "data", "joined", "last_click", "overlapping_elements", "top_tags_of_sites", "pages_by_sliding_days", "lateral_nodes")


def plain(rows):
    return sorted((tuple(None if v is None or v != v else str(v) for v in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_what_its_sql_gives(spark, tables, name):
    got = __spark_entry__.queries()[name](spark, str(DATA))
    columns = sorted(got.columns)
    sql = tables.execute(queries.oracle_sql()[name])
    order = [d[0] for d in sql.description]
    assert sorted(order) == columns
    want = [tuple(r[order.index(c)] for c in columns) for r in sql.fetchall()]
    assert plain(got.select(*columns).collect()) == plain(want)


def test_entry(spark):
    if not DATA.exists():
        pytest.skip("no test tables")
    got = __spark_entry__.entry(spark)
    assert got.columns == ["doc_id", "node_id", "name", "value"] and got.count() > 0
