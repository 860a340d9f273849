"""Joins on order, and windows over streams."""

import random

import pytest

from canopyq.operators import joins
from canopyq.streaming import windows


def test_as_of(spark):
    rng = random.Random(3)
    left = [(k, rng.choice(["a", "b", None]), rng.choice([*range(12), None])) for k in range(60)]
    right = [(rng.choice(["a", "b", "c", None]), rng.choice([*range(12), None]), rng.randint(0, 99)) for _ in range(30)]
    left += left[:3]
    l, r = spark.createDataFrame(left, "id int, by string, at int"), spark.createDataFrame(right, "by string, at int, v int")
    got = sorted(((x.id, x.by, x.at, x.right_v) for x in joins.as_of_join(l, r, "by", "at", ["v"]).collect()), key=str)

    def latest(by, at):
        return max(((t, v) for b, t, v in right if b == by and b is not None and t is not None and at is not None and t <= at), default=(None, None))[1]

    assert got == sorted(((k, b, t, latest(b, t)) for k, b, t in left), key=str)
    assert joins.as_of_join(l.limit(0), r, "by", "at", ["v"]).count() == 0
    assert {x.right_v for x in joins.as_of_join(l, r.limit(0), "by", "at", ["v"]).collect()} == {None}
    with pytest.raises(ValueError, match="right_v"):
        joins.as_of_join(l.withColumnRenamed("id", "right_v"), r, "by", "at", ["v"])


@pytest.mark.parametrize("width", [1, 4, 100])
def test_intervals(spark, width):
    rng = random.Random(4)
    spans = [[(rng.choice(["a", "b", None]), s := rng.choice([*range(-9, 20), None]), None if s is None else s + rng.randint(-1, 9)) for _ in range(40)] for _ in range(2)]
    l, r = (spark.createDataFrame(x, "by string, a int, z int") for x in spans)
    got = sorted((tuple(x.l), tuple(x.r)) for x in joins.interval_join(l, r, "by", ("a", "z"), ("a", "z"), width).collect())
    want = [(x, y) for x in spans[0] for y in spans[1] if x[0] is not None and x[0] == y[0] and None not in (x[1], y[1]) and x[1] <= x[2] and y[1] <= y[2] and x[1] <= y[2] and y[1] <= x[2]]
    assert got == sorted(want)
    with pytest.raises(ValueError, match="width"):
        joins.interval_join(l, r, "by", ("a", "z"), ("a", "z"), 0)


ROWS = [(1, "2024-01-01 10:00:00", "s"), (2, "2024-01-01 11:00:00", "s"), (3, "2024-01-02 10:00:00", None), (3, "2024-01-02 10:00:00", None), (4, None, "s")]


def batch(spark, rows):
    return spark.createDataFrame(rows, "page_id long, at string, site string").selectExpr("page_id", "cast(at as timestamp) as at", "site")


def test_windows_of_tables(spark):
    pages = batch(spark, ROWS)
    count = lambda **o: sorted(((str(r.start)[:16], r.site, r.n) for r in windows.pages_by_window(pages, "at", "site", **o).collect()), key=str)
    assert count() == [("2024-01-01 00:00", "s", 2), ("2024-01-02 00:00", None, 2)]
    assert count(length="2 days", slide="1 day") == [("2023-12-31 00:00", "s", 2), ("2024-01-01 00:00", "s", 2), ("2024-01-01 00:00", None, 2), ("2024-01-02 00:00", None, 2)]
    assert count(gap="2 hours") == [("2024-01-01 10:00", "s", 2), ("2024-01-02 10:00", None, 2)]
    assert windows.pages_by_window(pages.limit(0), "at", "site").count() == 0
    assert windows.first_deliveries(pages, "at", "page_id").count() == 4


def run(spark, tmp_path, make):
    """Two batches through a stream, one after the other; what the stream gave out."""
    folder, out = tmp_path / "in", tmp_path / "out"
    for k, rows in enumerate([ROWS, [(5, "2024-01-09 10:00:00", "s"), (1, "2024-01-01 10:00:00", "s")], [(6, "2024-01-20 10:00:00", "s"), (7, "2024-01-01 12:00:00", "s")]]):
        batch(spark, rows).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema("page_id long, at timestamp, site string").parquet(str(folder))
        query = make(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(out))
        assert query.awaitTermination(120)
    return spark.read.parquet(str(out)).collect()


def test_windows_of_streams_drop_late_rows_and_free_their_state(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: windows.pages_by_window(s, "at", "site"))
    # the first two days are over when the third batch comes; its late row is in no window
    found = {(str(r.start)[:10], r.site): r.n for r in got}
    assert found[("2024-01-02", None)] == 2 and found[("2024-01-09", "s")] == 1 and found[("2024-01-01", "s")] in (2, 3)
    assert ("2024-01-20", "s") not in found


def test_first_deliveries_of_streams(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: windows.first_deliveries(s, "at", "page_id"))
    ids = [r.page_id for r in got]
    assert ids.count(3) == 1 and ids.count(1) == 1 and {2, 3, 5, 6} <= set(ids)
