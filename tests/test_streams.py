"""Streams with timers against their batch twins; a silent key's state goes; duplicates are dropped within the watermark."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from trolley.operators import prices
from trolley.streaming import feeds

SCHEMA = "item long, at timestamp, n long, price decimal(12,2)"


def run(stream, tmp_path, name):
    out = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-log")).trigger(availableNow=True).start()
    out.awaitTermination()
    return out


def batches(seed, n=4):
    """Batches of events in the order of time, with ties, silences of over 90 days and repeated values."""
    rng, rows, day = random.Random(seed), [], 0
    for b in range(n):
        part = []
        for k in range(60):
            day += rng.choice([0, 0, 0, 1, 1, 3])
            if rng.random() < 0.03:
                day += 100
            part.append((rng.choice([1, 2, 3, None]), day, 1000 * b + k, rng.choice([None, *map(Decimal, ("4.10", "4.20", "5.00", "6.30"))])))
        rows.append(part)
    return rows


def frame(spark, part):
    return spark.createDataFrame(part, "item long, day int, n long, price decimal(12,2)").select("item", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("day"))).alias("at"), "n", "price")


@pytest.mark.parametrize("kind", ["changes", "alerts"])
def test_streams_equal_their_batch_twins(spark, tmp_path, kind):
    parts = batches(3)
    for part in parts:
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = feeds.files(spark, str(tmp_path / "in"), SCHEMA)
        if kind == "changes":
            found = feeds.changes(stream, ["item"], "at", "price", ["n"])
        else:
            found = feeds.alerts(stream, ["item"], "at", "price", Decimal("4.50"), Decimal("5.50"), ["n"])
        run(found, tmp_path, "out")
    events = frame(spark, [r for p in parts for r in p])
    if kind == "changes":
        twin = prices.change_feed(events, ["item"], "at", ["n"], "price")
    else:
        twin = prices.alert_feed(events, ["item"], "at", ["n"], "price", F.lit(Decimal("4.50")), F.lit(Decimal("5.50")))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert dict(got.dtypes)["price"] == "decimal(12,2)"
    key = lambda df: sorted(((r.item or -1), r.at, r.n, r.price) for r in df.select("item", "at", "n", "price").collect())
    assert key(got) == key(twin) and len(key(twin)) > 10


def test_state_of_a_silent_key_goes(spark, tmp_path):
    days = [(1, 0), (2, 0), (2, 200), (2, 201)]  # key 1 is silent while the watermark passes its timer
    for k, (item, day) in enumerate(days):
        frame(spark, [(item, day, k, Decimal("5.00"))]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = run(feeds.changes(feeds.files(spark, str(tmp_path / "in"), SCHEMA), ["item"], "at", "price", ["n"]), tmp_path, "out")
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] < 6
    left = spark.read.format("statestore").option("path", str(tmp_path / "out-log")).option("stateVarName", "last").load()
    assert [r.key.item for r in left.select("key").collect()] == [2]


def test_events_before_the_last_are_ignored(spark, tmp_path):
    for part in ([(1, 5, 1, Decimal("5.00"))], [(1, 3, 2, Decimal("9.00")), (1, 6, 3, Decimal("5.00")), (1, 7, 4, Decimal("6.30"))]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(feeds.changes(feeds.files(spark, str(tmp_path / "in"), SCHEMA), ["item"], "at", "price", ["n"]), tmp_path, "out")
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 4]


def test_duplicates_within_the_watermark(spark, tmp_path):
    for part in ([(1, 0, 7, None), (1, 0, 7, None)], [(1, 0, 7, None), (2, 0, 8, None)]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(feeds.unique(feeds.files(spark, str(tmp_path / "in"), SCHEMA), "n", "at"), tmp_path, "out")
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [7, 8]
