"""As-of values and rolling minima with one key that holds a third of all rows; intervals by bins; numbering; substitutes; months."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trolley.operators import intervals, prices, shared, substitutes

DAY = 86400


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(11)
    rows = []
    for k in range(1500):
        key = 1 if k % 3 == 0 else rng.choice([*range(2, 60), None])
        rows.append((key, rng.randint(0, 400) * DAY + rng.choice([0, 0, 5, 40_000, DAY - 1]), rng.choice([None, *range(100, 130)]), k))
    return spark.createDataFrame(rows, "item long, at long, price long, n long").repartition(5).cache()


@pytest.mark.parametrize("hot", [0, 100, 10**9])
def test_rolling_low(spark, events, hot):
    rows = events.where("item IS NOT NULL")
    got = {r.n: r.low for r in prices.rolling_low(rows, "item", "at", "price", "low", 90, hot).collect()}
    own = rows.collect()
    assert len(got) == len(own)
    for r in own:
        seen = [x.price for x in own if x.item == r.item and r.at - 90 * DAY <= x.at <= r.at and x.price is not None]
        assert got[r.n] == (min(seen) if seen else None)


@pytest.mark.parametrize("hot", [0, 100, 10**9])
def test_asof(spark, events, hot):
    rng = random.Random(12)
    probes = [(1 if k % 3 == 0 else rng.choice([2, 3, None, 999]), rng.randint(0, 400) * DAY + rng.choice([0, 5, 6]), k) for k in range(300)]
    df = spark.createDataFrame(probes, "item long, at long, probe long")
    got = Counter((r.item, r.at, r.probe, r.price) for r in prices.asof(df, events, ["item"], "at", "price", ["n"], hot).collect())
    own = events.collect()
    want = Counter()
    for item, at, k in probes:
        seen = [(x.at, x.n, x.price) for x in own if x.item == item and x.at <= at and x.price is not None]
        want[item, at, k, max(seen)[2] if seen else None] += 1
    assert got == want


def test_no_range_holds_more_than_its_share_of_a_hot_key(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("item"), (F.col("id") * 7919 % 60_000).alias("at"))
    sizes = [r["count"] for r in shared.ranged(rows, [F.col("item"), F.col("at")]).groupBy(shared.PART).count().collect()]
    assert sum(sizes) == 60_000 and max(sizes) <= 1.5 * 60_000 / len(sizes) and len(sizes) > 4


def test_intervals(spark):
    rng = random.Random(13)
    points = [(rng.randint(0, 3), rng.randint(-50, 900), k) for k in range(200)]
    spans = [(rng.randint(0, 3), a, a + rng.choice([0, 1, 7, 30, 400, 900, -5]), k) for k in range(150) for a in [rng.randint(-60, 800)]] + [(1, None, 5, 900), (1, 5, None, 901)]
    p, s = spark.createDataFrame(points, "item long, at long, p long"), spark.createDataFrame(spans, "item long, since long, until long, s long")
    got = Counter((r.p, r.s) for r in intervals.join(p, s, ["item"], "at", "since", "until", 5).collect())
    assert got == Counter((k, m) for i, at, k in points for j, a, b, m in spans if i == j and a is not None and b is not None and a <= at < b)
    assert not intervals.join(p, s.limit(0), ["item"], "at", "since", "until", 5).count()


def test_numbering(spark):
    rows = spark.createDataFrame([(k * 37 % 101, "x") for k in range(101)], "k long, v string").repartition(7)
    got = {r.k: r.place for r in shared.numbered(rows, [F.col("k")], "place").collect()}
    assert got == {k: k + 1 for k in range(101)}


def test_substitutes_equal_all_pairs(spark):
    rng = random.Random(14)
    items = [(k, rng.choice("ab"), rng.choice(["x", "y", None]), rng.choice([1, 2, None]), rng.randint(1, 12)) for k in range(120)]
    df = spark.createDataFrame(items, "item long, kind string, brand string, fat long, base long")
    got = {(r.item, tuple(r.open)): (r.substitute, r.substitute_price) for r in substitutes.cheapest(df, "item", "base", ["kind"], ["fat", "brand"]).collect()}
    want = {}
    for i, kind, brand, fat, base in items:
        for open_ in ((), ("brand",), ("fat",), ("brand", "fat")):
            fits = [(b[4], b[0]) for b in items if b[1] == kind and b[4] < base and ("brand" in open_ or (brand is not None and b[2] == brand)) and ("fat" in open_ or (fat is not None and b[3] == fat))]
            if fits:
                want[i, open_] = min(fits)[::-1]
    assert got == want


def test_months_are_split_and_rewritten_alone(spark, tmp_path):
    rows = spark.range(4000).select("id", F.expr("timestamp_ntz '2024-01-15 00:00:00' + make_interval(0, cast(id % 2 as int))").alias("valid_from"), (F.col("id") % 9).alias("price"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these months are small
    prices.write_monthly(rows, str(tmp_path / "t"), files=4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    table = spark.read.parquet(str(tmp_path / "t"))
    assert table.count() == 4000 and {r.month: r["count"] for r in table.groupBy("month").count().collect()} == {"2024-01": 2000, "2024-02": 2000}
    assert len(list((tmp_path / "t" / "month=2024-01").glob("*.parquet"))) > 1
    prices.write_monthly(rows.where("id % 2 = 0 and id < 100"), str(tmp_path / "t"), files=4)
    assert {r.month: r["count"] for r in spark.read.parquet(str(tmp_path / "t")).groupBy("month").count().collect()} == {"2024-01": 50, "2024-02": 2000}
