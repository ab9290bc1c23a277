import gzip
import math
import zipfile

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trolley.functions import columns as C
from trolley.functions import names as N
from trolley.operators import gates, places
from trolley.plans import queries
from trolley.sources.dialects import Dialect, archive, read
from trolley.streaming import feeds

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted(repr(["null" if x is None or x is pd.NaT or pd.isna(x) else float(x) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x) for x in row]) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    own, other = queries.QUERIES[name](spark, DATA).toPandas(), con.execute(queries.SQL[name]).df()
    assert sorted(own.columns) == sorted(other.columns)
    assert rows(own) == rows(other)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_golden_values(spark):
    unit = lambda p, t: one(spark, C.unit_price(F.lit(p), F.lit(t), F.lit("g")))
    assert unit(690, 260) // 1000 == 265 and unit(450, 260) // 1000 == 173
    cost = lambda q, kind, n, t: one(spark, C.promo_cost(F.lit(q), F.lit(1000), F.lit(kind), F.lit(n), F.lit(t)))
    assert cost(3, "n_for_t", 3, 2000) == 2000 and cost(2, "x_plus_y", 1, 1) == 1000 and cost(1, "x_plus_y", 1, 1) == 1000
    assert one(spark, C.parse_size(F.lit("water 6*1.5 L")))["total"] == 9000
    assert [r["qty"] for r in one(spark, C.list_needs(F.lit("bread, 2 milk, eggs")))] == [1, 2, 1]


def test_gates_and_pending(spark):
    stats = spark.createDataFrame([(1, "2024-01-01", 100, 0, 0, "2024-01-01"), (1, "2024-01-02", 60, 0, 0, "2024-01-12"), (1, "2024-01-03", 60, 1, 1, "2024-01-03")], "store int, at string, items int, zero int, jumps int, arrived string")
    got = {r["at"]: r["reasons"] for r in gates.verdicts(stats, ["store"], "at").collect()}
    assert got == {"2024-01-01": [], "2024-01-02": ["drop", "stale"], "2024-01-03": ["zero", "jump"]}
    files = spark.createDataFrame([("a", "c", "s", "full", 1), ("a", "c", "s", "full", 1), ("b", "c", "s", "delta", 2), ("d", "c", "t", "delta", 1), ("e", "c", "s", "full", 3)], "sha256 string, chain_id string, store_code string, file_type string, file_ts int")
    log = spark.createDataFrame([("e", "c", "s", "full", 3)], files.schema)
    assert {r["sha256"]: r["loadable"] for r in gates.pending(files, log).collect()} == {"a": True, "b": True, "d": False}
    loaded = spark.createDataFrame([("x", "c", "t", "full", 0)], files.schema)  # a full file of an earlier day
    assert {r["sha256"]: r["loadable"] for r in gates.pending(files, loaded).collect()} == {"a": True, "b": True, "d": True, "e": True}


@pytest.mark.parametrize("lat", [0.0, 31.5, 60.0, -75.0, 89.99])
def test_stores_are_found_at_any_latitude(spark, lat):
    rng = np.random.default_rng(7)
    at = [(float(lat + rng.normal() * 0.1), float((179.9 + rng.normal() * 0.4 / max(math.cos(math.radians(lat)), 0.01) + 180) % 360 - 180)) for _ in range(60)]
    at = [(min(a, 90.0), b) for a, b in at]
    points = spark.createDataFrame(at[:30], "lat double, lon double")
    stores = spark.createDataFrame([(k, *x) for k, x in enumerate(at[30:])], "store long, s_lat double, s_lon double")

    def km(a, b):
        (p, q), (r, t) = a, b
        x = math.sin(math.radians(r - p) / 2) ** 2 + math.cos(math.radians(p)) * math.cos(math.radians(r)) * math.sin(math.radians(t - q) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(x))

    want = {(a, k) for a in at[:30] for k, b in enumerate(at[30:]) if round(km(a, b) * 1000) <= 15_000}
    got = [((r.lat, r.lon), r.store) for r in places.within(points, stores, 15.0).collect()]
    assert set(got) == want and len(got) == len(want)


def test_promotions_with_limits(spark):
    cost = lambda q, kind, n, t, least, most: one(spark, C.limited_promo_cost(F.lit(q), F.lit(1000), F.lit(kind), F.lit(n), F.lit(t), F.lit(least), F.lit(most).cast("int")))
    assert cost(2, "n_for_t", 3, 2000, 3, None) == 2000 and cost(7, "n_for_t", 3, 2000, 3, None) == 5000 and cost(7, "n_for_t", 3, 2000, 1, 4) == 6000
    assert cost(3, "fixed_price", 0, 900, 1, 2) == 2800 and cost(2, "percent_off", 10, 0, 1, None) == 1800 and cost(5, "x_plus_y", 1, 1, 1, None) == 3000


def test_names_and_explanations(spark):
    assert one(spark, N.clean_name(F.lit(" # MILK   ק\"ג 3% "))) == "milk קילוגרם 3%"
    size = lambda name, q, u: one(spark, N.size_of(F.lit(name), F.lit(q).cast("double"), F.lit(u).cast("string")))
    assert size("milk 6*1.5 L", None, None)["total"] == 9000 and size("milk 6*1.5 L", 0.5, "kg")["total"] == 500 and size("milk", 2.0, "odd") is None
    x = one(spark, N.explain(F.expr("map('a', '1', 'b', '2', 'c', null)"), F.expr("map('a', '1', 'b', '3', 'd', '4')")))
    assert (x["same"], x["different"], x["unverified"]) == (["a"], ["b"], ["c", "d"])
    assert [r["need"] for r in one(spark, C.list_needs(F.lit("1.5 kg rice, 2 milk, eggs")))] == ["kg rice", "milk", "eggs"]
    assert [float(r["qty"]) for r in one(spark, C.list_needs(F.lit("1.5 kg rice, 2 milk, eggs")))] == [1.5, 2.0, 1.0]


ITEM = "<{0}><ChainId>1</ChainId><StoreId>2</StoreId><ItemCode>{1}</ItemCode><ItemName>חלב</ItemName><ItemPrice>{2}</ItemPrice></{0}>"


@pytest.mark.parametrize(("tag", "charset", "container"), [("Item", "UTF-8", "gzip"), ("Item", "windows-1255", "gzip"), ("Product", "UTF-16", "gzip"), ("Product", "UTF-8", "zip")])
def test_dialects(spark, tmp_path, tag, charset, container):
    data = ("<root>" + ITEM.format(tag, 7, "5.90") + ITEM.format(tag, 8, "x").replace(f"<{tag}>", f"<{tag} n='1'>") + "</root>").encode(charset)
    path = tmp_path / ("f.xml.gz" if container == "gzip" else "f.zip")
    if container == "gzip":
        path.write_bytes(gzip.compress(data))
    else:
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("f.xml", data)
    got = read(spark, str(path), Dialect(tag, charset, container)).orderBy("item_code").collect()
    assert [(r["item_code"], r["raw_name"], r["price"] and float(r["price"])) for r in got] == [("7", "חלב", 5.9), ("8", "חלב", None)]


@pytest.mark.parametrize("every", [2, 24])
def test_table_under_deltas(spark, tmp_path, every):
    for part in ([(1, 1, 5), (2, 1, 7)], [(1, 2, 6)], [(2, 3, 8), (3, 1, 1)], [(1, 1, 9)], [(3, 4, 2)]):
        spark.createDataFrame(part, "k long, at long, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = feeds.files(spark, str(tmp_path / "in"), "k long, at long, v long")
        feeds.apply_deltas(stream, str(tmp_path / "table"), str(tmp_path / "log"), ["k"], [F.desc("at"), "v"], every).awaitTermination()
    got = feeds.current(spark, str(tmp_path / "table"), ["k"], [F.desc("at"), "v"]).collect()
    assert sorted((r.k, r.at, r.v) for r in got) == [(1, 2, 6), (2, 3, 8), (3, 4, 2)]
    bases = [n for a, n in feeds._parts(spark, str(tmp_path / "table")) if a == "base"]
    assert bases == ([4] if every == 2 else []) or bases == [2, 4]


def test_archive_keeps_each_content_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a", b"one"), ("b", b"two"), ("c", b"one")):
        (tmp_path / "in" / name).write_bytes(data)
    index = archive(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    kept = {r["sha256"]: bytes(r["content"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(kept) == 2 and {r["path"][-1]: kept[r["sha256"]] for r in index.collect()} == {"a": b"one", "b": b"two", "c": b"one"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count()
