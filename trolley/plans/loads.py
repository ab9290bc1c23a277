"""Batch twins of the feeds and of the transactional load, on files made of the price observations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trolley.operators import gates, loading, prices
from trolley.plans import tables as T
from trolley.plans.registry import query
from trolley.plans.tables import sql

#: What an alert waits for, in hundredths, and what it must rise to before it may sound again. Fixed values.
BELOW, REARM = 100_000, 120_000
_ORDER = ["order_id", "line", "price", "qty"]
_W = "WINDOW w AS (PARTITION BY item, store ORDER BY valid_from, order_id, line, price, qty)"


@query(f"SELECT item, store, valid_from, price FROM (SELECT *, lag(price) OVER w AS before, lag(valid_from) OVER w AS last FROM obs {_W}) WHERE last IS NULL OR valid_from > last + INTERVAL 90 DAY OR price <> before", "obs")
def change_stream(s, d):
    """What the change stream emits for all price observations."""
    return prices.change_feed(T.observations(s, d), ["item", "store"], "valid_from", _ORDER, "price").select("item", "store", "valid_from", "price")


@query(f"""SELECT item, valid_from, order_id, line, price FROM (SELECT *, row_number() OVER (PARTITION BY item, armed ORDER BY valid_from, order_id, line, price, qty) AS nth FROM (
    SELECT *, sum(starts) OVER (PARTITION BY item ORDER BY valid_from, order_id, line, price, qty ROWS UNBOUNDED PRECEDING) AS armed FROM (
        SELECT *, CASE WHEN last IS NULL OR valid_from > last + INTERVAL 90 DAY THEN 1 ELSE 0 END + CASE WHEN price >= {REARM} THEN 1 ELSE 0 END AS starts FROM (SELECT *, lag(valid_from) OVER (PARTITION BY item ORDER BY valid_from, order_id, line, price, qty) AS last FROM obs))) WHERE price < {BELOW}) WHERE nth = 1""", "obs")
def alert_stream(s, d):
    """What the alert stream emits for all price observations of each item."""
    rows = T.observations(s, d).select("item", "valid_from", *_ORDER)
    return prices.alert_feed(rows, ["item"], "valid_from", _ORDER, "price", F.lit(BELOW), F.lit(REARM)).select("item", "valid_from", "order_id", "line", "price")


_FILES = """f AS (SELECT store, CAST(date_trunc('month', valid_from) AS DATE) AS file_date, count(*) AS items, count_if(price <= 0) AS zero, count_if(before IS NOT NULL AND price > 3 * before) AS jumps FROM (
    SELECT *, lag(price) OVER (PARTITION BY item, store ORDER BY valid_from, order_id, line, price, qty) AS before FROM obs) GROUP BY ALL),
    v AS (SELECT *, CASE WHEN month(file_date) % 3 = 1 THEN 'full' ELSE 'delta' END AS file_type, zero > 0 OR jumps > 0 OR coalesce(100 * items < 40 * before, false) OR store % 6 > 3 AND month(file_date) % 2 = 0 AS bad FROM (SELECT *, lag(items) OVER (PARTITION BY store ORDER BY file_date) AS before FROM f)),
    o AS (SELECT store, min(file_date) AS first_full FROM v WHERE file_type = 'full' AND NOT bad GROUP BY store)"""


@query(sql("", "obs").rstrip() + ", " + _FILES + """ SELECT v.store, file_date::VARCHAR AS file_date, file_type, CASE WHEN file_type = 'delta' AND (first_full IS NULL OR first_full > file_date) THEN 'waiting' WHEN bad THEN 'quarantined' ELSE 'accepted' END AS status, items FROM v LEFT JOIN o ON o.store = v.store""")
def load_states(s, d):
    """What a load decides on each store's monthly files: accepted, quarantined by the gates, or a delta that waits for a full file."""
    w = Window.partitionBy("item", "store").orderBy(*T.EVENT_ORDER)
    rows = T.observations(s, d).withColumn("before", F.lag("price").over(w)).withColumn("file_date", F.trunc("valid_from", "month"))
    stats = gates.file_stats(rows, ["store", "file_date"])
    month = F.month("file_date")
    arrived = F.date_add("file_date", F.when(month % 2 == 0, F.pmod("store", F.lit(6))).otherwise(0).cast("int"))
    judged = gates.verdicts(stats.withColumn("arrived", arrived), ["store"], "file_date", drop_percent=60)
    name = F.concat_ws("/", F.col("store").cast("string"), F.col("file_date").cast("string"))
    files = judged.select(F.sha2(name, 256).alias("sha256"), F.lit("").alias("chain_id"), F.col("store").cast("string").alias("store_code"), F.when(month % 3 == 1, "full").otherwise("delta").alias("file_type"), F.col("file_date").cast("timestamp_ntz").alias("file_ts"), "reasons", "items")
    decided = loading.states(files.drop("reasons", "items"), s.createDataFrame([], loading.LOG), files.select("sha256", "reasons"))
    return decided.join(files.select("sha256", "items"), "sha256").select(F.col("store_code").cast("long").alias("store"), F.col("file_ts").cast("date").cast("string").alias("file_date"), "file_type", "status", "items")
