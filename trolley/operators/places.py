"""Stores around users: a grid cell as the join key, then the distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trolley.functions.columns import haversine_km
from trolley.operators.shared import written


#: Rows of a point that meet the point's list in one place, and parts that a task has of all points together.
TOGETHER, SHARES = 1000, 8


def metres(lat: Column, lon: Column, s_lat: Column, s_lon: Column) -> Column:
    """Whole metres between two places."""
    return F.round(haversine_km(lat, lon, s_lat, s_lon) * 1000).cast("long")


def in_reach(lat: Column, lon: Column, s_lat: Column, s_lon: Column, km: float) -> Column:
    """Whether two places are at most km apart, as `within` has it; bands of latitude rule most pairs out first."""
    return (F.abs(lat - s_lat) <= km / 110.0) & (metres(lat, lon, s_lat, s_lon) <= int(km * 1000))


def dealt(rows: DataFrame, keys: list[str], many: Column | None = None) -> DataFrame:
    """keys, _first, _parts: over how many parts the rows of each key are dealt, and the first number of these, which no other key has.

    A key has a part for each TOGETHER rows or, if these are more than its share of SHARES parts a task, as many as its share: so what goes to each
    part of a key goes to a bounded number of them in all, however many rows there are. many: the number of a key's rows, if not the count of rows.
    """
    n = tasks(rows.sparkSession)
    sizes = rows.groupBy(*keys).agg((F.count("*") if many is None else many).alias("_n"))
    share = F.ceil(F.col("_n") * (SHARES * n) / F.col("_all"))
    parts = F.least(F.ceil(F.col("_n") / TOGETHER), share, F.lit(n)).cast("int")
    numbered = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("_n").alias("_all")))).select(*keys, parts.alias("_parts"), (F.monotonically_increasing_id() * n).alias("_first"))
    return written(numbered, "dealt")  # numbers are drawn once


def tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def to_parts(rows: DataFrame, parts: DataFrame, keys: list[str], id: str) -> DataFrame:
    """rows with _to, the part (of `dealt`) of their key that their id falls to."""
    return rows.join(parts, keys).withColumn("_to", F.col("_first") + F.pmod(F.xxhash64(id), F.col("_parts"))).drop("_first", "_parts")


def to_each_part(lists: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """lists (a row for each of the keys) with _to: a row for each part of their key, without the keys."""
    return lists.join(parts, keys).withColumn("_to", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_parts") - 1))).drop("_first", "_parts", *keys)


def beside(rows: DataFrame, lists: DataFrame, keys: list[str], id: str, counted: DataFrame | None = None) -> DataFrame:
    """rows joined to the one row that lists has of their keys (numbers), spread so that a key with many rows is no one task's work.

    A key's rows are dealt by their id over as many parts as `dealt` says, and its list goes to each part. Few and small rows that grow when
    the list is unfolded later stay spread: the parts aren't merged and nothing is broadcast. counted: cheaper rows with as many of each key.
    """
    parts = dealt(rows if counted is None else counted, keys)
    return to_parts(rows, parts, keys, id).repartition(tasks(rows.sparkSession), "_to").join(to_each_part(lists, parts, keys).hint("merge"), "_to").drop("_to")


def within(points: DataFrame, stores: DataFrame, km: float) -> DataFrame:
    """Pairs of a distinct point (lat, lon) and a store (store, s_lat, s_lon) at most km apart, with metres.

    A store stands in the nine cells around its own, so one equi-join on the cell finds all its neighbours. Cells are
    bands of latitude; within a band, a cell is as wide in longitude as its end nearer to a pole needs.
    """
    size = km / 110.0  # a degree of latitude has over 110 km
    cell = lambda c: F.floor(F.col(c) / size)
    top = (F.abs(F.col("cx") + 0.5) + 1.5) * size  # no latitude of a band and its neighbours lies nearer to a pole
    wide = F.when(top < 89.0, size / F.cos(F.radians(top))).otherwise(360.0)
    turns = F.greatest(F.floor(360.0 / wide), F.lit(1))
    across = lambda lon, by: F.pmod(F.floor((F.col(lon) + 180.0) / 360.0 * turns) + by, turns)  # noqa: E731  cells go around the world
    near = stores.withColumn("cx", F.explode(F.array(*[cell("s_lat") + n for n in (-1, 0, 1)])))
    near = near.withColumn("cy", F.explode(F.array_distinct(F.array(*[across("s_lon", n) for n in (-1, 0, 1)]))))
    pairs = points.select("lat", "lon").distinct().withColumn("cx", cell("lat")).withColumn("cy", across("lon", 0)).join(near, ["cx", "cy"])
    return pairs.withColumn("metres", metres(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon"))).where(F.col("metres") <= int(km * 1000)).select("lat", "lon", "store", "metres")


def nearest(points: DataFrame, stores: DataFrame, km: float, n: int) -> DataFrame:
    """The n nearest stores of each distinct point within km; the smaller store id wins a tie."""
    w = Window.partitionBy("lat", "lon").orderBy("metres", "store")
    return within(points, stores, km).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def around(who: DataFrame, stores: DataFrame, km: float, id: str) -> DataFrame:
    """id, store, metres: every store within km of each row of who (id, lat, lon); a place's stores are one list until the rows unfold it."""
    lists = within(who, stores, km).groupBy("lat", "lon").agg(F.collect_list(F.struct("store", "metres")).alias("near"))
    return beside(who.select(id, "lat", "lon"), lists, ["lat", "lon"], id).select(id, F.inline("near"))
