"""Prices as change events: latest, as of a time, changes, validity, overlay of exceptions on a base, delta upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trolley.operators.shared import PART, ranged

#: Rows of one key that one task may hold as a window; keys of more are spread over ranges.
HOT = 1_000_000


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that has no ties but equal rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def parted(rows: DataFrame, keys: list[str], hot: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of keys with at most `hot` rows, the others or None): one count of the keys, which is summed before it is shuffled."""
    many = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(*keys)
    if not many.limit(1).count():
        return rows, None
    same = [rows[k].eqNullSafe(many[k]) for k in keys]
    return rows.join(many, same, "left_anti"), rows.join(many, same, "left_semi")


def running(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, kind: str = "last", down: bool = False) -> DataFrame:
    """rows with the last known (or the least) value of their key up to themselves and their peers in an order, for keys of any size.

    Ranges of (keys, order) are tasks of even size. Within a range a window gives the value so far; what the ranges before
    hold of the same key is one row a range and comes to it as a carry. Rows that agree in keys and order stay in one range.
    """
    by = [F.col(c).desc() if down else F.col(c).asc() for c in order]
    parts = ranged(rows, [*[F.col(k) for k in keys], *by])
    one = F.min if kind == "min" else lambda c: F.last(c, ignorenulls=True)
    within = Window.partitionBy(PART, *keys).orderBy(*by)
    local = one(value).over(within.rangeBetween(Window.unboundedPreceding, 0))
    place = F.struct(*order)
    whole = F.min(value) if kind == "min" else (F.min_by if down else F.max_by)(value, place)
    ends = parts.where(F.col(value).isNotNull()).groupBy(PART, *keys).agg(whole.alias("_end"))
    every = parts.groupBy(PART, *keys).agg(F.lit(1).alias("_there"))
    on = lambda a, b: [a[c].eqNullSafe(b[c]) for c in (PART, *keys)]
    across = every.join(ends, on(every, ends), "left").select(*[every[c] for c in (PART, *keys)], "_end")
    carry = across.withColumn("_carry", one("_end").over(Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))).where("_carry IS NOT NULL").drop("_end")
    seen = parts.withColumn("_local", local)
    both = seen.join(F.broadcast(carry), on(seen, carry), "left").select(*[seen[c] for c in seen.columns], "_carry")  # a carry is a key's second range or a later one: fewer than ranges
    known = F.least("_local", "_carry") if kind == "min" else F.coalesce("_local", "_carry")
    return both.withColumn(name, known).drop("_local", "_carry", PART)


def rolling_low(rows: DataFrame, key: str, at: str, value: str, name: str, days: int = 90, hot: int = HOT) -> DataFrame:
    """rows with the least value of their key in the last `days` days up to their own time (at: whole seconds, not null), peers included."""
    width = days * 86400
    few, many = parted(rows, [key], hot)
    out = few.withColumn(name, F.min(value).over(Window.partitionBy(key).orderBy(at).rangeBetween(-width, 0)))
    return out if many is None else out.unionByName(_rolling_low_of_many(many, key, at, value, name, days))


def _rolling_low_of_many(rows: DataFrame, key: str, at: str, value: str, name: str, days: int) -> DataFrame:
    """A window is the row's own day so far, the whole days before it, and the end of its first day: a running minimum, a minimum of
    daily minima (a row a day and key), and a running minimum from the day's end, for which rows stand in again a window earlier."""
    day = F.floor(F.col(at) / 86400)
    own = running(rows.withColumn("_day", day), [key, "_day"], [at], value, "_own", "min")
    daily = rows.groupBy(key, day.alias("_day")).agg(F.min(value).alias("_low"))
    steps = [F.struct((F.col("_day") + k).alias("_day"), F.col("_low")) for k in range(1, days)]
    whole = daily.select(key, F.inline(F.array(*steps))).groupBy(key, "_day").agg(F.min("_low").alias("_between"))
    held = own.join(whole, [key, "_day"], "left")
    probes = held.select(key, (F.col("_day") - days).alias("_day"), (F.col(at) - days * 86400).alias("_at"), F.lit(None).cast(dict(rows.dtypes)[value]).alias("_value"), F.lit(0).alias("_side"), F.struct(*held.columns).alias("_row"))
    events = rows.select(key, day.alias("_day"), F.col(at).alias("_at"), F.col(value).alias("_value"), F.lit(1).alias("_side"), F.lit(None).cast(probes.schema["_row"].dataType).alias("_row"))
    first = running(probes.unionByName(events), [key, "_day"], ["_at", "_side"], "_value", "_first", "min", down=True).where("_side = 0")
    low = F.least("_first", "_row._own", "_row._between")
    return first.select(*[F.col(f"_row.`{c}`").alias(c) for c in rows.columns], low.alias(name))


def asof(probes: DataFrame, events: DataFrame, keys: list[str], at: str, value: str, order: list[str], hot: int = HOT) -> DataFrame:
    """Each probe with the last value of its key at or before its time, or null: one shuffle of both sides, no range join.

    order: columns of events that break ties of time, ascending. Keys of over `hot` probes and events are spread over ranges.
    """
    ties = [F.lit(None).cast(dict(events.dtypes)[c]).alias(c) for c in order]
    rest = [c for c in probes.columns if c not in {*keys, at}]
    left = probes.select(*keys, at, F.lit(1).alias("_side"), F.struct(*rest).alias("_probe"), F.lit(None).cast(dict(events.dtypes)[value]).alias("_value"), *ties)
    right = events.select(*keys, at, F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_probe"].dataType).alias("_probe"), F.col(value).alias("_value"), *order)
    few, many = parted(left.unionByName(right), keys, hot)
    w = Window.partitionBy(*keys).orderBy(at, "_side", *order).rowsBetween(Window.unboundedPreceding, 0)
    both = few.withColumn("_known", F.last("_value", ignorenulls=True).over(w))
    if many is not None:
        both = both.unionByName(running(many, keys, [at, "_side", *order], "_value", "_known"))
    return both.where("_side = 1").select(*keys, at, "_probe.*", F.col("_known").alias(value))


def changes(events: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The events whose value differs from the one before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return events.withColumn("_before", F.lag(value).over(w)).where(~F.col(value).eqNullSafe(F.col("_before"))).drop("_before")


def change_feed(events: DataFrame, keys: list[str], at: str, order: list[str], value: str, silent_days: int = 90) -> DataFrame:
    """The events that the change stream emits: the first of a key, one behind a longer silence, and each that differs from the one before."""
    w = Window.partitionBy(*keys).orderBy(at, *order)
    silent = F.col(at) > F.lag(at).over(w) + F.expr(f"INTERVAL {silent_days} DAY")
    return events.where(F.col(value).isNotNull()).withColumn("_new", F.coalesce(silent, F.lit(True)) | ~F.col(value).eqNullSafe(F.lag(value).over(w))).where("_new").drop("_new")


def alert_feed(events: DataFrame, keys: list[str], at: str, order: list[str], value: str, below: Column, rearm: Column, silent_days: int = 90) -> DataFrame:
    """The events that the alert stream emits: the first below the threshold since the value reached `rearm` or the key was silent for longer.

    What arms is counted up to each event; of the events below of one count the first is an alert.
    """
    w = Window.partitionBy(*keys).orderBy(at, *order)
    silent = F.coalesce(F.col(at) > F.lag(at).over(w) + F.expr(f"INTERVAL {silent_days} DAY"), F.lit(True))
    starts = (silent.cast("int") + (F.col(value) >= rearm).cast("int")).alias("_starts")
    rows = events.where(F.col(value).isNotNull()).select("*", starts).withColumn("_armed", F.sum("_starts").over(w))
    first = F.row_number().over(Window.partitionBy(*keys, "_armed").orderBy(at, *order))
    return rows.where(F.col(value) < below).withColumn("_nth", first).where("_nth = 1").drop("_starts", "_armed", "_nth")


def validity(events: DataFrame, keys: list[str], order: list[str], at: str) -> DataFrame:
    """valid_to: the time of the key's next event, null for the last."""
    return events.withColumn("valid_to", F.lead(at).over(Window.partitionBy(*keys).orderBy(*order)))


def overlay(base: DataFrame, exceptions: DataFrame, base_key: list[str], keys: list[str], value: str) -> DataFrame:
    """Base rows under the exceptions of the finer keys: value and its source."""
    joined = base.withColumnRenamed(value, "_base").join(exceptions.withColumnRenamed(value, "_own"), base_key, "left")
    return joined.select(*keys, F.coalesce("_own", "_base").alias(value), F.when(F.col("_own").isNull(), "base").otherwise("exception").alias("source"))


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """base with delta applied: of rows with equal keys the first in order stays."""
    return latest(base.unionByName(delta), keys, order)


def write_monthly(events: DataFrame, path: str, at: str = "valid_from", files: int = 8) -> None:
    """Change events in monthly partitions, a month in up to `files` tasks and files; only the months in events are rewritten."""
    salt = F.pmod(F.xxhash64(*[c for c, t in events.dtypes if not t.startswith("map")]), F.lit(files))
    monthly = events.withColumn("month", F.date_format(at, "yyyy-MM")).withColumn("_salt", salt)
    monthly.repartition("month", "_salt").drop("_salt").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
