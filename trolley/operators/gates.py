"""Quality gates over whole files: accepted or quarantined with reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def file_stats(rows: DataFrame, files: list[str]) -> DataFrame:
    """Items, zero prices and jumps over three times the previous price, by file. rows: file keys, price, before."""
    return rows.groupBy(*files).agg(F.count("*").alias("items"), F.count_if(F.col("price") <= 0).alias("zero"), F.count_if(F.col("price") > 3 * F.col("before")).alias("jumps"))


def verdicts(stats: DataFrame, feed: list[str], at: str, drop_percent: int = 30, stale_days: int = 3, late: str = "arrived") -> DataFrame:
    """stats with reasons (zero, jump, drop, stale): empty means accepted. The previous file of the same feed is the measure of a drop."""
    before = F.lag("items").over(Window.partitionBy(*feed).orderBy(at))
    reasons = F.array_compact(F.array(F.when(F.col("zero") > 0, "zero"), F.when(F.col("jumps") > 0, "jump"), F.when(100 * F.col("items") < (100 - drop_percent) * before, "drop"), F.when(F.datediff(late, at) > stale_days, "stale")))
    return stats.withColumn("reasons", reasons)


def split(rows: DataFrame, judged: DataFrame, files: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): a file passes or fails as a whole."""
    bad = judged.where(F.size("reasons") > 0).select(*files, "reasons")
    return rows.join(bad, files, "left_anti"), rows.join(bad, files)


def pending(files: DataFrame, log: DataFrame) -> DataFrame:
    """Files whose content was never loaded, one per content (that of the smallest chain, store and time); a delta is loadable only after a full file of its feed.

    The full file may have been loaded before or come with the delta: it is looked for in files and log (sha256,
    chain_id, store_code, file_type, file_ts) together.
    """
    feed = ["chain_id", "store_code"]
    order = [*feed, "file_ts", "file_type"]
    first = F.min(F.struct(*order, *[c for c in files.columns if c not in {*order, "sha256"}])).alias("_first")
    fresh = files.join(log.select("sha256"), "sha256", "left_anti").groupBy("sha256").agg(first).select("sha256", "_first.*").select(*files.columns)
    fulls = files.select(*feed, "file_type", "file_ts").unionByName(log.select(*feed, "file_type", "file_ts")).where("file_type = 'full'")
    first = fulls.groupBy(*feed).agg(F.min("file_ts").alias("_full"))
    loadable = (F.col("file_type") == "full") | F.coalesce(F.col("_full") <= F.col("file_ts"), F.lit(False))
    return fresh.join(first, feed, "left").withColumn("loadable", loadable).drop("_full")
