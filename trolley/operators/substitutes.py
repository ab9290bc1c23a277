"""Cheapest substitutes over all items of a type, without pairs: items meet by what they must have in common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cheapest(items: DataFrame, key: str, price: str, fixed: list[str], soft: list[str], own: str | None = None) -> DataFrame:
    """key, open (the soft attributes left open, ascending), substitute, substitute_price: for each item and each choice of open attributes.

    A substitute agrees in all fixed attributes and in the soft ones that are not open; an unknown value agrees with nothing.
    It costs less than the item; of several the cheapest counts, then the smallest key. Items without one have no row for that
    choice. Each item stands under one key for every choice, 2^soft in all, so the work grows with the items and not with their
    pairs: a key's cheapest item is a minimum that is taken before the shuffle, and items are joined to one row a key. The unfolded
    items are looked through side by side: they are far more than their file says, and are never broadcast.
    own: a name under which the item's own price goes along.
    """
    soft = sorted(soft)
    choices, left = [], []
    for mask in range(1 << len(soft)):
        bound = [c for k, c in enumerate(soft) if not mask >> k & 1]
        known = F.lit(True)
        for c in [*fixed, *bound]:
            known &= F.col(c).isNotNull()
        values = [F.col(c).cast("string") for c in [*fixed, *bound]]
        left.append(F.array(*[F.lit(c) for k, c in enumerate(soft) if mask >> k & 1]).cast("array<string>"))
        choices.append(F.when(known, F.struct(F.lit(mask).alias("mask"), F.array(*values).cast("array<string>").alias("same"))))
    each = items.select(F.col(key).alias("_key"), F.col(price).alias("_price"), F.explode(F.array_compact(F.array(*choices))).alias("c")).select("_key", "_price", "c.mask", "c.same")
    least = each.groupBy("mask", "same").agg(F.min(F.struct("_price", "_key")).alias("least"))
    found = each.hint("merge").join(least, ["mask", "same"]).where(F.col("least._price") < F.col("_price"))
    more = [F.col("_price").alias(own)] if own else []
    return found.select(F.col("_key").alias(key), F.get(F.array(*left), F.col("mask")).alias("open"), F.col("least._key").alias("substitute"), F.col("least._price").alias("substitute_price"), *more)
