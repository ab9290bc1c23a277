"""Matching and search: blocked nearest vectors, trigram candidates, rank fusion, hard rules, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trolley.functions.columns import jaccard_permille, trigrams
from trolley.operators import vectors


def vector_topk(items: DataFrame, key: str, block: str, vector: str, k: int, queries: DataFrame | None = None) -> DataFrame:
    """Each query's k best others of its block by dot product (in millionths, so that ties are exact); all items are queries by default.

    Products are made by tiles of a block (`vectors.exhaustive`); all pairs of a block are looked at, and only k rows a query and tile go on.
    """
    return vectors.exhaustive(items, items if queries is None else queries, key, vector, k, block)


def trigram_pairs(names: DataFrame, least: int) -> DataFrame:
    """Unordered pairs of distinct names with a trigram similarity of `least` thousandths or more.

    Trigrams are ordered by rarity; two similar names share one of the first |x| - ceil(least |x|) + 1 of each, so only
    these prefixes are joined, as digests of names, and the trigrams are compared once a pair.
    """
    named = names.select("name").distinct().withColumn("grams", trigrams(F.col("name"))).withColumn("id", F.xxhash64("name"))
    each = named.select("id", F.size("grams").alias("n"), F.explode("grams").alias("g"))
    rare = each.join(each.groupBy("g").agg(F.count("*").alias("df")), "g")
    ordered = rare.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("o"))
    prefix = ordered.select("id", "n", F.explode(F.slice("o", F.lit(1), F.col("n") - F.ceil(F.col("n") * least / 1000).cast("int") + 1)).alias("x")).select("id", "n", F.col("x.g").alias("g"))
    a, b = (prefix.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), "g") for x in "ab")
    fits = (F.col("na") * 1000 >= F.col("nb") * least) & (F.col("nb") * 1000 >= F.col("na") * least)
    pairs = a.join(b, "g").where(F.col("a") < F.col("b")).where(fits).select("a", "b").distinct()
    x, y = (named.select(F.col("id").alias(k), F.col("name").alias(f"name_{k}"), F.col("grams").alias(f"g{k}")) for k in "ab")
    found = pairs.join(x, "a").join(y, "b").withColumn("similarity", jaccard_permille(F.col("ga"), F.col("gb"))).where(F.col("similarity") >= least)
    return found.select(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b"), "similarity")


def best(scores: DataFrame, query: str, key: str, k: int, keep: list[str] | None = None) -> DataFrame:
    """query, key, rank: the k best of each query by score, ties by key."""
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key)))
    return ranked.where(F.col("rank") <= k).select(query, key, *(keep or []), F.col("rank").cast("long").alias("rank"))


def letters(text: Column) -> Column:
    """How often each letter occurs: a dense vector that stands in for a model's."""
    return F.transform(F.sequence(F.lit(97), F.lit(122)), lambda c: F.length(text) - F.length(F.replace(text, F.char(c), F.lit(""))))


def fuse(lists: list[DataFrame], key: list[str], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (key, rank): the sum of 10^9 div (k + rank), whole so that it is exact."""
    both = lists[0]
    for other in lists[1:]:
        both = both.unionByName(other)
    return both.groupBy(*key).agg(F.sum(F.floor(F.lit(1_000_000_000) / (F.col("rank") + k)).cast("long")).alias("score"))


def level(same_barcode: Column, same_type: Column, a: Column, b: Column) -> Column:
    """exact, any_brand or substitute: a critical attribute that differs or is null rules out any_brand."""
    return F.when(same_barcode, "exact").when(same_type & F.coalesce(a == b, F.lit(False)), "any_brand").when(same_type, "substitute")


def precision_recall(rows: DataFrame, by: list[str], predicted: str, actual: str) -> DataFrame:
    hit = lambda p, a: F.count_if((F.col(predicted) == p) & (F.col(actual) == a))
    return rows.groupBy(*by).agg(hit(1, 1).alias("tp"), hit(1, 0).alias("fp"), hit(0, 1).alias("fn"), hit(0, 0).alias("tn"))


def resolved(sources: list[DataFrame], key: str) -> DataFrame:
    """One row a key of tables that are given in the order of their authority; within one, the most confident."""
    both = sources[0].withColumn("_rank", F.lit(0))
    for n, rows in enumerate(sources[1:], 1):
        both = both.unionByName(rows.withColumn("_rank", F.lit(n)))
    first = Window.partitionBy(key).orderBy("_rank", F.desc("confidence"), "canonical")
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_rank")
