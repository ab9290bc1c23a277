"""Text search over an index: postings in blocks of falling impact, of which a query reads only those that can still matter.

A first look at the blocks of highest impact gives each query a score that its k best reach at least. A product that is to beat it
must have, for each of its words, an impact that does so together with the most that the query's other words can add. Blocks
below that bound hold nobody's posting that counts, so what is read gives the same k best as all postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trolley.functions.columns import jaccard_permille, trigrams
from trolley.operators.shared import written

#: Levels of impact that a word's postings are parted by, from its highest down.
LEVELS = 16


def bm25_index(products: DataFrame, k1: float = 1.2, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(postings: w, block, product, impact; blocks: w, block, n, high): a word counts by its rarity, a long text counts less.

    Blocks are levels of impact, 0 the highest, so that no word's postings need to be sorted in one task.
    """
    words = products.select("product", F.split("product", " ").alias("w"))
    size = words.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl"))
    each = words.select("product", F.size("w").alias("dl"), F.explode("w").alias("w"))
    df = each.select("w", "product").distinct().groupBy("w").agg(F.count("*").alias("df"))  # so that no impact is negative
    part = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1) * (k1 + 1) / (1 + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = each.join(df, "w").join(F.broadcast(size)).groupBy("w", "product").agg(F.sum(part).alias("impact"))  # size is one row
    top = scored.groupBy("w").agg(F.max("impact").alias("top"))
    level = F.least(F.floor((1 - F.col("impact") / F.col("top")) * LEVELS), F.lit(LEVELS - 1)).cast("int")
    postings = written(scored.join(top, "w").select("w", level.alias("block"), "product", "impact"), "postings")
    return postings, postings.groupBy("w", "block").agg(F.count("*").alias("n"), F.max("impact").alias("high"))


def _best(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("score"), "product")
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def _scored(asked: DataFrame, postings: DataFrame) -> DataFrame:
    """q, product, score (millionths) from the given blocks of words. asked: q, w, times, block."""
    return asked.join(postings, ["w", "block"]).groupBy("q", "product").agg(F.round(F.sum(F.col("times") * F.col("impact")) * 1e6).cast("long").alias("score"))


def bm25_topk(queries: DataFrame, index: tuple[DataFrame, DataFrame], k: int) -> tuple[DataFrame, DataFrame]:
    """(q, product, score, rank: the k best of each query; q, read, postings: how many of its words' postings were read)."""
    postings, blocks = index
    words = queries.select("q", F.explode(F.split("q", " ")).alias("w")).groupBy("q", "w").agg(F.count("*").alias("times"))
    asked = words.join(blocks, "w").withColumn("most", F.col("times") * F.max("high").over(Window.partitionBy("q", "w")))
    above = F.sum("n").over(Window.partitionBy("q", "w").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    first = asked.withColumn("above", F.coalesce(above, F.lit(0))).where(F.col("above") < k)  # at least k products of each word, if it has as many
    reach = _best(_scored(first.select("q", "w", "times", "block"), postings), k).groupBy("q").agg(F.min("score").alias("least"), F.max("rank").alias("seen"))
    total = words.join(blocks.groupBy("w").agg(F.max("high").alias("high")), "w").groupBy("q").agg(F.sum(F.col("times") * F.col("high")).alias("all"))
    held = asked.join(total, "q").join(reach, "q", "left")
    enough = F.when(F.col("seen") >= k, F.col("least")).otherwise(F.lit(-1))
    bound = (F.col("all") - F.col("most") + F.col("times") * F.col("high")) * 1e6 + 1  # scores are rounded
    wanted = held.withColumn("wanted", bound >= enough)
    found = _best(_scored(wanted.where("wanted").select("q", "w", "times", "block"), postings), k)
    read = wanted.groupBy("q").agg(F.sum(F.when(F.col("wanted"), F.col("n")).otherwise(0)).alias("read"), F.sum("n").alias("postings"))
    return found, read


def trigram_index(products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings: g, product, nb; grams: g, df)."""
    own = products.select("product", trigrams(F.col("product")).alias("gb"))
    postings = written(own.select(F.explode("gb").alias("g"), "product", F.size("gb").alias("nb")), "grams")
    return postings, postings.groupBy("g").agg(F.count("*").alias("df"))


def _verified(pairs: DataFrame) -> DataFrame:
    score = jaccard_permille(trigrams(F.col("q")), trigrams(F.col("product")))
    return pairs.distinct().select("q", "product", score.alias("score")).where("score >= 0")


def trigram_topk(queries: DataFrame, index: tuple[DataFrame, DataFrame], k: int) -> tuple[DataFrame, DataFrame]:
    """(q, product, score in thousandths, rank; q, read, postings), of products that share a trigram with the query.

    The rarest quarter of a query's trigrams gives a similarity that its k best reach at least. A product that reaches it shares at
    least that part of the query's trigrams, so one of the others but so many, and is of a size that allows it.
    """
    postings, grams = index
    own = queries.select("q", trigrams(F.col("q")).alias("ga"))
    order = Window.partitionBy("q").orderBy(F.coalesce("df", F.lit(0)), "g")
    each = own.select("q", F.size("ga").alias("na"), F.explode("ga").alias("g")).join(grams, "g", "left").withColumn("nth", F.row_number().over(order))
    first = each.where(F.col("nth") <= F.ceil(F.col("na") / 4)).join(postings, "g").select("q", "product")
    reach = _best(_verified(first), k).groupBy("q").agg(F.min("score").alias("least"), F.max("rank").alias("seen"))
    held = each.join(reach, "q", "left").withColumn("t", F.when(F.col("seen") >= k, F.col("least")).otherwise(F.lit(0)))
    prefix = F.col("na") - F.greatest(F.ceil(F.col("na") * F.col("t") / 1000), F.lit(1)) + 1
    wanted = held.withColumn("wanted", F.col("nth") <= prefix)
    fits: Column = (F.col("nb") * 1000 >= F.col("na") * F.col("t")) & (F.col("na") * 1000 >= F.col("nb") * F.col("t"))
    pairs = wanted.where("wanted").join(postings, "g").where(fits).select("q", "product")
    read = wanted.groupBy("q").agg(F.sum(F.when(F.col("wanted"), F.coalesce("df", F.lit(0))).otherwise(0)).alias("read"), F.sum(F.coalesce("df", F.lit(0))).alias("postings"))
    return _best(_verified(pairs), k), read
