"""Splits over up to three stores, bundles across items, and the exact optimum of a basket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.operators import places, splits
from trolley.plans import tables as T
from trolley.plans.catalogue import _packs, variant_lists
from trolley.plans.registry import query
from trolley.plans.shopping import _asked

#: Hundredths that another product in place of the one asked for counts more, by the need's level. Fixed values.
PENALTY = {"any_brand": 100, "close": 300}

_SETS = """, sets AS MATERIALIZED (SELECT a."user", 1 AS k, a.store AS a, -1 AS b, -1 AS c, a.place AS i, a.place AS j, a.place AS l, a.travel AS travel FROM cands a
    UNION ALL SELECT a."user", 2, a.store, b.store, -1, a.place, b.place, b.place, a.travel + b.travel FROM cands a JOIN cands b ON a."user" = b."user" AND a.place < b.place
    UNION ALL SELECT a."user", 3, a.store, b.store, c.store, a.place, b.place, c.place, a.travel + b.travel + c.travel FROM cands a JOIN cands b ON a."user" = b."user" AND a.place < b.place JOIN cands c ON a."user" = c."user" AND b.place < c.place),
    best_of AS MATERIALIZED (SELECT s."user", h.basket, h.need, s.k, s.a, s.b, s.c, min(h.cost) AS cost FROM hits h JOIN sets s ON s."user" = h."user" AND h.place IN (s.i, s.j, s.l) GROUP BY ALL),
    of_set AS MATERIALIZED (SELECT basket, k, a, b, c, count(*) AS found, sum(cost) AS total FROM best_of GROUP BY ALL),
    sized AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY basket, k ORDER BY missing, total + travel + stop_cost, a, b, c) AS rn FROM (
        SELECT t.basket, t."user", s.k, s.a, s.b, s.c, t.n - coalesce(f.found, 0) AS missing, CAST(coalesce(f.total, 0) AS BIGINT) AS total, CAST(s.travel AS BIGINT) AS travel, CAST((s.k - 1) * stop_value AS BIGINT) AS stop_cost
        FROM asked t JOIN sets s USING ("user") JOIN shoppers USING ("user") LEFT JOIN of_set f ON f.basket = t.basket AND f.k = s.k AND f.a = s.a AND f.b = s.b AND f.c = s.c))"""
_SIZED = T.sql("", "cands", "hits", "asked", "shoppers").rstrip() + _SETS


def _sized(s, d) -> DataFrame:
    return splits.best_sets(_asked(s, d), T.hits(s, d), T.candidates(s, d), T.shoppers(s, d), most=3, by_size=True)


@query(_SIZED + " SELECT basket, k AS n_stores, a, b, c, missing, total, travel, stop_cost FROM sized WHERE rn = 1")
def best_sets_by_size(s, d):
    """The best single store, the best pair and the best three stores of each basket, with their trips."""
    return _sized(s, d).select("basket", "n_stores", "a", "b", "c", "missing", "total", "travel", "stop_cost")


@query(_SIZED + """, x AS (SELECT basket, "user", max(CASE WHEN k = 1 THEN {m: missing, o: total + travel + stop_cost, a: a, b: b, c: c} END) AS s1, max(CASE WHEN k = 2 THEN {m: missing, o: total + travel + stop_cost, a: a, b: b, c: c} END) AS s2, max(CASE WHEN k = 3 THEN {m: missing, o: total + travel + stop_cost, a: a, b: b, c: c} END) AS s3 FROM sized WHERE rn = 1 GROUP BY ALL),
    y AS (SELECT basket, s3, min_saving, "user" % 3 AS more, CASE WHEN "user" % 3 >= 1 AND s2 IS NOT NULL AND (s2.m < s1.m OR (s2.m = s1.m AND s2.o < s1.o AND s1.o - s2.o >= min_saving)) THEN s2 ELSE s1 END AS w FROM x JOIN shoppers USING ("user")),
    z AS (SELECT basket, CASE WHEN more >= 2 AND s3 IS NOT NULL AND (s3.m < w.m OR (s3.m = w.m AND s3.o < w.o AND w.o - s3.o >= min_saving)) THEN s3 ELSE w END AS w FROM y)
    SELECT basket, w.a AS a, w.b AS b, w.c AS c, w.m AS missing, w.o AS objective FROM z""")
def split_limits(s, d):
    """One to three stores, as many as the user takes; each further store must find more needs or save at least what the user asks for."""
    own = T.shoppers(s, d).select("user", "min_saving", F.pmod(F.col("user"), F.lit(3)).alias("more"))
    each = F.struct("missing", (F.col("total") + F.col("travel") + F.col("stop_cost")).alias("objective"), "a", "b", "c")
    rows = _sized(s, d).groupBy("basket", "user").agg(*[F.max(F.when(F.col("n_stores") == k, each)).alias(f"s{k}") for k in (1, 2, 3)]).join(own, "user")

    def better(x: str, w: str):
        saved = F.col(f"{w}.objective") - F.col(f"{x}.objective")
        more = (F.col(f"{x}.missing") < F.col(f"{w}.missing")) | ((F.col(f"{x}.missing") == F.col(f"{w}.missing")) & (saved > 0) & (saved >= F.col("min_saving")))
        return F.coalesce(more, F.lit(False))

    rows = rows.withColumn("w", F.when((F.col("more") >= 1) & better("s2", "s1"), F.col("s2")).otherwise(F.col("s1")))
    rows = rows.withColumn("w", F.when((F.col("more") >= 2) & better("s3", "w"), F.col("s3")).otherwise(F.col("w")))
    return rows.select("basket", "w.a", "w.b", "w.c", "w.missing", "w.objective")


def _terms(s, d, rows: DataFrame) -> DataFrame:
    """rows (user, item, store and others) with promos: the terms that hold for the item there and are open to the user."""
    clubs = T.shoppers(s, d).select("user", "club_a", "club_n")
    one = F.struct("promo_id", "kind", F.col("n").cast("int").alias("n"), F.col("t").cast("long").alias("t"), F.col("min_qty").cast("int").alias("min_qty"), F.col("max_qty").cast("int").alias("max_qty"))
    open_ = rows.select("user", "item", "store").distinct().join(T.offered_deals(s, d), ["item", "store"]).join(clubs, "user").where(T.eligible())
    found = open_.groupBy("user", "item", "store").agg(F.sort_array(F.collect_set(one)).alias("promos"))
    return rows.join(found, ["user", "item", "store"], "left")


def optimal_rows(s, d) -> DataFrame:
    """A row per basket with its needs, the options of each need at each candidate store, and the user's terms."""
    one = F.struct("promo_id", "kind", F.col("n").cast("int").alias("n"), F.col("t").cast("long").alias("t"), F.col("min_qty").cast("int").alias("min_qty"), F.col("max_qty").cast("int").alias("max_qty"), "club")
    deals = T.offered_deals(s, d).groupBy("item", "store").agg(F.collect_set(one).alias("deals"))
    option = lambda item, store, price, penalty, packs, deals: F.struct("need", item.alias("item"), store.alias("store"), price.alias("price"), penalty.cast("int").alias("penalty"), packs.alias("packs"), deals.alias("deals"))
    own = T.hits(s, d).select("basket", "need", "store", "price", "qty").join(deals.withColumnRenamed("item", "need"), ["need", "store"], "left")
    mine = own.select("basket", F.array(option(F.col("need"), F.col("store"), F.col("price"), F.lit(0), F.col("qty"), F.col("deals"))).alias("o"))
    penalty = F.when(F.col("level") == "close", PENALTY["close"]).otherwise(PENALTY["any_brand"])
    # of the variants without a deal at a store only the cheapest for the amount can be of use, whatever else is bought; those with one may share it
    packs = lambda x: _packs(F.col("whole"), x["pack"])
    cheapest = lambda x: F.array_min(F.transform(x["plain"], lambda y: F.struct((packs(y) * y["price"]).alias("cost"), y["item"].alias("item"), y["price"].alias("price"), packs(y).alias("packs"))))
    plain = F.transform(F.filter("v", lambda x: F.size(x["plain"]) > 0), lambda x: F.struct(x["store"].alias("store"), cheapest(x).alias("y")))
    plain = F.transform(plain, lambda x: option(x["y"]["item"], x["store"], x["y"]["price"], penalty, x["y"]["packs"], F.lit(None).cast(deals.schema["deals"].dataType)))
    dealt = F.flatten(F.transform("v", lambda x: F.transform(x["dealt"], lambda y: option(y["item"], x["store"], y["price"], penalty, packs(y), y["deals"]))))
    other = F.filter(F.concat(plain, dealt), lambda x: (x["item"] != F.col("need")) & x["packs"].isNotNull())
    # a need's options go to its basket as one list; places and clubs are the user's and are looked up in the basket's row
    options = mine.union(variant_lists(s, d, deals).select("basket", other.alias("o"))).repartition(places.tasks(s), "basket")
    listed = options.groupBy("basket").agg(F.flatten(F.collect_list("o")).alias("o"))
    needs = T.needs(s, d).groupBy("basket", "user").agg(F.collect_list(F.struct("need", "qty")).alias("needs"))
    terms = T.shoppers(s, d).select("user", "club_a", "club_n", F.col("stop_value").cast("long").alias("stop_value"), (1 + F.pmod(F.col("user"), F.lit(3))).cast("int").alias("max_stores"), F.col("min_saving").cast("long").alias("min_saving"))
    rows = needs.join(splits.store_rows(T.candidates(s, d)).join(terms, "user"), "user").join(listed, "basket", "left")
    at = lambda x: (F.array_position("stores", x["store"]) - 1).cast("int")
    options = F.transform("o", lambda x: F.struct(x["need"].alias("need"), x["item"].alias("item"), at(x).alias("place"), x["price"].alias("price"), x["penalty"].alias("penalty"), x["packs"].alias("packs"), F.filter(x["deals"], lambda p: T.opened(p["club"])).alias("promos")))
    return rows.select("basket", "needs", options.alias("options"), "stores", "travels", "stop_value", "max_stores", "min_saving")


@query(None)
def optimal_baskets(s, d):
    """The exact optimum of each basket over one to three stores: products by level, promotions across items, preferences, trips and stops."""
    return splits.optimal(optimal_rows(s, d))


def bundle_rows(s, d) -> DataFrame:
    """A row per basket and store at which a promotion holds for one of its needs: lines with quantity, price and terms."""
    rows = _terms(s, d, T.hits(s, d).select("user", "basket", F.col("need").alias("item"), "store", "qty", "price"))
    some = rows.where("promos IS NOT NULL").select("basket", "store").distinct()
    return rows.join(some, ["basket", "store"], "left_semi").groupBy("basket", "store").agg(F.sort_array(F.collect_list(F.struct("item", "qty", "price", "promos"))).alias("lines"))


@query(None)
def bundle_allocation(s, d):
    """Units dealt to overlapping promotions at each store, greedily and exactly: what the basket's needs there cost, and the bundles."""
    return splits.allocated(bundle_rows(s, d))
