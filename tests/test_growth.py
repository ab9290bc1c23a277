"""Results and the number of rows between steps where a few places, chains or items are shared by many rows."""

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from trolley.operators import baskets, intervals, places, shared
from trolley.plans import catalogue, nightly, optimum, shopping
from trolley.plans import tables as T

DATA = "/root/testdata/sf0.01"


def test_users_of_one_place_are_dealt_over_tasks(spark):
    who = spark.range(6000).select(F.col("id").alias("user"), (31.0 + F.col("id") % 2 / 100).alias("lat"), (34.5 + F.col("id") % 1).alias("lon")).coalesce(1)
    stores = spark.range(40).select(F.col("id").alias("store"), (31.0 + F.col("id") / 100).alias("s_lat"), F.lit(34.5).alias("s_lon"))
    got = places.around(who, stores, 15.0, "user")
    plain = who.join(places.within(who, stores, 15.0), ["lat", "lon"]).select("user", "store", "metres")
    assert plain.count() == got.count() > 6000 and got.exceptAll(plain).count() == 0
    tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 2 and max(tasks) < sum(tasks) * 0.7


def test_ranked_stores_equal_a_plain_ranking(spark):
    asked = spark.range(60).select(F.col("id").alias("basket"), F.col("id").alias("user"), (F.col("id") % 3 + 2).alias("n"), (F.col("id") % 2).alias("lat"), (-(F.col("id") % 2)).alias("lon"))
    near = spark.range(41).select((F.col("id") * 7 % 41).alias("store"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("lat")).withColumn("lon", -F.col("lat")).where("store % 5 > 0 OR lat = 0")
    some = [(b, s, c, c % 2 == 0) for b in range(58) for s, c in ((7 * b % 41, 5), (0, 3), (40, 3), (b % 41, b % 4), (7 * b % 41, 1)) if b % 2 == 0 or s % 5]
    hits = spark.createDataFrame(some, "basket long, store long, cost long, promo boolean")
    found = hits.groupBy("basket", "store").agg(F.count("*").alias("found"), F.count_if("promo").alias("promos"), F.sum("cost").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    plain = asked.join(near, ["lat", "lon"]).join(found, ["basket", "store"], "left").select("basket", "store", zero("found"), (F.col("n") - F.coalesce("found", F.lit(0))).alias("missing"), zero("promos"), zero("total"))
    plain = plain.withColumn("place", F.row_number().over(Window.partitionBy("basket").orderBy("missing", "total", "store")).cast("long"))
    got = baskets.ranked(asked, near, hits, ["lat", "lon"])
    assert got.columns == plain.columns and sorted(got.collect()) == sorted(plain.collect())


def test_needs_and_deals_meet_before_stores_are_unfolded(spark):
    """What is written between the steps has a row for a store only where it has the item and lies in reach."""
    deals, offers = T.deals(spark, DATA), T.offers(spark, DATA)
    own = T.offered_deals(spark, DATA)
    known = deals.join(offers, ["item", "store"], "left_semi").select(*own.columns)
    assert own.count() == known.count() and own.exceptAll(known).count() == 0
    assert own.count() * 2 < deals.count()
    plan = shopping.basket_compare(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan  # stores without any of the needs aren't sorted by basket


def test_chain_wide_promotions_are_unfolded_behind_the_last_group(spark):
    got = shopping.promo_interval_join(spark, DATA)
    assert got.groupBy("basket", "item", "store").count().where("count > 1").count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("Generate explode(stores")]
    assert "Aggregate" not in top and got.where("chain_wide > 0").count() > 0


def test_candidates_are_made_within_a_users_row(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(nightly, "store", lambda df, name: seen.append(df) or shared.store(df, name))
    monkeypatch.setattr(nightly, "_WRITTEN", {})
    T.candidates(spark, DATA)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in plan and not {"Window", "Aggregate"} & set(plan[: plan.index("posexplode")].replace("+-", " ").split())


def test_variants_are_unfolded_behind_the_last_join(spark):
    """A need meets its place's list of a product and not a row for each candidate store; the same stores are found."""
    plan = catalogue._other_lists(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(both" not in plan  # no candidate row for each need
    shut = T.reached(spark, DATA).select("user", F.explode("near").alias("store"))
    known = T.candidates(spark, DATA).select("user", "store")
    assert shut.count() == known.count() and shut.exceptAll(known).count() == 0
    needs = catalogue.leveled(spark, DATA).where("level <> 'exact'").count()
    lists = catalogue._other_lists(spark, DATA)
    assert lists.count() <= 2 * needs and lists.select(F.explode("v")).count() > 4 * needs


def test_effective_prices_group_offers_before_quantities(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(nightly, "store", lambda df, name: seen.append((name, df)) or shared.store(df, name))
    monkeypatch.setattr(nightly, "_WRITTEN", {})
    shopping.effective_prices(spark, DATA)
    plan = next(df for name, df in seen if name == "effective_prices")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and not any(re.search(r"(?<!_)qty#", line) for line in plan.split("\n") if "Aggregate" in line)


def test_options_of_a_basket_go_there_once(spark):
    plan = optimum.optimal_rows(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[user#\w+, item#\w+, store#", plan)  # promotions are looked up in the basket's row
    row = optimum.optimal_rows(spark, DATA).where("size(options) > 0").first()
    assert all(row["stores"][o["place"]] is not None for o in row["options"])


def _executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _stored(monkeypatch):
    seen = {}
    monkeypatch.setattr(nightly, "store", lambda df, name: seen.update({name: df}) or shared.store(df, name))
    monkeypatch.setattr(nightly, "_WRITTEN", {})
    return seen


def test_baskets_are_weighed_once_for_their_saving_share(spark):
    plan = shopping.saving_share(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert plan.count("MapInArrow") == 1 and "bound" in below  # only baskets that have a bound


def test_lines_go_to_their_basket_once(spark, monkeypatch):
    seen, before = _stored(monkeypatch), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        T.needs(spark, DATA)
        assert _executed(seen["needs"]).count("Exchange hashpartitioning") == 2  # lines and orders
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_needs_meet_bundles_before_stores(spark, monkeypatch):
    seen = _stored(monkeypatch)
    assert shopping.cross_item_bundles(spark, DATA).count() > 0 and "hits" not in seen and "offered_deals" in seen


def test_choices_meet_their_users_no_more(spark):
    for query in (shopping.net_saving, shopping.store_limits):
        plan = query(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan[: plan.index("MapInArrow")]


def test_items_are_dealt_before_their_choices_are_unfolded(spark, monkeypatch):
    plain = {n: sorted(map(str, getattr(catalogue, n)(spark, DATA).collect())) for n in ("allowed_substitutes", "preference_filter", "hard_rules")}
    monkeypatch.setattr(catalogue, "SPREAD", 100)
    assert catalogue.labels(spark, DATA).rdd.getNumPartitions() == 20
    for name, rows in plain.items():
        assert rows and sorted(map(str, getattr(catalogue, name)(spark, DATA).collect())) == rows
    assert "BroadcastHashJoin" not in _executed(catalogue.allowed_substitutes(spark, DATA))


def test_needs_are_counted_before_they_meet_labels(spark):
    got = catalogue.preference_filter(spark, DATA)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "BroadcastHashJoin" not in _executed(got) and "count(1)" in plan[plan.index("Join") :]


def test_hits_go_to_their_basket_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for query in (shopping.full_coverage_stores, shopping.estimate_band, shopping.basket_compare):
        query(spark, DATA)  # writes the tables that it reads
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = _executed(query(spark, DATA))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert not re.search(r"Exchange hashpartitioning\((basket#\w+, store#|lat#\w+, lon#\w+, store#)", plan)
        if query is not shopping.basket_compare:
            assert re.findall(r"Exchange hashpartitioning\((\w+)#", plan[: plan.index("Join")]) == ["basket"]


def test_lists_go_to_a_bounded_number_of_parts(spark):
    rows = spark.range(400_000).select((F.col("id") % 100).alias("a"), F.col("id").alias("user"))
    got = places.dealt(rows, ["a"])
    n = places.tasks(spark)
    total = got.agg(F.sum("_parts")).first()[0]
    assert n < total <= places.SHARES * n + 100 < 400  # and not one for each TOGETHER rows
    numbers = got.select(F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_parts") - 1)).alias("x"))
    assert numbers.distinct().count() == total


def test_promotions_stand_in_few_bins(spark, monkeypatch):
    seen = []
    join = intervals.join
    monkeypatch.setattr(intervals, "join", lambda points, spans, keys, at, start, end, width: seen.append((spans, start, end, width)) or join(points, spans, keys, at, start, end, width))
    shopping.promo_interval_join(spark, DATA)
    spans, start, end, width = seen[0]
    bins = F.floor((F.col(end) - 1) / width) - F.floor(F.col(start) / width) + 1
    assert spans.agg(F.avg(bins)).first()[0] < 2


def test_a_needs_picks_go_to_its_basket_as_numbers(spark):
    df = catalogue.basket_variants(spark, DATA)
    node, todo, found = None, [df._jdf.queryExecution().optimizedPlan()], []
    while todo:
        node = todo.pop()
        if node.nodeName() == "RepartitionByExpression":
            found.append([node.output().apply(i).dataType().simpleString() for i in range(node.output().size())])
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert ["bigint", "array<bigint>"] in found  # and not a list for each of the columns
    known = catalogue.variants_by_level(spark, DATA).groupBy("basket", "store").agg(F.count("*").alias("found"), F.sum("cost").alias("total"))
    assert df.where("found > 0").select("basket", "store", "found", "total").exceptAll(known).count() == 0 and known.count() == df.where("found > 0").count()
