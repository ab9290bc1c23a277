"""Queries of the retail operators over whole tables, each with SQL that gives the same rows on another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trolley.functions import columns as C
from trolley.operators import gates, matching, places, postings, prices
from trolley.plans import tables as T
from trolley.plans.registry import QUERIES, SQL, query
from trolley.plans.tables import sql, table

__all__ = ["QUERIES", "SQL"]

AT = "1996-06-30"
RADIUS = T.RADIUS


def _latest(s: SparkSession, d: str) -> DataFrame:
    return prices.latest(T.observations(s, d), ["item", "store"], T.latest_first())


def _offers(s: SparkSession, d: str) -> DataFrame:
    return _latest(s, d).select("item", "store", "price")


# ---- places


@query('SELECT "user" AS user_id, store, metres FROM near JOIN users USING (lat, lon)', "near", "users")
def stores_in_radius(s, d):
    return places.around(T.users(s, d), T.stores(s, d), RADIUS, "user").withColumnRenamed("user", "user_id")


@query('SELECT "user" AS user_id, store, metres, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY metres, store) AS rn FROM near) JOIN users USING (lat, lon) WHERE rn <= 10', "near", "users")
def nearest_n(s, d):
    return T.users(s, d).join(places.nearest(T.users(s, d), T.stores(s, d), RADIUS, T.NEAREST), ["lat", "lon"]).select(F.col("user").alias("user_id"), "store", "metres", F.col("place").cast("long").alias("place"))


# ---- price layer


@query("SELECT item, store, valid_from, price FROM latest", "latest")
def latest_price(s, d):
    return _latest(s, d).select("item", "store", "valid_from", "price")


@query("""SELECT item, store, order_id AS basket, p.price FROM (SELECT l_partkey AS item, l_suppkey AS store, o_orderkey AS order_id, o_orderdate AS at, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey) q
    LEFT JOIN LATERAL (SELECT price FROM obs WHERE obs.item = q.item AND obs.store = q.store AND obs.valid_from <= q.at ORDER BY valid_from DESC, obs.order_id DESC, obs.line DESC, price DESC, qty DESC LIMIT 1) p ON true""", "obs")
def price_asof(s, d):
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("at"))
    seen = T.observations(s, d)
    probes = seen.select("item", "store", "order_id").join(orders, "order_id").select("item", "store", F.col("at").alias("valid_from"), F.col("order_id").alias("basket"))
    return prices.asof(probes, seen, ["item", "store"], "valid_from", "price", ["order_id", "line", "qty"]).select("item", "store", "basket", "price")


@query("""SELECT item, store, valid_from, price FROM (SELECT *, row_number() OVER w AS rn, lag(price) OVER w AS before FROM obs WINDOW w AS (PARTITION BY item, store ORDER BY valid_from, order_id, line, price, qty))
    WHERE rn = 1 OR price IS DISTINCT FROM before""", "obs")
def price_changes(s, d):
    return prices.changes(T.observations(s, d), ["item", "store"], T.EVENT_ORDER, "price").select("item", "store", "valid_from", "price")


@query("SELECT item, store, valid_from, price, lead(valid_from) OVER (PARTITION BY item, store ORDER BY valid_from, order_id, line, price, qty) AS valid_to FROM obs", "obs")
def price_validity(s, d):
    return prices.validity(T.observations(s, d), ["item", "store"], T.EVENT_ORDER, "valid_from").select("item", "store", "valid_from", "price", "valid_to")


@query("SELECT item, store, coalesce(l.price, i.base) AS price, CASE WHEN l.price IS NULL THEN 'base' ELSE 'exception' END AS source FROM items i LEFT JOIN latest l USING (item)", "items", "latest")
def base_exception(s, d):
    return prices.overlay(T.items(s, d).select("item", F.col("base").alias("price")), _offers(s, d), ["item"], ["item", "store"], "price")


@query("""SELECT item, store, price FROM (SELECT *, row_number() OVER (PARTITION BY item, store ORDER BY valid_from DESC, order_id DESC, line DESC, price, qty) AS rn FROM obs) WHERE rn = 1""", "obs")
def latest_upsert(s, d):
    seen = T.observations(s, d)
    full, delta = seen.where(f"valid_from < '{AT}'"), seen.where(f"valid_from >= '{AT}'")
    keys = ["item", "store"]
    return prices.upsert(prices.latest(full, keys, T.latest_first()), delta, keys, T.latest_first()).select("item", "store", "price")


@query("SELECT item, store, valid_from, price * CASE WHEN size > 0 THEN 100000 END // size AS unit_price FROM obs JOIN items USING (item)", "obs", "items")
def unit_price(s, d):
    return T.observations(s, d).join(T.items(s, d).select("item", "size"), "item").select("item", "store", "valid_from", C.unit_price(F.col("price"), F.col("size"), F.lit("g")).alias("unit_price"))


@query("SELECT p_partkey AS item, 6 AS packs, CAST(p_size * 6000 AS BIGINT) AS total, 'ml' AS base_unit FROM part")
def size_parse(s, d):
    size = C.parse_size(F.concat("p_name", F.lit(" 6*"), F.col("p_size").cast("string"), F.lit(" L")))
    return table(s, d, "part").select(F.col("p_partkey").alias("item"), size.alias("z")).select("item", "z.packs", "z.total", "z.base_unit")


# ---- promotions

_COST = """CASE WHEN club = 'A' THEN least((qty // 3) * (2 * price) + (qty % 3) * price, qty * price) WHEN club = 'N' THEN least((qty - (qty // 2) * 1) * price, qty * price) ELSE least(qty * price * (100 - pct) // 100, qty * price) END"""


def _cost(q):
    kind = F.when(F.col("club") == "A", "n_for_t").when(F.col("club") == "N", "x_plus_y").otherwise("percent_off")
    return C.promo_cost(q, F.col("price"), kind, F.when(F.col("club") == "A", 3).when(F.col("club") == "N", 1).otherwise(F.col("pct")), F.when(F.col("club") == "A", 2 * F.col("price")).otherwise(1))


@query(f"SELECT order_id, line, item, store, qty * price AS shelf, {_COST} AS cost FROM obs", "obs")
def promo_cost(s, d):
    return T.observations(s, d).select("order_id", "line", "item", "store", (F.col("qty") * F.col("price")).alias("shelf"), _cost(F.col("qty")).alias("cost"))


# ---- levels of flexibility


def _cheapest(s, d, key: list[str]):
    offers = _offers(s, d).join(T.items(s, d), "item")
    best = offers.groupBy(*key, "store").agg(F.min(F.struct("price", "item")).alias("best"))
    return best.select(*key, "store", "best.price", F.col("best.item").alias("best_item"))


_CHEAPEST = "SELECT {0}, store, min(price) AS price, CAST(min(price * 100000000 + item) % 100000000 AS BIGINT) AS best_item FROM latest JOIN items USING (item) GROUP BY {0}, store"


@query(_CHEAPEST.format("item"), "latest", "items")
def cheapest_variant_exact(s, d):
    return _cheapest(s, d, ["item"])


@query(_CHEAPEST.format("kind, trait"), "latest", "items")
def cheapest_variant_brand(s, d):
    return _cheapest(s, d, ["kind", "trait"])


@query(_CHEAPEST.format("kind"), "latest", "items")
def cheapest_variant_close(s, d):
    return _cheapest(s, d, ["kind"])


@query("""SELECT a.kind, CASE WHEN a.trait = b.trait THEN 'any_brand' ELSE 'substitute' END AS level, CAST(sum(a.n * b.n) AS BIGINT) AS pairs
    FROM (SELECT kind, trait, brand, count(*) AS n FROM items GROUP BY ALL) a JOIN (SELECT kind, trait, brand, count(*) AS n FROM items GROUP BY ALL) b ON a.kind = b.kind AND a.brand < b.brand GROUP BY ALL""", "items")
def hard_rule_filter(s, d):
    kinds = T.items(s, d).groupBy("kind", "trait", "brand").agg(F.count("*").alias("n"))
    a, b = kinds.alias("a"), kinds.alias("b")
    level = matching.level(F.lit(False), F.lit(True), F.col("a.trait"), F.col("b.trait"))
    return a.join(b, F.col("a.kind") == F.col("b.kind")).where("a.brand < b.brand").groupBy(F.col("a.kind").alias("kind"), level.alias("level")).agg(F.sum(F.col("a.n") * F.col("b.n")).alias("pairs"))


# ---- matching and search


@query("""SELECT a, b, score, place FROM (SELECT a.vec_id AS a, b.vec_id AS b, CAST(round(list_dot_product(a.embedding::double[], b.embedding::double[]) * 1000000) AS BIGINT) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY CAST(round(list_dot_product(a.embedding::double[], b.embedding::double[]) * 1000000) AS BIGINT) DESC, b.vec_id) AS place
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE place <= 5""")
def vector_topk(s, d):
    return matching.vector_topk(table(s, d, "embeddings"), "vec_id", "label", "embedding", 5).withColumn("place", F.col("place").cast("long"))


_GRAMS = "list_distinct(list_transform(range(1, len({0}) - 1), lambda i: lower({0}[i:i + 2])))"


@query(f"""WITH n AS (SELECT DISTINCT p_name AS name, {_GRAMS.format("p_name")} AS g FROM part)
    SELECT x.name AS a, y.name AS b, CAST(1000 * len(list_intersect(x.g, y.g)) // len(list_distinct(list_concat(x.g, y.g))) AS BIGINT) AS similarity FROM n x JOIN n y ON x.name < y.name
    WHERE 1000 * len(list_intersect(x.g, y.g)) // len(list_distinct(list_concat(x.g, y.g))) >= 300""")
def trigram_topk(s, d):
    return matching.trigram_pairs(table(s, d, "part").select(F.col("p_name").alias("name")), 300)


_CONFIDENCE = "(1000 - 10 * (item * 37 % 60))"


@query(f"""SELECT item, confidence, CASE WHEN confidence >= 900 THEN 'accept' WHEN confidence >= 600 THEN 'review' ELSE 'reject' END AS band, sold FROM (
    SELECT item, {_CONFIDENCE} AS confidence, CAST(sum(qty) AS BIGINT) AS sold, row_number() OVER (ORDER BY sum(qty) DESC, item) AS rn FROM obs GROUP BY item) WHERE (confidence >= 600 AND confidence < 900) OR rn <= 300""", "obs")
def review_queue(s, d):
    sold = T.observations(s, d).groupBy("item").agg(F.sum("qty").alias("sold")).withColumn("confidence", 1000 - 10 * F.pmod(F.col("item") * 37, F.lit(60)))
    rows = sold.select("item", "confidence", C.band(F.col("confidence")).alias("band"), "sold")
    top = rows.orderBy(F.desc("sold"), "item").limit(300)
    return rows.where("band = 'review'").union(top).distinct()


# ---- gates and operations

_FILES = """files AS (SELECT store, CAST(date_trunc('month', valid_from) AS DATE) AS file_date, count(*) AS items, count_if(price <= 0) AS zero, count_if(before IS NOT NULL AND price > 3 * before) AS jumps FROM (
    SELECT *, lag(price) OVER (PARTITION BY item, store ORDER BY valid_from, order_id, line, price, qty) AS before FROM obs) GROUP BY ALL)"""


def _stats(s, d):
    w = Window.partitionBy("item", "store").orderBy(*T.EVENT_ORDER)
    rows = T.observations(s, d).withColumn("before", F.lag("price").over(w)).withColumn("file_date", F.trunc("valid_from", "month"))
    return gates.file_stats(rows, ["store", "file_date"])


@query(sql("", "obs").rstrip() + ", " + _FILES + " SELECT store, file_date::VARCHAR AS file_date, items, zero, jumps FROM files")
def gate_counts(s, d):
    return _stats(s, d).withColumn("file_date", F.col("file_date").cast("string"))


@query(sql("", "obs").rstrip() + ", " + _FILES + """ SELECT store, file_date::VARCHAR AS file_date, concat_ws(',', CASE WHEN zero > 0 THEN 'zero' END, CASE WHEN jumps > 0 THEN 'jump' END, CASE WHEN 100 * items < 70 * before THEN 'drop' END, CASE WHEN date_diff('day', file_date, arrived) > 3 THEN 'stale' END) AS reasons
    FROM (SELECT *, lag(items) OVER (PARTITION BY store ORDER BY file_date) AS before, file_date + CAST(store % 6 AS INTEGER) AS arrived FROM files)""")
def gate_verdicts(s, d):
    stats = _stats(s, d).withColumn("arrived", F.date_add("file_date", F.pmod("store", F.lit(6)).cast("int")))
    return gates.verdicts(stats, ["store"], "file_date").select("store", F.col("file_date").cast("string").alias("file_date"), F.concat_ws(",", "reasons").alias("reasons"))


@query("""WITH f AS (SELECT md5(event_type || user_id || props) AS sha256, CAST(user_id % 10 AS VARCHAR) AS chain_id, CAST(user_id AS VARCHAR) AS store_code, CASE WHEN event_type = 'view' THEN 'full' ELSE 'delta' END AS file_type, ts FROM events),
    u AS (SELECT sha256, min(ts) AS ts FROM f GROUP BY sha256) SELECT sha256 FROM u WHERE ts >= TIMESTAMP '2024-01-02'""")
def pending_files_anti(s, d):
    seen = table(s, d, "events").select(F.md5(F.concat("event_type", F.col("user_id").cast("string"), "props").cast("binary")).alias("sha256"), "ts")
    log = seen.where("ts < timestamp_ntz '2024-01-02'").select("sha256").distinct()
    return seen.join(log, "sha256", "left_anti").select("sha256").distinct()


@query("""SELECT chain, count(DISTINCT item) AS items, count(DISTINCT store) AS stores, count_if(club <> 'R') AS club_rows, count(*) AS rows_, max(valid_from) AS newest FROM obs JOIN stores USING (store) GROUP BY chain""", "obs", "stores")
def ops_metrics(s, d):
    return T.observations(s, d).join(T.stores(s, d).select("store", "chain"), "store").groupBy("chain").agg(F.countDistinct("item").alias("items"), F.countDistinct("store").alias("stores"), F.count_if(F.col("club") != "R").alias("club_rows"), F.count("*").alias("rows_"), F.max("valid_from").alias("newest"))


@query("""SELECT day, files, ok, CAST(sum(ok) OVER w AS BIGINT) AS ok_14, CAST(sum(files) OVER w AS BIGINT) AS files_14 FROM (SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS files, count_if(event_type <> 'error') AS ok FROM events GROUP BY 1) WINDOW w AS (ORDER BY day ROWS 13 PRECEDING)""")
def load_success(s, d):
    days = table(s, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("files"), F.count_if(F.col("event_type") != "error").alias("ok"))
    w = Window.orderBy("day").rowsBetween(-13, 0)  # one row a day
    return days.select("day", "files", "ok", F.sum("ok").over(w).alias("ok_14"), F.sum("files").over(w).alias("files_14"))


# ---- history and reports


@query("SELECT item, CAST(valid_from AS DATE)::VARCHAR AS day, min(price) AS low, max(price) AS high, CAST(sum(price) AS BIGINT) AS total, count(*) AS n, count_if(pct > 0) AS promos FROM obs GROUP BY ALL", "obs")
def price_history(s, d):
    return T.observations(s, d).groupBy("item", F.to_date("valid_from").cast("string").alias("day")).agg(F.min("price").alias("low"), F.max("price").alias("high"), F.sum("price").alias("total"), F.count("*").alias("n"), F.count_if(F.col("pct") > 0).alias("promos"))


@query("SELECT item, store, order_id, line, price, min(price) OVER w AS low_90 FROM obs WINDOW w AS (PARTITION BY item ORDER BY epoch(valid_from)::BIGINT RANGE BETWEEN 7776000 PRECEDING AND CURRENT ROW)", "obs")
def rolling_low_90d(s, d):
    rows = T.observations(s, d).withColumn("at", F.unix_timestamp(F.col("valid_from").cast("timestamp"))).select("item", "store", "order_id", "line", "price", "at")
    return prices.rolling_low(rows, "item", "at", "price", "low_90").drop("at")


@query("""SELECT item, CAST(sum(gap) AS BIGINT) AS days, count(gap) AS gaps FROM (SELECT item, date_diff('day', lag(day) OVER (PARTITION BY item ORDER BY day), day) AS gap FROM (SELECT DISTINCT item, CAST(valid_from AS DATE) AS day FROM obs WHERE pct >= 5)) GROUP BY item""", "obs")
def promo_cycle(s, d):
    days = T.observations(s, d).where("pct >= 5").select("item", F.to_date("valid_from").alias("day")).distinct()
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy("item").orderBy("day")))
    return days.withColumn("gap", gap).groupBy("item").agg(F.sum("gap").alias("days"), F.count("gap").alias("gaps"))


@query("SELECT chain, strftime(valid_from, '%Y-%m') AS month, CAST(sum(price) * 1000 // sum(base) AS BIGINT) AS index_ FROM obs JOIN stores USING (store) JOIN items USING (item) GROUP BY ALL", "obs", "stores", "items")
def basket_index(s, d):
    rows = T.observations(s, d).join(T.stores(s, d).select("store", "chain"), "store").join(T.items(s, d).select("item", "base"), "item")
    return rows.groupBy("chain", F.date_format("valid_from", "yyyy-MM").alias("month")).agg(C.div(F.sum("price") * 1000, F.sum("base")).alias("index_"))


_BY_CHAIN = "by_chain AS (SELECT name, chain, CAST(sum(price) // count(*) AS BIGINT) AS mean FROM latest JOIN stores USING (store) JOIN items USING (item) GROUP BY ALL)"


def _by_chain(s, d):
    rows = _offers(s, d).join(T.stores(s, d).select("store", "chain"), "store").join(T.items(s, d).select("item", "name"), "item")
    return rows.groupBy("name", "chain").agg(C.div(F.sum("price"), F.count("*")).alias("mean"))


@query(sql("", "latest", "stores", "items").rstrip() + ", " + _BY_CHAIN + " SELECT name, min(mean) AS low, max(mean) AS high, (max(mean) - min(mean)) * 1000 // min(mean) AS gap FROM by_chain GROUP BY name")
def chain_gap(s, d):
    return _by_chain(s, d).groupBy("name").agg(F.min("mean").alias("low"), F.max("mean").alias("high"), C.div((F.max("mean") - F.min("mean")) * 1000, F.min("mean")).alias("gap"))


@query("SELECT kind, trait, CAST(grouping(kind) + grouping(trait) AS BIGINT) AS level, count(*) AS rows_, CAST(sum(price) AS BIGINT) AS total FROM latest JOIN items USING (item) GROUP BY ROLLUP (kind, trait)", "latest", "items")
def taxonomy_rollup(s, d):
    return _offers(s, d).join(T.items(s, d), "item").rollup("kind", "trait").agg((F.grouping("kind") + F.grouping("trait")).cast("long").alias("level"), F.count("*").alias("rows_"), F.sum("price").alias("total"))


@query("SELECT brand, type, CAST(grouping(brand) AS BIGINT) AS all_brands, CAST(grouping(type) AS BIGINT) AS all_types, count(*) AS rows_, min(price) AS low FROM latest JOIN items USING (item) GROUP BY CUBE (brand, type)", "latest", "items")
def brand_cube(s, d):
    return _offers(s, d).join(T.items(s, d), "item").cube("brand", "type").agg(F.grouping("brand").cast("long").alias("all_brands"), F.grouping("type").cast("long").alias("all_types"), F.count("*").alias("rows_"), F.min("price").alias("low"))


@query("SELECT DISTINCT item FROM obs WHERE store % 2 = 0 INTERSECT SELECT DISTINCT item FROM obs WHERE store % 2 = 1", "obs")
def common_items_intersect(s, d):
    rows = T.observations(s, d)
    return rows.where("store % 2 = 0").select("item").intersect(rows.where("store % 2 = 1").select("item"))


@query(f"SELECT DISTINCT item, store FROM obs WHERE valid_from < TIMESTAMP '{AT}' EXCEPT SELECT DISTINCT item, store FROM obs WHERE valid_from >= TIMESTAMP '{AT}'", "obs")
def dropped_items_except(s, d):
    rows = T.observations(s, d)
    return rows.where(f"valid_from < timestamp_ntz '{AT}'").select("item", "store").distinct().join(rows.where(f"valid_from >= timestamp_ntz '{AT}'").select("item", "store").distinct(), ["item", "store"], "left_anti")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def attr_json(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


_NAME_GRAMS = "list_distinct(list_transform(range(1, len({0}) - 1), lambda i: lower({0}[i:i + 2])))"


@query(f"""SELECT basket, CAST(i AS INTEGER) AS place, CASE WHEN i % 2 = 0 THEN qty ELSE 1 END AS qty, need, canonical, confidence, CASE WHEN confidence >= 900 THEN 'accept' WHEN confidence >= 600 THEN 'review' ELSE 'reject' END AS band FROM (
    SELECT *, CASE WHEN i % 3 = 0 THEN name[1:len(name) - 1] ELSE name END AS need FROM (SELECT basket, CAST(qty AS INTEGER) AS qty, name, row_number() OVER (PARTITION BY basket ORDER BY item) - 1 AS i FROM needs JOIN items USING (item)))
    JOIN (SELECT need, arg_min(name, (-score, name)) AS canonical, CAST(max(score) AS BIGINT) AS confidence FROM (SELECT need, name, 1000 * len(list_intersect(g, h)) // len(list_distinct(list_concat(g, h))) AS score FROM (
        SELECT DISTINCT need, {_NAME_GRAMS.format("need")} AS g FROM (SELECT name AS need FROM items UNION SELECT name[1:len(name) - 1] FROM items)), (SELECT DISTINCT name, {_NAME_GRAMS.format("name")} AS h FROM items)) GROUP BY need) USING (need)""", "needs", "items")
def list_parse(s, d):
    """Lists as text, split into needs with quantities, each matched to the catalogue by its trigrams with a confidence; weak ones wait for the user."""
    rows = T.needs(s, d).join(T.items(s, d).select("item", "name"), "item").withColumn("i", F.row_number().over(Window.partitionBy("basket").orderBy("item")) - 1)
    said = F.when(F.col("i") % 3 == 0, F.expr("substring(name, 1, length(name) - 1)")).otherwise(F.col("name"))
    rows = rows.withColumn("part", F.when(F.col("i") % 2 == 0, F.concat(F.col("qty").cast("string"), F.lit(" "), said)).otherwise(said))
    texts = rows.groupBy("basket").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), ", ").alias("text"))
    parsed = texts.select("basket", F.posexplode(C.list_needs(F.col("text"))).alias("place", "n")).select("basket", "place", F.col("n.qty").cast("int").alias("qty"), "n.need")
    names = T.items(s, d).select(F.col("name").alias("product")).distinct()
    found, _ = postings.trigram_topk(parsed.select(F.col("need").alias("q")).distinct(), postings.trigram_index(names), 1)
    matched = parsed.join(found.select(F.col("q").alias("need"), F.col("product").alias("canonical"), F.col("score").alias("confidence")), "need", "left")
    return matched.select("basket", "place", "qty", "need", "canonical", "confidence", C.band(F.col("confidence")).alias("band"))


@query("""SELECT user_id, count(*) AS n, min(ts) AS start_, CAST(max(event_id) AS BIGINT) AS last_event FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
    SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, session""")
def session_activity(s, d):
    return table(s, d, "events").groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.count("*").alias("n"), F.min("ts").alias("start_"), F.max("event_id").alias("last_event")).drop("session_window")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start_, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_activity(s, d):
    return table(s, d, "events").groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start_"), "event_type", "n")


@query("""SELECT order_id, "user" AS user_id, CAST(sum(saved) OVER (PARTITION BY "user" ORDER BY order_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS saved_so_far FROM (
    SELECT order_id, o_custkey AS "user", CAST(sum(qty * price * pct // 100) AS BIGINT) AS saved FROM obs JOIN orders ON order_id = o_orderkey GROUP BY ALL)""", "obs")
def cumulative_saving(s, d):
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"))
    saved = T.observations(s, d).groupBy("order_id").agg(F.sum(C.div(F.col("qty") * F.col("price") * F.col("pct"), 100)).alias("saved")).join(orders, "order_id")
    return saved.select("order_id", "user_id", F.sum("saved").over(Window.partitionBy("user_id").orderBy("order_id").rowsBetween(Window.unboundedPreceding, 0)).alias("saved_so_far"))


@query("SELECT chain, brand, count(*) AS offers, CAST(sum(price) // count(*) AS BIGINT) AS mean FROM latest JOIN stores USING (store) JOIN items USING (item) GROUP BY chain, brand HAVING count(*) >= 5", "latest", "stores", "items")
def market_report(s, d):
    rows = _offers(s, d).join(T.stores(s, d).select("store", "chain"), "store").join(T.items(s, d).select("item", "brand"), "item")
    return rows.groupBy("chain", "brand").agg(F.count("*").alias("offers"), C.div(F.sum("price"), F.count("*")).alias("mean")).where("offers >= 5")


@query("""SELECT name, store, item, unit_price, rank() OVER (PARTITION BY name, store ORDER BY unit_price) AS rank_, CAST(ntile(4) OVER (PARTITION BY name, store ORDER BY unit_price, item) AS INTEGER) AS quarter, unit_price - min(unit_price) OVER (PARTITION BY name, store) AS above FROM (
    SELECT name, store, item, price * CASE WHEN size > 0 THEN 100000 END // size AS unit_price FROM latest JOIN items USING (item))""", "latest", "items")
def variant_ranks(s, d):
    """The variants of a canonical product at a store, ranked by unit price."""
    w = Window.partitionBy("name", "store")
    rows = _offers(s, d).join(T.items(s, d).select("item", "name", "size"), "item").select("name", "store", "item", C.unit_price(F.col("price"), F.col("size"), F.lit("g")).alias("unit_price"))
    return rows.select("name", "store", "item", "unit_price", F.rank().over(w.orderBy("unit_price")).cast("long").alias("rank_"), F.ntile(4).over(w.orderBy("unit_price", "item")).alias("quarter"), (F.col("unit_price") - F.min("unit_price").over(w)).alias("above"))


@query("""SELECT name, min(price) AS low, CAST(count(DISTINCT CASE WHEN price < wanted THEN item END) AS BIGINT) AS variants, CAST(count(CASE WHEN price < wanted AND (before IS NULL OR before >= wanted) THEN 1 END) AS BIGINT) AS crossings FROM (
    SELECT o.*, i.name, w.wanted, lag(price) OVER (PARTITION BY o.item, store ORDER BY valid_from, order_id, line, price, qty) AS before FROM obs o JOIN items i USING (item) JOIN (SELECT name, CAST(sum(base) // count(*) AS BIGINT) AS wanted FROM items GROUP BY name) w ON w.name = i.name) GROUP BY name""", "obs", "items")
def price_alerts(s, d):
    """By canonical product: how often any of its variants at any store falls below the wanted price, and how many variants ever do."""
    items = T.items(s, d).select("item", "name", "base")
    wanted = items.groupBy("name").agg(C.div(F.sum("base"), F.count("*")).alias("wanted"))
    w = Window.partitionBy("item", "store").orderBy(*T.EVENT_ORDER)
    rows = T.observations(s, d).withColumn("before", F.lag("price").over(w)).join(items, "item").join(wanted, "name")
    under = F.col("price") < F.col("wanted")
    crossing = under & (F.col("before").isNull() | (F.col("before") >= F.col("wanted")))
    return rows.groupBy("name").agg(F.min("price").alias("low"), F.countDistinct(F.when(under, F.col("item"))).alias("variants"), F.count_if(crossing).alias("crossings"))


from trolley.plans import catalogue, loads, optimum, reports, shopping  # noqa: E402, F401  they register their queries
