"""Files, freshness, gaps, indices, spend and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trolley.functions import columns as C
from trolley.operators import gates, matching, shared
from trolley.plans import tables as T
from trolley.plans.registry import query
from trolley.plans.tables import sql, table

NOW = "2024-01-31 00:00:00"
_FILES = """files AS (SELECT md5(event_type || user_id || props) AS sha256, CAST(user_id % 10 AS VARCHAR) AS chain_id, CAST(user_id AS VARCHAR) AS store_code, CASE WHEN event_type IN ('view', 'click') THEN 'full' ELSE 'delta' END AS file_type, ts AS file_ts, event_type = 'error' AS failed FROM events)"""


def _files(s, d):
    kind = F.when(F.col("event_type").isin("view", "click"), "full").otherwise("delta")
    return table(s, d, "events").select(F.md5(F.concat("event_type", F.col("user_id").cast("string"), "props").cast("binary")).alias("sha256"), F.pmod("user_id", F.lit(10)).cast("string").alias("chain_id"), F.col("user_id").cast("string").alias("store_code"), kind.alias("file_type"), F.col("ts").alias("file_ts"), (F.col("event_type") == "error").alias("failed"))


@query("WITH " + _FILES + """, log AS (SELECT sha256, chain_id, store_code, file_type, min(file_ts) AS file_ts FROM files WHERE file_ts < TIMESTAMP '2024-01-10' GROUP BY ALL),
    fresh AS (SELECT sha256, chain_id, store_code, file_type, min(file_ts) AS file_ts FROM files WHERE file_ts >= TIMESTAMP '2024-01-10' AND sha256 NOT IN (SELECT sha256 FROM log) GROUP BY ALL),
    fulls AS (SELECT chain_id, store_code, min(file_ts) AS first_full FROM (SELECT * FROM log UNION ALL SELECT * FROM fresh) WHERE file_type = 'full' GROUP BY ALL)
    SELECT sha256, file_type = 'full' OR coalesce(first_full <= file_ts, false) AS loadable FROM fresh LEFT JOIN fulls USING (chain_id, store_code)""")
def loadable_files(s, d):
    """Files never loaded, one per content; a delta waits for a full file of its feed, loaded before or coming with it."""
    one = lambda rows: rows.groupBy("sha256", "chain_id", "store_code", "file_type").agg(F.min("file_ts").alias("file_ts"))
    log, fresh = one(_files(s, d).where("file_ts < timestamp_ntz '2024-01-10'")), one(_files(s, d).where("file_ts >= timestamp_ntz '2024-01-10'"))
    return gates.pending(fresh, log).select("sha256", "loadable")


@query("WITH " + _FILES + f" SELECT chain_id, file_type, count_if(failed) AS failed, count(*) AS files, CAST(date_diff('minute', max(file_ts), TIMESTAMP '{NOW}') AS BIGINT) AS age_minutes FROM files GROUP BY ALL")
def freshness(s, d):
    """Failed files and the age of the newest file at a stated time, by chain and type."""
    age = F.timestamp_diff("MINUTE", F.date_trunc("minute", F.max("file_ts")), F.lit(NOW).cast("timestamp_ntz")).cast("long")
    return _files(s, d).groupBy("chain_id", "file_type").agg(F.count_if("failed").alias("failed"), F.count("*").alias("files"), age.alias("age_minutes"))


@query("WITH " + _FILES + " SELECT store_code, count_if(failed) AS reports, count(*) AS shown, 1000 * count_if(failed) // count(*) AS permille FROM files GROUP BY store_code HAVING count_if(failed) > 0")
def gap_reports(s, d):
    rows = _files(s, d).groupBy("store_code").agg(F.count_if("failed").alias("reports"), F.count("*").alias("shown"))
    return rows.where("reports > 0").withColumn("permille", C.div(1000 * F.col("reports"), F.col("shown")))


@query("SELECT user_id % 5 AS category, count_if(event_type = 'purchase') AS accepted, count(*) AS offered, 1000 * (count(*) - count_if(event_type = 'purchase')) // count(*) AS rejected_permille FROM events WHERE event_type IN ('purchase', 'click') GROUP BY 1")
def rejection_rate(s, d):
    """Substitutions that were offered and not taken."""
    rows = table(s, d, "events").where("event_type in ('purchase', 'click')").groupBy((F.col("user_id") % 5).alias("category")).agg(F.count_if(F.col("event_type") == "purchase").alias("accepted"), F.count("*").alias("offered"))
    return rows.withColumn("rejected_permille", C.div(1000 * (F.col("offered") - F.col("accepted")), F.col("offered")))


_BY_CHAIN = "by_chain AS (SELECT name, chain, CAST(sum(price) // count(*) AS BIGINT) AS mean FROM latest JOIN stores USING (store) JOIN items USING (item) GROUP BY ALL)"


def _by_chain(s, d):
    rows = T.offers(s, d).join(T.stores(s, d).select("store", "chain"), "store").join(T.items(s, d).select("item", "name"), "item")
    return rows.groupBy("name", "chain").agg(C.div(F.sum("price"), F.count("*")).alias("mean"))


@query(sql("", "latest", "stores", "items").rstrip() + ", " + _BY_CHAIN + " SELECT name, CAST(floor(1000 * stddev_samp(mean) / avg(mean) + 0.5) AS BIGINT) AS cv_permille, count(*) AS chains FROM by_chain GROUP BY name HAVING count(*) > 1")
def cv_across_chains(s, d):
    """Standard deviation over mean of a product's price across chains, in thousandths."""
    cv = F.floor(1000 * F.stddev_samp("mean") / F.avg("mean") + 0.5).cast("long")
    return _by_chain(s, d).groupBy("name").agg(cv.alias("cv_permille"), F.count("*").alias("chains")).where("chains > 1")


@query(sql("", "latest", "stores", "items").rstrip() + ", " + _BY_CHAIN + ", whole AS (SELECT name FROM by_chain GROUP BY name HAVING count(*) = (SELECT count(DISTINCT chain) FROM by_chain)), basket AS (SELECT chain, CAST(sum(mean) AS BIGINT) AS total FROM by_chain JOIN whole USING (name) GROUP BY chain) SELECT min(total) AS low, max(total) AS high, (max(total) - min(total)) * 1000 // min(total) AS gap, count(*) AS chains FROM basket")
def basket_gap(s, d):
    """The same basket at every chain: products that all chains have."""
    chains = _by_chain(s, d)
    n = chains.agg(F.countDistinct("chain").alias("n"))
    whole = chains.groupBy("name").agg(F.count("*").alias("n")).join(F.broadcast(n), "n").select("name")
    totals = chains.join(whole, "name").groupBy("chain").agg(F.sum("mean").alias("total"))
    return totals.agg(F.min("total").alias("low"), F.max("total").alias("high"), C.div((F.max("total") - F.min("total")) * 1000, F.min("total")).alias("gap"), F.count("*").alias("chains"))


#: The month that all fixed baskets are measured against.
BASE_MONTH = "1996-01"
_DENSE = """m AS (SELECT chain, strftime(valid_from, '%Y-%m') AS month, name, CAST(sum(price) // count(*) AS BIGINT) AS mean FROM obs JOIN stores USING (store) JOIN items USING (item) WHERE item % 8 = 0 GROUP BY ALL),
    months AS (SELECT DISTINCT strftime(valid_from, '%Y-%m') AS month FROM obs), dense AS MATERIALIZED (SELECT chain, name, month, last_value(mean IGNORE NULLS) OVER (PARTITION BY chain, name ORDER BY month) AS price FROM (
        SELECT k.chain, k.name, months.month, m.mean FROM (SELECT chain, name, min(month) AS since FROM m GROUP BY ALL) k JOIN months ON months.month >= k.since LEFT JOIN m ON m.chain = k.chain AND m.name = k.name AND m.month = months.month))"""
_DENSE = sql("", "obs", "stores", "items").rstrip() + ", " + _DENSE


def _dense(s, d):
    """chain, name, month, price: the mean price of each product of the basket at each chain, from its first month on, a gap with the last one known."""
    rows = T.observations(s, d).where("item % 8 = 0").join(T.stores(s, d).select("store", "chain"), "store").join(T.items(s, d).select("item", "name"), "item")
    month = lambda c: F.date_format(c, "yyyy-MM")
    seen = rows.groupBy("chain", "name", month("valid_from").alias("month")).agg(C.div(F.sum("price"), F.count("*")).alias("mean"))
    months = T.observations(s, d).select(month("valid_from").alias("month")).distinct().agg(F.sort_array(F.collect_set("month")).alias("months"))  # one row, a month each
    since = seen.groupBy("chain", "name").agg(F.min("month").alias("since"))
    grid = since.join(F.broadcast(months)).select("chain", "name", F.explode(F.filter("months", lambda x: x >= F.col("since"))).alias("month"))
    w = Window.partitionBy("chain", "name").orderBy("month")
    return grid.join(seen, ["chain", "name", "month"], "left").select("chain", "name", "month", F.last("mean", ignorenulls=True).over(w).alias("price"))


@query(_DENSE + f""" SELECT x.chain, x.month, CAST(sum(x.price) * 1000 // sum(b.price) AS BIGINT) AS index_, count(*) AS products FROM dense x JOIN dense b ON b.chain = x.chain AND b.name = x.name AND b.month = '{BASE_MONTH}' WHERE x.month >= '{BASE_MONTH}' GROUP BY ALL""")
def fixed_basket_index(s, d):
    """One basket a chain, of the products that it had by the base month: what it costs each month, in thousandths of that month."""
    rows = _dense(s, d).where(F.col("month") >= BASE_MONTH)
    base = F.first(F.when(F.col("month") == BASE_MONTH, F.col("price")), ignorenulls=True).over(Window.partitionBy("chain", "name"))
    held = rows.withColumn("base", base).where("base IS NOT NULL")
    return held.groupBy("chain", "month").agg(C.div(F.sum("price") * 1000, F.sum("base")).alias("index_"), F.count("*").alias("products"))


@query(_DENSE.replace("WITH ", "WITH RECURSIVE ", 1) + """, links AS MATERIALIZED (SELECT chain, month, row_number() OVER (PARTITION BY chain ORDER BY month) AS k, CAST(coalesce(sum(CASE WHEN before IS NOT NULL THEN price END), 1) AS BIGINT) AS now_, CAST(coalesce(sum(before), 1) AS BIGINT) AS before_ FROM (SELECT *, lag(price) OVER (PARTITION BY chain, name ORDER BY month) AS before FROM dense) GROUP BY chain, month),
    chained(chain, month, k, index_) AS (SELECT chain, month, k, 1000000::BIGINT FROM links WHERE k = 1 UNION ALL SELECT l.chain, l.month, l.k, c.index_ * l.now_ // l.before_ FROM chained c JOIN links l ON l.chain = c.chain AND l.k = c.k + 1) SELECT chain, month, index_ FROM chained""")
def chained_basket_index(s, d):
    """Month linked to month over the products that both have, in millionths of a chain's first month: new products join without a jump."""
    before = F.lag("price").over(Window.partitionBy("chain", "name").orderBy("month"))
    both = _dense(s, d).withColumn("before", before)
    one = F.lit(1).cast("long")
    links = both.groupBy("chain", "month").agg(F.coalesce(F.sum(F.when(F.col("before").isNotNull(), F.col("price"))), one).alias("now"), F.coalesce(F.sum("before"), one).alias("past"))
    listed = links.groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("month", "now", "past"))).alias("l"))  # a month each
    start = F.array(F.struct(F.get("l", F.lit(0))["month"].alias("month"), F.lit(1_000_000).cast("long").alias("index_")))
    step = lambda acc, x: F.concat(acc, F.array(F.struct(x["month"].alias("month"), C.div(F.element_at(acc, -1)["index_"] * x["now"], x["past"]).alias("index_"))))
    return listed.select("chain", F.inline(F.aggregate(F.slice("l", F.lit(2), F.size("l")), start, step)))


@query("SELECT kind, CAST(sum(CASE WHEN item % 5 = 0 THEN price END) // count(CASE WHEN item % 5 = 0 THEN 1 END) AS BIGINT) AS own, CAST(sum(CASE WHEN item % 5 <> 0 THEN price END) // count(CASE WHEN item % 5 <> 0 THEN 1 END) AS BIGINT) AS branded FROM latest JOIN items USING (item) GROUP BY kind", "latest", "items")
def private_label_gap(s, d):
    rows = T.offers(s, d).join(T.items(s, d).select("item", "kind"), "item")
    own = F.col("item") % 5 == 0
    mean = lambda c: C.div(F.sum(F.when(c, F.col("price"))), F.count_if(c))
    return rows.groupBy("kind").agg(mean(own).alias("own"), mean(~own).alias("branded"))


@query("""SELECT o_custkey AS user_id, strftime(o_orderdate, '%Y-%m') AS month, CAST(sum(qty * price) AS BIGINT) AS spend, count(DISTINCT order_id) AS baskets FROM obs JOIN orders ON order_id = o_orderkey GROUP BY ALL""", "obs")
def monthly_spend(s, d):
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    spent = T.observations(s, d).groupBy("order_id").agg(F.sum(F.col("qty") * F.col("price")).alias("spend")).join(orders, "order_id")
    return spent.groupBy("user_id", "month").agg(F.sum("spend").alias("spend"), F.count("*").alias("baskets"))


@query("SELECT item, store, order_id, line, price, high_90, 1000 * (high_90 - price) // high_90 AS drop_permille FROM (SELECT *, max(price) OVER (PARTITION BY item, store ORDER BY epoch(valid_from)::BIGINT RANGE BETWEEN 7776000 PRECEDING AND CURRENT ROW) AS high_90 FROM obs) WHERE price < high_90", "obs")
def price_drops(s, d):
    """How far a price lies below its highest of the last 90 days at the same store."""
    w = Window.partitionBy("item", "store").orderBy("at").rangeBetween(-90 * 86400, 0)
    rows = T.observations(s, d).withColumn("at", F.unix_timestamp(F.col("valid_from").cast("timestamp"))).withColumn("high_90", F.max("price").over(w)).where("price < high_90")
    return rows.select("item", "store", "order_id", "line", "price", "high_90", C.div(1000 * (F.col("high_90") - F.col("price")), F.col("high_90")).alias("drop_permille"))


@query("SELECT chain, store, CAST(sum(price) AS BIGINT) AS total, CAST(round(1000 * percent_rank() OVER (PARTITION BY chain ORDER BY sum(price))) AS BIGINT) AS percent_rank, CAST(1000 * sum(price) // sum(sum(price)) OVER (PARTITION BY chain) AS BIGINT) AS share FROM latest JOIN stores USING (store) GROUP BY chain, store", "latest", "stores")
def store_shares(s, d):
    totals = T.offers(s, d).groupBy("store").agg(F.sum("price").alias("total")).join(T.stores(s, d).select("store", "chain"), "store")
    w = Window.partitionBy("chain")
    return totals.select("chain", "store", "total", F.round(1000 * F.percent_rank().over(w.orderBy("total"))).cast("long").alias("percent_rank"), C.div(1000 * F.col("total"), F.sum("total").over(w)).alias("share"))


#: Products that a page shows.
SHOWN = 20


@query(f"""SELECT kind, trait, count(*) AS items, count(DISTINCT brand) AS brands, min(base) AS low, string_agg(CASE WHEN place <= {SHOWN} THEN item || ':' || base END, ' ' ORDER BY base, item) AS products FROM (SELECT *, row_number() OVER (PARTITION BY kind, trait ORDER BY base, item) AS place FROM items) GROUP BY kind, trait""", "items")
def page_dataset(s, d):
    """One row a category page: how much it holds, and the cheapest products that it shows."""
    rows = T.items(s, d).select("kind", "trait", "brand", "item", "base")
    place = F.row_number().over(Window.partitionBy("kind", "trait").orderBy("base", "item"))
    shown = rows.withColumn("place", place).where(F.col("place") <= SHOWN).groupBy("kind", "trait").agg(F.sort_array(F.collect_list(F.struct("base", "item"))).alias("p"))
    listed = shown.select("kind", "trait", F.array_join(F.transform("p", lambda x: F.concat(x["item"].cast("string"), F.lit(":"), x["base"].cast("string"))), " ").alias("products"))
    whole = rows.groupBy("kind", "trait").agg(F.count("*").alias("items"), F.countDistinct("brand").alias("brands"), F.min("base").alias("low"))
    return whole.join(listed, ["kind", "trait"])


@query("SELECT kind, trait, name, CAST(row_number() OVER (ORDER BY kind, trait, name) AS BIGINT) AS node, 3 AS depth FROM (SELECT DISTINCT kind, trait, name FROM items)", "items")
def taxonomy_seed(s, d):
    """Departments, types and products of the catalogue as a numbered path; numbers are given range by range."""
    rows = T.items(s, d).select("kind", "trait", "name").distinct()
    return shared.numbered(rows, [F.col("kind"), F.col("trait"), F.col("name")], "node").select("kind", "trait", "name", "node", F.lit(3).alias("depth"))


@query("""SELECT item, name, size, generation FROM (SELECT item, name, size, 'old' AS generation FROM items WHERE item % 2 = 0 UNION ALL SELECT item, name, CAST(NULL AS BIGINT), 'new' FROM items WHERE item % 2 = 1)""", "items")
def adapters_union(s, d):
    """Two generations of a chain's files as one table: the new one has other names and no size."""
    old = T.items(s, d).where("item % 2 = 0").select("item", "name", "size").withColumn("generation", F.lit("old"))
    new = T.items(s, d).where("item % 2 = 1").select(F.col("item").alias("code"), F.col("name").alias("title")).withColumnsRenamed({"code": "item", "title": "name"}).withColumn("generation", F.lit("new"))
    return old.unionByName(new, allowMissingColumns=True)


@query("SELECT channel, count(*) AS offers, min(price) AS low FROM (SELECT price, CASE WHEN store % 4 = 0 THEN 'online' ELSE 'physical' END AS channel FROM latest) GROUP BY channel", "latest")
def channel_split(s, d):
    channel = F.when(F.col("store") % 4 == 0, "online").otherwise("physical")
    return T.offers(s, d).groupBy(channel.alias("channel")).agg(F.count("*").alias("offers"), F.min("price").alias("low"))


_GOLD = """gold AS (SELECT doc_id, lang, quality, toxic, CASE WHEN letters * 10 >= length(text) * 7 AND length(text) >= 200 THEN 1 ELSE 0 END AS p, CASE WHEN marks * 50 >= length(text) AND length(text) > 0 THEN 1 ELSE 0 END AS t FROM (
    SELECT doc_id, lang, text, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS letters, length(regexp_replace(text, '[^#*$%&|<>!]', '', 'g')) AS marks FROM documents) JOIN labels USING (doc_id))"""


@query("WITH " + _GOLD + """ SELECT level, category, tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN 1000 * tp // (tp + fp) END AS precision_permille, CASE WHEN tp + fn > 0 THEN 1000 * tp // (tp + fn) END AS recall_permille FROM (
    SELECT level, lang AS category, count_if(p = 1 AND y = 1) AS tp, count_if(p = 1 AND y = 0) AS fp, count_if(p = 0 AND y = 1) AS fn, count_if(p = 0 AND y = 0) AS tn FROM (SELECT lang, 'quality' AS level, p, quality AS y FROM gold UNION ALL SELECT lang, 'toxic', t, toxic FROM gold) GROUP BY level, lang)""")
def precision_recall(s, d):
    """Rules over the whole text against the labels, by level and category: counts, and precision and recall in thousandths."""
    only = lambda pattern: F.length(F.regexp_replace("text", pattern, ""))
    size = F.length("text")
    quality = ((only("[^a-zA-Z]") * 10 >= size * 7) & (size >= 200)).cast("int")
    toxic = ((only("[^#*$%&|<>!]") * 50 >= size) & (size > 0)).cast("int")
    rows = table(s, d, "documents").select("doc_id", F.col("lang").alias("category"), quality.alias("q"), toxic.alias("t")).join(table(s, d, "labels"), "doc_id")
    each = rows.select("category", F.inline(F.array(F.struct(F.lit("quality").alias("level"), F.col("q").alias("p"), F.col("quality").alias("y")), F.struct(F.lit("toxic").alias("level"), F.col("t").alias("p"), F.col("toxic").alias("y")))))
    counts = matching.precision_recall(each, ["level", "category"], "p", "y")
    share = lambda other: C.div(1000 * F.col("tp"), F.col("tp") + F.col(other))
    return counts.select("level", "category", "tp", "fp", "fn", "tn", share("fp").alias("precision_permille"), share("fn").alias("recall_permille"))


@query("WITH " + _GOLD + " SELECT a.doc_id AS a, b.doc_id AS b, a.quality = b.quality AS same FROM labels a JOIN labels b ON b.doc_id = a.doc_id + 1")
def gold_pairs(s, d):
    """Labelled neighbours as pairs with whether their labels agree."""
    labels = table(s, d, "labels").select("doc_id", "quality")
    after = labels.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("b"), F.col("quality").alias("other"))
    return labels.join(after, "doc_id").select(F.col("doc_id").alias("a"), "b", (F.col("quality") == F.col("other")).alias("same"))


@query(sql("", "obs", "stores").rstrip() + """, f AS (SELECT store, CAST(date_trunc('month', valid_from) AS DATE)::VARCHAR AS file_date, count(*) AS items, count_if(price > 300000) AS bad FROM obs GROUP BY ALL)
    SELECT store, count_if(bad = 0) AS accepted_files, count_if(bad > 0) AS quarantined_files, CAST(sum(CASE WHEN bad > 0 THEN items ELSE 0 END) AS BIGINT) AS quarantined_rows FROM f GROUP BY store""")
def quarantine_split(s, d):
    """Files that fail a gate go aside as a whole."""
    rows = T.observations(s, d).withColumn("file_date", F.trunc("valid_from", "month").cast("string"))
    judged = rows.groupBy("store", "file_date").agg(F.when(F.max("price") > 300_000, F.array(F.lit("price"))).otherwise(F.array().cast("array<string>")).alias("reasons"))
    good, bad = gates.split(rows, judged, ["store", "file_date"])
    count = lambda x, files, n: x.groupBy("store").agg(F.countDistinct("file_date").alias(files), F.count("*").alias(n))
    both = count(good, "accepted_files", "accepted_rows").join(count(bad, "quarantined_files", "quarantined_rows"), "store", "full")
    return both.select("store", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("accepted_files", "quarantined_files", "quarantined_rows")])


@query("SELECT month, count(*) AS rows_, count(DISTINCT item) AS items FROM (SELECT item, strftime(valid_from, '%Y-%m') AS month FROM obs) GROUP BY month", "obs")
def monthly_partitions(s, d):
    return T.observations(s, d).groupBy(F.date_format("valid_from", "yyyy-MM").alias("month")).agg(F.count("*").alias("rows_"), F.countDistinct("item").alias("items"))
