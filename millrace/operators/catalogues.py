"""Scopes, stages, offers, stock, knowledge, accounts and work lists: what a sales desk looks up and maintains.

Operators are functions of DataFrames or columns; the queries apply them to the tables of one data folder. Orders stand for
conversions, suppliers for accounts, nations and regions for cities and provinces, parts for catalogue items.
"""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.catalog import Catalog
from millrace.functions.columns import conjunction, depth_of, half_up, ratio
from millrace.io import load

catalog = Catalog()
QUERIES, ORACLE_SQL = catalog.queries, catalog.sql

NOW = "2024-01-31 00:00:00"
STAGES = ("view", "click", "signup", "purchase")
DEPTH_SQL = "CASE {} WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE -1 END"
K = "CAST(json_extract(props, '$.k') AS BIGINT)"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def prop_k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


# ------------------------------------------------------------------------------------ scans and scopes


@catalog.query("where_raw", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 101000 AND o_orderpriority <> '5-LOW' ORDER BY o_orderkey")
def where_raw(spark: SparkSession, d: str, where: str = "o_totalprice BETWEEN 100000 AND 101000 AND o_orderpriority <> '5-LOW'") -> DataFrame:
    """A predicate given as SQL text."""
    return load(spark, d, "orders").where(where).select("o_orderkey", "o_totalprice").orderBy("o_orderkey")


def require(table: DataFrame, **key) -> DataFrame:
    """The one row with this key; an error if there is none."""
    row = table.where(conjunction(F.col(k) == v for k, v in key.items())).limit(1)
    if row.isEmpty():
        raise LookupError(f"no row with {key}")
    return row


@catalog.query("point_lookup", "SELECT * FROM customer WHERE c_custkey = 42")
def point_lookup(spark: SparkSession, d: str, key: int = 42) -> DataFrame:
    return require(load(spark, d, "customer"), c_custkey=key)


@catalog.query("sql_with_parameters", "SELECT user_id, COUNT(*) AS n FROM events WHERE event_type = 'signup' AND value >= 20 GROUP BY user_id")
def sql_with_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Arbitrary SQL with named parameter markers over a table."""
    return spark.sql("SELECT user_id, COUNT(*) AS n FROM {events} WHERE event_type = :kind AND value >= :least GROUP BY user_id", args={"kind": "signup", "least": 20}, events=load(spark, d, "events"))


def paged(table: DataFrame, order: Iterable[tuple[str, bool]], limit: float | None = None, offset: float = 0) -> DataFrame:
    """Sorted by columns of the table (name, descending) alone; limits are floored and never negative."""
    order = list(order)
    if unknown := [c for c, _ in order if c not in table.columns]:
        raise ValueError(f"no such columns: {unknown}")
    rows = table.orderBy(*(F.desc(c) if down else F.asc(c) for c, down in order)).offset(max(0, int(offset // 1)))
    return rows if limit is None else rows.limit(max(0, int(limit // 1)))


@catalog.query("ordered_tail", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 7 OFFSET 2")
def ordered_tail(spark: SparkSession, d: str) -> DataFrame:
    return paged(load(spark, d, "supplier").select("s_suppkey", "s_acctbal"), [("s_acctbal", True), ("s_suppkey", False)], 7.9, 2.5)


@catalog.query("filter_fragments", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal > 9900")
def filter_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Terms folded with AND, of which none holds for all rows; an absent one is left out."""
    c = load(spark, d, "customer")
    fragments = lambda least, segments: [t for t in (F.col("c_acctbal") > least if least is not None else None, F.col("c_mktsegment").isin(*segments) if segments else None) if t is not None]
    both, one = (c.where(conjunction(fragments(*x))).select("c_custkey") for x in ((0, ("BUILDING", "MACHINERY")), (9900, ())))
    return both.unionAll(one).where(conjunction([]))


@catalog.query("run_scope", f"SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND {K} % 10 IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0) AND ts >= TIMESTAMP '2024-01-05'")
def run_scope(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose group lies in a scope of a dimension, from a time on."""
    scope = load(spark, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").cast("long").alias("g"))
    e = load(spark, d, "events").where(F.col("event_type").isin("view", "click") & (F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")))
    return e.withColumn("g", prop_k() % 10).join(scope, "g", "left_semi").select("event_id")


#: Endings of administrative names that a place can be written with.
SUFFIXES = ("_city", "_province", "-area")


def canonical_key(text: Column) -> Column:
    """Compatibility forms and case folded, trimmed, an administrative ending cut."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
    t = F.regexp_replace(F.lower(F.trim(F.translate(text, wide, "".join(map(chr, range(0x21, 0x7F))) + " "))), r"\s+", "_")
    return F.regexp_replace(t, "(" + "|".join(SUFFIXES) + ")$", "")


@catalog.query("canonical_filters", """
WITH asked AS (SELECT c_custkey, c_mktsegment AS s, n_nationkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment <> 'MACHINERY')
SELECT c_custkey, CASE WHEN s = 'BUILDING' THEN (SELECT string_agg(n.n_nationkey::VARCHAR, ',' ORDER BY n.n_nationkey) FROM nation n WHERE n.n_regionkey = asked.n_regionkey) ELSE n_nationkey::VARCHAR END AS cities FROM asked""")
def canonical_filters(spark: SparkSession, d: str) -> DataFrame:
    """What customers ask for as canonical places: their city in several spellings, or their province as the set of its cities."""
    n, r = load(spark, d, "nation"), load(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    wide = lambda t: F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ_", "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ＿")
    c = load(spark, d, "customer").join(n.join(r, "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    s = F.col("c_mktsegment")
    raw = F.when(s == "AUTOMOBILE", F.concat(F.lit("  "), F.initcap(F.replace("n_name", F.lit("_"), F.lit(" "))), F.lit(" "))).when(s == "BUILDING", F.concat(F.lower("r_name"), F.lit("_province"))).when(s == "FURNITURE", wide(F.col("n_name"))).when(s == "HOUSEHOLD", F.concat(F.lower("n_name"), F.lit(" city"))).otherwise(F.concat("n_name", F.lit("?")))
    asked = c.select("c_custkey", canonical_key(raw).alias("key"))
    alias = n.select(canonical_key(F.col("n_name")).alias("key"), "n_nationkey").unionByName(n.join(r, "n_regionkey").select(canonical_key(F.col("r_name")).alias("key"), "n_nationkey"))
    places = alias.groupBy("key").agg(F.array_sort(F.collect_set("n_nationkey")).alias("keys"))  # a key's cities, a dimension
    return asked.join(places, "key").select("c_custkey", F.concat_ws(",", F.transform("keys", lambda x: x.cast("string"))).alias("cities"))


def period(start: Column, end: Column, days: int = 30, tz: str = "Asia/Shanghai") -> tuple[Column, Column]:
    """A reporting period as instants [from, to): the last days by default; one bound fixes the other; days are local, and
    the last one counts in full."""
    local = lambda day: F.to_utc_timestamp(day.cast("timestamp"), tz)
    to = F.coalesce(local(F.date_add(F.to_date(end), 1)), F.when(F.to_date(start).isNotNull(), now()), now())
    return F.coalesce(local(F.to_date(start)), to - F.make_dt_interval(F.lit(days))), to


@catalog.query("reporting_period", """
WITH q AS (SELECT c_custkey, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN min(o_orderdate) END AS f, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'FURNITURE') THEN max(o_orderdate) END AS t FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment),
p AS (SELECT c_custkey, f, COALESCE(date_trunc('day', t) + INTERVAL 1 DAY - INTERVAL 8 HOUR, TIMESTAMP '2024-01-31') AS stop FROM q)
SELECT c_custkey, COALESCE(date_trunc('day', f) - INTERVAL 8 HOUR, stop - INTERVAL 30 DAY)::TIMESTAMP AS start, stop::TIMESTAMP AS stop FROM p""")
def reporting_period(spark: SparkSession, d: str) -> DataFrame:
    """Periods of customers' orders: both bounds, one of them, or none are given."""
    s = F.col("c_mktsegment")
    o = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("f"), F.max("o_orderdate").alias("t"))
    day = lambda c, *names: F.when(s.isin(*names), F.date_format(c, "yyyy-MM-dd"))
    start, stop = period(day("f", "AUTOMOBILE", "BUILDING"), day("t", "AUTOMOBILE", "FURNITURE"))
    return load(spark, d, "customer").join(o, "c_custkey").select("c_custkey", start.cast("timestamp_ntz").alias("start"), stop.cast("timestamp_ntz").alias("stop"))


@catalog.query("stage_depth", f"SELECT event_id, ({DEPTH_SQL.format('event_type')})::INTEGER AS depth FROM events")
def stage_depth(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", depth_of(F.col("event_type"), STAGES).alias("depth"))


def reached(stage: Column, least: str, lost: str = "error") -> Column:
    """Whether a row has reached a stage: lost ones have not, whatever they were."""
    return (stage != lost) & (depth_of(stage, STAGES) >= STAGES.index(least))


@catalog.query("reached_counts", f"SELECT COUNT(DISTINCT user_id) FILTER (WHERE event_type <> 'error' AND {DEPTH_SQL.format('event_type')} >= 1) AS click, COUNT(DISTINCT user_id) FILTER (WHERE event_type <> 'error' AND {DEPTH_SQL.format('event_type')} >= 2) AS signup FROM events WHERE user_id % 3 = 0")
def reached_counts(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").where("user_id % 3 = 0")
    per = e.groupBy("user_id").agg(*(F.max(reached(F.col("event_type"), s).cast("long")).alias(s) for s in ("click", "signup")))
    return per.agg(*(F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in ("click", "signup")))


@catalog.query("not_managed", """
SELECT event_type, COUNT(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = e.user_id OR s.s_suppkey = CAST(json_extract(e.props, '$.k') AS BIGINT) + 50)) AS n FROM events e GROUP BY event_type""")
def not_managed(spark: SparkSession, d: str) -> DataFrame:
    """Rows of which neither key is a managed identity; two flags from one key set, no nested loop."""
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("key")).distinct()
    e = load(spark, d, "events").select("event_type", "user_id", (prop_k() + 50).alias("other"))
    one = s.select(F.col("key").alias("user_id"), F.lit(True).alias("a"))
    two = s.select(F.col("key").alias("other"), F.lit(True).alias("b"))
    return e.join(one, "user_id", "left").join(two, "other", "left").groupBy("event_type").agg(F.count_if(F.col("a").isNull() & F.col("b").isNull()).alias("n"))


@catalog.query("coalesced_time", "SELECT COUNT(*) AS n FROM (SELECT o_orderkey, o_orderdate, MIN(l_shipdate) AS shipped FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey, o_orderdate) WHERE COALESCE(shipped, o_orderdate) >= TIMESTAMP '1998-01-01' AND COALESCE(shipped, o_orderdate) < TIMESTAMP '1999-01-01'")
def coalesced_time(spark: SparkSession, d: str) -> DataFrame:
    shipped = load(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("shipped"))
    at = F.coalesce("shipped", "o_orderdate")
    return load(spark, d, "orders").join(shipped, "o_orderkey", "left").where((at >= "1998-01-01") & (at < "1999-01-01")).agg(F.count("*").alias("n"))


@catalog.query("filter_variants", "SELECT COUNT(DISTINCT p_brand) AS brands, COUNT(DISTINCT p_brand || '/' || p_type) AS variants, COUNT(DISTINCT CASE WHEN p_size > 25 THEN p_type END) AS large FROM part")
def filter_variants(spark: SparkSession, d: str) -> DataFrame:
    """How many values each filter of a page offers, over the distinct combinations."""
    p = load(spark, d, "part").groupBy("p_brand", "p_type").agg(F.max((F.col("p_size") > 25).cast("int")).alias("large"))
    kinds = lambda c: F.size(F.collect_set(c)).cast("long")
    return p.agg(kinds("p_brand").alias("brands"), F.count("*").alias("variants"), kinds(F.when(F.col("large") == 1, F.col("p_type"))).alias("large"))


# ------------------------------------------------------------------------------------ offers, stock and knowledge


def applicable(items: DataFrame, offers: DataFrame, parts: int = 64) -> DataFrame:
    """Items with the offers that apply: those of the item, else of its brand, else of all.

    items: item, brand; offers: offer, item, brand (null: not bound to one). An item's level is found before any pair is made,
    by whether it, or its brand, has an offer. A brand has many items and many offers: its items are dealt into `parts`, and
    its offers go to each of them. All sides grow with the tables, and the copies are more than a size check before they are
    made can see, so they are merged: none goes through the driver.
    """
    one = offers.where("item is not null").select("offer", "item")
    brand = offers.where("item is null and brand is not null").select("offer", "brand")
    every = offers.where("item is null and brand is null").select("offer")
    level = lambda rows, n: rows.select("item", "offer", F.lit(n).alias("level"))
    copied = lambda rows: rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # more tasks than parts, in a fixed number: what comes in is small beside the pairs that come out
    dealt = lambda rows, *by: rows.repartition(2 * parts, *by).hint("merge")
    rest = items.join(one.select("item").distinct().hint("merge"), "item", "left_anti").withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int"))
    own = dealt(rest, "brand", "part")
    branded = own.join(dealt(copied(brand), "brand", "part"), ["brand", "part"])
    named = own.join(dealt(copied(brand.select("brand").distinct()), "brand", "part"), ["brand", "part"], "left_semi").select("item")
    plain = rest.join(named.hint("merge"), "item", "left_anti")
    general = dealt(plain, "part").join(dealt(copied(every), "part"), "part")
    return level(items.join(one.hint("merge"), "item"), 1).unionByName(level(branded, 2)).unionByName(level(general, 3))


OFFERS_SQL = "o AS (SELECT s_suppkey AS offer, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END AS item, CASE WHEN s_suppkey % 3 = 1 THEN 'Brand#' || (s_suppkey % 20) END AS brand FROM supplier WHERE s_suppkey % 3 < 2 OR s_suppkey IN (2, 5))"


def offers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = load(spark, d, "supplier").where((k % 3 < 2) | k.isin(2, 5))
    return s.select(k.alias("offer"), F.when(k % 3 == 0, k).alias("item"), F.when(k % 3 == 1, F.concat(F.lit("Brand#"), (k % 20).cast("string"))).alias("brand"))


@catalog.query("offer_applicability", f"""WITH {OFFERS_SQL}, a AS (SELECT p_partkey AS item, offer, CASE WHEN o.item IS NOT NULL THEN 1 WHEN o.brand IS NOT NULL THEN 2 ELSE 3 END AS level FROM part JOIN o ON o.item = p_partkey OR (o.item IS NULL AND o.brand = p_brand) OR (o.item IS NULL AND o.brand IS NULL))
SELECT item, offer, level FROM a QUALIFY level = MIN(level) OVER (PARTITION BY item)""")
def offer_applicability(spark: SparkSession, d: str) -> DataFrame:
    return applicable(load(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("brand")), offers(spark, d)).select("item", "offer", "level")


@catalog.query("in_list_join", "SELECT c_mktsegment, COUNT(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY c_mktsegment")
def in_list_join(spark: SparkSession, d: str) -> DataFrame:
    """Any number of ids: a semi-join, no chunks of a list."""
    ids = load(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").join(ids, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@catalog.query("market_facts", """
WITH l AS (SELECT l_partkey, SUM(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS stock, MAX(CASE WHEN l_shipdate >= TIMESTAMP '1999-01-01' THEN l_discount END) AS best FROM lineitem GROUP BY l_partkey)
SELECT p_brand, MIN(p_retailprice) AS entry_price, COALESCE(SUM(stock), 0)::DOUBLE AS stock, MAX(best) AS best_offer, COUNT(*) AS models FROM part LEFT JOIN l ON l_partkey = p_partkey GROUP BY p_brand""")
def market_facts(spark: SparkSession, d: str) -> DataFrame:
    """Per brand its entry price, units in stock and best offer that still runs."""
    stock = F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0.0))
    best = F.max(F.when(F.col("l_shipdate") >= "1999-01-01", F.col("l_discount")))
    items = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(stock.alias("stock"), best.alias("best"))
    p = load(spark, d, "part").join(items, "p_partkey", "left")
    return p.groupBy("p_brand").agg(F.min("p_retailprice").alias("entry_price"), F.coalesce(F.sum("stock"), F.lit(0.0)).alias("stock"), F.max("best").alias("best_offer"), F.count("*").alias("models"))


@catalog.query("answer_fact", """
WITH q AS (SELECT c_custkey, c_custkey * 7 % (SELECT COUNT(*) FROM part) AS item, CASE c_custkey % 3 WHEN 0 THEN 'price' WHEN 1 THEN 'stock' ELSE 'spec' END AS kind FROM customer),
l AS (SELECT l_partkey, COUNT(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_partkey)
SELECT c_custkey, kind, CASE kind WHEN 'price' THEN 'from ' || FLOOR(p_retailprice + 0.5)::BIGINT WHEN 'stock' THEN CASE WHEN COALESCE(n, 0) > 0 THEN n || ' in stock' ELSE 'ask us' END ELSE p_type || ', size ' || p_size END AS answer, 'part:' || p_partkey AS ref FROM q JOIN part ON p_partkey = item LEFT JOIN l ON l_partkey = item""")
def answer_fact(spark: SparkSession, d: str) -> DataFrame:
    """Answers by kind of question from catalogue facts alone, each with the fact's reference."""
    p = load(spark, d, "part")
    k, n = F.col("c_custkey"), p.count()
    q = load(spark, d, "customer").select("c_custkey", (k * 7 % n).alias("p_partkey"), F.when(k % 3 == 0, "price").when(k % 3 == 1, "stock").otherwise("spec").alias("kind"))
    stock = load(spark, d, "lineitem").where("l_linestatus = 'O'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    price = F.concat(F.lit("from "), F.floor(F.col("p_retailprice") + 0.5).cast("string"))
    left = F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" in stock"))).otherwise("ask us")
    spec = F.concat("p_type", F.lit(", size "), F.col("p_size").cast("string"))
    answer = F.when(F.col("kind") == "price", price).when(F.col("kind") == "stock", left).otherwise(spec)
    return q.join(p, "p_partkey").join(stock, "p_partkey", "left").select("c_custkey", "kind", answer.alias("answer"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("ref"))


@catalog.query("validity_bounds", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN o_orderdate - INTERVAL 8 HOUR WHEN 'O' THEN o_orderdate + INTERVAL 12 HOUR END AS start, CASE o_orderstatus WHEN 'F' THEN o_orderdate + INTERVAL 16 HOUR WHEN 'O' THEN o_orderdate + INTERVAL 12 HOUR END AS stop, o_orderstatus <> 'P' OR o_orderpriority < '3' AS valid FROM orders""")
def validity_bounds(spark: SparkSession, d: str, tz: str = "Asia/Shanghai") -> DataFrame:
    """A bound as an instant or as a local day, which begins and ends with the day; empty is no bound, else it is invalid."""
    status, at = F.col("o_orderstatus"), F.col("o_orderdate").cast("timestamp")
    raw = F.when(status == "F", F.date_format(at, "yyyy-MM-dd")).when(status == "O", F.date_format(at, "yyyy-MM-dd'T'12:00:00'Z'")).when(F.col("o_orderpriority") < "3", "").otherwise(F.concat(F.lit("2001-02-30T"), F.col("o_orderpriority"), F.lit("Z")))
    rows = load(spark, d, "orders").select("o_orderkey", raw.alias("raw"))
    day = F.when(F.col("raw").rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_timestamp("raw", F.lit("yyyy-MM-dd")))
    instant = F.when(F.col("raw").rlike(r"^\d{4}-\d\d-\d\dT.*Z$"), F.try_to_timestamp("raw"))
    local = lambda x: F.to_utc_timestamp(x, tz)
    start, stop = F.coalesce(local(day), instant), F.coalesce(local(day + F.expr("interval 1 day")), instant)
    return rows.select("o_orderkey", start.cast("timestamp_ntz").alias("start"), stop.cast("timestamp_ntz").alias("stop"), ((F.col("raw") == "") | start.isNotNull()).alias("valid"))


@catalog.query("active_knowledge", """
WITH k AS (SELECT lower(p_type) AS category, lower(trim(p_name)) AS phrase, p_partkey % 5 <> 0 AS active, p_partkey % 7 AS day FROM part), s AS (SELECT unnest(['red widget', ' Small Ring ', 'no such']) AS phrase)
SELECT DISTINCT phrase FROM (SELECT phrase FROM k WHERE active AND day <= 3 AND category = 'economy' UNION ALL SELECT lower(trim(phrase)) FROM s)""")
def active_knowledge(spark: SparkSession, d: str, settings: tuple[str, ...] = ("red widget", " Small Ring ", "no such")) -> DataFrame:
    """Phrases of the settings and of knowledge of a category that is active and in force, each once."""
    p = load(spark, d, "part").where((F.lower("p_type") == "economy") & (F.col("p_partkey") % 5 != 0) & (F.col("p_partkey") % 7 <= 3))
    own = spark.createDataFrame([(x,) for x in settings], "p_name string")
    return p.select("p_name").unionByName(own).select(F.lower(F.trim("p_name")).alias("phrase")).distinct()


@catalog.query("scope_models", "SELECT p_brand, COALESCE(SUM(stock), 0)::BIGINT AS stock FROM part LEFT JOIN (SELECT l_partkey, COUNT(*) AS stock FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_partkey) ON l_partkey = p_partkey GROUP BY p_brand ORDER BY stock DESC, p_brand LIMIT 5")
def scope_models(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    """The models to look at first: by stock, then by name."""
    stock = load(spark, d, "lineitem").where("l_linestatus = 'O'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("stock"))
    p = load(spark, d, "part").join(stock, "p_partkey", "left")
    return p.groupBy("p_brand").agg(F.coalesce(F.sum("stock"), F.lit(0)).alias("stock")).orderBy(F.desc("stock"), "p_brand").limit(k)


# ------------------------------------------------------------------------------------ aggregates and orders


@catalog.query("null_group", "SELECT CASE WHEN event_type = 'error' THEN CASE WHEN value > 50 THEN 'severe' END ELSE event_type END AS reason, COUNT(*) AS n FROM events GROUP BY 1")
def null_group(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a value are a group of their own."""
    reason = F.when(F.col("event_type") == "error", F.when(F.col("value") > 50, "severe")).otherwise(F.col("event_type"))
    return load(spark, d, "events").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@catalog.query("zero_of_nothing", "SELECT COALESCE(SUM(value), 0)::DOUBLE AS total, COUNT(*) AS n, COALESCE(MAX(value), 0)::DOUBLE AS most FROM events WHERE event_type = 'refund'")
def zero_of_nothing(spark: SparkSession, d: str) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return load(spark, d, "events").where("event_type = 'refund'").agg(zero(F.sum("value")).alias("total"), F.count("*").alias("n"), zero(F.max("value")).alias("most"))


@catalog.query("count_by", "SELECT o_orderpriority AS key, COUNT(*) AS n FROM orders GROUP BY 1")
def count_by(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("key")).agg(F.count("*").alias("n"))


@catalog.query("share_of_best", f"WITH q AS (SELECT {K} % 10 AS q, COUNT(*) FILTER (WHERE event_type = 'purchase') / COUNT(*)::DOUBLE AS density FROM events GROUP BY 1) SELECT q, FLOOR(density / (SELECT MAX(density) FROM q) * 10000 + 0.5) / 10000 AS share FROM q")
def share_of_best(spark: SparkSession, d: str) -> DataFrame:
    """Each group's density over the best one's; the best is one number, not a window over everything."""
    q = load(spark, d, "events").groupBy((prop_k() % 10).alias("q")).agg((F.count_if(F.col("event_type") == "purchase") / F.count("*")).alias("density"))
    best = q.agg(F.max("density").alias("best")).first().best or 0.0
    return q.select("q", half_up(ratio(F.col("density"), F.lit(best)), 4).alias("share"))


@catalog.query("insertion_order", "SELECT user_id, arg_max(event_type, (ts::DATE, event_id)) AS latest FROM events GROUP BY user_id")
def insertion_order(spark: SparkSession, d: str) -> DataFrame:
    """Ties of a coarse time are broken by the sequence in which rows came in, an explicit column."""
    return load(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct(F.to_date("ts"), "event_id")).alias("latest"))


@catalog.query("business_ranking", """
WITH c AS (SELECT o_custkey, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS won, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS open, COUNT(*) AS n, MAX(o_totalprice) AS most, MAX(o_orderdate) AS latest FROM orders GROUP BY o_custkey)
SELECT o_custkey, won, open, n FROM c ORDER BY won DESC, open DESC, n DESC, most DESC, latest DESC, o_custkey LIMIT 50""")
def business_ranking(spark: SparkSession, d: str) -> DataFrame:
    status = lambda s: F.count_if(F.col("o_orderstatus") == s)
    c = load(spark, d, "orders").groupBy("o_custkey").agg(status("F").alias("won"), status("O").alias("open"), F.count("*").alias("n"), F.max("o_totalprice").alias("most"), F.max("o_orderdate").alias("latest"))
    return c.orderBy(*(F.desc(x) for x in ("won", "open", "n", "most", "latest")), "o_custkey").limit(50).select("o_custkey", "won", "open", "n")


@catalog.query("effectiveness_order", f"WITH q AS (SELECT {K} % 20 AS q, COUNT(*) FILTER (WHERE event_type = 'purchase') AS wins, COUNT(*) FILTER (WHERE event_type = 'signup') AS leads, COUNT(*) AS n FROM events GROUP BY 1) SELECT q, wins, leads, n FROM q ORDER BY wins / n::DOUBLE DESC, leads / n::DOUBLE DESC, n, q LIMIT 10")
def effectiveness_order(spark: SparkSession, d: str) -> DataFrame:
    kind = lambda k: F.count_if(F.col("event_type") == k)
    q = load(spark, d, "events").groupBy((prop_k() % 20).alias("q")).agg(kind("purchase").alias("wins"), kind("signup").alias("leads"), F.count("*").alias("n"))
    return q.orderBy(F.desc(F.col("wins") / F.col("n")), F.desc(F.col("leads") / F.col("n")), "n", "q").limit(10)


# How much one run does of each kind of work.
RUN_CAPS = {"view": 20, "click": 200, "signup": 50, "purchase": 30}


@catalog.query("run_caps", "SELECT event_type, event_id FROM (SELECT event_type, event_id, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS i FROM events) WHERE i <= CASE event_type WHEN 'view' THEN 20 WHEN 'click' THEN 200 WHEN 'signup' THEN 50 WHEN 'purchase' THEN 30 ELSE 0 END")
def run_caps(spark: SparkSession, d: str) -> DataFrame:
    """The best rows of each kind, as many as one run takes; each is a top-k of its own, so no kind is sorted as a whole."""
    e = load(spark, d, "events")
    parts = [e.where(F.col("event_type") == k).orderBy(F.desc("value"), "event_id").limit(n).select("event_type", "event_id") for k, n in RUN_CAPS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@catalog.query("notes_to_read", "SELECT conv_id, COUNT(*) AS turns FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY conv_id ORDER BY turns DESC, conv_id LIMIT 10")
def notes_to_read(spark: SparkSession, d: str) -> DataFrame:
    """Threads without an excluded author, the most answered first."""
    c = load(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "system").alias("excluded"))
    return c.where("excluded = 0").select("conv_id", "turns").orderBy(F.desc("turns"), "conv_id").limit(10)


@catalog.query("set_algebra", """
WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND value > 70), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 70)
SELECT 'both' AS kind, COUNT(*) AS n FROM a WHERE user_id IN (FROM b) UNION ALL SELECT 'first', COUNT(*) FROM a WHERE user_id NOT IN (FROM b) UNION ALL SELECT 'second', COUNT(*) FROM b WHERE user_id NOT IN (FROM a)""")
def set_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Union, difference and membership of two sets of keys in one pass over keys."""
    e = load(spark, d, "events").where("value > 70 and event_type in ('signup', 'purchase')")
    u = e.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "signup").alias("a"), F.bool_or(F.col("event_type") == "purchase").alias("b"))
    n = u.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("first"), F.count_if(F.col("b") & ~F.col("a")).alias("second"))
    return n.select(F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in ("both", "first", "second")))))


# ------------------------------------------------------------------------------------ scoring rules, strategy and plans


def apportioned(weight: Column, over: list[str], order: list, total: int = 100) -> Column:
    """Integer weights of each group that sum to the total: floors, then the largest remainders."""
    group = Window.partitionBy(*over)
    exact = weight * total / F.sum(weight).over(group)
    rank = F.row_number().over(group.orderBy(F.desc(exact - F.floor(exact)), *order))
    return (F.floor(exact) + (rank <= total - F.sum(F.floor(exact)).over(group)).cast("int")).cast("long")


@catalog.query("effective_maxima", """
WITH w AS (SELECT n_regionkey, n_nationkey, (n_nationkey * 7 % 11 + 1) AS weight FROM nation), e AS (SELECT *, weight * 100 / SUM(weight) OVER (PARTITION BY n_regionkey)::DOUBLE AS exact FROM w),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY exact - FLOOR(exact) DESC, n_nationkey) AS i, SUM(FLOOR(exact)) OVER (PARTITION BY n_regionkey) AS base FROM e)
SELECT n_nationkey, (FLOOR(exact) + CASE WHEN i <= 100 - base THEN 1 ELSE 0 END)::BIGINT AS maximum FROM r""")
def effective_maxima(spark: SparkSession, d: str) -> DataFrame:
    w = load(spark, d, "nation").withColumn("weight", F.col("n_nationkey") * 7 % 11 + 1)
    return w.select("n_nationkey", apportioned(F.col("weight"), ["n_regionkey"], ["n_nationkey"]).alias("maximum"))


@catalog.query("config_versions", "WITH v AS (SELECT user_id % 5 AS name, event_id AS version, value AS low, value + (event_id % 3 - 0.5) * 10 AS high FROM events) SELECT name, version, low, high FROM v WHERE low < high AND high <= 100 QUALIFY ROW_NUMBER() OVER (PARTITION BY name ORDER BY version DESC) = 1")
def config_versions(spark: SparkSession, d: str) -> DataFrame:
    """The latest version of each configuration whose thresholds ascend and stay in range; others were never in force."""
    v = load(spark, d, "events").select((F.col("user_id") % 5).alias("name"), F.col("event_id").alias("version"), F.col("value").alias("low"), (F.col("value") + (F.col("event_id") % 3 - F.lit(0.5)) * 10).alias("high"))
    best = F.max(F.struct("version", "low", "high")).alias("b")
    return v.where("low < high and high <= 100").groupBy("name").agg(best).select("name", "b.version", "b.low", "b.high")


@catalog.query("topic_of_day", """
WITH s AS (SELECT user_id AS account, ts::DATE AS day, event_type AS topic, COUNT(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL),
f AS (SELECT account, day, topic, n, ROW_NUMBER() OVER (PARTITION BY account, day ORDER BY n DESC, topic) AS i FROM s), t AS (SELECT account, day, topic FROM f WHERE i = 1)
SELECT account, day::VARCHAR AS day, topic, topic = LAG(topic) OVER (PARTITION BY account ORDER BY day) AND day - LAG(day) OVER (PARTITION BY account ORDER BY day) <= 2 AS conflict FROM t""")
def topic_of_day(spark: SparkSession, d: str) -> DataFrame:
    """A topic for each account and day, the one asked for most, and whether it repeats that of a slot close before."""
    e = load(spark, d, "events").where("event_type <> 'error'")
    n = e.groupBy(F.col("user_id").alias("account"), F.to_date("ts").alias("day"), F.col("event_type").alias("topic")).agg(F.count("*").alias("n"))
    t = n.groupBy("account", "day").agg(F.min(F.struct((-F.col("n")).alias("n"), "topic")).alias("b")).select("account", "day", "b.topic")
    w = Window.partitionBy("account").orderBy("day")
    return t.select("account", F.col("day").cast("string").alias("day"), "topic", ((F.col("topic") == F.lag("topic").over(w)) & (F.datediff("day", F.lag("day").over(w)) <= 2)).alias("conflict"))


@catalog.query("style_rules", """
WITH s AS (SELECT source, AVG(CASE WHEN contains(text, '!') THEN 1.0 ELSE 0 END) AS shouts, AVG(CASE WHEN contains(text, '?') THEN 1.0 ELSE 0 END) AS asks, AVG(CASE WHEN regexp_matches(text, '[0-9]') THEN 1.0 ELSE 0 END) AS counts FROM documents GROUP BY source)
SELECT source, concat_ws(',', CASE WHEN shouts >= 0.4 THEN 'shouts' WHEN shouts <= 0.1 THEN 'no shouts' END, CASE WHEN asks >= 0.4 THEN 'asks' WHEN asks <= 0.1 THEN 'no asks' END, CASE WHEN counts >= 0.4 THEN 'counts' WHEN counts <= 0.1 THEN 'no counts' END) AS rules FROM s""")
def style_rules(spark: SparkSession, d: str) -> DataFrame:
    """What two fifths of an account's texts do is a rule, what a tenth or less do is to be avoided."""
    t = F.col("text")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    s = load(spark, d, "documents").groupBy("source").agg(share(t.contains("!")).alias("shouts"), share(t.contains("?")).alias("asks"), share(t.rlike("[0-9]")).alias("counts"))
    rule = lambda k: F.when(F.col(k) >= 0.4, k).when(F.col(k) <= 0.1, f"no {k}")
    return s.select("source", F.concat_ws(",", *map(rule, ("shouts", "asks", "counts"))).alias("rules"))


# ------------------------------------------------------------------------------------ desks and accounts


@catalog.query("owner_stamp", "SELECT o_orderkey, COALESCE(arg_max(l_suppkey, (l_shipdate, l_linenumber)) FILTER (WHERE l_shipdate <= o_orderdate + INTERVAL 400 DAY), -1) AS owner FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY o_orderkey")
def owner_stamp(spark: SparkSession, d: str) -> DataFrame:
    """Conversions with who owned the lead then: the latest touch up to that time, of equal ones the first as stored, which
    is what SQL engines that read in order return; so it is the same whatever partitions rows come in."""
    o = load(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    l = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_linenumber", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))
    touched = (F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("interval 400 days")) & F.col("l_suppkey").isNotNull()
    shipped = F.expr("l_shipdate - timestamp_ntz'1970-01-01'")  # as written, whatever the session's time zone
    first = F.when(touched, F.struct((-shipped).alias("at"), (-F.col("l_linenumber")).alias("line"), "path", "row"))
    return o.join(l, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderkey").agg(F.coalesce(F.min_by("l_suppkey", first), F.lit(-1)).alias("owner"))


@catalog.query("briefing", "WITH n AS (SELECT COUNT(DISTINCT user_id) AS users, COUNT(*) FILTER (WHERE event_type = 'purchase') AS won, COUNT(*) FILTER (WHERE event_type = 'error') AS errors FROM events) SELECT concat_ws(' ', users || ' users,', won || ' purchases.', CASE WHEN errors > 0 THEN errors || ' errors need a look.' END) AS text FROM n")
def briefing(spark: SparkSession, d: str) -> DataFrame:
    """A short text from numbers; what is zero isn't mentioned."""
    u = load(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("w"), F.count_if(F.col("event_type") == "error").alias("e"))
    n = u.agg(F.count("*").alias("users"), F.coalesce(F.sum("w"), F.lit(0)).alias("won"), F.coalesce(F.sum("e"), F.lit(0)).alias("errors"))
    said = lambda c, text: F.concat(F.col(c).cast("string"), F.lit(text))
    return n.select(F.concat_ws(" ", said("users", " users,"), said("won", " purchases."), F.when(F.col("errors") > 0, said("errors", " errors need a look."))).alias("text"))


@catalog.query("capability_blocks", "SELECT user_id, kind, seen_at FROM (SELECT user_id, event_type AS kind, ts AS seen_at, value, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1 AND value < 20")
def capability_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Capabilities whose latest state is not available."""
    best = F.max(F.struct("ts", "event_id", "value")).alias("b")
    e = load(spark, d, "events").groupBy("user_id", F.col("event_type").alias("kind")).agg(best)
    return e.where("b.value < 20").select("user_id", "kind", F.col("b.ts").alias("seen_at"))


@catalog.query("last_touch_owner", """
WITH h AS (SELECT o_custkey, o_orderkey % 25 AS account, o_orderdate FROM orders WHERE o_orderstatus <> 'P'), last AS (SELECT o_custkey, arg_max(account, (o_orderdate, account)) AS account FROM h GROUP BY o_custkey),
n AS (SELECT account, COUNT(*) AS held FROM last GROUP BY account)
SELECT c_custkey, COALESCE(CASE WHEN held <= 70 THEN last.account END, c_nationkey)::BIGINT AS account, last.account IS NOT NULL AND held <= 70 AS sticky FROM customer LEFT JOIN last ON o_custkey = c_custkey LEFT JOIN n ON n.account = last.account""")
def last_touch_owner(spark: SparkSession, d: str, capacity: int = 70) -> DataFrame:
    """A lead stays with the account that touched it last while that has room; else it goes to its area's account."""
    o = load(spark, d, "orders").where("o_orderstatus <> 'P'").withColumn("account", F.col("o_orderkey") % 25)
    last = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("account", F.struct("o_orderdate", "account")).alias("account"))
    last = last.join(last.groupBy("account").agg(F.count("*").alias("held")), "account")
    stays = F.col("account").isNotNull() & (F.col("held") <= capacity)
    return load(spark, d, "customer").join(last, "c_custkey", "left").select("c_custkey", F.when(stays, F.col("account")).otherwise(F.col("c_nationkey").cast("long")).alias("account"), F.coalesce(stays, F.lit(False)).alias("sticky"))


@catalog.query("work_queue", f"WITH u AS (SELECT user_id, MAX(value) AS score, MAX(ts) AS latest, COUNT(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY user_id) SELECT user_id, score, errors FROM u WHERE errors < 20 AND latest >= TIMESTAMP '{NOW}' - INTERVAL 2 DAY ORDER BY score DESC, latest, user_id LIMIT 25")
def work_queue(spark: SparkSession, d: str) -> DataFrame:
    u = load(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("score"), F.max(F.col("ts").cast("timestamp")).alias("latest"), F.count_if(F.col("event_type") == "error").alias("errors"))
    rows = u.where((F.col("errors") < 20) & (F.col("latest") >= now() - F.expr("interval 2 days")))
    return rows.orderBy(F.desc("score"), "latest", "user_id").limit(25).select("user_id", "score", "errors")


@catalog.query("metric_merge", "SELECT c_custkey, COALESCE(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal * 2 END, c_acctbal) AS balance, COALESCE(CASE WHEN c_custkey % 5 = 0 THEN 'NEW' END, c_mktsegment) AS segment FROM customer")
def metric_merge(spark: SparkSession, d: str) -> DataFrame:
    """New values that are known over old ones."""
    c, k = load(spark, d, "customer"), F.col("c_custkey")
    fresh = c.select("c_custkey", F.when(k % 3 == 0, F.col("c_acctbal") * 2).alias("b"), F.when(k % 5 == 0, "NEW").alias("s"))
    return c.join(fresh, "c_custkey", "left").select("c_custkey", F.coalesce("b", "c_acctbal").alias("balance"), F.coalesce("s", "c_mktsegment").alias("segment"))


@catalog.query("gated_signals", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'complaint' WHEN value < 5 THEN 'idle' END AS reason, event_type <> 'error' AND value >= 5 AS scored FROM events")
def gated_signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals without an intent to buy are kept with the reason and never scored."""
    reason = F.when(F.col("event_type") == "error", "complaint").when(F.col("value") < 5, "idle")
    return load(spark, d, "events").select("event_id", reason.alias("reason")).withColumn("scored", F.col("reason").isNull())


@catalog.query("users_evaluated", f"SELECT {K} % 20 AS run, COUNT(DISTINCT user_id) AS users, COUNT(*) AS signals FROM events GROUP BY 1")
def users_evaluated(spark: SparkSession, d: str) -> DataFrame:
    per = load(spark, d, "events").groupBy((prop_k() % 20).alias("run"), "user_id").agg(F.count("*").alias("n"))
    return per.groupBy("run").agg(F.count("*").alias("users"), F.sum("n").alias("signals"))


@catalog.query("provenance", "SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'live' WHEN bool_or(event_type = 'signup') THEN 'imported' ELSE 'simulated' END AS provenance FROM events WHERE value > 97 GROUP BY user_id")
def provenance(spark: SparkSession, d: str, order: tuple[str, ...] = ("simulated", "imported", "live")) -> DataFrame:
    """The strongest origin of a lead's rows wins."""
    rank = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 1).otherwise(0)
    best = load(spark, d, "events").where("value > 97").groupBy("user_id").agg(F.max(rank).alias("r"))
    return best.select("user_id", F.get(F.array(*map(F.lit, order)), F.col("r")).alias("provenance"))


@catalog.query("corpus_union", """
WITH a AS (SELECT doc_id, source, 1 AS side FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, 'other' AS source, 2 AS side FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, arg_min(source, side) AS source, COUNT(*) AS parts FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id""")
def corpus_union(spark: SparkSession, d: str) -> DataFrame:
    """Two corpora by key: fields of the first one win, parts are counted."""
    docs = load(spark, d, "documents")
    a = docs.where("doc_id % 3 <> 0").select("doc_id", "source", F.lit(1).alias("side"))
    b = docs.where("doc_id % 2 = 0").select("doc_id", F.lit("other").alias("source"), F.lit(2).alias("side"))
    return a.unionByName(b).groupBy("doc_id").agg(F.min_by("source", "side").alias("source"), F.count("*").alias("parts"))


@catalog.query("latest_brief", "SELECT user_id, MAX(ts) AS at, arg_max(value, (ts, event_id)) AS value FROM events WHERE value > 10 AND event_type = 'view' GROUP BY user_id")
def latest_brief(spark: SparkSession, d: str) -> DataFrame:
    """The latest brief that has data."""
    e = load(spark, d, "events").where("value > 10 and event_type = 'view'")
    return e.groupBy("user_id").agg(F.max("ts").alias("at"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@catalog.query("query_upsert", """
WITH old AS (SELECT DISTINCT p_name AS key, bool_or(p_size > 10) OVER (PARTITION BY p_name) AS active, MAX(p_size) OVER (PARTITION BY p_name) AS weight FROM part WHERE p_partkey % 2 = 0),
new AS (SELECT p_name AS key, MAX(p_size) AS weight FROM part WHERE p_partkey % 3 = 0 GROUP BY p_name)
SELECT CASE WHEN old.key IS NULL THEN 'created' WHEN NOT active THEN 'reactivated' WHEN old.weight <> new.weight THEN 'updated' ELSE 'unchanged' END AS outcome, COUNT(*) AS n FROM new LEFT JOIN old USING (key) GROUP BY 1""")
def query_upsert(spark: SparkSession, d: str) -> DataFrame:
    """What an upsert by text key does: rows created, updated, reactivated and unchanged."""
    p = load(spark, d, "part")
    old = p.where("p_partkey % 2 = 0").groupBy(F.col("p_name").alias("key")).agg(F.bool_or(F.col("p_size") > 10).alias("active"), F.max("p_size").alias("had"))
    new = p.where("p_partkey % 3 = 0").groupBy(F.col("p_name").alias("key")).agg(F.max("p_size").alias("weight"))
    outcome = F.when(F.col("had").isNull(), "created").when(~F.col("active"), "reactivated").when(F.col("had") != F.col("weight"), "updated").otherwise("unchanged")
    return new.join(old, "key", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@catalog.query("profile_research", f"WITH e AS (SELECT user_id, COUNT(*) FILTER (WHERE event_type = 'signup' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 20 DAY) AS local, COUNT(*) FILTER (WHERE event_type = 'error') AS industry, MAX(value) AS best FROM events GROUP BY user_id) SELECT user_id, local > 10 AS verified, FLOOR(LEAST(100, best * 0.8 + CASE WHEN local > 10 THEN 8 ELSE 0 END - CASE WHEN industry > 15 THEN 20 ELSE 0 END) + 0.5)::BIGINT AS score FROM e")
def profile_research(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of a profile appended and the lead scored anew; notes that are too old are ignored."""
    fresh = (F.col("event_type") == "signup") & (F.col("ts").cast("timestamp") >= now() - F.expr("interval 20 days"))
    e = load(spark, d, "events").groupBy("user_id").agg(F.count_if(fresh).alias("local"), F.count_if(F.col("event_type") == "error").alias("industry"), F.max("value").alias("best"))
    score = F.col("best") * 0.8 + F.when(F.col("local") > 10, 8).otherwise(0) - F.when(F.col("industry") > 15, 20).otherwise(0)
    return e.select("user_id", (F.col("local") > 10).alias("verified"), F.floor(F.least(F.lit(100.0), score) + 0.5).alias("score"))


@catalog.query("latest_appointment_event", """
WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS latest, COUNT(*) FILTER (WHERE event_type = 'signup') AS proposed FROM events GROUP BY user_id)
SELECT user_id, CASE latest WHEN 'purchase' THEN 'visited' WHEN 'error' THEN 'no_show' WHEN 'signup' THEN 'proposed' WHEN 'click' THEN 'confirmed' ELSE 'cancelled' END AS state, proposed FROM s""")
def latest_appointment_event(spark: SparkSession, d: str) -> DataFrame:
    """Appointments as the latest event of their log, and how often one was proposed."""
    s = load(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"), F.count_if(F.col("event_type") == "signup").alias("proposed"))
    state = F.when(F.col("latest") == "purchase", "visited").when(F.col("latest") == "error", "no_show").when(F.col("latest") == "signup", "proposed").when(F.col("latest") == "click", "confirmed").otherwise("cancelled")
    return s.select("user_id", state.alias("state"), "proposed")
