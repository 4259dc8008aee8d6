"""Scans, predicates, joins, aggregates, windows, sorts and set operations over the activity and order tables.

`now` is always a literal; every query takes the tables of one data folder and leaves the physical plan to Spark.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.catalog import Catalog
from millrace.functions.columns import ascii_bounds, depth_of, half_up, matches, overlaps, ratio
from millrace.io import load

catalog = Catalog()
QUERIES, ORACLE_SQL = catalog.queries, catalog.sql

NOW = "2024-01-31 00:00:00"
STAGES = ("view", "click", "signup", "purchase")
K = "CAST(json_extract(props, '$.k') AS BIGINT)"


def prop_k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("long")


@catalog.query("scan_filter_sort", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 10")
def scan_filter_sort(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders").where(matches(o_orderstatus="F") & (F.col("o_totalprice") > 300000))
    return rows.select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(100)


@catalog.query("count_where", "SELECT COUNT(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 10")
def count_where(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").where(matches(l_returnflag="R") & (F.col("l_quantity") < 10)).agg(F.count("*").alias("n"))


@catalog.query("rebase_time", f"SELECT event_id, ts + (TIMESTAMP '{NOW}' - INTERVAL 1 HOUR - MAX(ts) OVER ()) AS ts FROM events")
def rebase_time(spark: SparkSession, d: str) -> DataFrame:
    """All times shifted so that the newest lies an hour before now; the newest is one scalar, not a global window."""
    e = load(spark, d, "events")
    shift = F.unix_micros(F.lit(NOW).cast("timestamp")) - 3_600_000_000 - F.unix_micros("newest")
    newest = e.agg(F.max("ts").cast("timestamp").alias("newest")).select(shift.alias("shift"))
    moved = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("shift"))
    return e.select("event_id", "ts").join(F.broadcast(newest)).select("event_id", moved.cast("timestamp_ntz").alias("ts"))


@catalog.query("token_search_topk", r"""
SELECT doc_id, (LEAST(len(regexp_extract_all(lower(text), '\bthe\b')), 3) + LEAST(len(regexp_extract_all(lower(text), '\bque\b')), 3) + LEAST(len(regexp_extract_all(lower(text), '\bder\b')), 3))::BIGINT AS score
FROM documents WHERE regexp_matches(lower(text), '\b(the|que|der)\b') ORDER BY score DESC, doc_id LIMIT 20""")
def token_search_topk(spark: SparkSession, d: str, tokens: tuple[str, ...] = ("the", "que", "der"), k: int = 20) -> DataFrame:
    """Occurrences of each token count up to three; the best k documents."""
    text = F.lower("text")
    score = sum((F.least(F.regexp_count(text, F.lit(ascii_bounds(rf"\b{t}\b"))), F.lit(3)) for t in tokens), F.lit(0)).cast("long")
    return load(spark, d, "documents").select("doc_id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(k)


@catalog.query("filter_conjunction", "SELECT event_id, event_type FROM events WHERE event_type IN ('signup', 'purchase') AND user_id = 3 AND props IS NOT NULL")
def filter_conjunction(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").where(matches(event_type=["signup", "purchase"], user_id=3) & F.col("props").isNotNull()).select("event_id", "event_type")


@catalog.query("scoped_filter_semi", f"""
SELECT c_custkey, c_name FROM customer c WHERE lower(c_mktsegment) = 'building' AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O')
AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def scoped_filter_semi(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer").where(F.lower("c_mktsegment") == "building")
    o = load(spark, d, "orders").where("o_orderstatus = 'O'")
    n = load(spark, d, "nation").where("n_regionkey = 1")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").join(n, c.c_nationkey == n.n_nationkey, "left_semi").select("c_custkey", "c_name")


@catalog.query("window_filter", "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-17'")
def window_filter(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").where((F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-17").cast("timestamp_ntz"))).select("event_id", "user_id")


def transitions(spark: SparkSession, d: str) -> DataFrame:
    """Each user's stage changes: the event before and the event, in order of time and id."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, d, "events").select("user_id", "event_id", "ts", F.lag("event_type").over(w).alias("from_stage"), F.col("event_type").alias("to_stage"))


TRANSITIONS_SQL = "t AS (SELECT user_id, event_id, ts, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_stage, event_type AS to_stage FROM events)"
DEPTH_SQL = "CASE {} WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE -1 END"


@catalog.query("stage_entered_counts", f"""
WITH {TRANSITIONS_SQL}, s AS (SELECT user_id, {DEPTH_SQL.format('from_stage')} AS f, {DEPTH_SQL.format('to_stage')} AS g, from_stage, to_stage FROM t), st(stage, i) AS (VALUES ('view', 0), ('click', 1), ('signup', 2))
SELECT st.stage, COUNT(DISTINCT s.user_id) AS users FROM st LEFT JOIN s ON s.g >= st.i AND s.to_stage NOT IN ('purchase', 'error') AND (s.from_stage IS NULL OR s.from_stage = 'error' OR s.f < st.i)
GROUP BY st.stage UNION ALL SELECT 'purchase', COUNT(DISTINCT user_id) FROM s WHERE to_stage = 'purchase' UNION ALL SELECT 'error', COUNT(DISTINCT user_id) FROM s WHERE to_stage = 'error'""")
def stage_entered_counts(spark: SparkSession, d: str) -> DataFrame:
    """Users who entered each stage; forward jumps count for every stage crossed, terminal stages only explicitly."""
    s = transitions(spark, d).withColumns({"f": depth_of(F.col("from_stage"), STAGES), "g": depth_of(F.col("to_stage"), STAGES)})
    entered = [(F.col("g") >= i) & ~F.col("to_stage").isin("purchase", "error") & (F.col("from_stage").isNull() | (F.col("from_stage") == "error") | (F.col("f") < i)) for i in range(3)]
    entered += [F.col("to_stage") == "purchase", F.col("to_stage") == "error"]
    names = [*STAGES, "error"]
    per_user = s.groupBy("user_id").agg(*(F.max(F.when(c, 1).otherwise(0)).alias(n) for c, n in zip(entered, names, strict=True)))
    wide = per_user.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(n).alias("stage"), F.col(n).alias("users")) for n in names))))


@catalog.query("text_search_or_semi", """
SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%part 1%' OR lower(p_type) LIKE '%brass%' OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)""")
def text_search_or_semi(spark: SparkSession, d: str) -> DataFrame:
    """Any column contains the term, or a child row qualifies; the disjunction is a union of keys, not a nested loop."""
    p = load(spark, d, "part")
    hits = load(spark, d, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("hit", F.lit(True))
    named = F.lower("p_name").contains("part 1") | F.lower("p_type").contains("brass")
    return p.join(hits, "p_partkey", "left").where(named | F.col("hit").isNotNull()).select("p_partkey", "p_name")


@catalog.query("array_containment", "SELECT user_id, ts::DATE::VARCHAR AS day FROM events GROUP BY 1, 2 HAVING list_contains(list(DISTINCT event_type), 'purchase') AND NOT list_contains(list(DISTINCT event_type), 'error')")
def array_containment(spark: SparkSession, d: str) -> DataFrame:
    """Users and days whose kinds of events have a purchase and no error among them."""
    kinds = load(spark, d, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.collect_set("event_type").alias("kinds"))
    return kinds.where(F.array_contains("kinds", "purchase") & ~F.array_contains("kinds", "error")).select("user_id", "day")


@catalog.query("freshness_anti", f"""
SELECT e.event_id, e.user_id FROM events e WHERE e.event_type = 'view' AND e.ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY
AND NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts AND p.ts > e.ts - INTERVAL 12 HOUR)""")
def freshness_anti(spark: SparkSession, d: str) -> DataFrame:
    """Fresh views without a purchase of the same user in the 12 hours before."""
    e = load(spark, d, "events")
    views = e.where(f"event_type = 'view' and ts >= timestamp_ntz'{NOW}' - interval 7 day").select("event_id", "user_id", "ts")
    bought = e.where("event_type = 'purchase'").select(F.col("user_id").alias("u"), F.col("ts").alias("p_ts"))
    return views.join(bought, (views.user_id == bought.u) & (bought.p_ts <= views.ts) & (bought.p_ts > views.ts - F.expr("interval 12 hour")), "left_anti").select("event_id", "user_id")


@catalog.query("or_of_in_subqueries", """
SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)""")
def or_of_in_subqueries(spark: SparkSession, d: str) -> DataFrame:
    c, o = load(spark, d, "customer"), load(spark, d, "orders")
    keys = o.where("o_orderpriority = '1-URGENT' or o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    near = c.join(load(spark, d, "nation").where("n_regionkey = 0"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")
    return c.join(keys.union(near).distinct(), "c_custkey", "left_semi").select("c_custkey")


@catalog.query("chips_array", """
SELECT user_id, array_to_string(list_slice(list(event_type ORDER BY f), 1, 3), ',') AS chips
FROM (SELECT user_id, event_type, MIN(event_id) AS f FROM events WHERE event_type <> 'error' GROUP BY ALL) GROUP BY user_id""")
def chips_array(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values in order of first appearance, without the excluded code, three at most."""
    first = load(spark, d, "events").where("event_type <> 'error'").groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("f", "event_type"))), lambda x: x["event_type"])
    return first.groupBy("user_id").agg(F.concat_ws(",", F.slice(ordered, 1, 3)).alias("chips"))


# ------------------------------------------------------------------------------------------------ joins


@catalog.query("join_inner_multi", "SELECT r_name, n_name, COUNT(*) AS orders, ROUND(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def join_inner_multi(spark: SparkSession, d: str) -> DataFrame:
    """Orders are summed per customer before the small dimensions are joined."""
    per = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    dims = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    rows = per.join(load(spark, d, "customer"), "c_custkey").join(dims, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("r_name", "n_name").agg(F.sum("n").alias("orders"), F.round(F.sum("t"), 2).alias("total"))


@catalog.query("join_left", "SELECT c_custkey, COUNT(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
def join_left(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return load(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@catalog.query("join_coalesced_key", """
WITH x AS (SELECT l_orderkey, l_linenumber, COALESCE(CASE WHEN l_returnflag = 'R' THEN l_suppkey END, s2) AS k FROM lineitem LEFT JOIN (SELECT p_partkey, p_partkey % 10 + 1 AS s2 FROM part WHERE p_size > 25) ON l_partkey = p_partkey)
SELECT s_name, COUNT(*) AS n FROM x JOIN supplier ON k = s_suppkey GROUP BY s_name""")
def join_coalesced_key(spark: SparkSession, d: str) -> DataFrame:
    second = load(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") % 10 + 1).alias("s2"))
    x = load(spark, d, "lineitem").join(second, "l_partkey", "left")
    n = x.groupBy(F.coalesce(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey")), F.col("s2")).alias("s_suppkey")).agg(F.count("*").alias("n"))
    return n.join(load(spark, d, "supplier"), "s_suppkey").groupBy("s_name").agg(F.sum("n").alias("n"))


@catalog.query("join_semi", "SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount > 0.09 AND l_quantity > 45)")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    l = load(spark, d, "lineitem").where("l_discount > 0.09D and l_quantity > 45")
    return load(spark, d, "supplier").join(l, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey", "s_name")


@catalog.query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").where("o_totalprice > 200000")
    return load(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@catalog.query("join_null_safe", f"""
WITH e AS (SELECT user_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS kind, {K} AS k FROM events),
m AS (SELECT kind, MAX(k) AS top FROM e GROUP BY kind) SELECT COALESCE(m.kind, '') AS kind, COUNT(*) AS n FROM e JOIN m ON e.kind IS NOT DISTINCT FROM m.kind AND e.k = m.top GROUP BY 1""")
def join_null_safe(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select(F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"), prop_k().alias("k"))
    m = e.groupBy(F.col("kind").alias("kind_")).agg(F.max("k").alias("top"))
    return e.join(m, e.kind.eqNullSafe(m.kind_) & (e.k == m.top)).groupBy(F.coalesce("kind", F.lit("")).alias("kind")).agg(F.count("*").alias("n"))


@catalog.query("latest_per_key", "SELECT user_id, event_id, event_type FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    """An aggregate that combines before the shuffle, so a key with many rows sends one row a task."""
    best = F.max(F.struct("ts", "event_id", "event_type")).alias("b")
    return load(spark, d, "events").groupBy("user_id").agg(best).select("user_id", "b.event_id", "b.event_type")


def intervals(spark: SparkSession, d: str) -> DataFrame:
    """Orders as intervals of a customer, each open until the next."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return load(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("start_ts"), F.lead("o_orderdate").over(w).alias("end_ts"))


INTERVAL_SQL = "i AS (SELECT o_custkey, o_orderkey, o_orderdate AS start_ts, LEAD(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS end_ts FROM orders)"


@catalog.query("join_valid_at", f"WITH {INTERVAL_SQL}, q AS (SELECT c_custkey, TIMESTAMP '1997-01-01' + INTERVAL 1 DAY * (c_custkey % 700) AS seen FROM customer) SELECT c_custkey, o_orderkey FROM q JOIN i ON c_custkey = o_custkey AND start_ts <= seen AND (end_ts IS NULL OR end_ts >= seen)")
def join_valid_at(spark: SparkSession, d: str) -> DataFrame:
    q = load(spark, d, "customer").select("c_custkey", F.expr("timestamp_ntz'1997-01-01' + make_dt_interval(cast(c_custkey % 700 as int))").alias("at"))
    i = intervals(spark, d)
    return q.join(i, (q.c_custkey == i.o_custkey) & overlaps(i.start_ts, i.end_ts, q["at"], q["at"])).select("c_custkey", "o_orderkey")


@catalog.query("interval_overlap", f"WITH {INTERVAL_SQL} SELECT o_orderkey FROM i WHERE start_ts <= TIMESTAMP '1998-06-30' AND (end_ts IS NULL OR end_ts >= TIMESTAMP '1998-06-01')")
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("1998-06-01", "1998-06-30"))
    i = intervals(spark, d)
    return i.where(overlaps(i.start_ts, i.end_ts, lo, hi)).select("o_orderkey")


@catalog.query("valid_offers_at", """
WITH o AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'n/a' ELSE strftime(DATE '1998-01-01' + CAST(p_size AS INTEGER) * 5, '%Y-%m-%d') END AS f, strftime(DATE '1998-05-01' + CAST(p_size AS INTEGER) * 3, '%Y-%m-%d') AS u FROM part)
SELECT p_partkey FROM o WHERE try_strptime(f, '%Y-%m-%d') IS NOT NULL AND try_strptime(f, '%Y-%m-%d') - INTERVAL 8 HOUR <= TIMESTAMP '1998-06-15 02:00:00' AND TIMESTAMP '1998-06-15 02:00:00' < try_strptime(u, '%Y-%m-%d') + INTERVAL 1 DAY - INTERVAL 8 HOUR""")
def valid_offers_at(spark: SparkSession, d: str, now: str = "1998-06-15 02:00:00", tz: str = "Asia/Shanghai") -> DataFrame:
    """Offers whose date-only bounds, as whole local days, hold now; a bound that is no date fails closed."""
    p = load(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 7 == 0, "n/a").otherwise(F.date_add(F.lit("1998-01-01").cast("date"), F.col("p_size") * 5).cast("string")).alias("f"), F.date_add(F.lit("1998-05-01").cast("date"), F.col("p_size") * 3).cast("string").alias("u"))
    start = F.to_utc_timestamp(F.try_to_timestamp("f", F.lit("yyyy-MM-dd")), tz)
    end = F.to_utc_timestamp(F.try_to_timestamp("u", F.lit("yyyy-MM-dd")) + F.expr("interval 1 day"), tz)
    at = F.lit(now).cast("timestamp")
    return p.where((start <= at) & (at < end)).select("p_partkey")


@catalog.query("reply_rate_after_first_touch", """
WITH f AS (SELECT user_id, MIN(ts) AS first FROM events WHERE event_type = 'click' GROUP BY user_id), r AS (SELECT DISTINCT f.user_id FROM f JOIN events e ON e.user_id = f.user_id AND e.event_type = 'signup' AND e.ts >= f.first AND e.ts <= TIMESTAMP '2024-01-20')
SELECT COUNT(*) AS touched, (SELECT COUNT(*) FROM r) AS replied, FLOOR((SELECT COUNT(*) FROM r) / GREATEST(COUNT(*), 1)::DOUBLE * 10000 + 0.5) / 10000 AS rate FROM f""")
def reply_rate_after_first_touch(spark: SparkSession, d: str) -> DataFrame:
    """One pass: a user replied if the last reply up to the deadline isn't before the first touch."""
    u = load(spark, d, "events").groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "click", F.col("ts"))).alias("first"), F.max(F.when((F.col("event_type") == "signup") & (F.col("ts") <= F.lit("2024-01-20").cast("timestamp_ntz")), F.col("ts"))).alias("last"))
    n = u.where("first is not null").agg(F.count("*").alias("touched"), F.count(F.when(F.col("last") >= F.col("first"), 1)).alias("replied"))
    return n.select("touched", "replied", half_up(ratio(F.col("replied"), F.col("touched")), 4).alias("rate"))


@catalog.query("join_or_keys", "SELECT DISTINCT l_orderkey, s_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey OR l_partkey = s_suppkey WHERE l_quantity > 48")
def join_or_keys(spark: SparkSession, d: str) -> DataFrame:
    """Two equi-joins and a distinct instead of a nested loop; the row is split into its keys before one join."""
    l = load(spark, d, "lineitem").where("l_quantity > 48").select("l_orderkey", F.explode(F.array("l_suppkey", "l_partkey")).alias("s_suppkey"))
    return l.join(load(spark, d, "supplier").select("s_suppkey"), "s_suppkey").select("l_orderkey", "s_suppkey").distinct()


@catalog.query("fuzzy_lookup_best", """
WITH q(term) AS (VALUES ('brand#11'), ('brand#23'), ('standard'), ('economy')), m AS (SELECT term, p_partkey, p_size, p_retailprice, CASE WHEN lower(p_brand) = term THEN 3 WHEN lower(p_type) LIKE term || '%' THEN 2 ELSE 1 END AS r FROM q JOIN part ON lower(p_brand) = term OR lower(p_type) LIKE '%' || term || '%')
SELECT term, p_partkey, r FROM m QUALIFY ROW_NUMBER() OVER (PARTITION BY term ORDER BY r DESC, p_size DESC, p_retailprice, p_partkey) = 1""")
def fuzzy_lookup_best(spark: SparkSession, d: str, terms: tuple[str, ...] = ("brand#11", "brand#23", "standard", "economy")) -> DataFrame:
    """Canonical name before prefix before mention; the newest, then the cheapest. The terms are literals of the plan."""
    brand, kind = F.lower("p_brand"), F.lower("p_type")
    rank = lambda t: F.when(brand == t, 3).when(kind.startswith(t), 2).when(kind.contains(t), 1)
    m = load(spark, d, "part").select("p_partkey", F.inline(F.array(*(F.struct(F.lit(t).alias("term"), rank(t).alias("r"), "p_size", "p_retailprice") for t in terms)))).where("r is not null")
    best = F.max_by(F.struct("p_partkey", "r"), F.struct("r", "p_size", -F.col("p_retailprice"), -F.col("p_partkey"))).alias("b")
    return m.groupBy("term").agg(best).select("term", "b.p_partkey", "b.r")


@catalog.query("cross_best_match", """
WITH p(profile, seg, w) AS (VALUES ('a', 'BUILDING', 3), ('b', 'MACHINERY', 2), ('c', 'AUTOMOBILE', 1)), x AS (SELECT c_custkey, profile, CASE WHEN c_mktsegment = seg THEN 10 ELSE 0 END + w + CASE WHEN c_acctbal > 5000 * w THEN 5 ELSE 0 END AS score FROM customer, p)
SELECT c_custkey, profile, score FROM x QUALIFY ROW_NUMBER() OVER (PARTITION BY c_custkey ORDER BY score DESC, profile) = 1""")
def cross_best_match(spark: SparkSession, d: str) -> DataFrame:
    """Each row against every profile of a configured list: an array per row, no join and no shuffle."""
    profiles = (("a", "BUILDING", 3), ("b", "MACHINERY", 2), ("c", "AUTOMOBILE", 1))
    options = F.array(*(F.struct((F.when(F.col("c_mktsegment") == s, 10).otherwise(0) + w + F.when(F.col("c_acctbal") > 5000 * w, 5).otherwise(0)).alias("score"), F.lit(-i).alias("order"), F.lit(n).alias("profile")) for i, (n, s, w) in enumerate(profiles)))
    return load(spark, d, "customer").select("c_custkey", F.array_max(options).alias("b")).select("c_custkey", "b.profile", "b.score")


@catalog.query("correlated_counts", "SELECT n_nationkey, (SELECT COUNT(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT COUNT(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation")
def correlated_counts(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    s = load(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return load(spark, d, "nation").select("n_nationkey").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").na.fill(0)


@catalog.query("correlated_top1", "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS last_order FROM customer")
def correlated_top1(spark: SparkSession, d: str) -> DataFrame:
    last = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))
    return load(spark, d, "customer").select("c_custkey").join(last, "c_custkey", "left")


# ------------------------------------------------------------------------------------------ aggregates


@catalog.query("count_by_key", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type")
def count_by_key(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@catalog.query("group_by_json", f"SELECT {K} % 10 AS bucket, COUNT(*) AS n FROM events GROUP BY 1")
def group_by_json(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy((prop_k() % 10).alias("bucket")).agg(F.count("*").alias("n"))


@catalog.query("run_stats_by_query", "SELECT source, COUNT(*) AS docs, COALESCE(SUM(quality), 0)::BIGINT AS good, COALESCE(SUM(toxic), 0)::BIGINT AS toxic, MAX(n_chars) AS longest FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def run_stats_by_query(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select("doc_id", "source", "n_chars").join(load(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("docs"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.max("n_chars").alias("longest"))


@catalog.query("conditional_sums", "SELECT user_id, SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS purchases, SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors FROM events GROUP BY user_id")
def conditional_sums(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if(F.col("event_type") == "error").alias("errors"))


@catalog.query("funnel_movements", "SELECT " + ", ".join(f"COUNT(DISTINCT CASE WHEN event_type = '{t}' THEN user_id END) AS {t}_users" for t in (*STAGES, "error")) + " FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def funnel_movements(spark: SparkSession, d: str) -> DataFrame:
    """Conditional distinct counts by one aggregate per user and one over users, without an Expand."""
    kinds = (*STAGES, "error")
    per = load(spark, d, "events").where("ts >= timestamp_ntz'2024-01-10'").groupBy("user_id").agg(*(F.max((F.col("event_type") == t).cast("int")).alias(t) for t in kinds))
    return per.agg(*(F.coalesce(F.sum(t), F.lit(0)).alias(f"{t}_users") for t in kinds))


@catalog.query("count_distinct", "SELECT COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT event_type) AS kinds FROM events")
def count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("kinds"))


@catalog.query("sum_json_metrics", f"SELECT user_id, COALESCE(SUM({K} * 2 + 1), 0)::BIGINT AS metric FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id")
def sum_json_metrics(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").where(matches(event_type=["view", "click"])).groupBy("user_id").agg(F.coalesce(F.sum(prop_k() * 2 + 1), F.lit(0)).alias("metric"))


@catalog.query("first_touch_min", "SELECT user_id, MIN(ts) AS first_ts, MAX(ts) AS last_ts FROM events GROUP BY user_id")
def first_touch_min(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@catalog.query("argmax_row", "SELECT user_id, arg_max(event_type, (value, event_id)) AS kind, arg_max(event_id, (value, event_id)) AS event_id FROM events GROUP BY user_id")
def argmax_row(spark: SparkSession, d: str) -> DataFrame:
    best = F.max_by(F.struct(F.col("event_type").alias("kind"), "event_id"), F.struct("value", "event_id")).alias("b")
    return load(spark, d, "events").groupBy("user_id").agg(best).select("user_id", "b.kind", "b.event_id")


@catalog.query("weighted_pipeline", f"""
WITH d AS (SELECT user_id, MAX({DEPTH_SQL.format('event_type')}) AS depth, SUM(value) AS v FROM events GROUP BY user_id), s(stage, depth, p) AS (VALUES ('view', 0, 0.05), ('click', 1, 0.15), ('signup', 2, 0.4), ('purchase', 3, 1.0))
SELECT stage, COUNT(d.user_id) AS users, FLOOR(COALESCE(ROUND(SUM(v), 4), 0) * p::DOUBLE + 0.5) AS weighted FROM s LEFT JOIN d ON s.depth = d.depth GROUP BY stage, p""")
def weighted_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Value of each stage by its probability; stages without users stay as zero rows."""
    odds = (0.05, 0.15, 0.4, 1.0)
    per = load(spark, d, "events").groupBy("user_id").agg(F.max(depth_of(F.col("event_type"), STAGES)).alias("depth"), F.sum("value").alias("v"))
    by = per.groupBy("depth").agg(F.count("*").alias("users"), F.round(F.sum("v"), 4).alias("v"))
    stages = spark.createDataFrame([(s, i, p) for i, (s, p) in enumerate(zip(STAGES, odds, strict=True))], "stage string, depth int, p double")
    return stages.join(by, "depth", "left").select("stage", F.coalesce("users", F.lit(0)).alias("users"), half_up(F.coalesce("v", F.lit(0.0)) * F.col("p")).alias("weighted"))


@catalog.query("style_profile", """
SELECT source, FLOOR(quantile_cont(n_chars, 0.25) * 100 + 0.5) / 100 AS p25, FLOOR(quantile_cont(n_chars, 0.5) * 100 + 0.5) / 100 AS p50, FLOOR(quantile_cont(n_chars, 0.75) * 100 + 0.5) / 100 AS p75, FLOOR(AVG(CASE WHEN contains(text, chr(10)) THEN 1.0 ELSE 0.0 END) * 10000 + 0.5) / 10000 AS multi_line FROM documents GROUP BY source""")
def style_profile(spark: SparkSession, d: str) -> DataFrame:
    q = F.percentile("n_chars", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = load(spark, d, "documents").groupBy("source").agg(q.alias("q"), F.avg(F.col("text").contains("\n").cast("double")).alias("m"))
    return rows.select("source", *(half_up(F.col("q")[i], 2).alias(n) for i, n in enumerate(("p25", "p50", "p75"))), half_up(F.col("m"), 4).alias("multi_line"))


@catalog.query("top_terms", r"""
WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS term FROM documents), c AS (SELECT lang, term, COUNT(*) AS n FROM t GROUP BY ALL HAVING COUNT(*) >= 2)
SELECT lang, term, n FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY lang ORDER BY n DESC, term) <= 10""")
def top_terms(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    t = load(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0)).alias("term"))
    c = t.groupBy("lang", "term").agg(F.count("*").alias("n")).where("n >= 2")
    return c.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "term"))).where(F.col("r") <= k).drop("r")


@catalog.query("score_bands", f"""
WITH u AS (SELECT user_id, SUM(value) AS v, MAX({DEPTH_SQL.format('event_type')}) AS d FROM events GROUP BY user_id), b AS (SELECT CASE WHEN v >= 4000 THEN 'high' WHEN v >= 2000 THEN 'middle' ELSE 'low' END AS band, d FROM u)
SELECT band, COUNT(*) AS users, COUNT(*) FILTER (WHERE d >= 2) AS signed, COUNT(*) FILTER (WHERE d >= 3) AS bought, FLOOR(COUNT(*) FILTER (WHERE d >= 3) / COUNT(*)::DOUBLE * 10000 + 0.5) / 10000 AS rate FROM b GROUP BY band""")
def score_bands(spark: SparkSession, d: str) -> DataFrame:
    u = load(spark, d, "events").groupBy("user_id").agg(F.sum("value").alias("v"), F.max(depth_of(F.col("event_type"), STAGES)).alias("d"))
    band = F.when(F.col("v") >= 4000, "high").when(F.col("v") >= 2000, "middle").otherwise("low")
    n = u.groupBy(band.alias("band")).agg(F.count("*").alias("users"), F.count_if(F.col("d") >= 2).alias("signed"), F.count_if(F.col("d") >= 3).alias("bought"))
    return n.withColumn("rate", half_up(ratio(F.col("bought"), F.col("users")), 4))


@catalog.query("pillar_signals", """
WITH p AS (SELECT l_shipdate::DATE AS day, l_returnflag AS pillar, l_quantity FROM lineitem), s AS (SELECT pillar, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS q FROM p GROUP BY pillar)
SELECT pillar, n, q, CASE WHEN n < 100 THEN 'keep' WHEN q / n >= MAX(q / n) OVER () * 0.999 THEN 'increase' WHEN q / n < MAX(q / n) OVER () * 0.99 THEN 'decrease' ELSE 'keep' END AS signal FROM s""")
def pillar_signals(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("pillar")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))
    share = F.col("q") / F.col("n")
    best = F.max(share).over(Window.partitionBy(F.lit(1)))  # over the few pillars
    signal = F.when(F.col("n") < 100, "keep").when(share >= best * 0.999, "increase").when(share < best * 0.99, "decrease").otherwise("keep")
    return s.select("pillar", "n", "q", signal.alias("signal"))


@catalog.query("zero_filled_counts", "SELECT k.kind, COUNT(e.event_id) AS n FROM (VALUES ('view'), ('click'), ('refund'), ('error')) k(kind) LEFT JOIN events e ON e.event_type = k.kind GROUP BY k.kind")
def zero_filled_counts(spark: SparkSession, d: str) -> DataFrame:
    kinds = spark.createDataFrame([(k,) for k in ("view", "click", "refund", "error")], "kind string")
    n = load(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return kinds.join(n, "kind", "left").na.fill(0)


# ---------------------------------------------------------------------------------- windows and sorts


@catalog.query("first_touch", "SELECT user_id, event_id, event_type FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def first_touch(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy("user_id").agg(F.min(F.struct("ts", "event_id", "event_type")).alias("b")).select("user_id", "b.event_id", "b.event_type")


@catalog.query("primary_signal", "SELECT user_id, event_id FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase') DESC, value DESC, ts DESC, event_id DESC) = 1")
def primary_signal(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct((F.col("event_type") == "purchase").alias("p"), "value", "ts", "event_id")
    return load(spark, d, "events").groupBy("user_id").agg(F.max(order)["event_id"].alias("event_id"))


@catalog.query("trend_windows", """
WITH w AS (SELECT event_type AS term, COUNT(DISTINCT user_id) FILTER (WHERE ts >= TIMESTAMP '2024-01-24') AS cur, COUNT(DISTINCT user_id) FILTER (WHERE ts < TIMESTAMP '2024-01-24') AS prev FROM events WHERE ts >= TIMESTAMP '2024-01-17' AND ts <= TIMESTAMP '2024-01-31' GROUP BY 1)
SELECT term, cur, prev, FLOOR((cur - prev) / GREATEST(1, prev)::DOUBLE * 100 + 0.5) / 100 AS change FROM w WHERE cur >= 2 OR prev >= 2""")
def trend_windows(spark: SparkSession, d: str) -> DataFrame:
    """Users per term in the current and the previous window; a user counts once a term and window."""
    e = load(spark, d, "events").where("ts >= timestamp_ntz'2024-01-17' and ts <= timestamp_ntz'2024-01-31'")
    now = F.col("ts") >= F.lit("2024-01-24").cast("timestamp_ntz")
    per = e.groupBy(F.col("event_type").alias("term"), "user_id").agg(F.max(now.cast("int")).alias("c"), F.max((~now).cast("int")).alias("p"))
    n = per.groupBy("term").agg(F.sum("c").alias("cur"), F.sum("p").alias("prev")).where("cur >= 2 or prev >= 2")
    return n.withColumn("change", half_up((F.col("cur") - F.col("prev")) / F.greatest(F.lit(1), F.col("prev")), 2))


@catalog.query("rolling_performance", "SELECT user_id, " + ", ".join(f"COUNT(*) FILTER (WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL {n} DAY) AS n_{n}d, ROUND(COALESCE(SUM(value) FILTER (WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL {n} DAY), 0), 4) AS v_{n}d" for n in (7, 14, 30)) + f" FROM events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY user_id")
def rolling_performance(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").where(f"ts <= timestamp_ntz'{NOW}'")
    since = {n: F.col("ts") >= F.expr(f"timestamp_ntz'{NOW}' - interval {n} day") for n in (7, 14, 30)}
    return e.groupBy("user_id").agg(*(c for n, s in since.items() for c in (F.count_if(s).alias(f"n_{n}d"), F.round(F.coalesce(F.sum(F.when(s, F.col("value"))), F.lit(0.0)), 4).alias(f"v_{n}d"))))


@catalog.query("unanswered_since", "WITH i AS (SELECT user_id, MAX(ts) AS last FROM events WHERE event_type = 'signup' GROUP BY user_id) SELECT e.user_id, COUNT(*) FILTER (WHERE e.event_type = 'click' AND (i.last IS NULL OR e.ts > i.last)) AS unanswered FROM events e LEFT JOIN i ON e.user_id = i.user_id GROUP BY e.user_id")
def unanswered_since(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    last = e.where("event_type = 'signup'").groupBy("user_id").agg(F.max("ts").alias("last"))
    rows = e.join(last, "user_id", "left")
    return rows.groupBy("user_id").agg(F.count_if((F.col("event_type") == "click") & (F.col("last").isNull() | (F.col("ts") > F.col("last")))).alias("unanswered"))


@catalog.query("cannibalisation_conflicts", """
SELECT a.l_orderkey AS a, b.l_orderkey AS b, a.l_partkey AS part FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_orderkey < b.l_orderkey AND abs(date_diff('day', a.l_shipdate::DATE, b.l_shipdate::DATE)) <= 3""")
def cannibalisation_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one topic at most three days apart: joined on day buckets, so a busy topic spreads over its days."""
    l = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("day"))
    bucket = F.floor(F.unix_date("day") / 4)
    a = l.withColumn("k", bucket)
    b = l.select(F.col("l_orderkey").alias("b"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("day").alias("b_day"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bk"))
    near = (a.l_partkey == b.p) & (a.l_suppkey == b.s) & (a.k == b.bk) & (a.l_orderkey < b.b) & (F.abs(F.datediff(a.day, b.b_day)) <= 3)
    return a.join(b, near).select(F.col("l_orderkey").alias("a"), "b", F.col("l_partkey").alias("part"))


@catalog.query("repeat_comments", "SELECT doc_id FROM documents QUALIFY ROW_NUMBER() OVER (PARTITION BY source, md5(text) ORDER BY doc_id) > 1")
def repeat_comments(spark: SparkSession, d: str) -> DataFrame:
    """All but the earliest copy of one author's text: keys carry digests, and only the earliest ids are joined back."""
    docs = load(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("digest"))
    first = docs.groupBy("source", "digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return docs.join(first, ["source", "digest"]).where("doc_id > first").select("doc_id")


@catalog.query("inbox_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def inbox_page(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50)


@catalog.query("order_by_case", "SELECT event_id, event_type FROM events ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, event_id LIMIT 100")
def order_by_case(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    return load(spark, d, "events").select("event_id", "event_type").orderBy(rank, "event_id").limit(100)


@catalog.query("nulls_last_order", "SELECT user_id, last FROM (SELECT user_id, MAX(ts) FILTER (WHERE event_type = 'purchase' AND value > 90) AS last FROM events GROUP BY user_id) ORDER BY last IS NULL, last, user_id LIMIT 40")
def nulls_last_order(spark: SparkSession, d: str) -> DataFrame:
    last = F.max(F.when((F.col("event_type") == "purchase") & (F.col("value") > 90), F.col("ts"))).alias("last")
    return load(spark, d, "events").groupBy("user_id").agg(last).orderBy(F.asc_nulls_last("last"), "user_id").limit(40)


@catalog.query("best_example", "SELECT source, doc_id FROM documents QUALIFY ROW_NUMBER() OVER (PARTITION BY source ORDER BY (lang = 'en') DESC, n_chars, doc_id) = 1")
def best_example(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct((F.col("lang") != "en").alias("other"), "n_chars", "doc_id")
    return load(spark, d, "documents").groupBy("source").agg(F.min(order)["doc_id"].alias("doc_id"))


@catalog.query("typical_examples", """
WITH m AS (SELECT source, median(n_chars) AS mc FROM documents GROUP BY source), x AS (SELECT d.source, d.doc_id, abs(d.n_chars - m.mc) AS dist FROM documents d JOIN m USING (source))
SELECT source, doc_id, dist FROM x QUALIFY ROW_NUMBER() OVER (PARTITION BY source ORDER BY dist, doc_id) <= 3""")
def typical_examples(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("source", "doc_id", "n_chars")
    m = docs.groupBy("source").agg(F.percentile("n_chars", F.lit(0.5)).alias("mc"))
    x = docs.join(m, "source").select("source", "doc_id", F.abs(F.col("n_chars") - F.col("mc")).alias("dist"))
    return x.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("dist", "doc_id"))).where("r <= 3").drop("r")


@catalog.query("explore_exploit_topk", """
WITH s AS (SELECT s_suppkey, COUNT(l_orderkey) AS runs, ROUND(COALESCE(SUM(l_quantity), 0), 2) AS yield FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity > 49.5 GROUP BY s_suppkey),
r AS (SELECT s_suppkey, runs > 5 AS seen, ROW_NUMBER() OVER (PARTITION BY runs > 5 ORDER BY yield DESC, s_suppkey) AS i FROM s)
SELECT s_suppkey, CASE WHEN seen THEN i + FLOOR((i - 1) / 3) ELSE 4 * i END::BIGINT AS slot FROM r WHERE CASE WHEN seen THEN i + FLOOR((i - 1) / 3) ELSE 4 * i END <= 12""")
def explore_exploit_topk(spark: SparkSession, d: str, slots: int = 12) -> DataFrame:
    """Slots in blocks of four: three for the best known, one for the best that has hardly been tried."""
    n = load(spark, d, "lineitem").where("l_quantity > 49.5").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("runs"), F.round(F.sum("l_quantity"), 2).alias("yield"))
    s = load(spark, d, "supplier").select("s_suppkey").join(n, "s_suppkey", "left").na.fill(0)
    first = lambda seen: s.where((F.col("runs") > 5) == seen).withColumn("seen", F.lit(seen)).orderBy(F.desc("yield"), "s_suppkey").limit(slots)
    r = first(True).unionByName(first(False)).withColumn("i", F.row_number().over(Window.partitionBy("seen").orderBy(F.desc("yield"), "s_suppkey")))
    slot = F.when(F.col("seen"), F.col("i") + F.floor((F.col("i") - 1) / 3)).otherwise(4 * F.col("i")).cast("long")
    return r.select("s_suppkey", slot.alias("slot")).where(F.col("slot") <= slots)


# ------------------------------------------------------------------------------------- set operations


@catalog.query("union_all_latest", "WITH u AS (SELECT user_id, ts, 'buy' AS k FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, ts, 'sign' FROM events WHERE event_type = 'signup') SELECT user_id, MAX(ts) AS last, arg_max(k, (ts, k)) AS k FROM u GROUP BY user_id")
def union_all_latest(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    u = e.where("event_type = 'purchase'").select("user_id", "ts", F.lit("buy").alias("k")).unionByName(e.where("event_type = 'signup'").select("user_id", "ts", F.lit("sign").alias("k")))
    return u.groupBy("user_id").agg(F.max(F.struct("ts", "k")).alias("b")).select("user_id", F.col("b.ts").alias("last"), "b.k")


@catalog.query("distinct_keys", "SELECT DISTINCT source, lang FROM documents")
def distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("source", "lang").distinct()


@catalog.query("keyed_merge", """
WITH a AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT s_suppkey AS id, s_name AS name, s_acctbal AS bal FROM supplier)
SELECT COALESCE(a.id, b.id) AS id, COALESCE(a.name, b.name) AS name, COALESCE(a.bal, b.bal) AS bal FROM a FULL JOIN b ON a.id = b.id""")
def keyed_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two keyed tables in one; the left table's non-null values win."""
    a = load(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("bal"))
    b = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name_b"), F.col("s_acctbal").alias("bal_b"))
    return a.join(b, "id", "full").select("id", F.coalesce("name", "name_b").alias("name"), F.coalesce("bal", "bal_b").alias("bal"))
