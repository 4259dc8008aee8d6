"""Text operators: normalisation, similarity, extraction and rule-based classification, as columns.

Lexicons and patterns are parameters of the operators; the queries pass small ones that fit the test tables.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.catalog import Catalog
from millrace.functions.columns import ascii_bounds, char_ngrams, count_of, days_between, half_up, instant_of, jaccard, local_date, meaningful
from millrace.io import load

catalog = Catalog()
QUERIES, ORACLE_SQL = catalog.queries, catalog.sql

SPACES = r"[ \t\n\r\f\x0B]+"
NORM_SQL = r"trim(regexp_replace(lower(text), '[ \t\n\r\f\v]+', ' ', 'g'))"


def norm(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), SPACES, " "))


@catalog.query("norm_text", f"SELECT doc_id, md5({NORM_SQL}) AS digest, length({NORM_SQL}) AS n FROM documents")
def norm_text(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", norm(F.col("text")).alias("t"))
    return docs.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@catalog.query("meaningful_chars", r"SELECT doc_id, length(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g')) AS n FROM documents")
def meaningful_chars(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.char_length(meaningful(F.col("text"))).cast("long").alias("n"))


@catalog.query("char_ngrams", r"""
WITH m AS (SELECT item_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS t FROM benchmark)
SELECT item_id, CASE WHEN t = '' THEN 0 WHEN length(t) < 2 THEN 1 ELSE len(list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2)))) END AS n FROM m""")
def char_ngrams_query(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "benchmark").select("item_id", F.size(char_ngrams(F.col("text"))).cast("long").alias("n"))


@catalog.query("bigram_jaccard", r"""
WITH m AS (SELECT item_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS t FROM benchmark), g AS (SELECT item_id, list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) AS g FROM m)
SELECT a.item_id AS a, b.item_id AS b, FLOOR(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g)))::DOUBLE * 10000 + 0.5) / 10000 AS sim FROM g a JOIN g b ON b.item_id = a.item_id + 1""")
def bigram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d, "benchmark").select("item_id", char_ngrams(F.col("text")).alias("g"))
    b = g.select((F.col("item_id") - 1).alias("a"), F.col("item_id").alias("b"), F.col("g").alias("h"))
    return g.join(b, g.item_id == b.a).select("a", "b", half_up(jaccard(F.col("g"), F.col("h")), 4).alias("sim"))




@catalog.query("js_round", "SELECT l_orderkey, l_linenumber, FLOOR((l_extendedprice * l_discount - 50) * 100 + 0.5) / 100 AS r, LEAST(GREATEST(l_quantity, 10), 40) AS c FROM lineitem")
def js_round(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", half_up(F.col("l_extendedprice") * F.col("l_discount") - 50, 2).alias("r"), F.least(F.greatest("l_quantity", F.lit(10.0)), F.lit(40.0)).alias("c"))


@catalog.query("verbatim_evidence", f"SELECT doc_id, item_id FROM (SELECT doc_id, {NORM_SQL} AS t FROM documents) JOIN (SELECT item_id, substr({NORM_SQL}, 1, CASE WHEN item_id % 3 = 0 THEN 18 ELSE 10000 END) AS q FROM benchmark) ON q <> '' AND contains(t, q)")
def verbatim_evidence(spark: SparkSession, d: str, width: int = 3) -> DataFrame:
    """Quotes that stand verbatim in a text: whole items, and the opening of every third one.

    A quote's outer words may be parts of a text's words; quotes and texts meet on up to `width` of those between.
    Quotes without such words meet texts on the first letters of a part of a word. Then whole quotes are compared.
    """
    opening = F.when(F.col("item_id") % 3 == 0, 18).otherwise(10_000)
    q = load(spark, d, "benchmark").select("item_id", F.substring(norm(F.col("text")), F.lit(1), opening).alias("q")).where("q <> ''")
    words = F.split("q", " ")
    first = F.substring(F.get(words, F.lit(0)), 1, 3)
    inner = F.least(F.size(words) - 2, F.lit(width))
    q = q.withColumn("size", F.when(inner > 0, inner).otherwise(-F.char_length(first)))
    q = q.withColumn("key", F.xxhash64("size", F.when(F.col("size") > 0, F.concat_ws(" ", F.slice(words, 2, F.greatest("size", F.lit(1))))).otherwise(first)))
    sizes = sorted(r["size"] for r in q.select("size").distinct().collect())  # width + 3 values at most
    t = load(spark, d, "documents").select("doc_id", norm(F.col("text")).alias("t"))
    w = t.select("doc_id", F.split("t", " ").alias("w"))
    runs = w.select("doc_id", F.explode(F.arrays_zip(*(F.slice("w", k + 1, F.size("w")).alias(f"w{k}") for k in range(width)))).alias("z"))
    keys = [F.when(F.col(f"z.w{n - 1}").isNotNull(), F.xxhash64(F.lit(n), F.concat_ws(" ", *(f"z.w{k}" for k in range(n))))) for n in sizes if n > 0]
    grams = runs.select("doc_id", F.explode(F.array(*keys)).alias("key")) if keys else None
    if parts := [-n for n in sizes if n < 0]:
        starts = w.select("doc_id", F.explode(F.array_distinct("w")).alias("x")).select("doc_id", "x", F.explode(F.sequence(F.lit(1), F.char_length("x"))).alias("i"))
        short = starts.select("doc_id", F.explode(F.array(*(F.when(F.col("i") + n - 1 <= F.char_length("x"), F.xxhash64(F.lit(-n), F.substring(F.col("x"), F.col("i"), F.lit(n)))) for n in parts))).alias("key"))
        grams = short if grams is None else grams.unionByName(short)
    if grams is None:
        return t.select("doc_id", F.lit(0).cast("long").alias("item_id")).limit(0)
    pairs = grams.join(q.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
    return pairs.join(t, "doc_id").join(q.select("item_id", "q"), "item_id").where(F.contains("t", "q")).select("doc_id", "item_id")


@catalog.query("dedupe_array_by_key", """
WITH e AS (SELECT user_id, event_type AS code, CAST(json_extract(props, '$.k') AS BIGINT) % 5 AS quote, event_id FROM events), f AS (SELECT user_id, code, quote, MIN(event_id) AS first FROM e GROUP BY ALL)
SELECT user_id, COUNT(*) AS n, string_agg(code || ':' || quote, ',' ORDER BY first) AS evidence FROM f GROUP BY user_id""")
def dedupe_array_by_key(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select("user_id", F.col("event_type").alias("code"), (F.get_json_object("props", "$.k").cast("long") % 5).alias("quote"), "event_id")
    f = e.groupBy("user_id", "code", "quote").agg(F.min("event_id").alias("first"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first", "code", "quote"))), lambda x: F.concat_ws(":", x["code"], x["quote"].cast("string")))
    return f.groupBy("user_id").agg(F.count("*").alias("n"), F.concat_ws(",", ordered).alias("evidence"))


@catalog.query("match_key", r"SELECT p_partkey, regexp_replace(lower(p_name || '-' || p_brand), '[ \-_·.#]+', '', 'g') AS k FROM part")
def match_key(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", F.regexp_replace(F.lower(F.concat_ws("-", "p_name", "p_brand")), r"[ \-_·.#]+", "").alias("k"))


@catalog.query("regex_spans", r"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{2,}')) AS quote, generate_subscripts(regexp_extract_all(text, '[0-9]{2,}'), 1) AS pos FROM documents) SELECT doc_id, (pos - 1)::BIGINT AS pos, quote FROM m""")
def regex_spans(spark: SparkSession, d: str) -> DataFrame:
    """Matches as exact slices of the raw text, in their order."""
    rows = load(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[0-9]{2,}"), 0)).alias("pos", "quote"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "quote")


@catalog.query("parse_count", """
WITH c AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 97)::VARCHAR || '.5w' WHEN 1 THEN (o_orderkey % 50)::VARCHAR || 'k' WHEN 2 THEN '1,' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') ELSE 'n/a' END AS raw FROM orders)
SELECT o_orderkey, COALESCE(CASE WHEN raw LIKE '%w' THEN FLOOR(replace(raw, 'w', '')::DOUBLE * 10000 + 0.5) WHEN raw LIKE '%k' THEN FLOOR(replace(raw, 'k', '')::DOUBLE * 1000 + 0.5) WHEN raw = 'n/a' THEN NULL ELSE replace(raw, ',', '')::DOUBLE END, -1)::BIGINT AS n FROM c""")
def parse_count(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, F.concat((k % 97).cast("string"), F.lit(".5w"))).when(k % 4 == 1, F.concat((k % 50).cast("string"), F.lit("k"))).when(k % 4 == 2, F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0"))).otherwise("n/a")
    return load(spark, d, "orders").select("o_orderkey", F.coalesce(count_of(raw), F.lit(-1)).alias("n"))


@catalog.query("epoch_heuristic", "SELECT event_id, epoch_ms(CASE WHEN event_id % 2 = 0 THEN (1700000000 + event_id) * 1000 ELSE 1700000000000 + event_id END) AS at FROM events")
def epoch_heuristic(spark: SparkSession, d: str) -> DataFrame:
    """Epoch seconds and milliseconds told apart by size."""
    e = load(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.lit(1_700_000_000) + F.col("event_id")).otherwise(F.lit(1_700_000_000_000) + F.col("event_id")).alias("n"))
    return e.select("event_id", instant_of(F.col("n")).cast("timestamp_ntz").alias("at"))


LEAKS = {"mail": r"[A-Za-z0-9._]+@[A-Za-z0-9-]+\.[A-Za-z.]+", "url": r"https?://[^\s]+", "ip": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "phone": r"\+?[0-9]{1,3} ?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}", "digits": r"\b[0-9]{13,19}\b", "secret": r"\b[0-9a-f]{40}\b"}


@catalog.query("contact_leak", "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}'))::BIGINT AS {k}" for k, p in LEAKS.items()) + " FROM documents WHERE " + " OR ".join(f"regexp_matches(text, '{p}')" for p in LEAKS.values()))
def contact_leak(spark: SparkSession, d: str) -> DataFrame:
    counts = [F.regexp_count("text", F.lit(ascii_bounds(p))).cast("long").alias(k) for k, p in LEAKS.items()]
    return load(spark, d, "documents").select("doc_id", *counts).where(" or ".join(f"{k} > 0" for k in LEAKS))


@catalog.query("local_day", "SELECT (ts + INTERVAL 8 HOUR)::DATE::VARCHAR AS day, COUNT(*) AS n FROM events GROUP BY 1")
def local_day(spark: SparkSession, d: str, tz: str = "Asia/Shanghai") -> DataFrame:
    return load(spark, d, "events").groupBy(local_date(F.col("ts").cast("timestamp"), tz).cast("string").alias("day")).agg(F.count("*").alias("n"))


@catalog.query("frac_days", "SELECT event_id, FLOOR(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400000000.0 AS days FROM events")
def frac_days(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2024-01-31").cast("timestamp")
    return load(spark, d, "events").select("event_id", days_between(now, F.col("ts").cast("timestamp")).alias("days"))


@catalog.query("strict_ts_parse", """
WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 09:30' WHEN 2 THEN '2024-02-31T00:00:00Z' ELSE 'soon' END AS raw, o_orderdate FROM orders)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN date_trunc('second', o_orderdate) WHEN 1 THEN date_trunc('day', o_orderdate) + INTERVAL 90 MINUTE END::TIMESTAMP AS at FROM r""")
def strict_ts_parse(spark: SparkSession, d: str, tz: str = "Asia/Shanghai") -> DataFrame:
    """An instant with its zone, or a wall-clock time in tz; anything else, impossible dates included, is null."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    raw = F.when(k % 4 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k % 4 == 1, F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit(" 09:30"))).when(k % 4 == 2, "2024-02-31T00:00:00Z").otherwise("soon")
    instant = F.when(F.col("raw").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp("raw"))
    wall = F.when(F.col("raw").rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d$"), F.to_utc_timestamp(F.try_to_timestamp("raw", F.lit("yyyy-MM-dd HH:mm")), tz))
    return load(spark, d, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", F.coalesce(instant, wall).cast("timestamp_ntz").alias("at"))


@catalog.query("stable_id", "SELECT c_custkey, substr(sha1(c_custkey || '|' || c_name), 1, 16) AS id FROM customer")
def stable_id(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select("c_custkey", F.substring(F.sha1(F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name")), 1, 16).alias("id"))


@catalog.query("hashtags", "SELECT p_partkey, len(list_distinct(regexp_extract_all(p_brand || ' ' || p_brand || ' #' || p_type, '#([A-Za-z0-9]+)', 1)))::BIGINT AS n FROM part")
def hashtags(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat_ws("", "p_brand", F.lit(" "), "p_brand", F.lit(" #"), "p_type")
    return load(spark, d, "part").select("p_partkey", F.size(F.array_distinct(F.regexp_extract_all(t, F.lit("#([A-Za-z0-9]+)"), 1))).cast("long").alias("n"))


@catalog.query("flatten_tree", "SELECT conv_id, turn, role, COUNT(*) OVER (PARTITION BY conv_id) AS size FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)")
def flatten_tree(spark: SparkSession, d: str) -> DataFrame:
    """Nested children back to rows, without repeats, each with the size of its tree."""
    c = load(spark, d, "conversations").select("conv_id", "turn", "role").distinct()
    tree = c.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("children"))
    return tree.select("conv_id", F.size("children").cast("long").alias("size"), F.inline("children"))


#: Rules of an intent: code, pattern, points.
RULES = (("number", r"\d{2,}", 3), ("insult", r"\b(idiot|worthless|pathetic|clown)\b", -5), ("shout", r"!!", -2), ("question", r"\?", 2), ("list", r" \| ", 1))


@catalog.query("intent_rules", "SELECT doc_id, " + "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{c}' END" for c, p, _ in RULES) + ") AS codes, (" + " + ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN {n} ELSE 0 END" for _, p, n in RULES) + ")::BIGINT AS strength FROM documents")
def intent_rules(spark: SparkSession, d: str) -> DataFrame:
    """A table of rules over each text: the codes that hold, and their points."""
    t = F.lower("text")
    held = [(c, t.rlike(ascii_bounds(p)), n) for c, p, n in RULES]
    return load(spark, d, "documents").select("doc_id", F.concat_ws(",", *(F.when(h, c) for c, h, _ in held)).alias("codes"), sum((F.when(h, n).otherwise(0) for _, h, n in held), F.lit(0)).cast("long").alias("strength"))


@catalog.query("actor_type_agg", "SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'BUYER' ELSE arg_max(event_type, (ts, event_id)) END AS actor FROM events GROUP BY user_id")
def actor_type_agg(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy("user_id").agg(F.when(F.bool_or(F.col("event_type") == "purchase"), "BUYER").otherwise(F.max_by("event_type", F.struct("ts", "event_id"))).alias("actor"))


@catalog.query("slot_fill_last_non_null", """
SELECT user_id, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS price, arg_max(event_type, (ts, event_id)) FILTER (WHERE event_type <> 'error') AS kind FROM events GROUP BY user_id""")
def slot_fill_last_non_null(spark: SparkSession, d: str) -> DataFrame:
    """The latest value of each slot that was stated."""
    at = F.struct("ts", "event_id")
    stated = lambda c, cond: F.max_by(c, F.when(cond, at))
    return load(spark, d, "events").groupBy("user_id").agg(stated("value", F.col("event_type") == "purchase").alias("price"), stated("event_type", F.col("event_type") != "error").alias("kind"))


@catalog.query("compliance_issues", r"""
SELECT issue, COUNT(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN regexp_matches(text, '\b[0-9a-f]{40}\b') THEN 'secret' END, CASE WHEN contains(text, '!!') THEN 'punctuation' END, CASE WHEN length(text) > 5000 THEN 'length' END, CASE WHEN regexp_matches(lower(text), '\b(idiot|worthless|pathetic|clown)\b') THEN 'prohibited' END], lambda x: x IS NOT NULL)) AS issue FROM documents) GROUP BY issue""")
def compliance_issues(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    issues = F.array_compact(F.array(F.when(t.rlike(ascii_bounds(r"\b[0-9a-f]{40}\b")), "secret"), F.when(t.contains("!!"), "punctuation"), F.when(F.length(t) > 5000, "length"), F.when(F.lower(t).rlike(ascii_bounds(r"\b(idiot|worthless|pathetic|clown)\b")), "prohibited")))
    return load(spark, d, "documents").select(F.explode(issues).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@catalog.query("unsupported_numbers", r"""
WITH a AS (SELECT conv_id, list_distinct(flatten(list(regexp_extract_all(text, '[0-9]+')) FILTER (WHERE role = 'assistant'))) AS said, list_distinct(flatten(list(regexp_extract_all(text, '[0-9]+')) FILTER (WHERE role <> 'assistant'))) AS known FROM conversations GROUP BY conv_id)
SELECT conv_id, len(list_filter(coalesce(said, []), lambda x: NOT list_contains(coalesce(known, []), x)))::BIGINT AS n FROM a""")
def unsupported_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that only the assistant names, per conversation: a set of (conversation, number) rows, not arrays."""
    c = load(spark, d, "conversations")
    said = c.select("conv_id", (F.col("role") == "assistant").alias("own"), F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), 0)).alias("x"))
    per = said.groupBy("conv_id", "x").agg(F.bool_and("own").alias("only"))
    n = per.where("only").groupBy("conv_id").agg(F.count("*").alias("n"))
    return c.select("conv_id").distinct().join(n, "conv_id", "left").na.fill(0)


@catalog.query("claim_verify", r"""
WITH c AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\b[0-9]{3,5}\b')))::BIGINT AS v FROM documents) SELECT doc_id, v, EXISTS (SELECT 1 FROM part WHERE p_partkey = v) AS supported FROM c""")
def claim_verify(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(ascii_bounds(r"\b[0-9]{3,5}\b")), 0))).alias("v")).select("doc_id", F.col("v").cast("long").alias("v"))
    facts = load(spark, d, "part").select(F.col("p_partkey").alias("v")).distinct().withColumn("known", F.lit(True))
    return c.join(facts, "v", "left").select("doc_id", "v", F.coalesce("known", F.lit(False)).alias("supported"))


@catalog.query("df_retrieval", r"""
WITH t AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) AS g FROM benchmark), n AS (SELECT COUNT(*) AS n FROM benchmark), f AS (SELECT g, COUNT(*) AS df FROM t GROUP BY g),
q AS (SELECT item_id AS q, g FROM t JOIN f USING (g), n WHERE df < n.n AND df > 1 AND item_id % 10 = 0), s AS (SELECT q, COUNT(*) AS size FROM q GROUP BY q), h AS (SELECT q.q, t.item_id, COUNT(*) AS hits FROM q JOIN t USING (g) WHERE t.item_id <> q.q GROUP BY ALL)
SELECT q, item_id, hits, FLOOR(LEAST(hits / size::DOUBLE, 0.95) * 10000 + 0.5) / 10000 AS score FROM h JOIN s USING (q) QUALIFY ROW_NUMBER() OVER (PARTITION BY q ORDER BY hits DESC, item_id) <= 3""")
def df_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Items that share most of a query's discriminating terms: those in some, not in all items."""
    b = load(spark, d, "benchmark")
    t = b.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0))).alias("g"))
    n = b.agg(F.count("*").alias("n"))
    f = t.groupBy("g").agg(F.count("*").alias("df")).join(F.broadcast(n)).where("df > 1 and df < n").select("g")
    q = t.where("item_id % 10 = 0").join(f, "g").select(F.col("item_id").alias("q"), "g")
    size = q.groupBy("q").agg(F.count("*").alias("size"))
    h = q.join(t, "g").where("item_id <> q").groupBy("q", "item_id").agg(F.count("*").alias("hits")).join(size, "q")
    h = h.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("hits"), "item_id"))).where("r <= 3")
    return h.select("q", "item_id", "hits", half_up(F.least(F.col("hits") / F.col("size"), F.lit(0.95)), 4).alias("score"))


def shared_run(a: str, b: str, cap: int = 40) -> int:
    """Length of the longest common substring, up to the cap: a search by halves, as shorter runs are shared too."""
    low, high = 0, min(cap, len(a), len(b))
    while low < high:
        n = (low + high + 1) // 2
        grams = {a[i : i + n] for i in range(len(a) - n + 1)}
        if any(b[i : i + n] in grams for i in range(len(b) - n + 1)):
            low = n
        else:
            high = n - 1
    return low


@catalog.query("longest_shared", r"""
WITH m AS (SELECT item_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS t FROM benchmark), p AS (SELECT a.item_id AS a, b.item_id AS b, a.t AS s, b.t AS u FROM m a JOIN m b ON b.item_id = a.item_id + 1),
x AS (SELECT a, b, u, s, unnest(range(1, length(s) + 1)) AS i FROM p), y AS (SELECT a, b, u, s, i, unnest(range(1, 41)) AS l FROM x)
SELECT a, b, COALESCE(MAX(l) FILTER (WHERE i + l - 1 <= length(s) AND contains(u, substr(s, i, l))), 0)::BIGINT AS n FROM y GROUP BY a, b""")
def longest_shared(spark: SparkSession, d: str, cap: int = 40) -> DataFrame:
    """Per pair of neighbouring items the longest run of meaningful characters that both have."""

    @F.pandas_udf("long")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([shared_run(x, y, cap) for x, y in zip(a, b, strict=True)], dtype="int64")

    m = load(spark, d, "benchmark").select("item_id", meaningful(F.col("text")).alias("t"))
    b = m.select((F.col("item_id") - 1).alias("a"), F.col("item_id").alias("b"), F.col("t").alias("u"))
    return m.join(b, m.item_id == b.a).select("a", "b", run("t", "u").alias("n"))


def top_apart(phrases: DataFrame, k: int) -> DataFrame:
    """Per group the k best phrases of which none contains another: g, phrase, df. The best one left is taken, and what it
    contains or is part of goes, k times over; groups are never gathered."""
    left, taken = phrases.select("g", "phrase", "df"), None
    for _ in range(k):
        best = left.groupBy("g").agg(F.min(F.struct((-F.col("df")).alias("m"), (-F.char_length("phrase")).alias("n"), "phrase")).alias("b"))
        best = best.select("g", F.col("b.phrase").alias("phrase"), (-F.col("b.m")).alias("df"))
        taken = best if taken is None else taken.unionByName(best)
        left = left.join(best.select("g", F.col("phrase").alias("first")), "g").where(~F.contains("phrase", "first") & ~F.contains("first", "phrase")).select("g", "phrase", "df")
    return taken


_GRAMS = r"""m AS (SELECT item_id % 4 AS g, item_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS t FROM benchmark),
e AS (SELECT DISTINCT g, item_id, substr(t, i, n) AS phrase FROM (SELECT g, item_id, t, n, unnest(range(1, length(t) - n + 2)) AS i FROM m, (SELECT unnest([4, 5, 6]) AS n) WHERE length(t) >= n)),
l0 AS MATERIALIZED (SELECT g, phrase, count(*) AS df FROM e GROUP BY ALL HAVING count(*) >= 2)"""


def _phrases_sql(k: int = 5) -> str:
    parts = [_GRAMS]
    for i in range(k):
        parts.append(f"b{i} AS MATERIALIZED (SELECT g, phrase, df FROM l{i} QUALIFY row_number() OVER (PARTITION BY g ORDER BY df DESC, length(phrase) DESC, phrase) = 1)")
        parts.append(f"l{i + 1} AS MATERIALIZED (SELECT l.* FROM l{i} l JOIN b{i} b USING (g) WHERE NOT contains(l.phrase, b.phrase) AND NOT contains(b.phrase, l.phrase))")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(k))


@catalog.query("recurring_phrases", _phrases_sql())
def recurring_phrases(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    """Per group the k most frequent phrases of 4 to 6 characters in two texts at least, overlaps suppressed."""
    m = load(spark, d, "benchmark").select((F.col("item_id") % 4).alias("g"), "item_id", meaningful(F.col("text")).alias("t"))
    grams = lambda n: F.when(F.char_length("t") >= n, F.transform(F.sequence(F.lit(1), F.char_length("t") - n + 1), lambda i: F.substring("t", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    each = m.select("g", "item_id", F.explode(F.array_distinct(F.concat(*(grams(n) for n in (4, 5, 6))))).alias("phrase"))
    return top_apart(each.groupBy("g", "phrase").agg(F.count("*").alias("df")).where("df >= 2"), k)
