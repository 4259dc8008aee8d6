"""Claims of a text held against facts: money, rates, terms, stock and dates, each about an item, as of a time.

A claim is a number with its unit, found clause by clause, and the item it is about: the nearest in its clause, else the last one named before it.
Values are compared as whole numbers of the kind's unit - hundredths of money and rates, days of terms and dates, pieces - so
support is an equality join, however many claims or facts one item has. A fact holds from its first day up to its last.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.catalog import Catalog
from millrace.functions import spans
from millrace.io import load, shared_folder
from millrace.operators.dictionary import clause_spans

catalog = Catalog()
QUERIES, ORACLE_SQL = catalog.queries, catalog.sql

NUMBER = r"\d[\d,]*(?:\.\d+)?"
#: The rest of a number after its first digit.
MORE = r"[\d,]*(?:\.\d+)?"
#: Patterns of claims in the normal form; the parts of each begin with different characters, so none is tried twice. What may not
#: stand before is asked after the first sign, so that places without a digit are passed over at once.
KINDS = {
    "money": rf"[$€£\d](?:(?<=[$€£])\s?{NUMBER}k?|(?<=\d)(?<![\d.$€£]\d){MORE}k?\s?(?:dollars?|euros?|pounds?|usd|eur|gbp)(?!\w))",
    "rate": rf"\d(?<![\d.]\d){MORE}\s?(?:%|percent|per cent)",
    "term": r"\d(?<![\d.]\d)\d*[\s-]?(?:days?|weeks?|months?|years?)(?!\w)",
    "stock": r"\d(?<![\d.]\d)\d*\s(?:in stock|left|pieces|units)(?!\w)",
    "date": r"\d(?<!\d\d)\d{3}-\d{2}-\d{2}(?!\d)",
}
# Days that a unit of time counts for.
DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}


def value_of(kind: Column, quote: Column) -> Column:
    """A claim's value in the unit of its kind, as a long; null for what is none, such as the 31st of February."""
    number = F.regexp_replace(F.regexp_extract(quote, NUMBER, 0), ",", "").try_cast("decimal(24,4)")
    unit = F.regexp_extract(quote, "(day|week|month|year)", 1)
    factor = F.create_map(*(F.lit(x) for kv in DAYS.items() for x in kv))[unit]
    hundredths = F.round(number * F.when(quote.rlike(r"\dk(\s|$)"), 100_000).otherwise(100)).try_cast("long")
    return (
        F.when(kind == "money", hundredths).when(kind == "rate", F.round(number * 100).try_cast("long")).when(kind == "term", (number * factor).try_cast("long"))
        .when(kind == "stock", number.try_cast("long")).when(kind == "date", F.unix_date(F.regexp_extract(quote, r"\d{4}-\d{2}-\d{2}", 0).try_cast("date")).cast("long"))
    )


def claims(texts: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """A row for each claim: the columns of texts but the text, kind, subject, value, quote and start.

    items: target and alias. Subject is null where the text names no item before the claim or in its clause.
    """
    own = [c for c in texts.columns if c != text]
    found = clause_spans(texts, items.select(F.lit("item").alias("kind"), "target", "alias"), text, None, "clauses_", KINDS)
    flat = F.flatten(F.transform("clauses_", lambda c: spans.of_kind(c["spans"], "item")))

    def told(c: Column) -> Column:
        near = spans.of_kind(c["spans"], "item")
        return F.transform(spans.of_kind(c["spans"], *KINDS), lambda s: F.struct(s["kind"].alias("kind"), spans.nearest(s, near)["target"].alias("near"), s["quote"].alias("quote"), s["start"].alias("start")))

    rows = found.select(*own, flat.alias("items_"), F.explode(F.flatten(F.transform("clauses_", told))).alias("c"))
    before = F.element_at(F.filter("items_", lambda i: i["end"] <= F.col("c.start")), -1)["target"]
    rows = rows.select(*own, "c.kind", F.coalesce("c.near", F.when(F.exists("items_", lambda i: i["end"] <= F.col("c.start")), before)).alias("subject"), "c.quote", "c.start")
    return rows.select(*own, "kind", "subject", value_of(F.col("kind"), F.lower("quote")).alias("value"), "quote", "start")


def verify(said: DataFrame, facts: DataFrame, at: str) -> DataFrame:
    """The claims with verdict and ref. facts: subject, kind, value, first, last (dates, null for ever) and ref; at: the
    column of claims with the day for which they are said.

    `supported` - a fact that holds says the same, ref is the smallest of these; `expired` - one that doesn't hold says it;
    `contradicted` - what holds says otherwise; `unknown` - nothing that holds is known. Claims are kept, each once.
    """
    day = F.to_date(F.col(at))
    # claims are met several times below: they are written once, so that texts are read once
    spark, folder = said.sparkSession, shared_folder(said.sparkSession)
    said.write.parquet(folder)
    rows = spark.read.schema(said.schema).parquet(folder)
    distinct = rows.select("subject", "kind", "value", day.alias("day")).distinct()
    f = facts.select("subject", "kind", "value", F.coalesce(F.col("first"), F.lit("0001-01-01").cast("date")).alias("first"), F.coalesce(F.col("last"), F.lit("9999-12-31").cast("date")).alias("last"), "ref")
    holds = (F.col("day") >= F.col("first")) & (F.col("day") < F.col("last"))
    same = distinct.join(f.groupBy("subject", "kind", "value", "first", "last").agg(F.min("ref").alias("ref")), ["subject", "kind", "value"])
    same = same.groupBy("subject", "kind", "value", "day").agg(F.min(F.when(holds, F.col("ref"))).alias("ref"), F.lit(True).alias("once"))
    # whether anything holds: days of a subject meet merged stretches of time, not all of its facts
    known = distinct.select("subject", "kind", "day").distinct().join(stretches(f), ["subject", "kind"]).where(holds).select("subject", "kind", "day").distinct().withColumn("known", F.lit(True))
    judged = distinct.join(same, ["subject", "kind", "value", "day"], "left").join(known, ["subject", "kind", "day"], "left")
    verdict = F.when(F.col("ref").isNotNull(), "supported").when(F.col("once"), "expired").when(F.col("known"), "contradicted").otherwise("unknown")
    judged = judged.select(*(F.col(c).alias(f"{c}_") for c in ("subject", "kind", "value", "day", "ref")), verdict.alias("verdict_"))
    equal = F.col("subject").eqNullSafe(F.col("subject_")) & (F.col("kind") == F.col("kind_")) & F.col("value").eqNullSafe(F.col("value_")) & day.eqNullSafe(F.col("day_"))
    return rows.join(judged, equal, "left").select(*said.columns, F.coalesce("verdict_", F.lit("unknown")).alias("verdict"), F.col("ref_").alias("ref"))


def stretches(facts: DataFrame) -> DataFrame:
    """Per subject and kind the times at which some fact holds: first and last of stretches that don't meet.

    What begins and what ends is counted by day, so facts of the same days are one row before they are put in order.
    """
    steps = facts.where("first < last").select("subject", "kind", F.explode(F.array(F.struct(F.col("first").alias("day"), F.lit(1).alias("n")), F.struct(F.col("last").alias("day"), F.lit(-1).alias("n")))).alias("s"))
    days = steps.groupBy("subject", "kind", "s.day").agg(F.sum("s.n").alias("n"))
    w = Window.partitionBy("subject", "kind").orderBy("day")
    open_ = days.withColumn("open", F.sum("n").over(w)).withColumn("before", F.coalesce(F.lag("open").over(w), F.lit(0)))
    edges = open_.where("(open > 0) <> (before > 0)").withColumn("last", F.lead("day").over(w))
    return edges.where("open > 0").select("subject", "kind", F.col("day").alias("first"), "last")


# ------------------------------------------------------------------------------------ queries

_CLAIM_SQL = """
l AS (SELECT l_orderkey, max({'e': l_extendedprice, 'n': l_linenumber, 'p': l_partkey, 'q': l_quantity, 'r': l_returnflag, 'd': l_discount}) AS l FROM lineitem GROUP BY l_orderkey),
m AS (SELECT o_orderkey, o_orderdate::DATE AS day, p_brand || ' ' || p_name AS subject, l.q AS q, l.r AS r, l.d AS d, p_retailprice AS price, p_size AS size FROM orders JOIN l ON l_orderkey = o_orderkey JOIN part ON p_partkey = l.p),
f AS (SELECT p_brand || ' ' || p_name AS subject, unnest(['money', 'stock', 'date']) AS kind, unnest([round(p_retailprice * 100)::BIGINT, p_size::BIGINT, (DATE '1994-01-01' + p_size * 40 + 1500 - DATE '1970-01-01')::BIGINT]) AS value, DATE '1994-01-01' + p_size * 40 AS first, DATE '1994-01-01' + p_size * 40 + 1500 AS last, p_partkey AS ref FROM part)"""


@catalog.query("claim_verification", f"""
WITH {_CLAIM_SQL}, c AS (SELECT o_orderkey, day, subject, 'money' AS kind, round((price + CASE WHEN r = 'R' THEN 1 ELSE 0 END) * 100)::BIGINT AS value FROM m UNION ALL SELECT o_orderkey, day, subject, 'rate', round(d * 100)::BIGINT * 100 FROM m
  UNION ALL SELECT o_orderkey, day, subject, 'stock', CASE WHEN r = 'A' THEN size ELSE q END::BIGINT FROM m UNION ALL SELECT o_orderkey, day, subject, 'term', 7 * q::BIGINT FROM m UNION ALL SELECT o_orderkey, day, subject, 'date', (DATE '1994-01-01' + size * 40 + 1500 - DATE '1970-01-01')::BIGINT FROM m WHERE r = 'N'),
s AS (SELECT c.*, (SELECT min(ref) FROM f WHERE f.subject = c.subject AND f.kind = c.kind AND f.value = c.value AND first <= day AND day < last) AS ref, EXISTS (SELECT 1 FROM f WHERE f.subject = c.subject AND f.kind = c.kind AND f.value = c.value) AS once, EXISTS (SELECT 1 FROM f WHERE f.subject = c.subject AND f.kind = c.kind AND first <= day AND day < last) AS known FROM c)
SELECT o_orderkey, kind, subject, value, CASE WHEN ref IS NOT NULL THEN 'supported' WHEN once THEN 'expired' WHEN known THEN 'contradicted' ELSE 'unknown' END AS verdict, coalesce(ref, -1) AS ref FROM s""")
def claim_verification(spark: SparkSession, d: str) -> DataFrame:
    """Claims of all orders' offers about parts, held against the catalogue of the day of the order."""
    top = F.max(F.struct("l_extendedprice", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_discount")).alias("l")
    line = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(top).select("o_orderkey", "l.*")
    part = load(spark, d, "part").withColumn("subject", F.concat_ws(" ", "p_brand", "p_name"))
    first = F.date_add(F.lit("1994-01-01").cast("date"), F.col("p_size") * 40)
    m = load(spark, d, "orders").join(line, "o_orderkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    price = F.format_number(F.col("p_retailprice") + F.when(F.col("l_returnflag") == "R", 1).otherwise(0), 2)
    stock = F.when(F.col("l_returnflag") == "A", F.col("p_size")).otherwise(F.col("l_quantity").cast("int")).cast("string")
    until = F.when(F.col("l_returnflag") == "N", F.concat(F.lit(" Valid until "), F.date_add(first, 1500).cast("string"), F.lit("!"))).otherwise("")
    text = F.concat(F.lit("Our "), F.upper("subject"), F.lit(": $"), price, F.lit(", "), F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit(" percent off; "), stock, F.lit(" in stock, pay within "), F.col("l_quantity").cast("int").cast("string"), F.lit(" weeks."), until)
    texts = m.select("o_orderkey", "o_orderdate", text.alias("text"))
    fact = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("long").alias("value"))
    facts = part.select("subject", F.explode(F.array(fact("money", F.round(F.col("p_retailprice") * 100)), fact("stock", F.col("p_size")), fact("date", F.unix_date(F.date_add(first, 1500))))).alias("f"), first.alias("first"), F.date_add(first, 1500).alias("last"), F.col("p_partkey").alias("ref"))
    said = claims(texts, part.select(F.col("subject").alias("target"), F.col("subject").alias("alias")).distinct())
    judged = verify(said, facts.select("subject", "f.kind", "f.value", "first", "last", "ref"), "o_orderdate")
    return judged.select("o_orderkey", "kind", "subject", "value", "verdict", F.coalesce("ref", F.lit(-1)).alias("ref"))
