"""Messages read by rule tables: words of a lexicon, reasons to skip, who writes, intents, questions, cues and budgets.

Vocabularies are tables or parameters; spans come from `operators.dictionary`, what counts from `operators.signals`.
"""

import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import Catalog
from millrace.functions import spans
from millrace.functions.columns import char_ngrams, half_up, meaningful
from millrace.io import load
from millrace.operators import signals
from millrace.operators.dictionary import MOST, clause_spans, pure_praise
from millrace.operators.schemas import violations

catalog = Catalog()
QUERIES, ORACLE_SQL = catalog.queries, catalog.sql


# ------------------------------------------------------------------------------------ lexicons


def contained(texts: DataFrame, words: DataFrame, text: str = "text", into: str = "hits") -> DataFrame:
    """The rows of texts with the words of the lexicon that they hold anywhere, also inside of words, each once, in order.

    words: one column. Texts and words meet in lower case and compatibility form; a text is read once for all words. A
    lexicon of more than MOST words is taken in parts.
    """
    fold = lambda s: unicodedata.normalize("NFKC", s).lower()
    column = words.columns[0]
    parts = max(1, -(-words.count() // MOST))
    out, names = texts, texts.columns
    for p in range(parts):
        own = words.where(F.col(column).isNotNull() & (F.pmod(F.xxhash64(column), F.lit(parts)) == p)).distinct()
        listed = sorted({fold(r[0]): r[0] for r in own.collect()}.items())  # about MOST words
        shared = texts.sparkSession.sparkContext.broadcast(listed)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for key, word in shared.value:
                if key:
                    automaton.add_word(key, word)
            if len(automaton):
                automaton.make_automaton()
            for batch in batches:
                n = batch.num_columns - 1
                found = [sorted({w for _, w in automaton.iter(fold(t.as_py()))}) if len(automaton) and t.is_valid else [] for t in batch.column(n)]
                yield pa.record_batch([*batch.columns[:n], pa.array(found, pa.list_(pa.string()))], names=[*batch.schema.names[:n], f"hits_{p}"])  # noqa: B023

        kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in out.schema)
        out = out.select(*(F.col(f"`{c}`") for c in out.columns), F.col(text).cast("string").alias("text_")).mapInArrow(work, f"{kinds}hits_{p} array<string>")
    return out.select(*names, F.array_sort(F.concat(*(f"hits_{p}" for p in range(parts)))).alias(into))


@catalog.query("lexicon_hits", r"""
WITH w AS (SELECT DISTINCT x FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS x FROM benchmark) WHERE length(x) >= 9), h AS (SELECT conv_id, turn, x FROM conversations JOIN w ON contains(lower(text), x))
SELECT c.conv_id, c.turn, coalesce(string_agg(x, ',' ORDER BY x), '') AS hits FROM conversations c LEFT JOIN h USING (conv_id, turn) GROUP BY c.conv_id, c.turn""")
def lexicon_hits(spark: SparkSession, d: str) -> DataFrame:
    """The long words of the benchmark that each turn holds, also as parts of its words."""
    w = load(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-zà-ÿ]+"), F.lit(0))).alias("x")).where(F.char_length("x") >= 9).distinct()
    found = contained(load(spark, d, "conversations").select("conv_id", "turn", "text"), w)
    return found.select("conv_id", "turn", F.concat_ws(",", "hits").alias("hits"))


# ------------------------------------------------------------------------------------ reasons and roles

# Words of praise and words that go with them.
PRAISE = {"nice": True, "great": True, "love": True, "lovely": True, "cool": True, "wow": True, "pretty": True, "so": False, "very": False, "it": False, "this": False, "really": False, "i": False, "a": False}
# Names of sellers' accounts.
SELLERS = r"(?i)\b(store|sales|dealer|official|outlet|motors)\b"


def skip_reason(analysed: DataFrame, text: str = "text", shortest: int = 4) -> DataFrame:
    """Adds reason, the first that holds: empty, marketing_account, pure_praise, too_short, keyword_hit, no_signal.

    analysed: rows of `signals.analyse` with their text.
    """
    bare = meaningful(F.col(text))
    reason = (
        F.when(F.col(text).isNull() | (bare == ""), "empty").when(F.col("role") == "marketing", "marketing_account").when(pure_praise(F.col(text), PRAISE), "pure_praise")
        .when(F.char_length(bare) < shortest, "too_short").when((F.size("codes") > F.when(F.array_contains("codes", "asked"), 1).otherwise(0)) | (F.size("declined") > 0), "keyword_hit").otherwise("no_signal")
    )
    return analysed.withColumn("reason", reason)


def actor(analysed: DataFrame, nickname: str) -> DataFrame:
    """Adds actor: DEALER by the name of the account, else SELLER, OWNER or CREATOR by what is said, BUYER, else UNKNOWN."""
    who = F.when(F.col(nickname).rlike(SELLERS), "DEALER").when(F.col("role") == "marketing", "SELLER").when(F.col("role") == "owner", "OWNER").when(F.col("role") == "creator", "CREATOR").when(F.col("purchase_signal"), "BUYER").otherwise("UNKNOWN")
    return analysed.withColumn("actor", who)


def read_messages(spark: SparkSession, d: str) -> DataFrame:
    told = signals.messages(spark, d).select("o_orderkey", "o_custkey", "o_orderpriority", "text")
    text = F.when((F.col("text") == "") & (F.col("o_orderpriority") == "4-NOT SPECIFIED"), "So pretty!! I love it").otherwise(F.col("text"))
    return signals.analyse(told.withColumn("text", text), signals.rule_table(spark).unionByName(signals.entities(spark, d)))


_READ_SQL = f"""{signals._MESSAGE_SQL}, f AS (SELECT m.*, orders.o_custkey, {signals._STOCK} AS stock, {signals._PRICE} AS price, {signals._VISIT} AS visit, {signals._LOVE} AS love, {signals._OWN} AS own, pr = '1-URGENT' AS loan, pr = '2-HIGH' AS noloan, st = 'P' AND q < 5 AS stop, st = 'O' AS placed, pr = '3-MEDIUM' AS budget, r = 'N' AND s = 'F' AS jacket FROM m JOIN orders USING (o_orderkey)),
g AS (SELECT *, stock OR price OR visit OR loan OR placed OR love OR own OR stop OR budget AS said, visit OR stock OR price OR loan OR budget OR love AS wants FROM f)"""


@catalog.query("prefilter_reasons", f"""
WITH {_READ_SQL} SELECT reason, COUNT(*) AS n FROM (SELECT CASE WHEN said OR noloan THEN 'keyword_hit' WHEN jacket THEN 'no_signal' WHEN pr = '4-NOT SPECIFIED' THEN 'pure_praise' ELSE 'empty' END AS reason FROM g) GROUP BY reason""")
def prefilter_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why messages are looked at or not."""
    return skip_reason(read_messages(spark, d)).groupBy("reason").agg(F.count("*").alias("n"))


@catalog.query("actor_type", f"""
WITH {_READ_SQL} SELECT o_orderkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'DEALER' WHEN own THEN 'OWNER' WHEN wants AND NOT stop THEN 'BUYER' ELSE 'UNKNOWN' END AS actor FROM g JOIN customer ON c_custkey = g.o_custkey""")
def actor_type(spark: SparkSession, d: str) -> DataFrame:
    """Who wrote each message: by the account's name, else by what it says."""
    name = F.when(F.col("c_mktsegment") == "MACHINERY", F.concat("c_name", F.lit(" | Official Store"))).otherwise(F.col("c_name"))
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), name.alias("nickname"))
    return actor(read_messages(spark, d).join(c, "o_custkey"), "nickname").select("o_orderkey", "actor")


@catalog.query("conv_intents", f"""
WITH {_READ_SQL} SELECT o_orderkey, concat_ws(',', CASE WHEN price THEN 'ask_price' END, CASE WHEN stock THEN 'ask_stock' END, CASE WHEN loan THEN 'ask_finance' END, CASE WHEN noloan THEN 'decline_finance' END, CASE WHEN visit THEN 'visit' END, CASE WHEN stop THEN 'refuse' END, CASE WHEN budget THEN 'state_budget' END) AS intents,
  CASE WHEN placed THEN n_name ELSE '' END AS place, CASE WHEN stock THEN colour ELSE '' END AS colour FROM g""")
def conv_intents(spark: SparkSession, d: str) -> DataFrame:
    """Intents of each message, any number of them, and its slots."""
    r = read_messages(spark, d)
    has = lambda code, name, column="codes": F.when(F.array_contains(column, code), name)
    intents = F.concat_ws(",", has("price", "ask_price"), has("inventory", "ask_stock"), has("finance", "ask_finance"), has("finance", "decline_finance", "declined"), has("test_drive", "visit"), has("refusal", "refuse"), has("budget", "state_budget"))
    return r.select("o_orderkey", intents.alias("intents"), F.coalesce("place", F.lit("")).alias("place"), F.coalesce("colour", F.lit("")).alias("colour"))


# ------------------------------------------------------------------------------------ questions and cues


def clusters(texts: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """A row for each question of a text: the columns of texts but the text, cluster and about, the nearest item.

    Cues in clauses that ask nothing are no questions; a cluster counts once a text.
    """
    own = [c for c in texts.columns if c != text]
    found = clause_spans(texts, rules, text, None, "clauses_")
    asked = signals.cues_where(F.filter("clauses_", lambda c: c["asked"]), lambda clause, s: ~signals.off_topic(clause, s))
    rows = found.select(*own, F.explode(signals.first_of_each(asked)).alias("q"))
    return rows.select(*own, F.col("q.code").alias("cluster"), F.col("q.about").alias("about"))


@catalog.query("question_clusters", f"""
WITH {_READ_SQL}, q AS (SELECT o_custkey, unnest(list_filter([CASE WHEN price THEN 'price' END, CASE WHEN stock THEN 'inventory' END, CASE WHEN loan THEN 'finance' END], lambda x: x IS NOT NULL)) AS cluster FROM g) SELECT cluster, COUNT(*) AS messages, COUNT(DISTINCT o_custkey) AS customers FROM q GROUP BY cluster""")
def question_clusters(spark: SparkSession, d: str) -> DataFrame:
    """What customers ask about, in how many messages, and how many of them."""
    told = signals.messages(spark, d).select("o_custkey", "text")
    per = clusters(told, signals.rule_table(spark).unionByName(signals.entities(spark, d))).groupBy("cluster", "o_custkey").agg(F.count("*").alias("n"))
    return per.groupBy("cluster").agg(F.sum("n").alias("messages"), F.count("*").alias("customers"))


# Cues of sentiment.
CUES = {("cue", "good"): ("love", "great", "reliable", "would love"), ("cue", "bad"): ("broken", "stop", "terrible", "noise"), ("negator", "not"): signals.RULES[("negator", "not")]}


def cues(texts: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """A row for each cue outside questions: the columns of texts but the text, cue (good or bad, turned by a negator), quote, about."""
    own = [c for c in texts.columns if c != text]
    found = clause_spans(texts, rules, text, None, "clauses_")

    def told(clause: Column) -> Column:
        items = spans.of_kind(clause["spans"], "item")
        turned = {"good": "bad", "bad": "good"}
        value = lambda s: F.when(signals.taken_back(clause, s), F.create_map(*(F.lit(x) for kv in turned.items() for x in kv))[s["target"]]).otherwise(s["target"])
        return F.transform(spans.of_kind(clause["spans"], "cue"), lambda s: F.struct(value(s).alias("cue"), s["quote"].alias("quote"), spans.nearest(s, items)["target"].alias("about")))

    rows = found.select(*own, F.explode(F.flatten(F.transform(F.filter("clauses_", lambda c: ~c["asked"]), told))).alias("c"))
    return rows.select(*own, "c.cue", "c.quote", "c.about")


@catalog.query("cue_attribution", f"""
WITH {_READ_SQL}, c AS (SELECT o_custkey, 'good' AS cue, thing AS about FROM g WHERE love UNION ALL SELECT o_custkey, 'bad', '' FROM g WHERE stop) SELECT cue, about, COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS customers FROM c GROUP BY cue, about""")
def cue_attribution(spark: SparkSession, d: str) -> DataFrame:
    """What is praised and blamed, by the item that stands nearest."""
    told = signals.messages(spark, d).select("o_custkey", "text")
    found = cues(told, signals.rule_table(spark, CUES).unionByName(signals.entities(spark, d))).withColumn("about", F.coalesce("about", F.lit("")))
    per = found.groupBy("cue", "about", "o_custkey").agg(F.count("*").alias("n"))
    return per.groupBy("cue", "about").agg(F.sum("n").alias("n"), F.count("*").alias("customers"))


# ------------------------------------------------------------------------------------ budgets

_AMOUNT = r"[$€£]? ?(\d[\d,]*(?:\.\d+)?)(k|w| thousand| million)?(?![\d%])"


def amount_of(number: Column, unit: Column) -> Column:
    factor = F.when(unit.isin("k", " thousand"), 1_000).when(unit == "w", 10_000).when(unit == " million", 1_000_000).otherwise(1)
    return F.regexp_replace(number, ",", "").try_cast("double") * factor


def budget(text: Column) -> Column:
    """least and most of the first budget that a text states: a range, a bound from above or below, about (a tenth either way) or
    a sum; the unit of a range's end holds for its start if that has none. Null where none is told."""
    t = F.lower(text)

    reads = lambda pattern: F.regexp_extract(t, pattern, 0)
    lead = r"(?:budget|spend|pay|afford)[^0-9.!?\n$€£]{0,24}?"
    two = rf"{lead}{_AMOUNT} ?(?:-|–|to|and) ?{_AMOUNT}"
    one = rf"{lead}{_AMOUNT}"
    part = lambda pattern, k: F.regexp_extract(t, pattern, k)
    unit_a = F.when((part(two, 2) == "") & (amount_of(part(two, 1), F.lit("")) < amount_of(part(two, 3), F.lit(""))), part(two, 4)).otherwise(part(two, 2))
    a, b = amount_of(part(two, 1), unit_a), amount_of(part(two, 3), part(two, 4))
    x, said = amount_of(part(one, 1), part(one, 2)), reads(one)
    ranged = reads(two) != ""
    below, above, about = said.rlike(r"(under|below|up to|at most|less than|max)"), said.rlike(r"(over|above|at least|more than|from)"), said.rlike(r"(about|around|roughly|some)")
    least = F.when(ranged, F.least(a, b)).when(below, F.lit(None)).when(about, x * 0.9).otherwise(x)
    most = F.when(ranged, F.greatest(a, b)).when(above, F.lit(None)).when(about, x * 1.1).otherwise(x)
    return F.struct(F.round(least, 2).alias("least"), F.round(most, 2).alias("most"))


@catalog.query("amount_extract", """
WITH o AS (SELECT o_orderkey, o_orderstatus AS st, o_orderpriority AS pr, floor(o_totalprice)::DOUBLE AS p, floor(o_totalprice / 1000)::DOUBLE AS k FROM orders)
SELECT o_orderkey, CASE st WHEN 'F' THEN CASE WHEN pr < '3' THEN k * 1000 WHEN pr < '4' THEN p ELSE round(p * 0.9, 2) END WHEN 'O' THEN CASE WHEN pr < '3' THEN -1 ELSE p END ELSE CASE WHEN pr < '3' THEN p ELSE -1 END END AS least,
  CASE st WHEN 'F' THEN CASE WHEN pr < '3' THEN (k + 5) * 1000 WHEN pr < '4' THEN p + 500 ELSE round(p * 1.1, 2) END WHEN 'O' THEN CASE WHEN pr < '3' THEN p ELSE -1 END ELSE CASE WHEN pr < '3' THEN p ELSE -1 END END AS most FROM o""")
def amount_extract(spark: SparkSession, d: str) -> DataFrame:
    """Budgets that customers state in eight ways, as bounds; -1 for none."""
    st, pr, p = F.col("o_orderstatus"), F.col("o_orderpriority"), F.floor(F.col("o_totalprice"))
    tell = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    k, written_out = F.floor(F.col("o_totalprice") / 1000), F.format_number(p, 0)
    text = F.when(st == "F", F.when(pr < "3", tell("My budget is ", k, "-", k + 5, "k, 3 doors")).when(pr < "4", tell("I can spend between $", written_out, " and $", F.format_number(p + 500, 0), ".")).otherwise(tell("Budget: about ", written_out, " euros"))).when(
        st == "O", F.when(pr < "3", tell("we pay up to €", written_out, " for 2")).otherwise(tell("budget at least ", p, " or so"))
    ).otherwise(F.when(pr < "3", tell("I could afford ", p)).otherwise(tell(p, " is what it costs")))
    b = load(spark, d, "orders").select("o_orderkey", budget(text).alias("b"))
    return b.select("o_orderkey", *(F.coalesce(f"b.{c}", F.lit(-1.0)).alias(c) for c in ("least", "most")))


# ------------------------------------------------------------------------------------ topics, relevance, accounts, leads


@catalog.query("title_topics", """
SELECT p_partkey, concat_ws(',', CASE WHEN c IN ('red', 'blue') THEN 'colour' ELSE 'state' END || ':' || c, 'thing:' || t, CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'price:' || lower(p_type) ELSE 'size:' || lower(p_type) END) AS topics FROM (SELECT *, split_part(p_name, ' ', 1) AS c, split_part(p_name, ' ', 2) AS t FROM part)""")
def title_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics of each part's title by a table of words: kind and word, in the order of the title."""
    name = F.split("p_name", " ")
    p = load(spark, d, "part")
    first = p.select(F.when(name[0].isin("red", "blue"), "colour").otherwise("state").alias("kind"), name[0].alias("alias"))
    kind = p.select(F.when(F.col("p_type").isin("PROMO", "ECONOMY"), "price").otherwise("size").alias("kind"), F.lower("p_type").alias("alias"))
    words = first.unionByName(p.select(F.lit("thing").alias("kind"), name[1].alias("alias"))).unionByName(kind).distinct().withColumn("target", F.col("alias"))
    title = F.concat(F.initcap("p_name"), F.lit(": "), F.lower("p_type"), F.lit("!"))
    # a word may be a state of one title and a size in another: only the kind that its place asks for counts
    found = clause_spans(p.select("p_partkey", title.alias("text")), words, "text", None, "clauses_")
    front, back = (F.filter(F.flatten(F.transform("clauses_", lambda c: c["spans"])), cond) for cond in (lambda s: s["kind"].isin("colour", "state", "thing") & (s["end"] <= F.instr("text", ":") - 1), lambda s: s["kind"].isin("price", "size") & (s["start"] >= F.instr("text", ":"))))
    return found.select("p_partkey", F.concat_ws(",", F.transform(F.concat(front, back), lambda s: F.concat_ws(":", s["kind"], s["target"]))).alias("topics"))


@catalog.query("relevant_notes", f"""
WITH {_READ_SQL}, k AS (SELECT split_part(p_name, ' ', 2) AS thing FROM part GROUP BY 1 HAVING avg(p_retailprice) >= (SELECT avg(p_retailprice) FROM part))
SELECT o_orderkey, CASE WHEN NOT (stock OR price OR love OR own) THEN 'none named' WHEN thing IN (SELECT thing FROM k) THEN 'in scope' END AS why FROM g WHERE NOT (stock OR price OR love OR own) OR thing IN (SELECT thing FROM k)""")
def relevant_notes(spark: SparkSession, d: str) -> DataFrame:
    """Messages that name an item in scope, or none at all; those that name only others aren't relevant. In scope is what is dear."""
    part = load(spark, d, "part").select(F.split("p_name", " ")[1].alias("target"), "p_retailprice")
    mean = part.agg(F.avg("p_retailprice").alias("mean"))
    scope = part.groupBy("target").agg(F.avg("p_retailprice").alias("own")).join(F.broadcast(mean)).select("target", F.when(F.col("own") >= F.col("mean"), "in").otherwise("out").alias("kind"), F.col("target").alias("alias"))
    found = clause_spans(signals.messages(spark, d).select("o_orderkey", "text"), scope, "text", None, "clauses_")
    kinds = F.array_distinct(F.flatten(F.transform("clauses_", lambda c: c["spans"]["kind"])))
    why = F.when(F.array_contains(kinds, "in"), "in scope").when(F.size(kinds) == 0, "none named")
    return found.select("o_orderkey", why.alias("why")).where("why is not null")


@catalog.query("industry_accounts", """
SELECT s_suppkey, s_acctbal > 5000 AS by_name, concat_ws(',', CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 'leasing' END, CASE WHEN s_acctbal < 0 THEN 'fleet' END) AS keywords FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_acctbal > 5000 OR s_acctbal < 0 OR r_name IN ('ASIA', 'EUROPE')""")
def industry_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Accounts of the trade: by the convention of their names, or by words of the trade in what they say of themselves."""
    n = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = load(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("s_acctbal") > 5000, F.concat(F.lit("Official Store "), "s_name")).otherwise(F.concat("s_name", F.lit(" (Salesforce user)")))
    bio = F.concat_ws(". ", F.when(F.col("r_name").isin("ASIA", "EUROPE"), F.concat(F.lit("Leasing in "), "n_name")), F.when(F.col("s_acctbal") < 0, "We serve whole fleets, Fleet-Management"), F.lit("Hello"))
    trade = spark.createDataFrame([("trade", w, a) for w, own in (("leasing", ("leasing", "lease")), ("fleet", ("fleet", "fleets", "fleet management"))) for a in own], "kind string, target string, alias string")
    found = clause_spans(s.select("s_suppkey", name.alias("name"), bio.alias("text")), trade, "text", None, "clauses_")
    words = F.array_distinct(F.flatten(F.transform("clauses_", lambda c: c["spans"]["target"])))
    rows = found.select("s_suppkey", F.col("name").rlike(SELLERS).alias("by_name"), F.concat_ws(",", words).alias("keywords"))
    return rows.where("by_name or keywords <> ''")


@catalog.query("rescreen", f"""
WITH {_READ_SQL}, s AS (SELECT o_custkey, bool_or(NOT stop AND NOT own AND (visit OR stock OR price OR loan)) AS was, bool_or(NOT stop AND NOT own AND wants) AS now_, bool_or(stop) AS stopped FROM g GROUP BY o_custkey)
SELECT was, CASE WHEN stopped THEN 'suppressed' WHEN now_ AND NOT was THEN 'restored' WHEN now_ THEN 'kept' ELSE 'dropped' END AS outcome, COUNT(*) AS n FROM s GROUP BY ALL""")
def rescreen(spark: SparkSession, d: str) -> DataFrame:
    """Leads screened again: the ladder of then, without its softer rungs, against today's, and who asked to be left alone."""
    told = signals.messages(spark, d).select("o_custkey", "text")
    rules = signals.rule_table(spark).unionByName(signals.entities(spark, d))
    old = tuple(r for r in signals.LADDER if r[0] not in ("research", "awareness"))
    now = signals.analyse(told, rules)
    before = signals.rung(F.col("codes"), old)
    per = now.groupBy("o_custkey").agg(F.bool_or(F.col("purchase_signal") & before.isNotNull()).alias("was"), F.bool_or("purchase_signal").alias("now_"), F.bool_or(F.array_contains("codes", "refusal")).alias("stopped"))
    outcome = F.when(F.col("stopped"), "suppressed").when(F.col("now_") & ~F.col("was"), "restored").when(F.col("now_"), "kept").otherwise("dropped")
    return per.groupBy("was", outcome.alias("outcome")).agg(F.count("*").alias("n"))


#: What a lead of a payload must look like.
LEAD_SCHEMA = {"type": "object", "required": ["phone", "at"], "properties": {"phone": {"type": "string", "pattern": "^[0-9]{6}$"}, "name": {"type": ["string", "null"], "minLength": 1}, "score": {"type": "number", "minimum": 0}, "at": {"type": "integer"}}}


def webhook(rows: DataFrame, schema: dict, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Leads of a payload by phone, and what was refused: count of rows by their first problem.

    A row that breaks the schema is refused alone. Rows of one phone are one lead: the first name that is told, the best score, the latest time.
    """
    judged = rows.select(raw, violations(F.col(raw), schema).alias("problems"))
    refused = judged.where(F.size("problems") > 0).groupBy(F.concat_ws(":", F.get("problems", F.lit(0))["path"], F.get("problems", F.lit(0))["problem"]).alias("problem")).agg(F.count("*").alias("rows"))
    field = lambda name, kind: F.get_json_object(raw, f"$.{name}").try_cast(kind).alias(name)
    good = judged.where(F.size("problems") == 0).select(field("phone", "string"), field("name", "string"), field("score", "double"), field("at", "long"))
    named = F.when(F.col("name").isNotNull(), F.struct("at", "name"))
    leads = good.groupBy("phone").agg(F.count("*").alias("rows"), F.min(named)["name"].alias("name"), F.max("score").alias("score"), F.max("at").alias("at"))
    return leads, refused


@catalog.query("webhook_leads", """
WITH r AS (SELECT lpad((c_nationkey * 1000 + length(c_mktsegment))::VARCHAR, 6, '0') AS phone, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE c_name END AS name, c_acctbal AS score, c_custkey AS moment FROM customer WHERE c_acctbal >= 0 AND c_acctbal < 9500)
SELECT phone, COUNT(*) AS rows, coalesce(arg_min(name, moment) FILTER (WHERE name IS NOT NULL), '') AS name, MAX(score) AS score, MAX(moment) AS seen FROM r GROUP BY phone
UNION ALL SELECT '$.score:minimum', COUNT(*), '', 0, 0 FROM customer WHERE c_acctbal < 0 UNION ALL SELECT '$.phone:pattern', COUNT(*), '', 0, 0 FROM customer WHERE c_acctbal >= 9500""")
def webhook_leads(spark: SparkSession, d: str) -> DataFrame:
    """Leads of a payload made of customers, and the counts of what was refused and why."""
    c = load(spark, d, "customer")
    phone = F.lpad((F.col("c_nationkey") * 1000 + F.char_length("c_mktsegment")).cast("string"), 6, "0")
    body = F.struct(F.when(F.col("c_acctbal") >= 9500, F.concat(F.lit("+"), phone)).otherwise(phone).alias("phone"), F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.col("c_name")).alias("name"), F.col("c_acctbal").alias("score"), F.col("c_custkey").alias("at"))
    leads, refused = webhook(c.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("raw")), LEAD_SCHEMA)
    empty = refused.select(F.col("problem").alias("phone"), "rows", F.lit("").alias("name"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("seen"))
    return leads.select("phone", "rows", F.coalesce("name", F.lit("")).alias("name"), "score", F.col("at").alias("seen")).unionByName(empty)


# ------------------------------------------------------------------------------------ stored answers


def faq_answers(questions: DataFrame, faqs: DataFrame, least: float = 0.34) -> DataFrame:
    """The columns of questions but their text, with faq and score: the stored question of the same card that is most alike.

    questions: card and text, faqs: card, faq and question. Alike is what two sets of bigrams share over the larger one; less than
    `least` is no answer, and then there is no row; ties go to the smallest faq. A card has few stored questions.
    """
    own = [c for c in questions.columns if c != "text"]
    asked = questions.withColumn("q_", char_ngrams(F.col("text"))).drop("text")
    stored = faqs.select("card", "faq", char_ngrams(F.col("question")).alias("s_")).where(F.size("s_") > 0)
    both = F.size(F.array_intersect("q_", "s_"))
    met = asked.join(stored, "card").select(*own, "faq", half_up(both / F.greatest(F.size("q_"), F.size("s_"), F.lit(1)), 3).alias("score")).where(F.col("score") >= least)
    return met.groupBy(*own).agg(F.min(F.struct((-F.col("score")).alias("m"), "faq")).alias("b")).select(*own, "b.faq", (-F.col("b.m")).alias("score"))


@catalog.query("faq_match", f"""
WITH {_READ_SQL}, n AS (SELECT DISTINCT p_name FROM part), q AS (SELECT o_orderkey, thing AS card, 'Is the ' || colour || ' ' || thing || ' in stock?' AS t FROM g WHERE stock UNION ALL SELECT o_orderkey, thing, 'How much is the ' || thing || '?' FROM g WHERE price),
fq AS (SELECT split_part(p_name, ' ', 2) AS card, 'stock:' || p_name AS faq, 'Is a ' || p_name || ' in stock now?' AS question FROM n UNION ALL SELECT DISTINCT split_part(p_name, ' ', 2), 'price:' || split_part(p_name, ' ', 2), 'And how much is a ' || split_part(p_name, ' ', 2) || ' today?' FROM n),
e AS (SELECT DISTINCT card, t FROM q), b AS (SELECT x, list_distinct(list_transform(range(1, length(m)), lambda i: substr(m, i, 2))) AS g FROM (SELECT x, regexp_replace(lower(x), '[^a-z0-9]', '', 'g') AS m FROM (SELECT t AS x FROM e UNION SELECT question FROM fq))),
s AS (SELECT e.card, e.t, faq, floor(len(list_intersect(a.g, c.g)) / greatest(len(a.g), len(c.g))::DOUBLE * 1000 + 0.5) / 1000 AS score FROM e JOIN fq ON fq.card = e.card JOIN b a ON a.x = e.t JOIN b c ON c.x = fq.question),
k AS (SELECT card, t, arg_min(faq, {{'m': -score, 'f': faq}}) AS faq, max(score) AS score FROM s WHERE score >= 0.34 GROUP BY card, t)
SELECT o_orderkey, card, faq, score FROM q JOIN k USING (card, t)""")
def faq_match(spark: SparkSession, d: str) -> DataFrame:
    """The stored question of the item that each question names, by likeness."""
    told = signals.messages(spark, d).select("o_orderkey", F.explode(F.regexp_extract_all("text", F.lit(r"(?:Is|How much is) the [^?]*\?"), F.lit(0))).alias("text"))
    asked = told.select("o_orderkey", F.regexp_extract("text", r"(\w+)(?: in stock)?\?$", 1).alias("card"), "text")
    part = load(spark, d, "part").select("p_name", F.split("p_name", " ")[1].alias("card"))
    stock = part.select("card", F.concat(F.lit("stock:"), "p_name").alias("faq"), F.concat(F.lit("Is a "), "p_name", F.lit(" in stock now?")).alias("question"))
    price = part.select("card", F.concat(F.lit("price:"), "card").alias("faq"), F.concat(F.lit("And how much is a "), "card", F.lit(" today?")).alias("question"))
    return faq_answers(asked, stock.unionByName(price).distinct())
