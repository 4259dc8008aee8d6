"""Weights of content pillars, what to do next with a lead, and whether an account may act.

Each works on tables of facts per account or lead; nothing is gathered but what one account or lead has of a fixed list.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import Catalog
from millrace.functions.columns import half_up
from millrace.io import load

catalog = Catalog()
QUERIES, ORACLE_SQL = catalog.queries, catalog.sql

# What a goal, research, attributed leads and engagement add to a pillar's weight; the factor of a pillar
# that brought no lead; the share below which a pillar is dropped; counts and shares from which research counts.
GOAL, RESEARCH, ATTRIBUTION, ENGAGEMENT, NO_LEAD, LEAST = 0.12, 0.1, 0.3, 0.03, 0.8, 0.05
MIN_COUNT, MIN_SHARE, FULL_SHARE = 2, 0.15, 0.3


def pillar_weights(mix: DataFrame, results: DataFrame, goals: DataFrame, research: DataFrame) -> DataFrame:
    """account, pillar, weight: shares of thousandths that sum to 1, from 0.05 on; the largest takes up what rounding leaves.

    mix: account, pillar, share (any positive scale); results: account, pillar, posts, leads, engagement; goals: account,
    pillar, strength; research: account, pillar, fit, count, share of questions. An account's pillars are a fixed list.
    """
    base = mix.where("share > 0").groupBy("account", "pillar").agg(F.sum("share").alias("share"))
    base = base.join(base.groupBy("account").agg(F.sum("share").alias("total")), "account").select("account", "pillar", (F.col("share") / F.col("total")).alias("w"))
    told = results.groupBy("account", "pillar").agg(*(F.sum(c).alias(c) for c in ("posts", "leads", "engagement")))
    rate = F.when(F.col("posts") > 0, F.col("leads") / F.col("posts")).otherwise(0.0)
    sums = told.groupBy("account").agg(F.sum("leads").alias("all_leads"), F.sum(rate).alias("all_rates"), F.sum("engagement").alias("all_engagement"))
    share = lambda a, b: F.when(F.col(b) > 0, a / F.col(b)).otherwise(0.0)
    told = told.join(sums, "account").select(
        "account", "pillar", F.when((F.col("all_leads") > 0) & (F.col("posts") >= 2) & (F.col("leads") == 0), NO_LEAD).otherwise(1.0).alias("factor"),
        (ATTRIBUTION * share(rate, "all_rates") + ENGAGEMENT * share(F.greatest("engagement", F.lit(0)), "all_engagement")).alias("more"),
    )
    boost = goals.select("account", "pillar", (GOAL * F.col("strength")).alias("b"))
    asked = (F.col("count") >= MIN_COUNT) & (F.col("share") >= MIN_SHARE)
    boost = boost.unionByName(research.where(asked).select("account", "pillar", (RESEARCH * F.col("fit") * F.least(F.lit(1.0), F.col("share") / FULL_SHARE)).alias("b"))).groupBy("account", "pillar").agg(F.sum("b").alias("b"))
    keys = ["account", "pillar"]
    raw = base.join(boost, keys, "full").join(told, keys, "full").select(*keys, ((F.coalesce("w", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))) * F.coalesce("factor", F.lit(1.0)) + F.coalesce("more", F.lit(0.0))).alias("w")).where("w > 0")
    return normalised(raw)


def normalised(raw: DataFrame) -> DataFrame:
    """Weights per account as shares: those under LEAST go, unless all do; then thousandths that sum to 1."""
    total = raw.join(raw.groupBy("account").agg(F.sum("w").alias("t"), F.max("w").alias("top")), "account").withColumn("s", F.col("w") / F.col("t"))
    kept = total.where((F.col("s") >= LEAST) | ((F.col("top") / F.col("t") < LEAST) & (F.col("w") == F.col("top"))))
    kept = kept.join(kept.groupBy("account").agg(F.sum("s").alias("k")), "account").select("account", "pillar", half_up(F.col("s") / F.col("k"), 3).alias("weight"))
    first = F.min(F.struct((-F.col("weight")).alias("m"), "pillar"))["pillar"]
    rest = kept.groupBy("account").agg(first.alias("largest"), F.sum("weight").alias("sum"))
    weight = F.when(F.col("pillar") == F.col("largest"), F.round(F.col("weight") + 1 - F.col("sum"), 3)).otherwise(F.col("weight"))
    return kept.join(rest, "account").select("account", "pillar", weight.alias("weight"))


def next_action(stage: Column, suppressed: Column, human: Column, waiting_hours: Column, due: Column, appointment: Column) -> Column:
    """What to do next with a lead: the first rung that holds.

    human: a conversation waits for one; waiting_hours: since the last message to the lead that has no reply, null if none
    waits; due: follow-ups are allowed again; appointment: proposed, confirmed or no_show.
    """
    chase = F.when(waiting_hours.isNull(), "write first message").when(waiting_hours < 24, "wait for reply").when(due, "follow up").otherwise("wait until follow-up is due")
    return (
        F.when(suppressed, "do not contact").when(stage == "won", "none: won").when(stage == "lost", "none: lost").when(human, "take over conversation")
        .when(stage == "discovered", "judge signals").when(stage == "candidate", "wait for signals").when(stage == "qualified", "assign account")
        .when(stage.isin("assigned", "contacted"), chase).when(stage == "replied", "answer").when(stage == "sales_qualified", "ask for contact").when(stage == "contact_acquired", "invite to visit")
        .when(stage == "appointment", F.when(appointment == "no_show", "invite again").when(appointment == "confirmed", "prepare visit").otherwise("confirm visit"))
        .when(stage == "visited", "follow up on offer").when(stage == "negotiating", "close").otherwise("check by hand")
    )


def operable(status: Column, restricted: Column, signed_in: Column, at_risk: Column) -> tuple[Column, Column]:
    """verdict (ok, review or blocked) and the first reason of an account."""
    reason = F.when(status == "disabled", "disabled").when(restricted, "restricted").when(~signed_in, "sign in again").when(at_risk, "at risk").when(status == "paused", "paused").when(status == "cooldown", "cooling down").otherwise("fine")
    return F.when(reason.isin("disabled", "restricted"), "blocked").when(reason == "fine", "ok").otherwise("review"), reason


# ------------------------------------------------------------------------------------ queries


@catalog.query("strategy_weights", """
WITH l AS (SELECT l_suppkey AS account, p_type AS pillar, l_orderkey, l_quantity AS q, l_returnflag = 'A' AS post, l_returnflag = 'A' AND l_discount >= 0.085 AS lead, l_returnflag = 'R' AS ask FROM lineitem JOIN part ON p_partkey = l_partkey),
b AS (SELECT account, pillar, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY account) AS w FROM l WHERE NOT post AND NOT ask GROUP BY account, pillar),
t AS (SELECT account, pillar, count(*) FILTER (WHERE post) AS posts, count(*) FILTER (WHERE lead) AS leads, coalesce(sum(q) FILTER (WHERE post), 0) AS eng FROM l GROUP BY account, pillar),
u AS (SELECT *, CASE WHEN posts > 0 THEN leads / posts::DOUBLE ELSE 0 END AS rate FROM t),
v AS (SELECT *, sum(leads) OVER (PARTITION BY account) AS al, sum(rate) OVER (PARTITION BY account) AS ar, sum(eng) OVER (PARTITION BY account) AS ae FROM u),
r AS (SELECT account, pillar, count(*) FILTER (WHERE ask) AS n, count(*) FILTER (WHERE ask) / nullif(sum(count(*) FILTER (WHERE ask)) OVER (PARTITION BY account), 0)::DOUBLE AS share FROM l GROUP BY account, pillar),
w AS (SELECT v.account, v.pillar, (coalesce(b.w, 0) + CASE WHEN v.pillar = 'PROMO' THEN 0.12 * CASE WHEN s_acctbal > 0 THEN 1.0 ELSE 0.5 END ELSE 0 END + CASE WHEN n >= 2 AND share >= 0.15 THEN 0.1 * CASE WHEN v.pillar = 'ECONOMY' THEN 1.0 ELSE 0.4 END * least(1.0, share / 0.3) ELSE 0 END) * CASE WHEN al > 0 AND posts >= 2 AND leads = 0 THEN 0.8 ELSE 1 END
  + 0.3 * CASE WHEN ar > 0 THEN rate / ar ELSE 0 END + 0.03 * CASE WHEN ae > 0 THEN eng / ae ELSE 0 END AS w FROM v JOIN supplier ON s_suppkey = v.account LEFT JOIN b USING (account, pillar) LEFT JOIN r ON r.account = v.account AND r.pillar = v.pillar),
x AS (SELECT account, pillar, w / sum(w) OVER (PARTITION BY account) AS s FROM w WHERE w > 0), y AS (SELECT account, pillar, floor(s / sum(s) OVER (PARTITION BY account) * 1000 + 0.5) / 1000 AS weight FROM x WHERE s >= 0.05)
SELECT account, pillar, CASE WHEN row_number() OVER (PARTITION BY account ORDER BY weight DESC, pillar) = 1 THEN round(weight + 1 - sum(weight) OVER (PARTITION BY account), 3) ELSE weight END AS weight FROM y""")
def strategy_weights(spark: SparkSession, d: str) -> DataFrame:
    """Pillars of all suppliers: what they ship, their goal, what is asked about, and what brought leads."""
    line = load(spark, d, "lineitem").join(load(spark, d, "part").select("p_partkey", F.col("p_type").alias("pillar")), F.col("l_partkey") == F.col("p_partkey"))
    line = line.select(F.col("l_suppkey").alias("account"), "pillar", F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("flag"), "l_discount")
    per = line.groupBy("account", "pillar").agg(F.count_if(F.col("flag") == "N").cast("double").alias("share"), F.count_if(F.col("flag") == "A").alias("posts"), F.count_if((F.col("flag") == "A") & (F.col("l_discount") >= 0.085)).alias("leads"), F.coalesce(F.sum(F.when(F.col("flag") == "A", F.col("q"))), F.lit(0.0)).alias("engagement"), F.count_if(F.col("flag") == "R").alias("count"))
    asked = per.join(per.groupBy("account").agg(F.sum("count").alias("all")), "account").select("account", "pillar", F.when(F.col("pillar") == "ECONOMY", 1.0).otherwise(0.4).alias("fit"), "count", (F.col("count") / F.greatest("all", F.lit(1))).alias("share"))
    goals = load(spark, d, "supplier").select(F.col("s_suppkey").alias("account"), F.lit("PROMO").alias("pillar"), F.when(F.col("s_acctbal") > 0, 1.0).otherwise(0.5).alias("strength")).join(per.select("account", "pillar"), ["account", "pillar"], "left_semi")
    return pillar_weights(per.select("account", "pillar", "share"), per, goals, asked)


_LEAD_SQL = """u AS (SELECT user_id, max(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE -1 END) FILTER (WHERE value > 60) AS depth, bool_or(event_type = 'error' AND value > 97) AS suppressed, bool_or(event_type = 'purchase' AND value > 97) AS won,
  arg_max(event_type, (ts, event_id)) AS latest, max(ts) AS last, max(ts) FILTER (WHERE event_type = 'click') AS sent, max(ts) FILTER (WHERE event_type = 'view') AS answered, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY user_id)"""


@catalog.query("next_action", f"""
WITH {_LEAD_SQL}, s AS (SELECT *, CASE WHEN won THEN 'won' WHEN errors > 12 THEN 'lost' WHEN latest = 'signup' THEN 'appointment' WHEN latest = 'purchase' THEN 'visited' WHEN latest = 'error' THEN 'replied' WHEN latest = 'click' THEN 'contacted' WHEN depth >= 2 THEN 'qualified' ELSE 'candidate' END AS stage, CASE WHEN answered IS NULL OR sent > answered THEN date_diff('hour', sent, TIMESTAMP '2024-01-31') END AS waiting FROM u)
SELECT user_id, CASE WHEN suppressed THEN 'do not contact' WHEN stage = 'won' THEN 'none: won' WHEN stage = 'lost' THEN 'none: lost' WHEN errors = 12 THEN 'take over conversation' WHEN stage = 'candidate' THEN 'wait for signals' WHEN stage = 'qualified' THEN 'assign account'
  WHEN stage = 'contacted' THEN CASE WHEN waiting IS NULL THEN 'write first message' WHEN waiting < 24 THEN 'wait for reply' WHEN errors < 8 THEN 'follow up' ELSE 'wait until follow-up is due' END WHEN stage = 'replied' THEN 'answer' WHEN stage = 'appointment' THEN CASE WHEN errors > 6 THEN 'invite again' ELSE 'confirm visit' END ELSE 'follow up on offer' END AS action FROM s""")
def next_action_query(spark: SparkSession, d: str) -> DataFrame:
    """What to do next with each user."""
    kind, value, at = F.col("event_type"), F.col("value"), F.struct("ts", "event_id")
    depth = F.when(kind == "view", 0).when(kind == "click", 1).when(kind == "signup", 2).when(kind == "purchase", 3).otherwise(-1)
    last = lambda name: F.max(F.when(kind == name, F.col("ts").cast("timestamp")))
    u = load(spark, d, "events").groupBy("user_id").agg(
        F.max(F.when(value > 60, depth)).alias("depth"), F.bool_or((kind == "error") & (value > 97)).alias("suppressed"), F.bool_or((kind == "purchase") & (value > 97)).alias("won"),
        F.max_by("event_type", at).alias("latest"), last("click").alias("sent"), last("view").alias("answered"), F.count_if(kind == "error").alias("errors"),
    )
    latest = F.col("latest")
    stage = F.when(F.col("won"), "won").when(F.col("errors") > 12, "lost").when(latest == "signup", "appointment").when(latest == "purchase", "visited").when(latest == "error", "replied").when(latest == "click", "contacted").when(F.col("depth") >= 2, "qualified").otherwise("candidate")
    hours = F.when(F.col("answered").isNull() | (F.col("sent") > F.col("answered")), F.floor(F.unix_seconds(F.lit("2024-01-31").cast("timestamp")) / 3600) - F.floor(F.unix_seconds("sent") / 3600))
    action = next_action(stage, F.col("suppressed"), F.col("errors") == 12, hours, F.col("errors") < 8, F.when(F.col("errors") > 6, "no_show").otherwise("proposed"))
    return u.select("user_id", action.alias("action"))


@catalog.query("operable", """
WITH u AS (SELECT l_suppkey, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) AS bad, max(l_shipdate) AS last FROM lineitem GROUP BY l_suppkey), t AS (SELECT max(l_shipdate) AS now_ FROM lineitem),
r AS (SELECT s_suppkey, CASE WHEN s_acctbal < -900 THEN 'disabled' WHEN coalesce(bad, 0) > 0.38 THEN 'restricted' WHEN last IS NULL OR last < now_ - INTERVAL 30 DAY THEN 'sign in again' WHEN bad > 0.345 THEN 'at risk' WHEN s_acctbal < 0 THEN 'paused' WHEN s_acctbal < 500 THEN 'cooling down' ELSE 'fine' END AS reason FROM supplier LEFT JOIN u ON l_suppkey = s_suppkey, t)
SELECT s_suppkey, CASE WHEN reason IN ('disabled', 'restricted') THEN 'blocked' WHEN reason = 'fine' THEN 'ok' ELSE 'review' END AS verdict, reason FROM r""")
def operable_query(spark: SparkSession, d: str) -> DataFrame:
    """Whether each supplier may act, by its balance, the share of its returns and its last shipment."""
    line = load(spark, d, "lineitem")
    u = line.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("bad"), F.max("l_shipdate").alias("last"))
    today = line.agg(F.max("l_shipdate").alias("today"))
    s = load(spark, d, "supplier").join(u, "s_suppkey", "left").join(F.broadcast(today))
    balance, bad = F.col("s_acctbal"), F.coalesce("bad", F.lit(0.0))
    status = F.when(balance < -900, "disabled").when(balance < 0, "paused").when(balance < 500, "cooldown").otherwise("active")
    fresh = F.coalesce(F.col("last") >= F.col("today") - F.expr("interval 30 days"), F.lit(False))
    verdict, reason = operable(status, bad > 0.38, fresh, bad > 0.345)
    return s.select("s_suppkey", verdict.alias("verdict"), reason.alias("reason"))
