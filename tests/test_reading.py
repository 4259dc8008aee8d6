"""Lexicons, reasons, roles, questions, cues and budgets, case by case."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import reading, signals

ENTITIES = [("item", "widget", "widget"), ("item", "bolt", "bolt")]


@pytest.fixture(scope="module")
def rules(spark):
    return signals.rule_table(spark).unionByName(spark.createDataFrame(ENTITIES, "kind string, target string, alias string"))


def table(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")


def test_lexicons_against_a_loop(spark, monkeypatch):
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 4))) for _ in range(40)})
    texts = ["".join(rnd.choice("abéABÉ .") for _ in range(rnd.randint(0, 12))) for _ in range(200)] + [None, "ab" * 100_000]
    lexicon = spark.createDataFrame([(w,) for w in words] + [(None,), (words[0],)], "w string")
    for most in (200_000, 7):  # at once and in parts
        monkeypatch.setattr(reading, "MOST", most)
        got = [r.hits for r in reading.contained(table(spark, texts), lexicon).orderBy("i").collect()]
        assert got == [sorted(w for w in words if t and w in t.lower()) for t in texts]
    assert {len(r.hits) for r in reading.contained(table(spark, texts), lexicon.limit(0)).collect()} == {0}


def test_reasons_and_roles(spark, rules):
    cases = {
        "": ("empty", "UNKNOWN"), "!!! 👍": ("empty", "UNKNOWN"), None: ("empty", "UNKNOWN"), "So nice, love it": ("pure_praise", "UNKNOWN"), "ok": ("too_short", "UNKNOWN"), "the sun is out again": ("no_signal", "UNKNOWN"),
        "How much is the widget?": ("keyword_hit", "BUYER"), "DM me for prices, limited offer": ("marketing_account", "SELLER"), "I bought a bolt": ("keyword_hit", "OWNER"), "In this video": ("keyword_hit", "CREATOR"), "I do not need a loan": ("keyword_hit", "UNKNOWN"),
    }
    df = signals.analyse(table(spark, list(cases)), rules).withColumn("name", F.lit("Ann"))
    rows = reading.actor(reading.skip_reason(df), "name").orderBy("i").collect()
    assert [(r.reason, r.actor) for r in rows] == list(cases.values())
    named = spark.createDataFrame([("City Motors | Jo",), ("Restorer",), (None,)], "name string")
    one = signals.analyse(named.withColumn("text", F.lit("How much?")), rules)
    assert sorted((str(r["name"]), r.actor) for r in reading.actor(one, "name").collect()) == [("City Motors | Jo", "DEALER"), ("None", "BUYER"), ("Restorer", "BUYER")]


def test_questions_and_cues(spark, rules):
    texts = ["How much is the bolt? And how much the widget?", "Available. In stock?", "how much was that jacket?", None, ""]
    got = sorted((r.i, r.cluster, r.about) for r in reading.clusters(table(spark, texts), rules).collect())
    assert got == [(0, "price", "bolt"), (1, "inventory", None)]
    own = signals.rule_table(spark, reading.CUES).unionByName(spark.createDataFrame(ENTITIES, "kind string, target string, alias string"))
    texts = ["I love the bolt, not the widget", "the widget is not great", "is the bolt broken?", "a terrible widget. A great bolt", None]
    got = sorted((r.i, r.cue, r.quote, r.about) for r in reading.cues(table(spark, texts), own).collect())
    assert got == [(0, "good", "love", "bolt"), (1, "bad", "great", "widget"), (3, "bad", "terrible", "widget"), (3, "good", "great", "bolt")]


def test_budgets(spark):
    cases = {
        "my budget is 20-30k": (20_000, 30_000), "budget 20k to 30k": (20_000, 30_000), "I can spend between $1,200.50 and $1,500": (1200.5, 1500), "budget: 30 to 20": (20, 30), "we pay up to 2 million": (None, 2_000_000), "budget under 500": (None, 500), "afford at least 300": (300, None),
        "budget about 1,000": (900, 1100), "budget is 5w": (50_000, 50_000), "it costs 500": (None, None), "no budget. 500": (None, None), "budget 5%": (None, None), None: (None, None), "": (None, None), "budget " + "x" * 100_000 + " 5": (None, None),
    }
    got = [tuple(r.b) for r in table(spark, list(cases)).orderBy("i").select(reading.budget(F.col("text")).alias("b")).collect()]
    assert got == list(cases.values())


def test_stored_answers(spark):
    q = spark.createDataFrame([(1, "a", "How long is the range?"), (2, "a", "what colour"), (3, "b", "how long is the range"), (4, None, "how long"), (5, "a", None), (6, "a", "")], "i int, card string, text string")
    f = spark.createDataFrame([("a", "f2", "how long is the range"), ("a", "f1", "HOW LONG is the range!"), ("a", "f3", "how long is the range of this car in winter, and in summer"), ("b", "f4", "is the range long"), ("b", "f5", "")], "card string, faq string, question string")
    grams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    x, y = grams("howlongistherange"), grams("istherangelong")
    got = {r.i: (r.faq, r.score) for r in reading.faq_answers(q, f).collect()}
    assert got == {1: ("f1", 1.0), 3: ("f4", int(len(x & y) / max(len(x), len(y)) * 1000 + 0.5) / 1000)}
