"""Weights of pillars against a loop, and ladders rung by rung."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.operators import strategy


def by_hand(mix, results, goals, research):
    w = defaultdict(lambda: defaultdict(float))
    for a, p, s in mix:
        total = sum(x for b, _, x in mix if b == a and x > 0)
        if s > 0:
            w[a][p] += s / total
    for a, p, s in goals:
        w[a][p] += strategy.GOAL * s
    for a, p, fit, n, share in research:
        if n >= 2 and share >= 0.15:
            w[a][p] += strategy.RESEARCH * fit * min(1, share / 0.3)
    for a in {r[0] for r in results}:
        own = {p: (n, k, e) for b, p, n, k, e in results if b == a}
        rates = {p: k / n if n else 0 for p, (n, k, e) in own.items()}
        for p, (n, k, e) in own.items():
            if sum(x[1] for x in own.values()) and n >= 2 and not k:
                w[a][p] *= strategy.NO_LEAD
            if sum(rates.values()):
                w[a][p] += strategy.ATTRIBUTION * rates[p] / sum(rates.values())
            if sum(x[2] for x in own.values()):
                w[a][p] += strategy.ENGAGEMENT * e / sum(x[2] for x in own.values())
    out = {}
    for a, own in w.items():
        total = sum(own.values())
        kept = {p: x / total for p, x in own.items() if x > 0 and x / total >= strategy.LEAST}
        got = {p: int(x / sum(kept.values()) * 1000 + 0.5) / 1000 for p, x in kept.items()}
        first = min(got, key=lambda p: (-got[p], p))
        got[first] = round(got[first] + 1 - sum(got.values()), 3)
        out |= {(a, p): x for p, x in got.items()}
    return out


def test_weights_against_a_loop(spark):
    rnd = random.Random(3)
    pillars = "abcdefg"
    mix = [(a, p, rnd.choice([0.0, 1.0, 2.5, 9.0])) for a in range(12) for p in rnd.sample(pillars, 5)]
    results = [(a, p, n := rnd.randrange(5), rnd.randint(0, n), float(rnd.randrange(50))) for a in range(12) for p in rnd.sample(pillars, 4)]
    goals = [(a, rnd.choice(pillars), 0.5) for a in range(0, 12, 2)]
    research = [(a, p, 0.6, rnd.randrange(5), rnd.random() / 2) for a in range(12) for p in rnd.sample(pillars, 2)]
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    got = strategy.pillar_weights(make(mix, "account long, pillar string, share double"), make(results, "account long, pillar string, posts long, leads long, engagement double"), make(goals, "account long, pillar string, strength double"), make(research, "account long, pillar string, fit double, count long, share double"))
    got = {(r.account, r.pillar): r.weight for r in got.collect()}
    want = by_hand(mix, results, goals, research)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    for a in range(12):
        assert sum(x for (b, _), x in got.items() if b == a) == pytest.approx(1)


def test_many_small_pillars_keep_the_largest(spark):
    raw = spark.createDataFrame([("x", f"p{i:02}", 1.0 + (i == 7) * 0.01) for i in range(40)] + [("y", "q", 5.0)], "account string, pillar string, w double")
    assert sorted(tuple(r) for r in strategy.normalised(raw).collect()) == [("x", "p07", 1.0), ("y", "q", 1.0)]


def test_ladders(spark):
    rows = [
        ("contacted", True, False, 5, True, None, "do not contact"), ("won", False, True, None, True, None, "none: won"), ("contacted", False, True, 5, True, None, "take over conversation"), ("contacted", False, False, None, True, None, "write first message"),
        ("contacted", False, False, 23, True, None, "wait for reply"), ("contacted", False, False, 24, True, None, "follow up"), ("assigned", False, False, 30, False, None, "wait until follow-up is due"), ("appointment", False, False, None, True, "no_show", "invite again"),
        ("appointment", False, False, None, True, "confirmed", "prepare visit"), ("appointment", False, False, None, True, "proposed", "confirm visit"), ("negotiating", False, False, None, True, None, "close"), ("odd", False, False, None, True, None, "check by hand"), (None, False, False, None, True, None, "check by hand"),
    ]
    df = spark.createDataFrame(rows, "stage string, s boolean, h boolean, w int, d boolean, a string, want string")
    assert all(r.want == r.got for r in df.select("want", strategy.next_action(*map(F.col, ("stage", "s", "h", "w", "d", "a"))).alias("got")).collect())
    rows = [("active", False, True, False, "ok"), ("disabled", False, False, True, "blocked"), ("paused", True, True, False, "blocked"), ("paused", False, True, False, "review"), ("active", False, False, False, "review"), ("active", False, True, True, "review")]
    df = spark.createDataFrame(rows, "status string, r boolean, i boolean, k boolean, want string")
    assert all(r.want == r.v for r in df.select("want", strategy.operable(*map(F.col, ("status", "r", "i", "k")))[0].alias("v")).collect())
