"""Claims against facts: what is found, and a loop over all facts as oracle."""

import random
from datetime import date, timedelta

from millrace.operators import claims


def test_what_is_claimed(spark):
    items = spark.createDataFrame([("w", "red widget"), ("b", "bolt")], "target string, alias string")
    texts = {
        "The Red Widget costs $1,200.50, or 12k dollars; 5 % off.": [("money", "w", 120_050), ("money", "w", 1_200_000), ("rate", "w", 500)],
        "bolt: 3 in stock, red widget: 12 left": [("stock", "b", 3), ("stock", "w", 12)],
        "90 days for the bolt until 2024-02-29; pay in 6 months, 2.5 percent.": [("term", "b", 90), ("date", "b", 19_782), ("term", "b", 180), ("rate", "b", 250)],
        "€ 5 for it": [("money", None, 500)], "2024-02-31 bolt": [("date", "b", None)], "no numbers, bolt": [], "": [], None: [], "1,5.": [], "v1.2.3 $": [],
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {}
    for r in claims.claims(df, items).orderBy("i", "start").collect():
        got.setdefault(r.i, []).append((r.kind, r.subject, r.value))
        assert list(texts)[r.i][r.start : r.start + len(r.quote)] == r.quote
    assert [got.get(i, []) for i in range(len(texts))] == list(texts.values())


def test_verdicts_against_a_loop(spark):
    rnd = random.Random(4)
    day = lambda: date(2024, 1, 1) + timedelta(days=rnd.randrange(20))
    facts = [(rnd.choice("abc"), rnd.choice("xy"), rnd.randrange(4), *(lambda d: (rnd.choice([d, None]), rnd.choice([d + timedelta(days=rnd.randrange(6)), None])))(day()), rnd.randrange(100)) for _ in range(40)]
    said = [(i, rnd.choice(["a", "b", "c", "d", None]), rnd.choice("xyz"), rnd.choice([0, 1, 2, 3, 9, None]), rnd.choice([day(), day(), None])) for i in range(300)]
    f = spark.createDataFrame(facts, "subject string, kind string, value long, first date, last date, ref int")
    c = spark.createDataFrame(said, "i int, subject string, kind string, value long, day date")
    got = {r.i: (r.verdict, r.ref) for r in claims.verify(c, f, "day").collect()}
    kinds = set()
    for i, subject, kind, value, d in said:
        own = [x for x in facts if x[0] == subject and x[1] == kind]
        holds = [x for x in own if d and (x[3] or date.min) <= d < (x[4] or date.max)]
        same = [x for x in own if x[2] == value and value is not None]
        refs = [x[5] for x in same if x in holds]
        want = ("supported", min(refs)) if refs else ("expired", None) if same and d else ("contradicted", None) if holds else ("unknown", None)
        if d is None:
            want = (got[i][0], None)  # without a day nothing holds
            assert got[i][0] in ("expired", "unknown")
        assert got[i] == want, (i, subject, kind, value, d)
        kinds.add(want[0])
    assert kinds == {"supported", "expired", "contradicted", "unknown"} and len(got) == len(said)
    assert claims.verify(c.limit(0), f, "day").count() == 0 and {r.verdict for r in claims.verify(c, f.limit(0), "day").collect()} == {"unknown"}


def test_claims_are_made_once(spark):
    """However often verify meets the claims, what they are made of runs once for each text."""
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    said = spark.range(5).selectExpr("'a' as subject", "'stock' as kind", "id as value", "date'2020-01-01' as day", "id as n")
    said = said.mapInArrow(seen, said.schema)
    facts = spark.createDataFrame([("a", "stock", 3, None, None, 7)], "subject string, kind string, value long, first date, last date, ref long")
    got = {r.n: (r.verdict, r.ref) for r in claims.verify(said, facts, "day").collect()}
    assert got == {n: ("supported", 7) if n == 3 else ("contradicted", None) for n in range(5)} and runs.value == 5
