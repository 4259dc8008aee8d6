"""Every query with SQL against DuckDB on the smallest tables, and the rest against plain Python."""

import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(df):
    def plain(x):
        if x is None or (not isinstance(x, list | tuple | dict) and pd.isna(x)):
            return None
        return round(float(x), 6) + 0.0 if isinstance(x, float) else str(x) if isinstance(x, pd.Timestamp) else x

    df = df[sorted(df.columns)]
    for k in df.columns:
        if str(df[k].dtype).startswith("datetime"):
            df = df.assign(**{k: df[k].astype("datetime64[us]").astype(str)})
    return list(df.columns), sorted(str([plain(x) for x in r]) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = rows(registry.QUERIES[name](spark, SF).toPandas())
    assert got == rows(duck.execute(registry.ORACLE_SQL[name]).fetchdf())
    assert got[1], "no rows on either side show nothing"


def test_stage_fold_equals_a_loop(spark):
    depth = {"view": 0, "click": 1, "signup": 2, "purchase": 3}
    e = pd.read_parquet(f"{SF}/events.parquet").sort_values(["ts", "event_id"])
    want = {}
    for user, kind, value in zip(e.user_id, e.event_type, e.value, strict=True):
        s = want.setdefault(user, "new")
        if s in ("purchase", "error"):
            continue
        if kind == "error":
            want[user] = "error" if value > 90 else s
        elif depth[kind] > depth.get(s, -1) and (kind != "purchase" or depth.get(s, -1) >= 1):
            want[user] = kind
    got = {r.user_id: r.stage for r in registry.QUERIES["stage_fold"](spark, SF).collect()}
    assert got == want


def test_streams_equal_their_batches(spark, tmp_path):
    from millrace.streaming import ingest

    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 400).parquet(f"{tmp_path}/in")
    stream = ingest.event_stream(spark, f"{tmp_path}/in", e.schema, 10)
    ingest.run_to_end(ingest.stages(stream), "stages", "update", f"{tmp_path}/c1")
    got = {r.user_id: (r.stage, r.n) for r in spark.sql("SELECT user_id, max_by(stage, n) AS stage, max(n) AS n FROM stages GROUP BY user_id").collect()}
    deepest = {r.user_id: (max(r.kinds, key=lambda k: ingest.DEPTH.get(k, -1)), r.n) for r in e.groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"), F.count("*").alias("n")).collect()}
    assert got == deepest
    ingest.run_to_end(ingest.without_repeats(ingest.event_stream(spark, f"{tmp_path}/in", e.schema, 10)).select("event_id"), "unique_events", "append", f"{tmp_path}/c2")
    assert spark.table("unique_events").count() == e.select("event_id").distinct().count()


def test_sources(spark, tmp_path):
    from millrace.sources import files

    (tmp_path / "a.json").write_text('{"id": 1, "t": "x"}\n{"id": oops}\n{"id": 2, "t": "y"}\n')
    good, bad = files.permissive_json(spark, str(tmp_path / "a.json"), "id long, t string")
    assert sorted(r.id for r in good.collect()) == [1, 2] and [r.value for r in bad.collect()] == ['{"id": oops}']
    (tmp_path / "c.csv").write_text('id,name\n1,"a, ""b"""\n2,c\n')
    assert [tuple(r) for r in files.catalogue_csv(spark, str(tmp_path / "c.csv"), "id int, name string").collect()] == [(1, 'a, "b"'), (2, "c")]
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "id int, seq int, v string")
    files.append(log, str(tmp_path / "log"), ["id", "seq", "v"])
    assert sorted((r.id, r.v) for r in files.snapshot(spark.read.parquet(str(tmp_path / "log")), ["id"], ["seq"]).collect()) == [(1, "b"), (2, "c")]
    with pytest.raises(ValueError):
        files.append(log, str(tmp_path / "log"), ["id"])


def test_longest_runs():
    from millrace.operators.texts import shared_run

    assert shared_run("xxabcdyy", "zabcdz") == 4 and shared_run("", "a") == 0 and shared_run("a" * 90, "a" * 80) == 40


def test_phrases_apart_against_a_loop(spark):
    import random

    from millrace.operators.texts import top_apart

    rnd = random.Random(1)
    phrases = {(rnd.randrange(3), "".join(rnd.choice("abc") for _ in range(rnd.randint(2, 4)))): rnd.randrange(2, 6) for _ in range(80)}
    got = top_apart(spark.createDataFrame([(g, p, n) for (g, p), n in phrases.items()], "g long, phrase string, df long"), 4).collect()
    for g in range(3):
        kept = []
        for _, _, p in sorted((-n, -len(p), p) for (x, p), n in phrases.items() if x == g):
            if len(kept) < 4 and not any(p in q or q in p for q in kept):
                kept.append(p)
        assert {r.phrase for r in got if r.g == g} == set(kept) and all(phrases[r.g, r.phrase] == r.df for r in got)


def test_emoji_by_grapheme(spark):
    import regex

    from millrace.operators.language import emoji_count

    texts = ["fine 😀😀", "plain © ® ™ 5 # *", "👍🏽 ok 🚗", "👨‍👩‍👧‍👦👩🏾‍🚀", "🇩🇪🇫🇷🇪", "1️⃣#️⃣*⃣", "❤️ ☺ ✌🏿", "©️ ™️", "🏴\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f", "é ü 中文", "", None, "😀" * 50_000, "👩‍❤️‍💋‍👨 🏳️‍🌈"]
    want = []
    for t in texts:
        n = 0
        for g in regex.findall(r"\X", t or ""):  # clusters of the standard: any with a keycap, a flag or a pictograph that is no text symbol
            signs = regex.findall(r"\p{Extended_Pictographic}", g)
            n += "\u20e3" in g or bool(regex.search("[\U0001f1e6-\U0001f1ff]", g)) or bool(signs) and (any(c not in "©®™‼⁉〰〽" for c in signs) or "\ufe0f" in g)
        want.append(n)
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(emoji_count(F.col("t")).alias("n")).collect()]
    assert got == want and want[3] == 2 and want[4] == 3


def test_near_classes(spark):
    from millrace.operators.lifecycle import near_classes

    rows = [(1, "abcdefghij klmnop"), (2, "abcdefghij-klmnop!"), (3, "abcdefghij klmnopq"), (4, "something else here"), (5, "ABCDEFGHIJ KLMNOP"), (6, "")]
    got = {r.id: (r["class"], r.links) for r in near_classes(spark.createDataFrame(rows, "id long, text string"), 0.8, "id", "text").collect()}
    assert got == {1: (1, 1), 2: (1, 1), 5: (1, 1), 3: (3, 1), 4: (4, 0), 6: (6, 0)}
    many = spark.createDataFrame([(i, "one and the same text") for i in range(2000)], "id long, text string")
    assert {(r["class"], r.links) for r in near_classes(many, 0.8, "id", "text").collect()} == {(0, 0)}  # copies make no pairs


def test_recurring_phrases(spark):
    rows_ = registry.QUERIES["recurring_phrases"](spark, SF).collect()
    assert len(rows_) == 20 and all(r.df >= 2 and 4 <= len(r.phrase) <= 6 for r in rows_)
    for r in rows_:
        assert not any(r.phrase != q.phrase and r.g == q.g and r.phrase in q.phrase for q in rows_)


def test_copies_against_a_loop(spark):
    import random

    from millrace.operators.lifecycle import copies

    rnd = random.Random(6)
    base = ["".join(rnd.choice("abcdefgh") for _ in range(30)) for _ in range(4)]
    texts = [rnd.choice(base) for _ in range(4)] + [b[:20] + "".join(rnd.choice("xyz") for _ in range(10)) for b in base] + [b[::-1] for b in base] + ["".join(rnd.choice("mnop") for _ in range(12)) for _ in range(4)] + ["", "a", "A!"]
    grams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)} or ({t} if t else set())
    plain = [t.lower().strip("!") for t in texts]
    least = {t: plain.index(t) for t in plain}
    got = {r.id: (r["class"], r.runs, r.alike, r.best) for r in copies(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string"), 0.5, 8, "id", "text").collect()}
    for i, t in enumerate(plain):
        runs = alike = 0
        best = 0.0
        for u in set(plain) - {t}:
            run = any(t[k : k + 8] in u for k in range(len(t) - 7))
            sim = len(grams(t) & grams(u)) / len(grams(t) | grams(u)) if grams(t) and grams(u) else 0.0
            runs, alike = runs + run, alike + (sim >= 0.5)
            best = max(best, sim) if run or sim >= 0.5 else best
        assert got[i][:3] == (least[t], runs, alike) and abs(got[i][3] - best) < 1e-4, t
    assert sum(g[1] > 0 for g in got.values()) > 3


def test_owner_of_equal_touches(spark, tmp_path):
    """Of touches at the same time with the same number the first as stored owns the lead, in whatever order rows are met."""
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute("create table orders as select i::BIGINT as o_orderkey, timestamp '2000-01-01' as o_orderdate, 'F' as o_orderstatus from range(400) r(i)")
    con.execute("create table lineitem as select (i % 400)::BIGINT as l_orderkey, CASE WHEN i % 7 > 0 THEN i * 37 % 1009 END::BIGINT as l_suppkey, 1::INTEGER as l_linenumber, timestamp '2000-02-01' + interval 1 hour * (i // 400 % 2) as l_shipdate from range(4000) r(i)")
    for t in ("orders", "lineitem"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    want = sorted(con.execute(registry.ORACLE_SQL["owner_stamp"]).fetchall())
    assert sorted(map(tuple, registry.QUERIES["owner_stamp"](spark, str(tmp_path)).collect())) == want


def test_owner_in_any_time_zone(spark, tmp_path):
    """Touches are put in order as written: an hour that the session's time zone skips comes before the next one."""
    con = duckdb.connect()
    con.execute("create table orders as select i::BIGINT as o_orderkey, timestamp '2000-03-01' as o_orderdate, 'F' as o_orderstatus from range(8) r(i)")
    con.execute("create table lineitem as select i::BIGINT as l_orderkey, k::BIGINT as l_suppkey, 1::INTEGER as l_linenumber, timestamp '2000-03-26 01:00:00' + interval 1 minute * ((i + k) * 45 % 240) as l_shipdate from range(8) r(i), range(3) s(k)")
    for t in ("orders", "lineitem"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    want, held = sorted(con.execute(registry.ORACLE_SQL["owner_stamp"]).fetchall()), spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got = sorted(map(tuple, registry.QUERIES["owner_stamp"](spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", held)
    assert got == want


def test_near_links_in_strips(spark, monkeypatch):
    """Every link between different sets, whatever strips and blocks they fall in and however many grams have no bit."""
    import random

    from millrace.operators import lifecycle

    monkeypatch.setattr(lifecycle, "STRIP", 40)
    monkeypatch.setattr(lifecycle, "BLOCK", 16)
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abcdeéß中文字人口手") for _ in range(rnd.randint(3, 30))) for _ in range(120)]
    texts += [t[: rnd.randint(2, len(t))] + rnd.choice("xyz") for t in texts]
    sets = [{t[k : k + 2] for k in range(len(t) - 1)} for t in texts]
    first = [min(k for k, o in enumerate(sets) if o == s) for s in sets]
    sim = lambda a, b: int(len(a & b) / len(a | b) * 10_000 + 0.5) / 10_000
    near = lambda a, b: sim(a, b) >= 0.8 and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) - 1e-9
    found = {k: [sim(sets[k], sets[o]) for o in set(first) if o != k and near(sets[k], sets[o])] for k in set(first)}
    want = [(i, k, len(found[k]), max(found[k], default=0.0)) for i, k in enumerate(first)]
    assert sum(w[2] for w in want) > 40
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for own in (768, 20, 0):
        monkeypatch.setattr(lifecycle, "OWN", own)
        assert sorted(map(tuple, lifecycle.near_classes(frame, 0.8, "id", "text").collect())) == want


def test_ranks_of_nations(spark):
    """What is ranked are a few suppliers for each nation and last digit, not for each customer."""
    from millrace.operators.scoring import candidates

    rows = candidates(spark, SF).groupBy("c_nationkey", "digit").count().collect()
    assert len(rows) <= 250 and max(r["count"] for r in rows) <= 80


def test_offers_of_one_brand(spark):
    """A brand's items are dealt out, and each row has its item's own level, repeated items included."""
    from millrace.operators.catalogues import applicable

    items = [(i, "b") for i in range(300)] + [(7, "none"), (300, "none"), (300, "none"), (301, None)]
    offers = [(1, None, "b"), (2, None, "b"), (3, 5, None), (4, None, None), (5, 300, None)]
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = applicable(spark.createDataFrame(items, "item long, brand string"), spark.createDataFrame(offers, "offer long, item long, brand string")).withColumn("at", F.spark_partition_id()).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    want = [(i, o, 2) for i in range(300) if i != 5 for o in (1, 2)] + [(5, 3, 1), (300, 5, 1), (300, 5, 1), (301, 4, 3)]
    assert sorted((r["item"], r["offer"], r["level"]) for r in got) == sorted(want)
    assert len({r["at"] for r in got if r["level"] == 2}) > 1


def test_no_offer_goes_through_the_driver(spark):
    """Copies of offers and the items of brands grow with the tables: no join broadcasts them, however small the files look."""
    df = registry.QUERIES["offer_applicability"](spark, SF)
    plan = lambda: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan()
    rows = df.collect()
    assert rows and "Broadcast" not in plan()
