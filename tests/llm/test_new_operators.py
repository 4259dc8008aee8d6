"""Toxicity, ranked search and whitening: against brute force, and their defined cases."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import impacts, toxicity, whitening

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def ranked(docs, items, k=20):
    """Scores written out, document by document."""
    bags = [(d, Counter(terms_of(t))) for d, t in docs if terms_of(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(list)
    for item, text in dict.fromkeys(items):
        asked[item] += terms_of(text)
    out = []
    for item, own in asked.items():
        scores = []
        for d, b in bags:
            m = 100 - 25 + 25 * sum(b.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t in own if t in b)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 4))) for _ in range(150)]
    text = lambda n: "".join(rnd.choice([str.upper, str])(rnd.choice(vocabulary)) + rnd.choice([" ", ", ", "-", "\n", "\x7f"]) for _ in range(n))
    docs = [(i * 7 % 401, text(rnd.choice([0, 1, 3, 20, 60]))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)] + [(5, docs[9][1]), (2000, None), (2001, ""), (2002, " ,.!"), (2003, "ÄÖ ß 中文,中文 é"), (2004, "b " * 30_000), (None, "a b c"), (None, "zz")]
    items = [(i, text(rnd.randint(1, 12))) for i in range(30)]
    items += [(30, docs[3][1]), (31, None), (32, ""), (33, "nowhere found"), (34, "b B b b"), (34, "a"), (34, "a"), (None, "a zz"), (35, "中文 é ÄÖ")]
    return docs, items


def test_ranked_search_against_brute_force(spark, corpus, monkeypatch):
    docs, items = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("block", F.lit("clash")).withColumn("term", F.lit(1))
    q = spark.createDataFrame(items, "item_id int, text string").withColumn("weight", F.lit("clash"))
    want = ranked(docs, items)
    for blocks, batch in ((1 << 14, 256), (37, 5)):
        monkeypatch.setattr(impacts, "DOCS", blocks)
        monkeypatch.setattr(impacts, "ITEMS", batch)
        index = impacts.build(d.repartition(3))
        assert sorted((tuple(r) for r in impacts.search(index, q).collect()), key=str) == want
    assert len(want) > 500 and index.blocks.count() > 8
    again = impacts.ImpactIndex(spark, index.folder)  # opened from its folder
    assert sorted((tuple(r) for r in impacts.search(again, q, 3).collect()), key=str) == ranked(docs, items, 3)


def test_ranked_search_of_nothing(spark, corpus):
    docs, items = corpus
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    for x, y in ((d.limit(0), q), (d, q.limit(0)), (d.where("text is null"), q), (d, q.where("item_id = 33"))):
        out = impacts.search(impacts.build(x), y)
        assert out.count() == 0 and out.schema.simpleString() == "struct<item_id:int,rank:int,doc_id:bigint,score:bigint>"


def test_bitmaps_add_and_multiply():
    rnd = np.random.default_rng(1)
    a, b, w = rnd.integers(0, 1 << 20, 64), rnd.integers(0, 1 << 20, 64), rnd.integers(0, 1 << 15, 8)
    (x, _), (y, _) = impacts.sliced(a, np.array([64])), impacts.sliced(b, np.array([64]))
    number = lambda s: sum(np.unpackbits(r).astype(np.int64) << i for i, r in enumerate(s))
    total = np.zeros((22, 8), np.uint8)
    impacts.add(total, x.T)
    impacts.add(total, y.T, 1)
    assert (number(total) == a + 2 * b).all()
    assert (number(impacts.weighted(np.ascontiguousarray(x.T), w, 36)) == a * np.repeat(w, 8)).all()
    sure, left = impacts.descend(x.T[:, None], 10)
    inside, equal = (np.flatnonzero(np.unpackbits(b[0])).tolist() for b in (sure, left))
    assert {*inside, *equal[: 10 - len(inside)]} == {*np.argsort(-a)[:10].tolist()}


def test_whitening_against_numpy(spark):
    rnd = np.random.default_rng(3)
    mixed = rnd.normal(size=(5, 24))
    v = (rnd.normal(size=(300, 5)) @ mixed + rnd.normal(size=(300, 24)) * 0.4).astype(np.float32)
    rows = [(i, r.tolist()) for i, r in enumerate(v)] + [(900 + i, v[7].tolist()) for i in range(30)]
    rows += [(1000, None), (1001, [float("nan")] * 24), (1002, [None] + v[1, 1:].tolist()), (1003, [float("inf")] * 24), (1004, []), (1005, [1.0, 2.0]), (None, v[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit("clash")).withColumn("ident", F.lit(0))
    x = np.floor(64 * v.astype(np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    got = defaultdict(list)
    for r in whitening.whitened_entries(df).collect():
        got[r.vec_id].append(r)
    assert set(got) == {*range(300), *range(900, 930), None} and all(sorted(r.component for r in rs) == list(range(1, 17)) for rs in got.values())
    for i, rs in got.items():
        own = x[i if i is not None and i < 300 else 7 if i else 3]
        for r in rs:
            z = (own - s / n) @ vectors[:, -r.component] / np.sqrt(values[-r.component])
            assert r.n == n and r.deviation == int(((n * own - s) ** 2).sum())
            assert abs(abs(r.whitened) - abs(z)) < 1e-7 and abs(r.explained / (values[-r.component] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-9
    plain = whitening.whiten(df, 4)
    assert plain.count() == 331 and len(plain.first().whitened) == 4 and plain.columns == ["vec_id", "whitened"]


def test_whitening_of_little(spark):
    kind = "vec_id string, embedding array<double>"
    for rows in ([], [("a", None)], [("a", [1.0, 2.0])], [("a", [1.0, 2.0])] * 5, [("a", [])]):
        assert whitening.whitened_entries(spark.createDataFrame(rows, kind)).count() == 0
    rows = [("a", [1.0, 2.0]), ("b", [3.0, 5.0]), ("b", [3.0, 5.0]), ("c", [1e300, -1e300])]
    got = [(r.vec_id, r.component, r.deviation) for r in whitening.whitened_entries(spark.createDataFrame(rows[:3], kind)).collect()]
    assert sorted(got) == [("a", 1, 128**2 + 192**2), ("b", 1, 128**2 + 192**2), ("b", 1, 128**2 + 192**2)]
    assert {r.deviation for r in whitening.whitened_entries(spark.createDataFrame(rows, kind)).collect()} == {None}


def sentences(n, share, seed=4):
    """Sentences about groups, in which insults are toxic and one group is named more often in toxic ones."""
    rnd = random.Random(seed)
    filler = ["report", "weather", "street", "music", "paper", "garden", "window", "coffee", "letter", "morning"]
    out = []
    for _ in range(n):
        toxic = rnd.random() < 0.4
        group = rnd.choice(["muslims", "jews"]) if rnd.random() < (share if toxic else 0.05) else rnd.choice(["christians", "buddhists", "people"])
        own = [rnd.choice(filler) for _ in range(8)] + [group] + ([rnd.choice(["vermin", "filth", "scumbags"])] if toxic and rnd.random() < 0.8 else [])
        rnd.shuffle(own)
        out.append((" ".join(own) + ".", int(toxic)))
    return out


def test_swaps_take_away_what_groups_alone_say():
    train, test = sentences(900, 0.9), sentences(400, 0.5, 7)
    y = np.array([t for _, t in train], float)
    plain, fair = (toxicity.fit_texts([s for s, _ in train], y, swap=s) for s in (0.0, toxicity.SWAP))
    neutral = [f"The {g} of the town read a letter in the garden this morning." for g in ("muslims", "jews", "christians", "buddhists")]
    gap = lambda m: max(m.raw(s) for s in neutral) - min(m.raw(s) for s in neutral)
    assert gap(fair) < 0.1 * gap(plain) and sum(plain.score(s) >= 0.5 for s in neutral) > 0 == sum(fair.score(s) >= 0.5 for s in neutral)
    insult = [(s, t) for s, t in test if not t or re.search("vermin|filth|scumbags", s)]
    assert sum((fair.score(s) >= 0.5) == t for s, t in insult) > 0.95 * len(insult)
    assert [a for _, a in toxicity.swaps("Muslims sing. Rain falls!", times=1)] == [[b"christians", b"sing"]]


def test_toxicity_on_tables(spark):
    import zlib

    train = sentences(600, 0.2)
    docs = [(i, s) for i, (s, _) in enumerate(train)] + [(5000, None), (5001, ""), (5002, "\n "), (5003, "paper " * 200_000), (None, "vermin filth"), (3, train[3][0])]
    labels = [(i, t) for i, (_, t) in enumerate(train)] + [(7, 1), (7, 1), (None, 1), (8, None), (99_999, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("y", F.lit("clash")).withColumn("draw", F.lit(1))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.classify(d, lab).collect()
    assert len(got) == len(docs) and sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in docs)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    assert by[None].score > 0.5 > by[5003].score and by[5000].score == by[5001].score == by[5002].score
    turned = {r.doc_id: r.score for r in toxicity.classify(d.repartition(5), lab.repartition(3)).collect()}
    assert turned == {k: r.score for k, r in by.items()}  # order and parts change nothing
    assert {r.score for r in toxicity.classify(d, lab.limit(0)).collect()} == {0.5} and toxicity.classify(d.limit(0), lab).count() == 0
    small = toxicity.labelled_sample(d, lab, "toxic", 50, 2_000).collect()
    assert 0 < len(small) <= 50 and sum(len(r.text) for r in small) <= 2_000


def test_toxicity_on_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.classify(spark.read.parquet(f"{d}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert len(toxic) > 60 and np.mean([a > b for a in toxic for b in clean]) > 0.95
    assert np.mean(np.array(toxic) >= 0.5) > 0.85 and np.mean(np.array(clean) >= 0.5) < 0.01


def test_quality_of_odd_rows(spark):
    from millrace.llm import quality

    rnd = random.Random(2)
    good = lambda: " ".join(rnd.choice(["field", "river", "window", "letter", "garden"]) for _ in range(30))
    docs = [(i, good() if i % 2 else "BUY NOW!! " * 15) for i in range(200)] + [(None, good()), (None, None), (500, "word " * 200_000), (501, ""), (501, ""), (7, good()), (3, good())]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("y", F.lit(1)).withColumn("version", F.lit(1))
    lab = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, 0), (None, 1)], "doc_id long, quality int")
    got = quality.classify(d, lab).collect()
    assert len(got) == len(docs) and all(r.held_out is not None and 0 <= r.score <= 1 for r in got)
    assert sum(r.score for r in got if r.doc_id == 501) == 2 * next(r.score for r in got if r.doc_id == 501)
    again = quality.classify(d.repartition(7), lab.repartition(4)).collect()
    assert sorted((str(r.doc_id), r.score) for r in got) == sorted((str(r.doc_id), r.score) for r in again)
    assert quality.classify(d.limit(0), lab).count() == 0


def test_the_fit_against_plain_loops():
    """One epoch of the factorisation machine, pair by pair and weight by weight."""
    from millrace.llm.quality import FactorisationMachine

    rnd = np.random.default_rng(4)
    docs = [(np.sort(rnd.choice(8, 3, replace=False)).astype(np.int64), rnd.random(3).astype(np.float32)) for _ in range(12)]
    y = rnd.integers(0, 2, 12).astype(float)
    fast = FactorisationMachine(8, 2).fit(docs, y, epochs=2, batch=4)
    slow = FactorisationMachine(8, 2)
    w, v = slow.w.astype(float).copy(), slow.v.astype(float).copy()
    bias = math.log((y.sum() + 1) / (len(y) + 2) / (1 - (y.sum() + 1) / (len(y) + 2)))
    seen_w, seen_v = np.full(8, 1e-6), np.full((8, 2), 1e-6)
    order_of = np.random.default_rng(9)
    for _ in range(2):
        order = order_of.permutation(12)
        for at in range(0, 12, 4):
            gw, gv, gb, touched = np.zeros(8), np.zeros((8, 2)), 0.0, set()
            for i in order[at : at + 4]:
                ids, x = docs[i]
                z = bias + sum(w[a] * p for a, p in zip(ids, x, strict=True)) + sum(float(v[ids[k]] @ v[ids[j]]) * x[k] * x[j] for k in range(3) for j in range(k))
                off = (1 / (1 + math.exp(-z)) - y[i]) / 4
                gb += off
                for k, a in enumerate(ids):
                    touched.add(int(a))
                    gw[a] += off * x[k]
                    gv[a] += off * x[k] * sum((v[ids[j]] * x[j] for j in range(3) if j != k), np.zeros(2))
            bias -= 0.1 * gb
            new_w, new_v = w.copy(), v.copy()
            for a in touched:
                g = gw[a] + 1e-4 * w[a]
                seen_w[a] += g * g
                new_w[a] -= 0.1 * g / math.sqrt(seen_w[a])
                g = gv[a] + 1e-4 * v[a]
                seen_v[a] += g * g
                new_v[a] -= 0.03 * g / np.sqrt(seen_v[a])
            w, v = new_w, new_v
    assert np.allclose(fast.w, w, atol=1e-3) and np.allclose(fast.v, v, atol=1e-3) and abs(fast.bias - bias) < 1e-3


def test_samples_of_languages_are_bounded_in_bytes(spark):
    from millrace.llm import langid

    rows = [(i, "word " * 100 + f"number {i}", "en") for i in range(40)] + [(100, "buch " * 200_000, "de"), (101, "livre " * 20, "fr"), (102, "livre " * 20, "fr"), (102, "livre " * 20, "fr"), (103, None, "fr"), (104, "x", None), (None, "mot " * 5, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("draw", F.lit(1)).withColumn("r", F.lit(1))
    got = langid.labelled_samples(df, symbols=3_000)
    assert list(got) == ["en", "fr", "de"] and all(0 < len(s) <= 6_000 for s in got.values()) and len(got["en"]) >= 3_000
    assert got == langid.labelled_samples(df.repartition(5), symbols=3_000)
    assert {r.lang_pred for r in langid.identify(df, got).where("doc_id < 40").collect()} == {"en"} and langid.labelled_samples(df.limit(0)) == {}
