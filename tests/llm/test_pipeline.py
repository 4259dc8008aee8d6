"""The stages of the corpus pipeline on a small table, and as a whole."""

import os
import random

from pyspark.sql import functions as F

import corpus_pipeline

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages_keep_the_schema_and_do_their_work(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rnd = random.Random(4)
    noise = [(10**9 + 10 + n, "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(n)), "en", "s", n) for n in (60, 300, 900, 5000)]
    odd = spark.createDataFrame([(10**9, None, None, None, None), (10**9 + 1, "", "en", "s", 0), (10**9 + 2, "12 34 !!", "de", "s", 8), *noise], docs.schema)
    docs = docs.unionByName(odd)
    benchmark = {r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    before = {r.doc_id: r for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert out.schema.simpleString() == docs.schema.simpleString()
        rows = {r.doc_id: r for r in out.collect()}
        assert set(rows) <= set(before)
        if i == 0:  # texts without letters and random letters of any length go, nothing else does here
            assert set(before) - set(rows) == {10**9, 10**9 + 1, 10**9 + 2, *(x[0] for x in noise)}
        elif i == 1:
            assert len({r.text for r in rows.values()}) == len(rows)
        elif i == 2:
            assert all(len(rows[k].text) <= len(before[k].text) and rows[k].n_chars == len(rows[k].text) for k in rows)
        elif i == 3:
            gone = [before[k] for k in set(before) - set(rows)]
            assert gone and all(any(b[:60] in r.text or b[-60:] in r.text for b in benchmark) for r in gone)
            assert not any(b in r.text for b in benchmark for r in rows.values())
        else:
            assert 0 < len(rows) < len(before)
        docs, before = out, rows
        docs = spark.createDataFrame(list(rows.values()), out.schema)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.count() > 0


def near_rows():
    """Texts, copies of them with one word changed to four, and a hot group whose members are not all alike."""
    rnd = random.Random(5)
    words = lambda n: ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    line, rows = words(12), []
    for n in (3, 4, 5, 9, 30, 60, 90, 150, 280):
        for _ in range(4):
            base = words(n) + (line if n % 60 == 0 else [])
            rows.append(base)
            for k in (1, 1, 2, 4):
                copy = list(base)
                for at in rnd.sample(range(len(copy)), min(k, len(copy))):
                    copy[at] = "new" + str(rnd.random())[2:8]
                rows.append(copy)
    base = words(80)
    for at in range(60):
        rows.append(base[:at] + ["odd" + str(at)] + base[at + 1 :])
    passage = words(90)  # shared by texts with 2 to 16 words of their own, on both sides of the similarity
    for own in range(2, 17):
        rows += [words(own) + passage, passage + words(own), words(own // 2) + passage + words(own - own // 2)]
    for at in range(60):  # a chain: each is near the next one only
        rows.append(base[at : at + 40] + words(1))
    rnd.shuffle(rows)
    return [(1000 + i, " ".join(r)) for i, r in enumerate(rows)] + [(2000, " "), (2001, ""), (2002, None)]


def test_near_duplicates_against_brute_force(spark):
    rows = near_rows()
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    linked = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) * 5 >= len(a | sets[j]) * 4:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
                linked += a != sets[j]
    want = [rows[i][0] for i in range(len(rows)) if root(i) == i]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = sorted(r.doc_id for r in corpus_pipeline.by_simhash(spark, docs, SF).collect())
    assert got == want and linked > 100
    assert corpus_pipeline.by_simhash(spark, docs.limit(0), SF).count() == 0


def test_repeated_and_missing_ids_in_every_stage(spark):
    rnd = random.Random(8)
    words = lambda n: ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    row = lambda i, w: (i, " ".join(w), "en", "s", len(" ".join(w)))
    shared, own, head, tail = words(70), words(90), words(30), words(20)
    first, cut, other, lone = row(1, shared + words(60)), row(2, own + shared), row(2, head + shared + tail), row(None, words(50))
    near = (None, cut[1] + " end", "en", "s", 0)
    rows = [first, *[cut] * 3, other, *[lone] * 2, near, *[first] * 2]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    key = lambda r: str(tuple(r))
    got = sorted(map(tuple, corpus_pipeline.by_simhash(spark, docs, SF).collect()), key=key)
    assert got == sorted([first, cut, other, lone], key=key)
    # repeated rows lose the same words once each, texts of one id what is theirs; rows without an id stay whole
    left = row(2, own), row(2, head + tail)
    want = [*[first] * 3, *[left[0]] * 3, left[1], *[lone] * 2, (None, near[1], "en", "s", len(near[1]))]
    assert sorted(map(tuple, corpus_pipeline.by_substring(spark, docs, SF).collect()), key=key) == sorted(want, key=key)
    assert sorted(map(tuple, corpus_pipeline.by_benchmark(spark, docs, SF).collect()), key=key) == sorted(rows, key=key)
    # repeated rows are drawn alike, rows without an id by their text
    many = docs.unionByName(spark.createDataFrame([row(None, words(30)) for _ in range(40)], schema)).unionByName(docs)
    drawn = [tuple(r) for r in corpus_pipeline.by_mixture(spark, many, SF).collect()]
    asked = [tuple(r) for r in many.collect()]
    assert {r[0] for r in drawn} >= {None} and all(drawn.count(r) == asked.count(r) for r in drawn)
    clash = docs.withColumns({c: F.lit("own") for c in ("score", "strangeness", "lang_pred", "row", "version", "source_", "p_", "key", "cuts", "text_", "n_words")})
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, clash, SF)
        assert out.columns == clash.columns and all({r.score, r.row, r.version, r.source_} == {"own"} for r in out.collect())
        assert stage(spark, docs.limit(0), SF).count() == 0
    same = spark.createDataFrame([(i, "the man and the woman went to the house", "en", "s", 39) for i in [*range(100, 140), None, None, 7, 7]], schema)
    assert corpus_pipeline.by_language(spark, same, SF).count() == 44
