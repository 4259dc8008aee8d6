"""Normal forms, spans, dictionaries and praise against brute force."""

import random
import time
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.functions import spans
from millrace.functions.normal import Mapped, anchored
from millrace.operators import dictionary
from millrace.operators.dictionary import Matcher, cased, praise_state, pure_praise
from millrace.registry import ORACLE_SQL, QUERIES


def test_normal_forms_keep_raw_spans():
    m = Mapped("Ａb　 ﬁne\tİx ß é!")
    assert m.norm == "ab fine i̇x ss é!"
    assert m.quote(0, 2) == "Ａb" and m.quote(3, 7) == "ﬁne" and m.quote(4, 6) == "ﬁn" and m.quote(len(m.norm) - 2, len(m.norm) - 1) == "é"
    assert Mapped("").find("x") is None and Mapped("x").find(" ") is None and Mapped("x").find(None) is None


def test_every_quote_that_exists_comes_back_raw(spark):
    rnd = random.Random(3)
    wide = str.maketrans({chr(c): chr(c + 0xFEE0) for c in range(33, 127)})
    texts = ["".join(rnd.choice("abcdeéß中文🚗ＡＢ１ \n\t-,.!") for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    rows = []
    for i, t in enumerate(texts):
        a = rnd.randrange(len(t))
        part = t[a : a + rnd.randint(1, 20)]
        rows.append((i, t, [part, part.upper(), part.translate(wide), part.replace(" ", "  \n"), part.replace("-", "").replace(",", " "), "nothing like it", None, ""]))
    df = spark.createDataFrame(rows, "i int, t string, q array<string>").select("i", "t", "q", anchored(F.col("t"), F.col("q")).alias("f"))
    bare = lambda s: "".join(c for c in unicodedata.normalize("NFKC", s).casefold() if c.isalnum())
    n = 0
    for r in df.collect():
        assert len(r.f) == len(r.q)
        for q, f in zip(r.q, r.f, strict=True):
            there = q and q.strip() and (q in r.t or bare(q) and bare(q) in bare(r.t))
            if q in (None, "", "nothing like it") or not there:
                assert f.quote is None or (q and q.strip())
                continue
            n += 1
            assert f.quote == r.t[f.start : f.start + len(f.quote)] and (f.quote == q if f.how == "exact" else True)
            assert bare(q) in bare(f.quote)
    assert n > 900
    empty = spark.createDataFrame([(None, ["a"]), ("a", None)], "t string, q array<string>").select(anchored(F.col("t"), F.col("q")).alias("f")).collect()
    assert [[x.quote for x in r.f] for r in empty] == [[None], []]


def by_hand(text, aliases):
    """Every place of every alias tried, then the longest first."""
    norm = Mapped(text).norm
    found = []
    for kind, target, alias, needs in aliases:
        parts = [p for p in dictionary.JOINERS.split(unicodedata.normalize("NFKC", alias).casefold().strip()) if p]
        for start in range(len(norm)):
            i, ok = start, bool(parts)
            for n, p in enumerate(parts):
                while n and i < len(norm) and norm[i] in " \t_-":
                    i += 1
                if not norm.startswith(p, i):
                    ok = False
                    break
                i += len(p)
            if ok and not (start and cased(norm[start]) and cased(norm[start - 1])) and not (i < len(norm) and cased(norm[i - 1]) and cased(norm[i])):
                found.append((kind, target, needs, start, i))
    named = {f[1] for f in found if not f[2]}
    out = []
    for kind, target, needs, a, b in sorted(found, key=lambda f: (f[3] - f[4], f[3], f[0], f[1])):
        if (not needs or needs in named) and not any(k == kind and a < d and c < b for k, _, c, d in out):
            out.append((kind, target, a, b))
    return sorted(out, key=lambda s: (s[2], s[3], s[0], s[1]))


def test_matcher_against_brute_force():
    rnd = random.Random(8)
    for _ in range(150):
        words = ["".join(rnd.choice("abé1") for _ in range(rnd.randint(1, 3))) for _ in range(6)] + ["中", "中文"]
        aliases = [(rnd.choice("xy"), str(rnd.randrange(4)), rnd.choice([" ", "-", "_"]).join(rnd.choices(words, k=rnd.randint(1, 3))), rnd.choice([None, None, str(rnd.randrange(4))])) for _ in range(12)]
        text = "".join(rnd.choice([w, w.upper(), w + "!"]) + rnd.choice([" ", "  ", "-", "", ". ", "\n"]) for w in rnd.choices(words, k=30))
        assert Matcher([(*a, None, None) for a in aliases]).spans(text) == by_hand(text, aliases)


def test_what_stands_beside_an_alias():
    m = Matcher([("b", "day", "ri", None, None, "cheng|chan"), ("b", "m3", "m3", "tesla", "bmw ?", None), ("b", "tesla", "tesla", None, None, None)])
    targets = lambda t, c=None: [s[1] for s in m.spans(t, c)]
    assert targets("ri") == ["day"] and targets("ri cheng") == ["day"] and targets("ri-m3") == ["day"]
    assert targets("m3 tesla") == ["m3", "tesla"] and targets("bmw m3", "a tesla") == [] and targets("m3", "a tesla") == ["m3"] and targets("m3") == []
    assert m.rows("TESLA  M3")[0] == {"kind": "b", "target": "tesla", "start": 0, "end": 5, "quote": "TESLA"}
    assert Matcher([]).spans("x") == [] and m.spans(None) == []
    clause = m.clauses("No tesla? Yes: ri; 1,500 or 2.5. m3")
    assert [(c["asked"], [s["target"] for s in c["spans"]]) for c in clause] == [(True, ["tesla"]), (False, ["day"]), (False, ["m3"])]
    assert [s["target"] for c in Matcher([], {"n": r"\d[\d,.]*\d"}).clauses("a 1,500, b 2.55.") for s in c["spans"]] == ["1,500", "2.55"]


def test_tables_of_aliases(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "red widget and blue bolt", "x"), (2, None, "y"), (3, "", None), (4, "Blue-Bolt, RED", "z")], "id int, text string, spans string")
    aliases = spark.createDataFrame([("p", "rw", "red widget"), ("p", "r", "red"), ("p", "bb", "blue bolt"), ("p", "b", "blue"), ("p", "n", None), ("p", "r", "red")], "kind string, target string, alias string")
    want = {1: ["rw", "bb"], 2: [], 3: [], 4: ["bb", "r"]}
    got = {r.id: [s.target for s in r.found] for r in dictionary.alias_spans(texts, aliases, into="found").collect()}
    assert got == want
    monkeypatch.setattr(dictionary, "MOST", 2)  # in parts
    assert {r.id: [s.target for s in r.found] for r in dictionary.alias_spans(texts, aliases, into="found").collect()} == want
    with pytest.raises(ValueError):
        dictionary.clause_spans(texts, aliases)
    assert dictionary.alias_spans(texts.limit(0), aliases).count() == 0
    assert {len(r.found) for r in dictionary.alias_spans(texts, aliases.limit(0), into="found").collect()} == {0}


def test_praise():
    def slow(s, tokens):
        best = [0] * (len(s) + 1)
        best[0] = 1
        for i in range(len(s)):
            for t, p in tokens.items():
                if best[i] and s.startswith(t, i):
                    best[i + len(t)] = max(best[i + len(t)], 2 if p else best[i])
        return best[-1]

    rnd = random.Random(1)
    for _ in range(500):
        tokens = {"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 4))): rnd.random() < 0.4 for _ in range(rnd.randint(1, 4))}
        sizes = {c: sorted({len(t) for t in tokens if t[0] == c}) for c in "ab"}
        s = "".join(rnd.choice(list(tokens)) if rnd.random() < 0.9 else rnd.choice("ab") for _ in range(rnd.randint(0, 8)))
        assert praise_state(s, tokens, sizes) == slow(s, tokens)


def test_praise_of_a_long_text(spark):
    words = {"so": False, "nice": True, "very": False, "n": False}
    texts = ["so nice!!", "so so", "sonice 👍", "nice price?", None, "", "so" * 500_000 + "nice", "so" * 500_000 + "x", "Ｎice"]
    began = time.perf_counter()
    got = [r.p for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).orderBy("i").select(pure_praise(F.col("t"), words).alias("p")).collect()]
    assert got == [True, False, True, False, False, False, True, False, False] and time.perf_counter() - began < 20


def test_algebra_of_spans(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(200):
        own = [[(lambda a: (rnd.choice("pq"), str(k), a, a + rnd.randint(1, 6)))(rnd.randrange(20)) for k in range(rnd.randint(0, 6))] for _ in range(2)]
        rows.append((i, *own))
    kind = "array<struct<kind: string, target: string, start: int, end: int>>"
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame(rows, f"i int, a {kind}, b {kind}").select(
        "*", spans.outside(a, b).alias("outside"), spans.apart(a, b).alias("apart"), spans.inside(a, b).alias("inside"), spans.follows(a, b, 2).alias("follows"),
        spans.longest_first(a).alias("longest"), F.transform(a, lambda s: spans.nearest(s, b)["target"]).alias("near"), spans.of_kind(a, "p").alias("p"),
    )
    for r in df.collect():
        name = lambda xs: [x.target for x in xs]
        within = lambda s, o: o.start <= s.start and s.end <= o.end
        meet = lambda s, o: s.start < o.end and o.start < s.end
        assert name(r.outside) == [s.target for s in r.a if not any(within(s, o) for o in r.b)] and name(r.inside) == [s.target for s in r.a if any(within(s, o) for o in r.b)]
        assert name(r.apart) == [s.target for s in r.a if not any(meet(s, o) for o in r.b)] and name(r.p) == [s.target for s in r.a if s.kind == "p"]
        assert name(r.follows) == [s.target for s in r.a if any(0 <= s.start - o.end <= 2 for o in r.b)]
        gap = lambda s, o: max(s.start - o.end, o.start - s.end, 0)
        for s, n in zip(r.a, r.near, strict=True):
            assert (n is None) == (not r.b) and (n is None or any(o.target == n and gap(s, o) == min(gap(s, x) for x in r.b) for o in r.b))
        taken = []
        for s in sorted(r.a, key=lambda s: (s.start - s.end, s.start, s.kind, s.target)):
            if not any(meet(s, t) for t in taken):
                taken.append(s)
        assert sorted((s.start, s.end) for s in r.longest) == sorted((s.start, s.end) for s in taken)


def test_quotes_at_their_first_place(spark, tmp_path):
    """Letters alone decide, however they are spaced, and ß is no ss."""
    texts = ["Un e fois une", "dass, daß", "T, o do to", "a  ΑΣ\tΣİ x", "ab", None, "..."]
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    quotes = spark.createDataFrame([(texts[0], ["ｕｎｅ"]), (texts[1], ["DAß", "dass"]), (texts[2], ["ＴＯ", None]), (texts[3], ["α σσ", "zz"])], "t string, q array<string>")
    got = [[(x.start, x.quote) for x in r.f] for r in quotes.coalesce(1).select(anchored(F.col("t"), F.col("q"), first=True).alias("f")).collect()]
    assert got == [[(0, "Un e")], [(6, "daß"), (0, "dass")], [(0, "T, o"), (None, None)], [(3, "ΑΣ\tΣ"), (None, None)]]
    con = duckdb.connect()
    con.execute(f"create view conversations as from '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(tuple, QUERIES["anchored_quotes"](spark, str(tmp_path)).collect())) == sorted(con.execute(ORACLE_SQL["anchored_quotes"]).fetchall())


def test_words_as_sql_has_them(spark, tmp_path):
    """Spans of dictionary_ner and issues of compliance_scan by words with one space between, and ß as itself."""
    items = [(1, "ss ötz zu reden war gut"), (2, "der die das haus"), (3, "die das haus und hof")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["wer ßötz zu reden, SS ötz!", "der-die das haus", "derdie das", "der  die\n das haus und", "中der die das", "ss ötz zu derdie", "der die das haus undhof die das haus", None, "..."]
    rows = [(i, 0, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("benchmark", "conversations", "documents"):
        con.execute(f"create view {t} as from '{tmp_path}/{t}.parquet/*.parquet'")
    for q in ("dictionary_ner", "compliance_scan"):
        assert sorted(map(tuple, QUERIES[q](spark, str(tmp_path)).collect())) == sorted(con.execute(ORACLE_SQL[q]).fetchall())
    m = Matcher([("b", "x", "a b", None, None, None), ("b", "y", "b c", None, None, None)], plain=True, joined=False, overlap=True)
    assert [s[1:] for s in m.spans("a \t B c, ab c, a-b c")] == [("x", 0, 3), ("y", 2, 5), ("y", 15, 18)]


class Counted:
    def __init__(self, automaton):
        self.automaton, self.walks = automaton, 0

    def iter(self, text):
        self.walks += 1
        return self.automaton.iter(text)


def test_clauses_that_come_again_are_read_once():
    rows = [("item", f"thing {i}", f"thing {i}", None, None, None) for i in range(8)] + [("cue", "price", "how much", None, None, None), ("negator", "not", "not", None, None, None)]
    texts = [f"How much is the Thing-{i % 8}? I do not ask twice; it was {i}.50 before." for i in range(2_000)]
    m = Matcher(rows, {"number": r"\d[\d,]*(?:\.\d+)?"})
    m.automaton = Counted(m.automaton)
    found = m.clause_column(texts, [None] * len(texts)).to_pylist()
    assert m.automaton.walks <= 8 + 1 + 2_000
    assert [[(s["kind"], s["quote"]) for c in f for s in c["spans"]] for f in found] == [[("cue", "How much"), ("item", f"Thing-{i % 8}"), ("number", str(i % 8)), ("negator", "not"), ("number", f"{i}.50")] for i in range(2_000)]
    m.automaton.walks = 0
    assert m.row_column(texts[:8] * 50, [None] * 400).to_pylist()[8:16] == m.row_column(texts[:8], [None] * 8).to_pylist() and m.automaton.walks == 8


def test_clauses_equal_the_whole_text():
    rnd = random.Random(11)
    words = ["widget", "steel", "bolt", "not", "3.5", "1,000", "$12", "st.", "louis", "5 weeks", "ß", "Ｗidget", "left"]
    aliases = [("item", "w", "widget", None, None, None), ("item", "b", "bolt", None, None, None), ("item", "sb", "steel bolt", None, None, None), ("negator", "n", "not", None, None, None)]
    tables = [aliases, [*aliases, ("place", "sl", "st. louis", None, None, None)], [*aliases, ("item", "s", "steel", "w", None, None)], [*aliases, ("item", "l", "louis", None, "st. ", None)], [*aliases, ("sum", "b", "bolt", None, None, None)]]
    for rows in tables:
        m = Matcher(rows, {"sum": r"\$\s?\d+", "list": r"\d[\d,]*"})
        assert m.local == (rows is aliases)
        for _ in range(400):
            text = "".join(rnd.choice(words) + rnd.choice([" ", " ", ". ", ";", ", ", ",", "!?", "\n", "...", "-"]) for _ in range(rnd.randrange(1, 30)))
            got = [(s["kind"], s["target"], s["start"], s["end"], s["quote"]) for c in m.clause_column([text], [None]).to_pylist()[0] for s in c["spans"]]
            form = m.form(text)
            assert got == [(k, t, form.starts[a], form.ends[b - 1], form.quote(a, b)) for k, t, a, b in m.spans(text)]
