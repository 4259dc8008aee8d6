"""Each operator against a brute-force version on small tables, and its defined cases."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import decontaminate, langid, mixing, pages, quality, scoring, simhash, substring
from millrace.llm.components import stars

RND = random.Random(11)
VOCABULARY = ["".join(RND.choice("abcdefghij") for _ in range(RND.randint(1, 6))) for _ in range(400)]


def words(n):
    return [RND.choice(VOCABULARY) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    shared, other = words(90), words(60)
    rows = [words(RND.randint(0, 200)) for _ in range(12)]
    rows += [rows[3], rows[3], shared, words(20) + shared + words(30), shared[5:70] + words(10), words(3) + other[2:], other + shared, ["ha", "ho"] * 120, ["ha", "ho"] * 70 + words(5)]
    out = [(i, " ".join(r)) for i, r in enumerate(rows)]
    return out + [(90, None), (91, ""), (92, " \t\n "), (93, "\x0b".join(shared) + "\n"), (94, "é " * 60), (95, "x" * 50_000)]


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_substring_dedup_against_brute_force(spark, texts):
    for size, gram in ((50, 8), (12, 4)):
        least = {}
        for i, t in texts:
            w = split(t)
            for k in range(len(w) - size + 1):
                key = tuple(w[k : k + size])
                least[key] = min(least.get(key, i), i)
        want = {}
        for i, t in texts:
            w = split(t)
            gone = {j for k in range(len(w) - size + 1) if least[tuple(w[k : k + size])] < i for j in range(k, k + size)}
            kept = " ".join(x for j, x in enumerate(w) if j not in gone)
            want[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
        df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("batch", F.lit(None).cast("string"))
        for batches in (1, 4):
            got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in substring.substring_dedup(df, size, gram, batches).collect()}
            assert got == want
    assert sum(v[1] for v in want.values()) > 500


def test_substring_dedup_of_nothing(spark):
    assert substring.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_substring_index_is_kept_between_calls(spark, texts, tmp_path):
    rows = lambda df: {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}
    table = lambda t: spark.createDataFrame(t, "doc_id long, text string")
    size, gram, folder = 12, 4, f"file://{tmp_path}/index"
    want, got = rows(substring.substring_dedup(table(texts), size, gram)), {}
    for at in range(0, len(texts), 6):
        index = substring.FingerprintIndex(spark, folder, fan_in=2)  # opened anew for each batch
        batch = table(texts[at : at + 6])
        once = rows(substring.substring_dedup(batch, size, gram, index=index))
        got |= once
        if at == 12:  # a batch that comes twice, and what a merge that died would leave
            assert rows(substring.substring_dedup(batch, size, gram, index=substring.FingerprintIndex(spark, folder, fan_in=2))) == once
            (tmp_path / "index" / "run-1-dead").mkdir()
            (tmp_path / "index" / "run-1-dead" / "part-0.parquet").write_bytes(b"half")
    assert got == want
    index = substring.FingerprintIndex(spark, folder, fan_in=2)
    index.compact()
    assert max(int(r.rpartition("/")[2].split("-")[1]) for r in index.runs) >= 2 and len(index.runs) <= 3
    spans = index.least(index.rows())
    assert spans.count() == spans.select("key", "s1", "s2").distinct().count() > 20


def test_simhash_against_brute_force(spark, texts):
    rows = texts + [(200 + i, (texts[2][1] or "") + " tail" * i) for i in range(4)] + [(91, "")]
    prints = {}
    for i, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in split(t)]
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        prints[i] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in prints:
        for j in prints:
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1))
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got) == sorted((i, f"{prints[i]:016x}", root(i)) for i, _ in rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_links_find_every_near_pair(spark):
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for k in (1, 2, 3, 4):
            x = int(b)
            for bit in rnd.choice(64, k, replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    want = {(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 3}
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")
    got = {(max(r.a, r.b), min(r.a, r.b)) for r in simhash.links(df).collect()}
    assert got == want and len(want) > 100


def test_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 40), (40, 50), (60, 60), (70, 71), (71, 75), (72, 75), (None, 3)]
    got = {r.node: r.root for r in stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 50: 40, 71: 70, 75: 70, 72: 70}


PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li>Home</li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>{0}<aside>Side</aside><script>var a="</p>";</script>
<div id="comments"><p>First!</p></div><form><label>Mail</label></form><footer>&copy; x</footer></body></html>"""


def test_main_text():
    body = "<article><h1>A &amp; B</h1><p><b>One<br>two<p>three   <i>four</i>five</p><!-- no --><ul><li>six<li>seven</ul><div class='share'>Share</div><p>8 &lt; 9</article>"
    assert pages.main_text(PAGE.format(body), None) == "A & B One two three fourfive six seven 8 < 9"
    assert pages.main_text(PAGE.format("<div><p>plain</p> text</div>"), None) == "plain text"
    assert pages.main_text("<div class='page has-sidebar'><div class='sidebar'>a</div><p>b</p></div>", None) == "b"
    for odd in (None, "", "   ", "<", "<p", "</p></p>", "<script>x", "<!--", "<b><p></b>", "<nav>x</nav>"):
        assert pages.main_text(odd, None) == ("" if odd != "<" else "<")


def test_tags_are_scanned_as_the_standard_says_and_in_linear_time():
    import time

    assert pages.main_text("<p data-x=don't>Hello</p><p>it's</p>", None) == "Hello it's"
    assert pages.main_text("<p title='it's'>Hello</p><p>that's it</p>", None) == "Hello that's it"
    assert pages.main_text("<p title='a>b' x = \"<p>\">one</p><p/>two<br/>three", None) == "one two three"
    for piece in ('<a x="', "<a b='", "<svg>", "<![CDATA[>", "<!-- ", "</x>", "<b>", "<p a=", "a<", "<div>x</i>"):
        began = time.perf_counter()
        pages.main_text(piece * (1_000_000 // len(piece) if piece[:4] not in ("<b>", "<div") else 3000), None)
        assert time.perf_counter() - began < 20, piece


def test_entropies_against_the_formula(spark):
    import math

    # branches of neutral names: the same on all pages, in two halves, and different on each
    rows = [(i, f"http://h.example/{i}", f"<body><div class='xa'>Same</div><div class='xb'>Half {i % 2}</div><div class='xc'>Own text {i}</div></body>") for i in range(16)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.node: r.importance for r in pages.style_tree(pages.parsed(df)).collect()}
    node = lambda *steps: [n := 0, *(n := pages.node(n, tag, names) for tag, names in steps)][-1]
    importance = {f"x{k}": v for k, v in zip("abc", (0.0, math.log(2) / math.log(16), 1.0), strict=True)}
    assert set(got) == {node(("body", ""), ("div", k)) for k in importance}
    for k, v in importance.items():
        assert got[node(("body", ""), ("div", k))] == pytest.approx(min(v, 0.9))  # the body is worth what its best part is, damped by a step
    assert {r.text for r in pages.extract(df).collect()} == {f"Own text {i}" for i in range(16)}
    assert pages.main_text(rows[3][2], None) == "Same Half 1 Own text 3"  # without its tree a page keeps them all
    assert pages.extract(df.limit(0)).count() == 0


def test_style_tree_removes_what_repeats(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div class='x1'>Same words</div><div class='x2'><p>Text number {i} here</p></div></body>", 1) for i in range(8)]
    rows += [(50, None, None, 1), (51, "odd", "<p>alone</p>", 1), (51, "odd", "<p>alone</p>", 1)]
    got = [(r.page_id, r.text, r.n_chars) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect()]
    assert sorted(got) == sorted([(i, t := f"Text number {i} here", len(t)) for i in range(8)] + [(50, "", 0), (51, "alone", 5), (51, "alone", 5)])


def test_factorisation_machine_pairs():
    fm = quality.FactorisationMachine(6, 3)
    fm.w = np.arange(6, dtype=np.float32)
    ids, x = np.array([0, 2, 5, 1]), np.array([1, 2, 0.5, 3], np.float32)
    pairs = sum(float(fm.v[a] @ fm.v[b]) * x[i] * x[j] for i, a in enumerate(ids) for j, b in enumerate(ids) if i < j)
    assert fm.raw(ids, x, np.array([0]))[0][0] == pytest.approx(float(fm.w[ids] @ x) + pairs, abs=1e-5)


def test_quality_learns_and_handles_odd_rows(spark):
    docs = [(i, " ".join(words(40)) if i % 2 else "BUY NOW!! " * 15) for i in range(240)] + [(900, None), (901, ""), (901, "")]
    labels = [(i, i % 2) for i in range(240)] + [(5, 1), (None, 1), (7, None)]
    d, l = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.classify(d, l).collect()
    held = [r for r in got if r.held_out and r.doc_id < 240]
    assert len(got) == 243 and held and all(r.predicted == r.doc_id % 2 for r in held)
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.classify(d, l.limit(0)).collect()} == {0.5}


def test_cross_parsing_counts_greedy_longest_phrases():
    thai = "".join(chr(0xE01 + RND.randrange(46)) for _ in range(300))
    samples = {"a": b"banana bandana", "b": b"the quick brown fox", "c": thai.encode(), "d": ("ab" * 400 + "abc").encode()}
    parser = langid.CrossParser(samples)
    long = " ".join(RND.choice(["banana", "ban", "quick", "the", "fox", "abab"]) for _ in range(400))
    texts = ["banana", "bananaband", "the fox ran", "zzz", "quick ban", "b" * 700, "ab" * 700, "b" + "ab" * 900, thai * 3, thai[7:120] + "the fox", long, "x" * 256, "ab" * 128]
    for at, text in enumerate(texts):
        symbols = bytes(langid.letters_only(text.encode()))
        for k, s in enumerate(samples.values()):
            ref, n, i = bytes(langid.letters_only(s)), 0, 0
            while i < len(symbols):
                j = i + 1
                while j <= len(symbols) and symbols[i:j] in ref:
                    j += 1
                i = max(j - 1, i + 1)
                n += 1
            assert parser.phrases([text])[0][0, k] == n, (text, k)
            assert parser.phrases(texts)[0][at, k] == n, (text, k)


def test_language_rows(spark):
    en, de = "the man and the woman went to the house with their dog ", "der mann und die frau gingen mit ihrem hund nach hause "
    rows = [(i, (en if i % 2 else de) * 3, "en" if i % 2 else "de") for i in range(60)] + [(70, None, "en"), (71, "123 !!", "de"), (72, "THE DOG and the man", None)]
    got = {r.doc_id: r for r in langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(60))
    assert got[70].lang_pred == got[71].lang_pred == "und" and got[70].score == 0 and got[72].lang_pred == "en"
    df = spark.createDataFrame([*rows, (None, "das haus und der hund", "de"), (80, de * 4000, "de")], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in langid.language_id(df).collect()}
    assert got[None].lang_pred == got[80].lang_pred == "de" and got[None].held_out is False
    assert langid.language_id(df.limit(0)).count() == 0
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.language_id(none).collect()] == ["und"]


def test_scores_against_the_plain_formulas(spark, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK", 400)
    monkeypatch.setattr(scoring, "FRAME", 150)
    rows = [(i, " ".join(words(RND.randint(0, 25)))) for i in range(30)] + [(40, None), (41, "NEW Word"), (41, "NEW Word")]
    got = sorted(scoring.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r.doc_id)
    import math
    import zlib

    learn = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    count = defaultdict(int)
    for t in learn:
        for w in [*split((t or "").lower()), None]:
            count[w] += 1
    n, v = sum(count.values()), len(count)
    # the trees by recursion over contexts
    seen = defaultdict(lambda: [0, 0])
    depth = scoring.DEPTH

    def steps(t):
        raw = " ".join(split((t or "").lower())).encode() + b"\n"
        for k in range(len(raw)):
            ctx = (b"\0" * depth + raw[:k])[-depth:]
            for b in range(8):
                yield ctx, (1 << b) + (raw[k] >> (8 - b)), raw[k] >> (7 - b) & 1

    for t in learn:
        for ctx, node, bit in steps(t):
            for d in range(depth + 1):
                seen[ctx[depth - d :], node][bit] += 1
    held = {(c[depth - d :], node) for _, t in rows for c, node, _ in steps(t) for d in range(depth + 1)}
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    below = defaultdict(float)
    weight = {}
    for d in range(depth, -1, -1):
        for c, node in [x for x in held if len(x[0]) == d]:
            pe = kt(*seen[c, node])
            pw = pe if d == depth else math.log(0.5) + np.logaddexp(pe, below[c, node])
            weight[c, node] = 1.0 if d == depth else math.exp(math.log(0.5) + pe - pw)
            if d:
                below[c[1:], node] += pw

    def chance(ctx, node, d=0):
        c = ctx[depth - d :]
        zeros, ones = seen[c, node]
        own = (ones + 0.5) / (zeros + ones + 1)
        w = weight[c, node]
        return own if d == depth else w * own + (1 - w) * chance(ctx, node, d + 1)

    empty = spark.createDataFrame([], "doc_id long, text string")
    assert scoring.scores(empty).count() == 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda x: x[0]), strict=True):
        tokens = [*split((t or "").lower()), None]
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (i, len(tokens), sum(count.get(w, 0) > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((count.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in tokens))
        assert r.score == pytest.approx(sum(math.log10(p if bit else 1 - p) for c, node, bit in steps(t) for p in [chance(c, node)]), rel=1e-6)


def plain_leaks(docs, items):
    """op7 by brute force: every alignment of every item with every document."""
    import regex

    D = decontaminate
    units = "|".join(sorted(D.UNITS, key=len, reverse=True))

    def three(text):
        raw = " ".join(split(text))
        if not raw:
            return None
        strip = lambda x: x.translate({ord(c): None for c in D.SIGNS}).lower()
        t = strip(regex.sub(r"\p{Lu}(?<=[\p{L}\p{Nd},;][\"')]? \p{Lu})\p{Ll}+", D.NAME, raw))
        t = regex.sub(rf"\p{{Nd}}+( ?)(?:{units})(?= |$)", rf"{D.NUMBER}\1{D.UNIT}", t)
        return strip(raw).split(" "), regex.sub(r"\p{Nd}+", D.NUMBER, t).split(" ")

    out = set()
    for i, text in docs:
        for k, item in items:
            if not (x := three(text)) or not (y := three(item)):
                continue
            (db, dt), (ib, it) = x, y
            size = len(ib)
            for shift in range(-size + 1, len(db)):
                at = [p for p in range(size) if 0 <= p + shift < len(db)]
                plain = [db[p + shift] == ib[p] for p in at]
                typed = [dt[p + shift] == it[p] for p in at]
                literal = [D.MARK not in it[p] for p in at]
                runs = range(len(at) - D.WINDOW + 1)
                hit = any(all(plain[r : r + D.WINDOW]) or all(typed[r : r + D.WINDOW]) and sum(literal[r : r + D.WINDOW]) >= D.LITERAL for r in runs)
                if size < D.WINDOW:
                    hit = all(plain) and len(plain) == size and (size >= D.WHOLE or len(db) == size)
                slots = {(ib[p], db[p + shift]) for p, same in zip(at, typed, strict=True) if same and D.MARK in it[p]}
                enough = lambda n: n >= min(D.LEAST, size) and n >= D.SHARE * size  # noqa: E731, B023
                consistent = len({a for a, _ in slots}) == len({b for _, b in slots}) == len(slots)
                if hit and (enough(sum(plain)) or enough(sum(typed)) and consistent):
                    out.add((i, k))
    return out


def test_leaks(spark):
    item = "If Alice has 12 apples and gives Bob 5 of them, how many apples does Alice keep after 3 days?"
    other = item.replace("Alice", "Carol").replace("Bob", "Dave").replace("12", "40").replace("5", "9")
    mixed = item.replace("Alice", "Carol", 1)
    capital, line = "What is the capital city of France?", "one, two three four five"
    filler = " ".join(words(40))
    rows = [(1, f"{filler}. {item} {filler}"), (2, f"{filler} {other.upper().lower()}"), (3, f"{filler}, if Carol" + other[8:]), (4, filler), (5, None), (6, ""), (7, item), (7, item), (8, mixed)]
    rows += [(9, capital), (9, filler), (10, f"{filler} {capital.upper()} {filler}"), (11, f"so {line}, six"), (12, "Too Short!"), (13, f"it is too short {filler}"), (14, item.upper())]
    rows += [(None, f"{filler} {capital}"), (15, "In 5 kg of salt the price of the Berlin market rose by 7 km to 3 m"), (16, "x " * 30_000 + item)]
    bench = [(10, item), (11, "too short"), (12, None), (13, capital), (14, line), (15, " "), (16, "In 9 kg of salt the price of the Munich market rose by 8 km to 2 m")]
    bench += [(20 + i, " ".join(words(n))) for i, n in enumerate((4, 6, 7, 12, 30))]
    for i, (_, text) in enumerate(bench[-5:]):  # a word changed here and there, and half of an item
        w = text.split()
        rows += [(30 + i, " ".join([*words(5), *w[: len(w) // 2], "zz", *w[len(w) // 2 + 1 :]])), (40 + i, " ".join([*w[: -(-len(w) * 2 // 3)], *words(9)]))]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item", F.lit(1)).withColumn("version", F.lit("x"))
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.leaks(d, b).collect()}
    assert set(got) == plain_leaks(rows, bench)
    assert {(1, 10), (2, 10), (3, 10), (7, 10), (8, 10), (14, 10), (9, 13), (10, 13), (None, 13), (11, 14), (12, 11), (15, 16), (16, 10)} <= set(got)
    assert got[1, 10] is False and got[7, 10] is False and got[3, 10] is True and got[15, 16] is True
    left = [(r.doc_id, r.text) for r in decontaminate.clean(d, b).collect()]
    assert sorted(map(str, left)) == sorted(str((i, t)) for i, t in rows if not plain_leaks([(i, t)], bench))
    assert (9, filler) in left and decontaminate.clean(d, b).columns == d.columns
    assert decontaminate.leaks(d, b.limit(0)).count() == decontaminate.leaks(d.limit(0), b).count() == 0


def test_raking_meets_its_targets(spark):
    cells = [(s, l, t, float(RND.randint(1, 1000))) for s in "abc" for l in "xy" for t in "pq"]
    df = spark.createDataFrame(cells, "source_ string, lang_ string, topic_ string, tokens double")
    targets = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"p": 0.1, "q": 0.9}}
    raked = mixing.rake(df, targets, rounds=30, keep=0.01)
    rows = raked.collect()
    assert sum(r.tokens * r.p for r in rows) == pytest.approx(0.01 * sum(r.tokens for r in rows))
    for r in mixing.residuals(raked).collect():
        assert r.target == targets[r.marginal][r.category]
        assert r.fitted == pytest.approx(r.target, rel=1e-3) and r.sampled == pytest.approx(r.target, rel=1e-3)
    assert max(r.p for r in mixing.rake(df, targets, keep=5.0).collect()) == 1


def test_mix_rows(spark):
    rows = [(i, "w " * (i % 50), "s" if i % 3 else None, None if i % 5 == 0 else "en") for i in range(300)] + [(300, None, "s", "en"), (301, "", "s", "en"), (None, "w w", "s", "en"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({"p": F.lit(0), "source_": F.lit("own"), "row": F.lit(1)})
    got = mixing.mix(df)
    assert got.count() == mixing.mix(df).count() > 0 and got.columns == [*df.columns, "lang_", "topic_", "n_tokens_", "p_"]
    assert {r.source_ for r in got.collect()} == {"own"}
    assert mixing.mix(df.limit(0)).count() == 0


def test_the_sample_has_its_targets(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.lit(30)).alias("text"), F.when(F.col("id") % 10 < 7, "web").otherwise("book").alias("source"), F.when(F.col("id") % 3 == 0, "de").otherwise("en").alias("lang"))
    targets = {"source": {"web": 0.5, "book": 0.5}, "lang": {"de": 0.4, "en": 0.6}}
    kept = mixing.mix(docs, targets=targets, keep=0.4)
    total = kept.count()
    assert total == pytest.approx(2400, rel=0.06)
    for m, goal in targets.items():
        for r in kept.groupBy(m).count().collect():
            assert r["count"] / total == pytest.approx(goal[r[m]], rel=0.08)
