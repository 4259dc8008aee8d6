"""Main text of pages: what markup hides and what it must not, and an independent parser and tree as oracle."""

import html
import math
import random
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

from pyspark.sql import functions as F

from millrace.llm import pages


def test_no_main_text_is_lost():
    for page, want in (
        ('<article><p>One <svg class="i"/> two</p><p>Three</p><p>Four <svg></svg> five</p></article>', "One two Three Four five"),
        ("<p>a <svg><svg></svg><text>LOGO</text></svg> b", "a b"),
        ("<p>a <svg><path></p><p>b</p>", "a b"),
        ('<article><p>a</p><div class="share-price">12</div><section class="legal">Law</section><div class="search-results">r</div><div class="related-work">w</div></article>', "a 12 Law r w"),
        ('<div class="share-price">12</div><div class="related-work">w</div><div id="social-history">h</div>', "12 w h"),
        ('<div id="social-history">h</div>', "h"),
        ("a &<b>lt;</b> b &amp;lt; &notit; &#x41;&#66", "a &lt; b &lt; ¬it; AB"),
        ("x <math><mi>y</mi><mo>=</mo><mn>2</mn><annotation>y=2</annotation></math> z", "x y=2 z"),
        ("<p>a<![CDATA[gone]]> b <!-- c --> d", "a b d"),
        ("<article><header><h1>Head</h1></header><p>t</p></article><header>Site</header>", "Head t"),
        ("<main><p>m</p><aside>n</aside><div class='ad'>q</div><div class='adverb'>r</div></main>", "m r"),
        ("<div class='header-image'>i</div><div class='page-header'>h</div><div class='no-sidebar'>s</div>", "i s"),
        ("<body class='has-comments sidebar'><p>t</p></body>", "t"),
        ("<template><p>t</p></template><object><p>o</p></object><p>x", "x"),
    ):
        assert pages.main_text(page) == want, page


def test_what_is_no_main_text_goes():
    for page, want in (
        ("<article><p>x</p></article><article class='comment'>c</article><article id='comment-12'>d</article>", "x"),
        ("<article><p>x</p><div class='post-comments'>c</div><ul class='commentList'><li>d</ul><form>f</form></article>", "x"),
        ("<p>x</p><div role='navigation'>n</div><div hidden>h</div><div aria-hidden='true'>a</div><div style='display: none'>d</div><span class='ad'>s</span>", "x"),
        ("<p>x</p><div class='cookie-notice'>c</div><div class='site-footer'>f</div><div id='mainMenu'>m</div><div class='article-sidebar'>s</div>", "x"),
        ("<p>x</p><textarea>t</textarea><select><option>o</select><button>b</button><iframe>i</iframe><noscript>n</noscript><title>t</title>", "x"),
    ):
        assert pages.main_text(page) == want, page


def test_the_tree_judges_what_names_hint_at(spark):
    """Legal notes that are the same on all pages go, those that are a page's own stay; menus never come back."""
    same = [(i, f"http://a/{i}", f"<div class='legal'>All rights</div><div class='text'>Own {i}</div><div class='menu'>Menu {i}</div>") for i in range(8)]
    own = [(100 + i, f"http://b/{i}", f"<div class='legal'>Law number {i}</div><div class='text'>Own {i}</div>") for i in range(8)]
    few = [(200 + i, f"http://c/{i}", f"<div class='legal'>Law {i}</div><div class='text'>Own {i}</div>") for i in range(3)]
    inside = [(300 + i, f"http://d/{i}", f"<article><div class='related'>Read more</div><p>Own {i}</p></article>") for i in range(8)]
    fewer = [(400 + i, f"http://e/{i}", f"<article><div class='related'>Read more</div><p>Own {i}</p></article>") for i in range(3)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(same + own + few + inside + fewer, "page_id int, url string, html string")).collect()}
    for i in range(8):
        assert got[i] == f"Own {i}" and got[100 + i] == f"Law number {i} Own {i}" and got[300 + i] == f"Own {i}"
    for i in range(3):
        assert got[200 + i] == f"Own {i}" and got[400 + i] == f"Read more Own {i}"


class Plain(HTMLParser):
    """Elements and their texts by the standard library's parser, with the end tags that may be left out."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.open, self.runs, self.out = [("", "", 0, False)], [], []

    def flush(self):
        text = re.sub(r"\s+", " ", "".join(self.runs)).strip()
        self.runs = []
        if text and self.open[-1][2] < 3:
            self.out.append((tuple(x[:2] for x in self.open[1:] if x[0] not in pages.INLINE), text, *self.open[-1][2:]))

    def state(self, tag, attrs):
        _, _, rank, inside = self.open[-1]
        r, within = 0, False
        for name in attrs.get("class", "").split() + attrs.get("id", "").split():
            x, w = pages.rank_of_name(name)
            r, within = max(r, x), within or w
        if tag in pages.NOT_MAIN or tag == "header" and not inside:
            r = 3
        elif tag in ("html", "body"):
            r = 0
        elif not within and (inside or tag in pages.MAIN):
            r = min(r, 1)
        rank = max(rank, r)
        return rank, inside or tag in pages.MAIN and rank < 2

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.runs.append(" ")
        elif tag not in pages.VOID:
            attrs = {k: v or "" for k, v in attrs}
            if tag not in pages.INLINE:
                self.flush()
                if tag in pages.CLOSES_P and any(x[0] == "p" for x in self.open):
                    while self.open.pop()[0] != "p":
                        pass
                if tag == "li" and self.open[-1][0] == "li":
                    self.open.pop()
            state = self.state(tag, attrs)
            if state != self.open[-1][2:]:
                self.flush()
            self.open.append((tag, ".".join(sorted(re.sub(r"\d{3,}", "#", c.lower()) for c in attrs.get("class", "").split())), *state))

    def handle_endtag(self, tag):
        if any(x[0] == tag for x in self.open):
            at = max(i for i, x in enumerate(self.open) if x[0] == tag)
            if tag not in pages.INLINE:
                self.flush()
            elif any(x[0] not in pages.INLINE for x in self.open[at:]):
                return
            elif any(x[2:] != self.open[at - 1][2:] for x in self.open[at:]):
                self.flush()
            del self.open[at:]

    def handle_data(self, data):
        self.runs.append(data)

    def handle_entityref(self, name):
        self.runs.append(html.unescape(f"&{name};"))

    def handle_charref(self, name):
        self.runs.append(html.unescape(f"&#{name};"))


def by_hand(rows):
    """Blocks of the plain parser, entropies of each branch over the pages of a host, and what then stays."""
    parsed = []
    for _, url, page in rows:
        p = Plain()
        p.feed(page or "")
        p.close()
        p.flush()
        parsed.append((re.sub(r"^\w+://([^/:?#]+).*", r"\1", url).lower(), p.out))
    shown = defaultdict(Counter)
    for host, own in parsed:
        for path in {b[0] for b in own if b[0]}:
            shown[host, path][tuple(b[1] for b in own if b[0] == path)] += 1
    m = {k: sum(c.values()) for k, c in shown.items()}
    entropy = {k: 1 - sum(n * math.log(n) for n in c.values()) / (m[k] * math.log(m[k])) if m[k] > 1 else 1.0 for k, c in shown.items()}
    branch = {}
    for (host, path), x in entropy.items():
        for k in range(1, len(path) + 1):
            if max(m[h, q] for h, q in entropy if h == host and q[:k] == path[:k]) >= pages.PAGES:
                branch[host, path[:k]] = max(branch.get((host, path[:k]), 0), x * pages.DAMP ** (len(path) - k))
    out = []
    for host, own in parsed:
        main = [b for b in own if b[2] < 2 and (b[3] or not any(c[3] for c in own))]
        left = []
        for b in main:
            known = [branch[host, b[0][:k]] for k in range(1, len(b[0]) + 1) if (host, b[0][:k]) in branch]
            limit = pages.HINTED if b[2] == 1 else pages.LOW_INSIDE if b[3] else pages.LOW
            if min(known) >= limit - 1e-12 if known else b[3] or b[2] == 0:
                left.append(b)
        out.append(" ".join(b[1] for b in left or main))
    return out


def random_page(rnd, host):
    names = ["a1", "legal", "related", "menu", "ad", "comments", "box", "share-price", "widget"]

    def part(depth):
        kind = rnd.random()
        if depth > 3 or kind < 0.4:
            return rnd.choice([f"<p>{rnd.choice(['same', 'other', str(rnd.random())])}</p>", "plain &amp; text ", "<b>bold</b>", "<ul><li>x<li>y</ul>"])
        tag = rnd.choice(["div", "section", "div", "aside", "nav", "span"])
        return f"<{tag} class='{rnd.choice(names)}'>" + "".join(part(depth + 1) for _ in range(rnd.randint(1, 3))) + f"</{tag}>"

    body = "".join(part(0) for _ in range(rnd.randint(1, 4)))
    return f"<html><body><div class='{host}'>{rnd.choice(['fixed', str(rnd.random())])}</div>" + (f"<article>{body}</article>" if rnd.random() < 0.3 else body) + "</body></html>"


def test_extraction_against_an_independent_version(spark, monkeypatch):
    rnd = random.Random(13)
    rows = [(i, f"http://h{i % 6}.example/{i}", random_page(rnd, f"t{i % 6}")) for i in range(150)]
    given = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select(F.col("page_id").cast("int"), "url", "html").collect()]
    for own in (rows, given):
        got = {r.page_id: (r.text, r.n_chars) for r in pages.extract(spark.createDataFrame(own, "page_id int, url string, html string")).collect()}
        want = by_hand(own)
        assert [got[r[0]] for r in own] == [(w, len(w)) for w in want]
    monkeypatch.setattr(pages, "SAYS", 3)  # more than are broadcast
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert [got[r[0]] for r in rows] == by_hand(rows)
    without = [pages.main_text(r[2]) for r in rows]
    assert sum(a != b for a, b in zip(without, by_hand(rows), strict=True)) > 20  # the tree decides


def test_odd_pages(spark):
    rows = [(1, None, None, "x"), (1, None, None, "x"), (None, "", "<p>a</p>", "x"), (None, "", "<p>a</p>", "x"), (2, "odd", "", "x"), (3, "http://h/", "<p>" + "word " * 300_000, "x"), (4, "HTTP://u:p@H:8/?", "<p> é 😀</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumn("host", F.lit(1)).withColumn("row", F.lit(2)).withColumn("blocks", F.lit(3))
    got = sorted(((str(r.page_id), r.url, r.text[:9], r.n_chars) for r in pages.extract(df).collect()), key=str)
    assert got == sorted([("1", None, "", 0)] * 2 + [("None", "", "a", 1)] * 2 + [("2", "odd", "", 0), ("3", "http://h/", "word word", 1_499_999), ("4", "HTTP://u:p@H:8/?", "é 😀", 3)], key=str)
    empty = pages.extract(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "text", "n_chars"]
