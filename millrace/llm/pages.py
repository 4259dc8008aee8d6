"""Main text of web pages by site style trees.

Pages of one host are merged into a style tree: a node stands for the tag path with the classes of its elements, and
keeps how many pages show it and how its contents vary. Its importance is the entropy of these contents over the
pages, normalised by the logarithm of their number: a branch that says the same on most pages is presentation, one
that differs from page to page is content. A node's children pass their importance up, damped by `DAMP` a step, and a
block is as important as the least important branch that it hangs in. Every block that tags don't rule out enters the
tree, whatever its classes are called.

Tags, roles and what is hidden decide first: menus, headers, footers, asides, forms, scripts and the like are out. Where a
page has an article or main element, only what is inside counts. Names are a prior. A name that says adverts, comments
or forms, and outside of articles one that says menu, sidebar, footer or cookies, is out for good, as such parts may well
vary from page to page. Any other name that hints at presentation - legal, related, notice - is out only if the tree finds
the block less important than `HINTED`, or is too small to tell and the block stands outside an article. A name counts
only as a whole: `share` and `share-box` do, `share-price` doesn't.

Each page is parsed once; its blocks, as text and 64-bit digests of their paths, are kept as a table. What the trees have to
say - nodes that are not important, and those whose names hint at presentation - goes to the pages by host while it is at
most `SAYS` rows; beyond that it meets them on digests, a row for each node of a page.

Blocks end at block elements; white space inside a block becomes one space; blocks are joined by one space.
Defined cases: null and empty pages and pages without text give an empty text; a null or odd url is a host of its own
name, the empty one; a null page_id stays null; repeated rows are returned each; unclosed, misnested and unknown tags never
fail; text outside any article counts where the page has no article or main element; a page that the tree would leave empty
keeps its blocks; other columns are not read, whatever their names; an empty table gives no rows.
"""

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import tidy, written

#: Comments and the like, and tags; as in the HTML standard a quote opens a value only behind an equals sign. Nothing in
#: it is tried twice, so a page is scanned in linear time, whatever it holds.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)?+|=)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
SPACES = re.compile(r"\s+")

# Element names of the HTML and MathML standards.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title iframe xmp noembed noframes".split())
SUBTREE = frozenset("svg template object canvas annotation annotation-xml".split())
MATHML = frozenset("math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd semantics mstyle mspace mpadded mphantom".split())
INLINE = MATHML | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPE = frozenset("ul ol dl table tbody thead body article main section div".split())
NOT_MAIN = RAW | SUBTREE | frozenset("nav footer aside form menu dialog button select fieldset head input label".split())
MAIN = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
# Words in classes and ids. Those of parts that are never main text, wherever they stand; of parts beside the
# main text; of parts that may be either; and words that may stand beside them in a name.
NEVER = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored comment comments commentlist disqus respond reply replies form login signup subscribe newsletter share sharing social".split())
BESIDE = frozenset("sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr popup modal overlay toolbar pagination pager contentinfo skip".split())
HINTS = frozenset("side promo promotion banner notice notices alert related recommended recommendations widget widgets search hidden complementary dialog tracking legal disclaimer copyright".split())
PLAIN = frozenset("site page main global top bottom left right upper lower box bar block container wrapper wrap inner outer section area list item items link links button buttons btn icon icons group row col column primary secondary mobile desktop sticky fixed post entry article story news blog text content title label body js is".split())

#: First parts of class names that say what else a page shows, as in "with-sidebar".
ABSENT = frozenset("no not has with without".split())

#: Pages of a host that must show a node for entropy to judge it, and the importance below which a block goes:
#: anywhere, inside an article, and where its names hint at presentation.
PAGES, LOW, LOW_INSIDE, HINTED, DAMP = 5, 0.3, 0.08, 0.8, 0.9

#: Nodes that are broadcast to the pages, by host; more are joined page by page.
SAYS = 200_000

WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
OUT, STRICT, HINT, FREE = 3, 2, 1, 0  # ranks: by tag; by name for good; by name unless the tree says otherwise; not at all


def rank_of_name(name: str) -> tuple[int, bool]:
    """The rank of one class or id, and whether it holds inside articles as well."""
    words = [w.lower() for w in WORDS.findall(name)]
    if not words or words[0] in ABSENT or any(w not in NEVER and w not in BESIDE and w not in HINTS and w not in PLAIN for w in words):
        return FREE, False
    if any(w in NEVER for w in words):
        return STRICT, True
    if any(w in BESIDE for w in words):
        return STRICT, False
    return (HINT, False) if any(w in HINTS for w in words) else (FREE, False)


def signature(attributes: str) -> tuple[str, int, bool, bool]:
    """The classes of an element, its rank by its attributes, whether that holds inside articles, and whether it is main."""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return "", FREE, False, False
    names, rank, inside, main = "", FREE, False, False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            if key == "class":
                names = ".".join(sorted(re.sub(r"\d{3,}", "#", v.lower()) for v in value.split()))
            for name in value.split():
                r, within = rank_of_name(name)
                rank, inside = max(rank, r), inside or within
        elif key == "role":
            if value.lower() in ROLES:
                rank, inside = OUT, True
            main |= value.lower() == "main"
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            rank, inside = OUT, True
    return names, rank, inside, main


class Block:
    """A run of text of one element: digests of the path to it, its rank, and whether it is inside an article."""

    __slots__ = ("path", "text", "rank", "inside")

    def __init__(self, path: tuple[int, ...], text: str, rank: int, inside: bool):
        self.path, self.text, self.rank, self.inside = path, text, rank, inside


class Element:
    __slots__ = ("tag", "path", "rank", "inside")

    def __init__(self, tag: str, path: tuple[int, ...], rank: int, inside: bool):
        self.tag, self.path, self.rank, self.inside = tag, path, rank, inside


def node(parent: int, tag: str, names: str) -> int:
    """The digest of a path: that of its parent, and the element."""
    return xxhash.xxh3_64_intdigest(f"{parent:x}>{tag}.{names}".encode("utf-8", "replace")) - (1 << 63)


def end_of(page: str, tag: str, at: int) -> int | None:
    """Behind the end tag that closes the subtree of a tag that ends at `at`; None if nothing does."""
    depth = 1
    for m in TOKEN.finditer(page, at):
        if m[2] and m[2].lower() == tag:
            if m[1]:
                depth -= 1
                if not depth:
                    return m.end()
            elif not m[3].endswith("/"):
                depth += 1
    return None


def blocks(page: str | None) -> list[Block]:
    """All blocks of text of a page that tags and attributes don't rule out, in its order."""
    found: list[Block] = []
    if not page:
        return found
    stack = [Element("", (), FREE, False)]
    opened: Counter[str] = Counter()  # how many elements of each tag are open
    endless: set[str] = set()  # tags that no end tag follows any more
    parts: list[str] = []

    def close(i: int) -> None:
        opened.subtract(s.tag for s in stack[i:])
        del stack[i:]

    def end() -> None:
        if parts:
            text = SPACES.sub(" ", "".join(parts)).strip()
            parts.clear()
            if text and stack[-1].rank < OUT:
                found.append(Block(stack[-1].path, text, stack[-1].rank, stack[-1].inside))

    def closed(i: int) -> bool:
        """Whether the elements from i on judge their text otherwise than the one before."""
        return any((s.rank, s.inside) != (stack[i - 1].rank, stack[i - 1].inside) for s in stack[i:])

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            parts.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            parts.append(html.unescape(page[at : m.start()]))  # run by run: a reference doesn't go on behind a tag
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if not opened[tag]:  # an end tag without its start is no boundary, but for that of a paragraph
                if tag == "p":
                    end()
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag not in INLINE:
                        end()
                        close(i)
                    elif all(s.tag in INLINE for s in stack[i:]):  # only inline elements are closed with an inline one
                        if closed(i):
                            end()
                        close(i)
                    break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        self_closed = m[3].endswith("/")
        if tag in SUBTREE or tag in RAW:
            if self_closed and tag in SUBTREE or tag in endless:
                continue
            if tag in SUBTREE:
                shut = end_of(page, tag, at)
            else:
                behind = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>", re.I).search(page, at)
                shut = behind.end() if behind else size if tag in ("script", "style", "textarea", "title", "xmp") else None
            if shut is None:
                endless.add(tag)
            else:
                at = shut
            continue
        if tag in VOID:
            if tag not in INLINE:
                end()
            continue
        names, rank, within, main = signature(m[3])
        inline = tag in INLINE
        if self_closed and (tag in MATHML or not inline and tag not in CLOSES_P):
            continue
        if not inline:
            end()
            if tag in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        close(i)
                        break
                    if stack[i].tag not in INLINE:
                        break
            if tag in SIBLING:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in SIBLING[tag]:
                        close(i)
                        break
                    if stack[i].tag in SCOPE:
                        break
        top = stack[-1]
        if tag in NOT_MAIN or tag == "header" and not top.inside:  # a header inside an article is its heading
            rank = OUT
        elif tag in ("html", "body"):
            rank = FREE
        elif rank < OUT and not within and (top.inside or tag in MAIN):
            rank = HINT if rank else FREE
        own = max(top.rank, rank)
        inside = top.inside or (tag in MAIN or main) and own < STRICT
        if inline and (own, inside) != (top.rank, top.inside):
            end()
        path = top.path if inline else (*top.path, node(top.path[-1] if top.path else 0, tag, names))
        stack.append(Element(tag, path, own, inside))
        opened[tag] += 1
    end()
    return found


def kept(found: list[Block], importance: dict[int, float]) -> list[Block]:
    """The blocks of the main text. importance: of nodes that enough pages show, each with all branches above it."""
    inside = any(b.inside for b in found)
    main = [b for b in found if b.rank < STRICT and (b.inside or not inside)]

    def stays(b: Block) -> bool:
        x = importance.get(b.path[-1] if b.path else 0)
        if x is None:
            return b.inside or b.rank == FREE
        return x >= (HINTED if b.rank == HINT else LOW_INSIDE if b.inside else LOW)

    return [b for b in main if stays(b)] or main  # a host that shows one and the same article everywhere still has that article


def main_text(page: str | None, importance: dict[int, float] | None = None) -> str:
    """The page's text without what tags, names or the host's style tree rule out."""
    return " ".join(b.text for b in kept(blocks(page), importance or {}))


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


BLOCK = "struct<node: long, rank: int, inside: boolean, text: string>"
NODE = "struct<node: long, digest: long, hint: boolean, path: array<long>>"


def parsed(pages: DataFrame, ident: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """The pages as a table: row, page_id, url, host, blocks, and a row for each node that shows text, with a digest of it."""
    rows = pages.select(F.col(ident).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html")).withColumn("host", host_of(F.col("url")))
    block = pa.list_(pa.struct([("node", pa.int64()), ("rank", pa.int32()), ("inside", pa.bool_()), ("text", pa.string())]))
    nodes = pa.list_(pa.struct([("node", pa.int64()), ("digest", pa.int64()), ("hint", pa.bool_()), ("path", pa.list_(pa.int64()))]))

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                texts, shown = [], []
                for page in batch.column(3):
                    found = blocks(page.as_py())
                    texts.append([{"node": b.path[-1] if b.path else 0, "rank": b.rank, "inside": b.inside, "text": b.text} for b in found])
                    digests: dict[tuple[int, ...], xxhash.xxh3_64] = {}
                    hints = {b.path for b in found if b.rank == HINT}
                    for b in found:
                        if b.path:
                            digests.setdefault(b.path, xxhash.xxh3_64()).update(b.text.encode("utf-8", "replace") + b"\0")
                    shown.append([{"node": p[-1], "digest": x.intdigest() - (1 << 63), "hint": p in hints, "path": list(p)} for p, x in digests.items()])
                yield pa.record_batch([*batch.columns[:3], pa.array(texts, block), pa.array(shown, nodes)], names=["page_id", "url", "host", "blocks", "nodes"])

    kind = rows.schema["page_id"].dataType.simpleString()
    table = rows.select("page_id", "url", "host", "html").mapInArrow(work, f"page_id {kind}, url string, host string, blocks array<{BLOCK}>, nodes array<{NODE}>")
    return written(table.withColumn("row", F.monotonically_increasing_id()), compression="zstd")


def style_tree(table: DataFrame) -> DataFrame:
    """host, node, importance and hint of the nodes that at least PAGES pages show: the least importance of the node and of all
    branches above it, and whether a name hints at presentation on some page."""
    seen = table.select("host", F.explode("nodes").alias("n")).select("host", "n.*")
    each = seen.groupBy("host", "node", "digest").agg(F.count("*").alias("n"))
    # entropy of the contents: log m - sum(n log n) / m, normalised by log m
    own = each.groupBy("host", "node").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    own = own.withColumn("own", F.when(F.col("m") > 1, 1 - F.col("nlogn") / (F.col("m") * F.log("m"))).otherwise(1.0))
    own = own.join(seen.groupBy("host", "node").agg(F.first("path").alias("path"), F.max("hint").alias("hint")), ["host", "node"])
    # a branch is as important as its most varied part, damped by the depth at which that lies below it
    up = own.select("host", "m", "own", F.size("path").alias("depth"), F.posexplode("path").alias("k", "branch"))
    branch = up.groupBy("host", "branch").agg(F.max(F.col("own") * F.pow(F.lit(DAMP), F.col("depth") - F.col("k") - 1)).alias("importance"), F.max("m").alias("m")).where(F.col("m") >= PAGES)
    hung = own.select("host", "node", "hint", F.explode("path").alias("branch")).join(branch.select("host", "branch", "importance"), ["host", "branch"])
    return hung.groupBy("host", "node").agg(F.min("importance").alias("importance"), F.max("hint").alias("hint"))


def chosen(blocks: Column, judged: Column) -> Column:
    """The text of a page. judged: map of node to importance, as in `kept`."""
    inside = F.exists(blocks, lambda b: b["inside"])
    main = F.filter(blocks, lambda b: (b["rank"] < STRICT) & (b["inside"] | ~inside))

    def stays(b: Column) -> Column:
        x = F.element_at(judged, b["node"])
        least = F.when(b["rank"] == HINT, HINTED).when(b["inside"], LOW_INSIDE).otherwise(LOW)
        return F.when(x.isNull(), b["inside"] | (b["rank"] == FREE)).otherwise(x >= least)

    left = F.filter(main, stays)
    return F.array_join(F.transform(F.when(F.size(left) > 0, left).otherwise(main), lambda b: b["text"]), " ")


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text and n_chars."""
    table = parsed(pages)
    says = written(style_tree(table).where((F.col("importance") < LOW) | F.col("hint")))
    entry = F.struct("node", "importance")
    whole = table.select("row", "host", "page_id", "url", "blocks")
    if says.count() <= SAYS:
        judged = says.groupBy("host").agg(F.map_from_entries(F.collect_list(entry)).alias("judged"))
        whole = whole.join(F.broadcast(judged), "host", "left")
    else:
        main = F.transform(F.filter("blocks", lambda b: b["rank"] < STRICT), lambda b: b["node"])
        wanted = table.select("row", "host", F.explode(F.array_distinct(main)).alias("node"))
        judged = wanted.join(says, ["host", "node"]).groupBy("row").agg(F.map_from_entries(F.collect_list(entry)).alias("judged"))
        whole = whole.join(judged, "row", "left")
    text = whole.select("page_id", "url", chosen(F.col("blocks"), F.coalesce("judged", F.create_map().cast("map<bigint,double>"))).alias("text"))
    return text.withColumn("n_chars", F.char_length("text").cast("long"))
