"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Words are lower-cased and freed of signs; numbers, names (capitalised words that start no sentence) and units after
a number become typed placeholders, so that a question with other numbers, names or units keeps its template. Every
window of `WINDOW` words of the benchmark is hashed twice, as template and as plain words, and every window of every
document is looked up among them. A template window needs `LITERAL` words that are no placeholders.

Hits of one document, item and alignment are one candidate, whose words are then compared in full. An item leaks if
plain words alone match for `SHARE` of the item and at least `LEAST` words (all of them in a shorter item); or if that
many template words match and the slots are consistent - the same value in the item has the same value in the document
and the other way round, so a re-parameterised question passes and an accidental likeness of placeholders doesn't.

Defined cases: null, empty and blank texts match nothing; items of fewer than WINDOW words leak where all their plain
words follow each other, those of fewer than `WHOLE` words only where they are a document's whole text, as
inside a text they can't be told from chance; repeated rows of one id are one document; a null id is an id; repeated
items are each reported; other columns are not read.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SPACE, written

WINDOW, LITERAL, SHARE, LEAST, WHOLE = 6, 3, 0.5, 8, 3
MARK = "∎"
NUMBER, NAME, UNIT = MARK + "n", MARK + "a", MARK + "u"
#: Up to so many documents with candidates are broadcast as a pair of numbers; more are joined by a shuffle.
WANTED = 1_000_000

# Units of measure and money.
UNITS = "mm cm m km in ft yd mi mg g kg lb lbs oz t ml cl l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years cent cents dollar dollars euro euros pound pounds percent mph kmh km/h w kw kwh v a hz mhz ghz b kb mb gb tb c f k".split()
#: Signs that are dropped from words before they are compared.
SIGNS = ".,;:!?\"'`()[]{}<>#$%&*|_~^=+/\\@-–—…“”‘’«»¿¡"


def spaced(text: Column) -> Column:
    """The words with one space between."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def bare(text: Column) -> Column:
    return F.lower(F.translate(text, SIGNS, ""))


def canonical(text: Column) -> Column:
    """The template of a spaced text; it has a word, perhaps an empty one, for each of the text's."""
    t = F.regexp_replace(text, r"\p{Lu}(?<=[\p{L}\p{Nd},;][\"')]? \p{Lu})\p{Ll}+", NAME)
    units = "|".join(sorted(UNITS, key=lambda u: -len(u)))
    t = F.regexp_replace(bare(t), rf"\p{{Nd}}+( ?)(?:{units})(?= |$)", f"{NUMBER}$1{UNIT}")
    return F.regexp_replace(t, r"\p{Nd}+", NUMBER)


def worded(rows: DataFrame) -> DataFrame:
    """Adds the words of raw, as they are, bare and in the template, and their number."""
    named = rows.withColumns({"words": F.split("raw", " "), "bare": F.split(bare(F.col("raw")), " "), "template": F.split(canonical(F.col("raw")), " ")})
    return named.drop("raw").withColumn("n", F.size("words"))


def windows(rows: DataFrame, short: list[int]) -> DataFrame:
    """Position and key of all windows: of WINDOW words by template and by plain words, and of the short sizes given.

    rows: bare, template, n and others, which are kept. Zipped arrays and hashes of columns stay in generated code.
    """
    shifted = lambda c, k: F.slice(c, k + 1, F.greatest("n", F.lit(1))).alias(f"{c[0]}{k}")
    each = rows.select(*(c for c in rows.columns if c not in ("bare", "template", "words")), F.posexplode(F.arrays_zip(*(shifted(c, k) for c in ("template", "bare") for k in range(WINDOW)))).alias("at", "w"))
    part = lambda c, size: [F.col(f"w.{c}{k}") for k in range(size)]
    marked = sum((F.col(f"w.t{k}").contains(MARK).cast("int") for k in range(WINDOW)), F.lit(0))
    full = F.col("at") + WINDOW <= F.col("n")
    by_template = F.when(full & (marked <= WINDOW - LITERAL), F.xxhash64(F.lit(WINDOW), *part("t", WINDOW)))
    by_words = F.when(full & (marked > 0), F.xxhash64(F.lit(WINDOW), *part("b", WINDOW)))
    whole = {s: F.col("n") == s if s < WHOLE else F.col("at") + s <= F.col("n") for s in short}
    by_size = [F.when(whole[s], F.xxhash64(F.lit(s), *part("b", s))) for s in short]
    kept = [c for c in each.columns if c != "w"]
    return each.select(*kept, F.explode(F.array(by_template, by_words, *by_size)).alias("key")).where("key is not null")


def found_rows(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """Per contaminated text and item: doc, version (digest of the text), item, words, matched, reparameterised."""
    items = worded(benchmark.select(F.col(item).alias("item"), spaced(F.col(text)).alias("raw")).where("raw <> ''"))
    short = sorted(r.n for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect())  # WINDOW - 1 values at most
    index = windows(items.where(F.col("n") >= WINDOW), []).select("key", "item", F.col("at").alias("start"), F.col("n").alias("size"))
    # a short item is one window that begins with it
    index = index.unionByName(windows(items.where(F.col("n") < WINDOW), short).where("at = 0").select("key", "item", F.lit(0).alias("start"), F.col("n").alias("size"))).distinct()

    rows = worded(docs.select(F.col(ident).alias("doc"), F.xxhash64(text).alias("version"), spaced(F.col(text)).alias("raw")).where("raw <> ''"))
    hits = windows(rows, short).select("doc", "version", "at", "key").join(index, "key")
    candidates = written(hits.select("doc", "version", "item", (F.col("at") - F.col("start")).alias("shift"), "size").distinct())
    asked = candidates.groupBy("doc", "version").agg(F.collect_set(F.struct("item", "shift", "size")).alias("asked"))
    wanted = candidates.select("version").distinct()
    texts = docs.select(F.col(ident).alias("doc"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    if wanted.count() <= WANTED:
        texts = texts.join(F.broadcast(wanted), "version", "left_semi")
    texts = texts.select("doc", "version", spaced(F.col("text")).alias("raw")).join(asked.select(F.col("doc").alias("doc_"), F.col("version").alias("version_"), "asked"), F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("version") == F.col("version_")))
    texts = worded(texts.select("doc", "version", "raw", "asked"))

    # only the aligned part of a document goes on
    low = lambda a: F.greatest(a["shift"], F.lit(0))
    high = lambda a: F.least(F.col("n"), a["shift"] + a["size"])
    cut = lambda c, a: F.slice(c, low(a) + 1, high(a) - low(a)).alias(f"d_{c}")
    parts = F.transform("asked", lambda a: F.struct(a["item"].alias("item"), (low(a) - a["shift"]).alias("skip"), cut("words", a), cut("bare", a), cut("template", a)))
    pairs = texts.select("doc", "version", F.explode(parts).alias("p")).select("doc", "version", "p.*")
    pairs = pairs.join(items.select(F.col("item").alias("item_"), F.col("n").alias("size"), *(F.col(c).alias(f"i_{c}") for c in ("words", "bare", "template"))), F.col("item") == F.col("item_"))
    own = lambda c: F.slice(f"i_{c}", F.col("skip") + 1, F.size("d_words")).alias(f"i_{c}")
    pairs = pairs.select("doc", "version", "item", "size", F.arrays_zip("d_bare", "d_template", own("bare"), own("template")).alias("z"))
    same = F.filter("z", lambda x: x["d_template"] == x["i_template"])
    slots = F.array_distinct(F.transform(F.filter("same", lambda x: x["i_template"].contains(MARK)), lambda x: F.struct(x["i_bare"].alias("i"), x["d_bare"].alias("d"))))
    pairs = pairs.withColumn("same", same).withColumn("slots", slots).withColumn("typed", F.size("same")).withColumn("plain", F.size(F.filter("z", lambda x: x["d_bare"] == x["i_bare"])))
    values = lambda side: F.size(F.array_distinct(F.transform("slots", lambda x: x[side])))
    consistent = (values("i") == F.size("slots")) & (values("d") == F.size("slots"))
    enough = lambda c: (F.col(c) >= F.least(F.lit(LEAST), F.col("size"))) & (F.col(c) >= SHARE * F.col("size"))
    kept = pairs.where(enough("plain") | (enough("typed") & consistent))
    other = F.exists("slots", lambda x: x["i"] != x["d"])
    best = kept.groupBy("doc", "version", "item").agg(F.max(F.struct(F.greatest("typed", "plain").alias("matched"), other.alias("other"))).alias("m"), F.max("size").alias("words"))
    return best.select("doc", "version", "item", "words", "m.matched", F.col("m.other").alias("reparameterised"))


def leaks(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """Per contaminated document and item: both ids, words of the item, words that match, whether slots differ."""
    found = found_rows(docs, benchmark, ident, item, text)
    best = found.groupBy("doc", "item").agg(F.max(F.struct("matched", "reparameterised")).alias("m"), F.max("words").alias("words"))
    return best.select(F.col("doc").alias(ident), F.col("item").alias(item), F.col("words").cast("long").alias("item_words"), F.col("m.matched").cast("long").alias("matched_words"), F.col("m.reparameterised").alias("reparameterised"))


def clean(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents in which no item leaks, with all their columns; each text of an id is judged on its own."""
    found = found_rows(docs, benchmark, ident, text=text).select(F.col("doc").alias("doc_"), F.col("version").alias("version_")).distinct()
    return docs.join(found, docs[ident].eqNullSafe(F.col("doc_")) & (F.xxhash64(docs[text]) == F.col("version_")), "left_anti").select(docs.columns)
