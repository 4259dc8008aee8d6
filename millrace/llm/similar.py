"""Near duplicates by the Jaccard similarity of word shingles: every pair that reaches it, and no other.

Two sets of similarity `least` or more share one of the first n - ceil(least * n) + 1 elements of each, whatever
the order of all elements is. The order puts shingles that are common in a sample of the texts last, the most
common at the very end, so what meets under one shingle is small; the sample decides about speed only.

Equal sets are one class. Classes are first compared with the representative of their SimHash component (fingerprints
of five-word shingles, multi-index hashing), and under each shingle with two of the other classes, which joins
large groups of near copies without all of their pairs; what is then still in different components is compared
pair by pair,
if enough of both sets stands from the shared shingle on - the first one that two sets share has all their
others behind it - and if their parities allow it: of `8 * 64` parts of all shingles, each of which a set has an odd
or even number of, two sets can differ in no more than they have shingles apart. Sketches rule out most other pairs;
similarities are computed from the whole sets of the rest.

Fingerprints alone can't do it: at a similarity of 0.8 two of them differ in ten bits of 64 on average, and no choice of
segments reaches that far without meeting much of the corpus.

Defined cases: null, empty and blank texts have no shingles and are copies of each other; texts with fewer words
than a shingle are one shingle of all their words; only A-Z are lower-cased, only ASCII white space splits words.
"""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import remove, shared_folder, tidy, written
from millrace.llm.components import stars
from millrace.llm.simhash import linked, majority

#: One text in `FOLDS` is looked at for common shingles; of those in `COMMON` of them or more, `KNOWN` are ordered.
FOLDS, COMMON, KNOWN = 8, 4, 100_000
#: Columns of parities, 64 parts each.
PARITIES = tuple(f"p{i}" for i in range(8))
#: Up to so many hashes of rows (16 MB) are broadcast; more are joined by shuffles.
WANTED = 2_000_000


def lowered(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in ascending order."""
    words = lowered(text)
    n = len(words) - width + 1
    runs = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if n > 0 else [b" ".join(words)] if words else []
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, 42) for s in runs), np.uint64, max(n, len(words) > 0)).view(np.int64))


def table(home: str) -> str:
    """A new folder in home."""
    return f"{home}/{uuid.uuid4().hex}"


def lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def identified(docs: DataFrame) -> Column:
    """A hash of all columns of a row."""
    return F.xxhash64(*(F.col(c) for c in docs.columns), *(F.col(c).isNull() for c in docs.columns))


def common_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles in ascending order, and the rank of each by its number of texts."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.record_batch([pa.array(shingles(text, width))], names=["h"])

    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0).select("text")
    counts = sample.mapInArrow(work, "h long").groupBy("h").count().where(F.col("count") >= COMMON)
    found = [r.h for r in counts.orderBy(F.desc("count"), "h").limit(KNOWN).select("h").collect()]
    h, rank = np.array(found, np.int64), np.arange(len(found), 0, -1)
    order = np.argsort(h)
    return h[order], rank[order]


def classes_of(rows: DataFrame, width: int, least: float, home: str) -> DataFrame:
    """Per class of equal sets: node (digest of the set), size, fingerprint, prefix, sketch (how many shingles fall to
    each of 256 parts, 255 standing for more), parities of 512 other parts and best, the row with the smallest id."""
    known, ranks = common_shingles(rows, width)

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                nodes, prints, sizes, sketches, prefixes, odd = [], [], [], [], [], []
                for text in batch.column(2).to_pylist():
                    h = shingles(text, width)
                    nodes.append(xxhash.xxh3_64_intdigest(h.tobytes()))
                    prints.append(majority(h.astype(">i8")))
                    sizes.append(len(h))
                    sketches.append(np.minimum(np.bincount(h & 255, minlength=256), 255).astype(np.uint8).tobytes())
                    odd.append(np.packbits((np.bincount(h >> 8 & 511, minlength=512) & 1).astype(np.uint8)).view(np.int64))
                    rank = np.zeros(len(h), np.int64)
                    if len(known):
                        where = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        rank = np.where(known[where] == h, ranks[where], 0)
                    keep = len(h) - int(np.ceil(least * len(h) - 1e-9)) + 1 if len(h) else 0
                    prefixes.append(h[np.lexsort((h, rank))[:keep]])
                signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.record_batch([batch.column(0), batch.column(1), signed(nodes), signed(prints), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), lists(prefixes), *map(pa.array, np.array(odd, np.int64).reshape(-1, len(PARITIES)).T)], names=["id", "row", "node", "fp", "size", "sketch", "prefix", *PARITIES])

    prints = rows.select("id", "row", "text").mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, row long, node long, fp long, size int, sketch binary, prefix array<long>, " + ", ".join(f"{p} long" for p in PARITIES))
    best = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "row")).alias("best")
    return written(prints.groupBy("node").agg(best, *(F.first(c).alias(c) for c in ("fp", "size", "sketch", "prefix", *PARITIES))), table(home))


def possible(pairs: DataFrame, classes: DataFrame, least: float, home: str) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow the similarity, with the rows of both."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = sum(np.asarray(batch.column(c), np.int64) for c in ("size_a", "size_b"))
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 256) for c in ("sketch_a", "sketch_b"))
            most = np.minimum(a, b)
            both = most.sum(1, dtype=np.int64)
            fits = (most == 255).any(1) | (both >= least * (n - both) - 1e-9)
            yield pa.record_batch([c for c in batch.columns[:4]], names=batch.schema.names[:4]).filter(pa.array(fits))

    side = lambda s: classes.select(F.col("node").alias(s), F.col("best.row").alias(f"row_{s}"), F.col("size").alias(f"size_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    alike = F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b") - 1e-9
    sides = pairs.join(side("a"), "a").join(side("b"), "b").where(alike)
    return written(sides.select("a", "b", "row_a", "row_b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(work, "a long, b long, row_a long, row_b long"), table(home))


def near(pairs: DataFrame, classes: DataFrame, rows: DataFrame, width: int, least: float, home: str) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity; the whole texts of what the sketches leave open are compared."""
    pairs = possible(pairs, classes, least, home)
    wanted = written(pairs.select(F.explode(F.array("row_a", "row_b")).alias("row")).distinct(), table(home))
    if wanted.count() <= WANTED:
        wanted = F.broadcast(wanted)

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [small.compress(b" ".join(lowered(t))) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.binary())], names=["row", "packed"])

    texts = rows.select("row", "text").join(wanted, "row").mapInArrow(pack, "row long, packed binary")
    texts = written(texts.groupBy("row").agg(F.first("packed").alias("packed")), table(home), compression="none")

    @tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_text, sets = zstandard.ZstdDecompressor(), {}

        def set_of(row: int, packed: bytes) -> np.ndarray:
            if row not in sets:
                if len(sets) >= 64:
                    sets.clear()
                sets[row] = shingles(open_text.decompress(packed).decode(errors="surrogatepass"), width)
            return sets[row]

        for batch in batches:
            fits = []
            for row_a, row_b, x, y in zip(*(batch.column(i) for i in range(2, 6)), strict=True):
                a, b = set_of(row_a.as_py(), x.as_py()), set_of(row_b.as_py(), y.as_py())
                both = len(np.intersect1d(a, b, assume_unique=True))
                fits.append(both >= least * (len(a) + len(b) - both) - 1e-9)
            yield pa.record_batch(batch.columns[:2], names=["a", "b"]).filter(pa.array(fits, pa.bool_()))

    side = lambda s: texts.select(F.col("row").alias(f"row_{s}"), F.col("packed").alias(f"packed_{s}"))
    sides = pairs.join(side("a"), "row_a").join(side("b"), "row_b").select("a", "b", "row_a", "row_b", "packed_a", "packed_b")
    return written(sides.mapInArrow(compare, "a long, b long"), table(home))


def split(hot: DataFrame, roots: DataFrame, classes: DataFrame, home: str) -> tuple[DataFrame, DataFrame]:
    """The rows (key, node, size, reach, part, parities) of the keys with several parts, as the links so far leave them, and
    for each key and part: its smallest and largest size, largest reach."""
    placed = hot.select("key", "node", "size", "reach").join(roots, "node", "left").select("key", "node", "size", "reach", F.coalesce("root", "node").alias("part"))
    spread = placed.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("key")
    placed = written(placed.join(spread, "key", "left_semi").join(classes.select("node", *PARITIES), "node"), table(home))
    parts = placed.groupBy("key", "part").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.max("reach").alias("far"))
    return placed, written(parts, table(home))


def near_copies(docs: DataFrame, width: int = 5, least: float = 0.8, distance: int = 3, ident: str = "doc_id", text: str = "text", home: str | None = None) -> DataFrame:
    """A row for each group of near duplicates: row, the hash (`identified`) of its row with the smallest id.

    Rows without an id come last, rows of one id by their hash. The result reads tables in the folder home.
    """
    rows = docs.select(F.col(ident).alias("id"), F.col(text).cast("string").alias("text"), identified(docs).alias("row"))
    home = home or shared_folder(docs.sparkSession)
    classes = classes_of(rows, width, least, home)
    sized = classes.where("size > 0")
    by_print = sized.select("node", "fp").join(linked(sized.select("node", "fp"), distance, "node"), "fp")
    by_print = by_print.where(F.col("node") != F.col("component_id")).select(F.col("node").alias("a"), F.col("component_id").alias("b"))

    # one shuffle by key serves the counts and the join
    index = classes.select(F.posexplode("prefix").alias("pos", "key"), "node", "size").select("key", "node", "size", (F.col("size") - F.col("pos")).alias("reach")).repartition("key")
    member = F.struct("node", "size")
    keys = index.groupBy("key").agg(F.count("*").alias("k"), F.min(member).alias("lo"), F.max(member).alias("hi")).where("k > 1")
    shared = written(index.join(keys, "key"), table(home))

    alike = lambda x, y: F.least(x, y) >= least * F.greatest(x, y) - 1e-9
    leaders = shared.select(F.col("node").alias("a"), "size", F.explode(F.array("lo", "hi")).alias("l")).where((F.col("a") != F.col("l.node")) & alike(F.col("size"), F.col("l.size")))
    pairs = by_print.unionByName(leaders.select("a", F.col("l.node").alias("b")))
    links = near(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), classes, rows, width, least, home)
    roots = stars(links)

    # under keys of up to three classes all pairs are done
    hot = shared.where("k > 3").select("key", "node", "size", "reach")
    placed, parts = split(hot, roots, classes, home)
    side = lambda df, s: df.select("key", *(F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "key"))
    # what is common lies within the reach of both, from their first common shingle on
    within = lambda x, y, n: F.least(x, y) >= least / (1 + least) * n - 1e-9
    fits = (F.col("high_b") >= least * F.col("low_a") - 1e-9) & (F.col("high_a") >= least * F.col("low_b") - 1e-9) & within("far_a", "far_b", F.col("low_a") + F.col("low_b"))
    apart = side(parts, "a").join(side(parts, "b"), "key").where((F.col("part_a") > F.col("part_b")) & fits)
    alike_within = alike(F.col("size_a"), F.col("size_b")) & within("reach_a", "reach_b", F.col("size_a") + F.col("size_b"))
    unlike = sum((F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in PARITIES), F.lit(0))
    fits = alike_within & (unlike <= (1 - least) / (1 + least) * (F.col("size_a") + F.col("size_b")) + 1e-9)
    rest = apart.select("key", "part_a", "part_b").join(side(placed, "a"), ["key", "part_a"]).join(side(placed, "b"), ["key", "part_b"]).where(fits)
    rest = rest.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")).distinct()
    more = near(rest, classes, rows, width, least, home)
    if not more.isEmpty():
        roots = stars(links.unionByName(more))
    groups = classes.select("node", "best").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("group")).agg(F.min("best").alias("best"))
    return groups.select("best.row")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest id, with the columns of docs.

    Most rows are alone in their group: only what is dropped or repeated is looked up, and texts stay where they are
    while that is at most `WANTED` rows; else they are joined by a shuffle.
    """
    home = shared_folder(docs.sparkSession)
    best = near_copies(docs, home=home, **options).withColumnRenamed("row", "row_of_group_")
    named = docs.withColumn("row_of_group_", identified(docs))
    kept = best.withColumn("kept_of_group_", F.lit(True))
    counted = named.groupBy("row_of_group_").agg(F.count("*").alias("n")).join(kept, "row_of_group_", "left")
    special = written(counted.where("n > 1 or kept_of_group_ is null").select("row_of_group_", F.coalesce("kept_of_group_", F.lit(False)).alias("kept_of_group_")))
    remove(docs.sparkSession, home)
    if special.count() <= WANTED:
        special = F.broadcast(special)
    alone = named.join(special, "row_of_group_", "left_anti")
    repeated = named.join(special.where("kept_of_group_"), "row_of_group_", "left_semi").dropDuplicates(["row_of_group_"])
    return alone.unionByName(repeated).select(docs.columns)
