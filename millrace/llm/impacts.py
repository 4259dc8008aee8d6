"""Ranked lexical search in a bit-sliced impact index.

Documents lie in blocks of up to `DOCS`, in the order of their ids. For each term of a block the index keeps the places of
the documents that hold it, and their impacts - whole numbers of up to 20 bits - as bitmaps: slice b has a bit for each
of these documents, set where bit b of the impact is. No other number of a document is kept.

A search multiplies slices by the weight of the term by shifting and adding, lays them over the documents of the block
and adds the terms of an item, all by carry arithmetic on bitmaps: a sum is once more a list of slices. Then the top
documents of all items are found together from the most significant slice downwards: documents with the bit are surely
in while they are fewer than k, and are all that is left to choose from once they are more. Blocks are searched on
their own, with what of the index the terms of the items need; the best of each block meet in a rank over items.

An impact is (10**9 * tf) div (1000 * tf + 12 * m), with m = 100 - 25 + (25 * n * N) div L for a document of n terms in
N documents with L terms; a term's weight is floor(1000 * ln((2N + 2) / (2df + 1))).

Defined cases: null texts, and texts and items without terms, are in no result, nor are scores of 0; equal scores go by
ascending id, rows without an id behind all others; repeated rows are documents of their own; repeated rows of an item are
one, and texts of one item id are searched together; a null item id is an id; very long texts are whole; empty tables give
no rows; other columns are not read, whatever their names.
"""

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from millrace.llm.common import shared_folder, written

#: Documents of a block, and terms with repeats from which on it is full.
DOCS, TERMS = 1 << 14, 1 << 22
SLICES = 20
TOP = 20
#: Up to so many distinct terms are broadcast to the scan of the index; more meet it by a shuffle.
ASKED = 500_000
#: Items and (item, term) pairs that are searched at once, about.
ITEMS, PAIRS = 256, 200_000
#: Bytes of slices that are multiplied at once.
CHUNK = 1 << 16

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A-Z in lower case; ASCII signs end terms; bytes from 128 on are parts of characters that are in terms.
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def terms(raw: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return raw.translate(_FOLD).split() if raw else []


def n_terms(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TERM)), F.lit(0)).cast("long")


def impacts(tf: np.ndarray, size: np.ndarray, n: int, total: int) -> np.ndarray:
    """Of documents with `size` terms, `tf` of them the term, among n documents with `total` terms."""
    m = 75 + 25 * size * n // total
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def sliced(value: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of runs of values, each run from a byte's start on: an array (bytes, SLICES) and the bytes of each run."""
    width = -(-counts // 8)
    first = np.cumsum(np.r_[0, width[:-1]]) * 8
    padded = np.zeros(int(width.sum()) * 8, np.int64)
    padded[np.repeat(first - np.cumsum(np.r_[0, counts[:-1]]), counts) + np.arange(len(value))] = value
    return np.stack([np.packbits((padded >> b & 1).astype(np.uint8)) for b in range(SLICES)], 1), width


def runs_of(data: bytes, ends: np.ndarray) -> pa.Array:
    """A binary array of consecutive parts."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64).tobytes()), pa.py_buffer(data)]).cast(pa.binary())


def block_rows(vocabulary: dict[bytes, int], ids: list[np.ndarray], n: int, total: int) -> pa.RecordBatch:
    """The rows of a block: term, its number of documents, their places and slices of impacts."""
    names = np.array(sorted(vocabulary), object)
    rank = np.empty(len(names), np.int64)
    rank[[vocabulary[t] for t in names]] = np.arange(len(names))
    size = np.array([len(i) for i in ids], np.int64)
    each, tf = np.unique(rank[np.concatenate(ids)] * DOCS + np.repeat(np.arange(len(ids)), size), return_counts=True)
    place = each % DOCS
    df = np.bincount(each // DOCS, minlength=len(names))
    bits, width = sliced(impacts(tf, size[place], n, total), df)
    return pa.record_batch([pa.array(names, pa.binary()), pa.array(df.astype(np.int32)), runs_of(place.astype("<u2").tobytes(), 2 * np.cumsum(df)), runs_of(bits.tobytes(), SLICES * np.cumsum(width))], names=["term", "n", "places", "slices"])


@dataclass
class ImpactIndex:
    """The index of a collection in a folder: blocks with their documents' ids, and the slices of their terms."""

    spark: SparkSession
    folder: str

    def __post_init__(self) -> None:
        self.n, self.total = self.spark.read.parquet(f"{self.folder}/size").first()

    @property
    def blocks(self) -> DataFrame:
        """block, ids."""
        return self.spark.read.parquet(f"{self.folder}/index").where("term is null").select("block", "ids")

    @property
    def slices(self) -> DataFrame:
        """block, term, n, places, slices."""
        return self.spark.read.parquet(f"{self.folder}/index").where("term is not null").select("block", "term", "n", "places", "slices")


def build(docs: DataFrame, folder: str | None = None, ident: str = "doc_id", text: str = "text") -> ImpactIndex:
    """Index all terms of all documents; each task makes blocks of its own documents, so no row is shuffled."""
    spark, folder = docs.sparkSession, folder or shared_folder(docs.sparkSession)
    counted = docs.select(n_terms(F.col(text)).alias("n")).agg(F.count_if(F.col("n") > 0).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    n, total = written(counted, f"{folder}/size").first()
    kind = pa.list_(to_arrow_type(docs.schema[ident].dataType))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = (TaskContext.get().partitionId() + 1) << 24
        vocabulary: dict[bytes, int] = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        held: list[np.ndarray] = []
        names: list = []
        size = 0

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal block, size
            if not held:
                return
            own = pa.array(names, kind.value_type)
            order = pc.sort_indices(own, null_placement="at_end")
            rows = block_rows(vocabulary, [held[i] for i in order.to_pylist()], n, total)
            ids = pa.array([own.take(order).to_pylist()], kind)
            number = lambda k: pa.array(np.full(k, block))
            yield pa.record_batch([number(1), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), ids], names=columns)
            for at in range(0, rows.num_rows, 20_000):
                part = rows.slice(at, 20_000)
                yield pa.record_batch([number(part.num_rows), *part.columns, pa.nulls(part.num_rows, kind)], names=columns)
            block, size = block + 1, 0
            vocabulary.clear()
            held.clear()
            names.clear()

        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms(raw.as_py())
                if found:
                    held.append(np.fromiter(map(vocabulary.__getitem__, found), np.int64, len(found)))
                    names.append(name)
                    size += len(found)
                if len(held) == DOCS or size >= TERMS:
                    yield from done()
        yield from done()

    columns = ["block", "term", "n", "places", "slices", "ids"]
    rows = docs.select(F.col(ident), F.col(text).cast("binary").alias("raw")).where("raw is not null")
    rows = rows.mapInArrow(work, f"block long, term binary, n int, places binary, slices binary, ids array<{docs.schema[ident].dataType.simpleString()}>")
    written(rows, f"{folder}/index", "zstd")
    return ImpactIndex(spark, folder)


def add(total: np.ndarray, more: np.ndarray, at: int = 0) -> None:
    """Add slices to the slices of `total` from `at` on, carrying up; the lowest slice is first."""
    carry = None
    for j, x in enumerate(more, at):
        a = total[j]
        odd = a ^ x
        if carry is None:
            total[j], carry = odd, a & x
        else:
            total[j], carry = odd ^ carry, (a & x) | (carry & odd)
    j = at + len(more)
    while j < len(total) and carry is not None and carry.any():
        total[j], carry = total[j] ^ carry, total[j] & carry
        j += 1


def weighted(bits: np.ndarray, weight: np.ndarray, height: int) -> np.ndarray:
    """Slices times the whole number given for each of their bytes, by shifting and adding."""
    out = np.zeros((height, bits.shape[1]), np.uint8)
    for b in range(int(weight.max(initial=0)).bit_length()):
        mask = np.where(weight >> b & 1, 255, 0).astype(np.uint8)
        if mask.any():
            add(out, bits & mask, b)
    return out


def descend(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """From slices (slice, item, byte): bitmaps of the documents that are surely among an item's top k, and of the
    equal ones that fill up the rest. Documents without any bit are in neither."""
    sure, left = np.zeros(total.shape[1:], np.uint8), np.bitwise_or.reduce(total, 0)
    for bits in total[::-1]:
        having = sure | (left & bits)
        n = np.bitwise_count(having).sum(1, dtype=np.int64)[:, None]
        sure = np.where(n <= k, having, sure)
        left = np.where(n <= k, left & ~bits, left & bits)
    return sure, left


def best_of_block(names: list, places: list[np.ndarray], bits: list[np.ndarray], n_docs: int, asked: list[list[tuple[int, int]]], n_items: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, place and score of each item's top k of a block. asked: for each term, its items and weights in them."""
    most = np.zeros(n_items, object)
    for each in asked:
        for item, weight in each:
            most[item] += weight * 1_000_000
    total = np.zeros((max(int(m) for m in most).bit_length(), n_items, -(-n_docs // 8)), np.uint8)
    # terms that an item holds more than once have another weight there
    pairs = [(t, weight, [i for i, w in each if w == weight]) for t, each in enumerate(asked) for weight in sorted({w for _, w in each}) if weight]
    at = 0
    while at < len(pairs):
        end, size = at, 0
        while end < len(pairs) and (end == at or size + len(bits[pairs[end][0]]) <= CHUNK):
            size += len(bits[pairs[end][0]])
            end += 1
        part, at = pairs[at:end], end
        width = np.array([len(bits[t]) for t, _, _ in part])
        weight = np.array([w for _, w, _ in part], np.int64)
        height = SLICES + int(weight.max()).bit_length()
        product = weighted(np.ascontiguousarray(np.concatenate([bits[t] for t, _, _ in part]).T), np.repeat(weight, width), height)
        for (t, _, items), start, w in zip(part, np.cumsum(np.r_[0, width[:-1]]), width, strict=True):
            place = places[t]
            own = np.unpackbits(product[:, start : start + w], axis=1)[:, : len(place)] << (7 - (place & 7)).astype(np.uint8)
            first = np.flatnonzero(np.r_[True, place[1:] >> 3 != place[:-1] >> 3])
            laid = np.add.reduceat(own, first, axis=1)  # the bits of one byte
            where = np.ix_(items, place[first] >> 3)
            some = total[(slice(None), *where)]
            add(some, np.broadcast_to(laid[:, None], (height, *some.shape[1:]))[: len(some)])
            total[(slice(None), *where)] = some
    sure, left = descend(total, k)
    items, found = [], []
    for i in range(n_items):
        inside, equal = (np.flatnonzero(np.unpackbits(b[i])) for b in (sure, left))
        chosen = np.r_[inside, equal[: max(0, k - len(inside))]]  # places ascend as ids do
        items.append(np.full(len(chosen), i))
        found.append(chosen)
    items, found = np.concatenate(items), np.concatenate(found)
    on = total[:, items, found >> 3] >> (7 - (found & 7)).astype(np.uint8) & 1
    score = sum((s.astype(np.int64) << b for b, s in enumerate(on)), np.zeros(len(found), np.int64))
    return items, found, score


def search(index: ImpactIndex, queries: DataFrame, k: int = TOP, item: str = "item_id", text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Per item, its k documents of the highest scores: item, rank, ident and score."""
    spark = index.spark
    folded = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = queries.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text")).where("text is not null").distinct()
    rows = rows.select("item", F.explode(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))).alias("term")).withColumn("term", F.col("term").cast("binary"))
    asked = written(rows.groupBy("item", "term").agg(F.count("*").alias("times")))
    wanted = asked.select("term").distinct()
    if wanted.count() <= ASKED:
        wanted = F.broadcast(wanted)
    hits = written(index.slices.join(wanted, "term", "left_semi"))
    df = hits.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * index.n + 2) / (2.0 * F.col("df") + 1)))
    asked = written(asked.join(df, "term").select("item", "term", (F.col("times") * weight).alias("weight")).where("weight > 0"))
    items = asked.groupBy("item").agg(F.count("*").alias("pairs"))
    sizes = items.agg(F.count("*"), F.coalesce(F.sum("pairs"), F.lit(0))).first()
    parts = max(1, -(-sizes[0] // ITEMS), -(-sizes[1] // PAIRS))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)))
    kind, doc_kind = queries.schema[item].dataType, index.blocks.schema["ids"].dataType.elementType
    schema = f"item {kind.simpleString()}, doc {doc_kind.simpleString()}, score long"
    found = [searched(index, hits, asked.where(F.col("part") == p), k, schema) for p in range(parts)]
    found = [f for f in found if f is not None]
    if not found:
        return spark.createDataFrame([], f"`{item}` {kind.simpleString()}, rank int, `{ident}` {doc_kind.simpleString()}, score long")
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)  # each task passes on k rows of an item
    return ranked.select(F.col("item").alias(item), "rank", F.col("doc").alias(ident), "score")


def searched(index: ImpactIndex, hits: DataFrame, asked: DataFrame, k: int, schema: str) -> DataFrame | None:
    """Item, document and score of the top k of each block, for items whose terms and weights are at most about PAIRS."""
    rows = sorted(((r.item, bytes(r.term), r.weight) for r in asked.select("item", "term", "weight").collect()), key=lambda r: (r[0] is not None, r))
    if not rows:
        return None
    items = list(dict.fromkeys(r[0] for r in rows))
    number = {v: i for i, v in enumerate(items)}
    by_term: dict[bytes, list[tuple[int, int]]] = {}
    for i, term, weight in rows:
        by_term.setdefault(term, []).append((number[i], weight))
    shared = index.spark.sparkContext.broadcast((items, by_term))
    out = to_arrow_schema(_parse_datatype_string(schema))

    def work(own: pa.Table, block: pa.Table) -> pa.Table:
        items, by_term = shared.value
        names = own.column("term").to_pylist()
        use = [i for i, t in enumerate(names) if t in by_term]
        if not use:
            return out.empty_table()
        ids = block.column("ids").combine_chunks().flatten()
        places, bits = own.column("places").to_pylist(), own.column("slices").to_pylist()
        got = best_of_block(
            [names[i] for i in use], [np.frombuffer(places[i], "<u2").astype(np.int64) for i in use], [np.frombuffer(bits[i], np.uint8).reshape(-1, SLICES) for i in use],
            len(ids), [by_term[names[i]] for i in use], len(items), k,
        )
        chosen = pa.array([items[i] for i in got[0].tolist()], out.field("item").type)
        return pa.table([chosen, ids.take(pa.array(got[1])), pa.array(got[2])], schema=out)

    return hits.groupBy("block").cogroup(index.blocks.groupBy("block")).applyInArrow(work, schema)
