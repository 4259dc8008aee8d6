"""Language-model scores by context-tree weighting, beside a smoothed unigram base.

A text is its words, lower-cased (A-Z), joined by one space, and an end byte. Each byte is eight binary decisions;
every decision has a tree over the preceding bytes, up to `DEPTH` of them. A node estimates its bit by
Krichevsky and Trofimov's rule from the training counts; the weighted probability of a node is the mean of its own
estimate's and the product of its children's, so all depths are mixed. What the finished trees predict for
the next byte after each context gives the log-probability of whole texts, and their code length per byte.

Texts are first written as blocks of at most `BLOCK` bytes. Each block gathers the words and byte strings that it
holds, with their counts in training texts; these are summed over blocks by shuffles. The two deepest levels of the trees
are computed over streams of strings sorted by context, of which only strings with the same last four bytes of context
(65,536 at most) must be in memory together; the levels above are aggregates of columns. Each block gets back the
totals and predictions for just what it holds, and scores its texts frame by frame. Nothing that grows with
the corpus is broadcast or held by one task; what is broadcast are the 65,280 nodes of contexts of one byte.

Words are counted under 63 bits of their XXH3 hash. A string's prediction is stored as a 32-bit float, which moves a
text's score by less than one part in ten million.

Defined cases: null, empty and blank texts are the end token and end byte alone; without training texts the base and
the trees fall back on their priors; repeated rows count each time; rows without an id learn; other columns are not read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fold_of, written

DEPTH = 5
#: Bytes of text in a block and in a frame, about; a longer text is a frame of its own.
BLOCK, FRAME = 48_000_000, 1_000_000
#: The code of the end token; words have other negative codes, strings positive ones.
END = -1


class WordCodes(dict):
    """A bounded cache of the codes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word) // 2 - (1 << 63)
        return h


_codes = WordCodes()


def strings(frame: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The code of each byte of the texts with the DEPTH bytes before it, zeros standing before a text's start; and
    where each text's codes end. frame: texts, each followed by a line feed."""
    raw = np.frombuffer(frame, np.uint8)
    code = raw.astype(np.int64)
    for k in range(1, DEPTH + 1):
        code[k:] |= raw[:-k].astype(np.int64) << (8 * k)
    ends = np.flatnonzero(raw == 10) + 1
    first, size = np.r_[0, ends[:-1]], np.diff(ends, prepend=0)
    for k in range(DEPTH):
        code[first[size > k] + k] &= (1 << (8 * k + 8)) - 1
    return code, ends


def words(frame: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all words of a frame's texts, and the number of words of each text."""
    found = frame.split()
    sizes = np.fromiter((t.count(b" ") + 1 if t else 0 for t in frame[:-1].split(b"\n")), np.int64)
    return np.fromiter(map(_codes.__getitem__, found), np.int64, len(found)), sizes


def unique(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code = np.sort(code)
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    return code[first], np.diff(np.r_[first, len(code)])


class Counts:
    """Codes with their counts in training texts; of others the codes alone, with count zero."""

    def __init__(self):
        self.raw: dict[bool, list[np.ndarray]] = {True: [], False: []}
        self.size, self.done = 0, [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def add(self, code: np.ndarray, learn: np.ndarray) -> None:
        self.raw[True].append(code[learn])
        self.raw[False].append(code[~learn])
        self.size += len(code)
        if self.size >= 3_000_000:
            self.sort()

    def sort(self) -> None:
        for learn, parts in self.raw.items():
            if parts:
                code, n = unique(np.concatenate(parts))
                self.done.append((code, n if learn else np.zeros(len(n), np.int64)))
                parts.clear()
        self.size = 0
        if sum(len(c) for c, _ in self.done) >= 4_000_000:
            self.done = [self.merged()]

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        code, n = (np.concatenate(x) for x in zip(*self.done, strict=True))
        order = np.argsort(code)
        code, n = code[order], n[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        return code[first], np.add.reduceat(n, first) if len(first) else n

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        self.sort()
        return self.merged()


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 1/2: eight steps up, then Stirling's series."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    product = x.copy()
    for k in range(1, 8):
        product *= x + k
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(product)


class Level:
    """Nodes of one depth: their counts, the weight of their own estimate, and their weighted probability."""

    def __init__(self, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.zeros, self.ones = zeros, ones
        both = zeros + ones
        own = log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(both + 1) - np.log(np.pi)
        #: Krichevsky and Trofimov's probability of a one, next.
        self.one = (ones + 0.5) / (both + 1)
        if below is None:
            self.weight, self.log = np.ones(len(own)), own
        else:
            self.weight, self.log = 1 / (1 + np.exp(np.minimum(below - own, 700))), np.logaddexp(own, below) - np.log(2)


def log_gamma_of(x: Column) -> Column:
    """`log_gamma` of a column."""
    y = x + 8
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + float(0.5 * np.log(2 * np.pi)) + series - F.log(product)


def level_above(nodes: DataFrame, depth: int) -> DataFrame:
    """The nodes of a depth from those below it. nodes: key, zeros, ones, log; the result has one and weight, too."""
    own_key = F.col("key").bitwiseAND(F.lit((1 << (8 * depth + 8)) - 1))
    sums = nodes.groupBy(own_key.alias("key")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log").alias("below"))
    own = log_gamma_of(F.col("zeros") + 0.5) + log_gamma_of(F.col("ones") + 0.5) - log_gamma_of(F.col("zeros") + F.col("ones") + 1) - float(np.log(np.pi))
    sums = sums.withColumn("own", own).withColumn("gap", F.col("below") - F.col("own"))
    mixed = F.greatest("own", "below") + F.log1p(F.exp(-F.abs("gap"))) - float(np.log(2))
    one = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
    return sums.select("key", "zeros", "ones", mixed.alias("log"), one.alias("one"), (1 / (1 + F.exp(F.least("gap", F.lit(700.0))))).alias("weight"))


def decisions(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight decisions of each string's last byte: node of the byte's tree, and bit."""
    k = np.arange(8)
    last = (code & 255)[:, None]
    return (1 << k) + (last >> (8 - k)), (last >> (7 - k)) & 1


def subtree(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, Level]:
    """For all strings with certain last bytes of their contexts: how likely the nodes of the two deepest levels find a
    one at each of the last byte's decisions; and the nodes of the upper one of these levels."""
    node, bit = decisions(code)
    key, leaf = np.unique(((code >> 8)[:, None] << 8 | node).reshape(-1), return_inverse=True)
    count = np.repeat(n, 8)
    ones = np.bincount(leaf, count * bit.reshape(-1), len(key))
    level = Level(np.bincount(leaf, count, len(key)) - ones, ones, None)
    q = level.one
    key, up = np.unique(key & ((1 << (8 * DEPTH)) - 1), return_inverse=True)
    level = Level(*(np.bincount(up, x, len(key)) for x in (level.zeros, level.ones, level.log)))
    q = level.weight[up] * level.one[up] + (1 - level.weight[up]) * q
    return q[leaf].reshape(-1, 8), key, level


def deepest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings with their eight probabilities, and nodes of depth DEPTH - 1. Rows (ctx, code, n) are sorted by ctx."""

    def done(ctx: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        q, key, level = subtree(code, n)
        m, k = len(code), len(key)
        pad = lambda x, before, after: pa.array(np.concatenate([np.zeros(before, x.dtype), x, np.zeros(after, x.dtype)]))
        size = np.r_[0, np.cumsum(np.r_[np.full(m, 8), np.zeros(k, int)])].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(size), pa.array(q.reshape(-1).astype(np.float32)))
        return pa.record_batch([pad(code, 0, k), lists, pad(key, m, 0), pad(level.zeros, m, 0), pad(level.ones, m, 0), pad(level.log, m, 0)], names=["code", "q", "key", "zeros", "ones", "log"])

    rest = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        rest = [np.concatenate([a, np.asarray(c, np.int64)]) for a, c in zip(rest, batch.columns, strict=True)]
        if len(rest[0]) >= 40_000:
            cut = np.searchsorted(rest[0], rest[0][-1])  # the last context may go on
            if cut:
                yield done(*(x[:cut] for x in rest))
                rest = [x[cut:] for x in rest]
    if len(rest[0]):
        yield done(*rest)


def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The log10 probabilities of strings. Rows (ctx, code, q, key, a, b) are sorted by ctx; the nodes of a context, which
    turn q into a + b * q, stand before its strings."""
    key, a, b = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        is_node = rows.column("code").is_null()
        nodes, found = rows.filter(is_node), rows.filter(rows.column("code").is_valid())
        own = np.asarray(nodes.column("key"), np.int64)
        order = np.argsort(own)
        key, a, b = (np.concatenate([x, np.asarray(nodes.column(c))[order]]) for x, c in ((key, "key"), (a, "a"), (b, "b")))
        if found.num_rows:
            code = np.asarray(found.column("code"), np.int64)
            node, bit = decisions(code)
            sort = np.argsort(key)
            key, a, b = key[sort], a[sort], b[sort]
            at = np.searchsorted(key, (code >> 8 & 0xFFFFFF)[:, None] << 8 | node)
            q = a[at] + b[at] * np.asarray(pa.chunked_array(found.column("q").chunks).combine_chunks().flatten(), np.float64).reshape(-1, 8)
            yield pa.record_batch([pa.array(code), pa.array(np.log10(np.where(bit == 1, q, 1 - q)).sum(1))], names=["code", "value"])
        last = np.asarray(rows.column("ctx"), np.int64)[-1:]
        if len(last):
            keep = key >> 8 == last[0]
            key, a, b = key[keep], a[keep], b[keep]


def predictions(codes: DataFrame) -> DataFrame:
    """Per string: the log10 probability of its last byte after the others. codes: code, n (training count, 0 allowed)."""
    spark = codes.sparkSession
    ctx = F.shiftright("code", 8).bitwiseAND(F.lit((1 << (8 * DEPTH - 8)) - 1)).alias("ctx")
    sorted_codes = codes.select(ctx, "code", "n").repartition("ctx").sortWithinPartitions("ctx")
    found = written(sorted_codes.mapInArrow(deepest, "code long, q array<float>, key long, zeros double, ones double, log double"))
    three = written(level_above(found.where("size(q) = 0"), 3))
    two = written(level_above(three, 2))
    # contexts of one byte and of none: 256 times 255 nodes at most, whatever the corpus
    top = level_above(two, 1).toPandas().sort_values("key")
    key = top.key.to_numpy(np.int64)
    root_key, up = np.unique(key & 255, return_inverse=True)
    root = Level(*(np.bincount(up, top[c].to_numpy(np.float64), len(root_key)) for c in ("zeros", "ones", "log")))
    w0, w1 = root.weight[up], top.weight.to_numpy(np.float64)
    top = pa.table({"k1": key, "a1": w0 * root.one[up] + (1 - w0) * w1 * top.one.to_numpy(np.float64), "b1": (1 - w0) * (1 - w1)})
    top = spark.createDataFrame(top, "k1 long, a1 double, b1 double")
    # what the levels down to a node make of the estimate q below it: a + b * q
    step = lambda d: ((F.col(f"a{d}") + F.col(f"b{d}") * F.col("weight") * F.col("one")).alias(f"a{d + 1}"), (F.col(f"b{d}") * (1 - F.col("weight"))).alias(f"b{d + 1}"))
    above = lambda d: F.col("key").bitwiseAND(F.lit((1 << (8 * d + 8)) - 1)) == F.col(f"k{d}")
    two = two.join(F.broadcast(top), above(1)).select(F.col("key").alias("k2"), *step(1))
    three = three.join(two, above(2)).select("key", *step(2))
    nodes = three.select(F.shiftright("key", 8).alias("ctx"), F.lit(None).cast("long").alias("code"), F.lit(None).cast("array<float>").alias("q"), "key", F.col("a3").alias("a"), F.col("b3").alias("b"))
    mine = found.where("size(q) > 0").select(F.shiftright("code", 8).bitwiseAND(F.lit(0xFFFFFF)).alias("ctx"), "code", "q")
    both = nodes.unionByName(mine, allowMissingColumns=True).repartition("ctx").sortWithinPartitions("ctx", F.col("code").asc_nulls_first())
    return both.mapInArrow(finished, "code long, value double")


class Lookup:
    """Values of codes: a table of indices at hashed places, and a search for the few codes whose place is another's."""

    def __init__(self, code: np.ndarray, value: np.ndarray):
        order = np.argsort(code)
        self.code, self.value = code[order], value[order]
        self.shift = np.uint64(64 - max(4, int(np.ceil(np.log2(len(code) + 1))) + 2))
        self.index = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.index[self.place(self.code)] = np.arange(len(code), dtype=np.int32)

    def place(self, code: np.ndarray) -> np.ndarray:
        return (code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def __call__(self, code: np.ndarray) -> np.ndarray:
        at = self.index[self.place(code)]
        missed = np.flatnonzero(self.code[at] != code)
        at[missed] = np.searchsorted(self.code, code[missed])
        return self.value[at]


def packed_texts(docs: DataFrame, held: Column, ident: str, text: str) -> DataFrame:
    """Rows of about FRAME bytes of text: block, ids, whether each is held out, and the compressed frame."""
    block_bytes, frame_bytes = BLOCK, FRAME

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3)
        block, size, texts, ids, held = TaskContext.get().partitionId() << 24, 0, [], [], []

        def row() -> pa.RecordBatch:
            frame = small.compress(b"\n".join(texts) + b"\n")
            one = lambda parts: pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), pa.concat_arrays(parts))
            out = pa.record_batch([pa.array([block]), one(ids), one(held), pa.array([frame], pa.binary())], names=["block", "ids", "held", "frame"])
            for x in (texts, ids, held):
                x.clear()
            return out

        now = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                got = [b" ".join((t or b"").lower().split()) for t in part.column(0).to_pylist()]
                texts += got
                ids.append(part.column(1))
                held.append(part.column(2))
                now += sum(map(len, got)) + len(got)
                if now >= frame_bytes:
                    yield row()
                    size, now = size + now, 0
                    if size >= block_bytes:
                        block, size = block + 1, 0
        if texts:
            yield row()

    rows = docs.select(F.col(text).cast("binary").alias("text"), F.col(ident).alias("id"), held.alias("held"))
    return written(rows.mapInArrow(pack, f"block long, ids array<{docs.schema[ident].dataType.simpleString()}>, held array<boolean>, frame binary"), compression="none")


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The codes of a block's words and strings, and their counts in training texts. Rows: block, held, frame."""
    open_frame = zstandard.ZstdDecompressor()
    block, count = None, Counts()

    def rows() -> Iterator[pa.RecordBatch]:
        code, n = count.all()
        for at in range(0, len(code), 100_000):
            c = code[at : at + 100_000]
            yield pa.record_batch([pa.array(np.full(len(c), block)), pa.array(c), pa.array(n[at : at + 100_000])], names=["block", "code", "n"])

    for batch in batches:
        for own, held, frame in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if own != block:
                if block is not None:
                    yield from rows()
                block, count = own, Counts()
            frame = open_frame.decompress(frame.as_py())
            learn = ~np.asarray(held.values.to_numpy(zero_copy_only=False), bool)
            code, ends = strings(frame)
            count.add(code, np.repeat(learn, np.diff(ends, prepend=0)))
            code, sizes = words(frame)
            count.add(code, np.repeat(learn, sizes))
            count.add(np.full(len(learn), END), learn)
    if block is not None:
        yield from rows()


def bundled(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Rows of block, code and value, about `most` at a time, as one row a block: differences of its sorted codes,
    compressed, and their values; strings, whose codes are positive, have 32-bit values."""
    small = zstandard.ZstdCompressor(level=1)
    parts: list[list[np.ndarray]] = []

    def rows() -> Iterator[pa.RecordBatch]:
        block, code, value = (np.concatenate(c) for c in zip(*parts, strict=True))
        parts.clear()
        order = np.lexsort((code, block))
        block, code, value = block[order], code[order], value[order]
        first = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | ((code[1:] < 0) != (code[:-1] < 0))])
        spans = [slice(a, b) for a, b in zip(first, [*first[1:], len(block)], strict=True)]
        codes = [small.compress(np.diff(code[x], prepend=0).tobytes()) for x in spans]
        values = [value[x].tobytes() if code[x.start] < 0 else value[x].astype(np.float32).tobytes() for x in spans]
        yield pa.record_batch([pa.array(block[first]), pa.array(codes, pa.binary()), pa.array(values, pa.binary())], names=["block", "codes", "values"])

    for batch in batches:
        parts.append([np.asarray(c) for c in batch.columns])
        if sum(len(x[0]) for x in parts) >= most:
            yield from rows()
    if any(len(x[0]) for x in parts):
        yield from rows()


def scores(docs: DataFrame, folds: int = 5, held: int = 1, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte."""
    packs = packed_texts(docs, F.coalesce(fold_of(ident, folds) == held, F.lit(False)), ident, text)
    held_by = written(packs.select("block", "held", "frame").mapInArrow(gathered, "block long, code long, n long"), compression="zstd")
    total = held_by.groupBy("code").agg(F.sum("n").alias("n"))
    counts = total.where("code < 0")
    seen = held_by.where("code < 0 and n > 0").agg(F.sum("n").alias("n")).first()
    n_all, v = seen.n or 0, counts.where("n > 0").count()
    values = counts.select("code", F.col("n").cast("double").alias("value")).unionByName(predictions(total.where("code >= 0")))
    told = held_by.select("block", "code").join(values, "code").select("block", "code", "value").mapInArrow(bundled, "block long, codes binary, values binary")
    kind = docs.schema[ident].dataType.simpleString()
    names = [ident, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_frame = zstandard.ZstdDecompressor()
        block, parts, tables = None, {True: [], False: []}, {}
        for batch in batches:
            for row in range(batch.num_rows):
                own, codes, values, ids, out, frame = (c[row] for c in batch.columns)
                if own.as_py() != block:  # what the block holds stands before its frames
                    block, parts, tables = own.as_py(), {True: [], False: []}, {}
                if codes.is_valid:
                    code = np.cumsum(np.frombuffer(open_frame.decompress(codes.as_py()), np.int64))
                    is_word = bool(code[0] < 0)
                    parts[is_word].append((code, np.frombuffer(values.as_py(), np.float64 if is_word else np.float32)))
                    continue
                if not tables:
                    tables = {k: Lookup(*map(np.concatenate, zip(*p, strict=True))) for k, p in parts.items()}
                    parts = {}
                raw = open_frame.decompress(frame.as_py())
                code, ends = strings(raw)
                sums = np.r_[0, np.cumsum(tables[False](code), dtype=np.float64)][ends]
                score = np.diff(sums, prepend=0)
                code, sizes = words(raw)
                n = np.r_[tables[True](code), tables[True](np.full(1, END))]
                logs = np.log10((n + 0.5) / (n_all + 0.5 * (v + 1)))
                at = np.r_[0, np.cumsum(sizes)]
                base = np.diff(np.r_[0, np.cumsum(logs[:-1])][at]) + logs[-1]
                known = np.diff(np.r_[0, np.cumsum(n[:-1] > 0)][at]) + int(n[-1] > 0)
                bits = -score * np.log2(10) / np.diff(ends, prepend=0)
                yield pa.record_batch([ids.values, out.values, pa.array(sizes + 1), pa.array(known.astype(np.int64)), pa.array(np.full(len(sizes), n_all)), pa.array(base), pa.array(score), pa.array(bits)], names=names)

    both = told.unionByName(packs, allowMissingColumns=True).select("block", "codes", "values", "ids", "held", "frame")
    both = both.repartition("block").sortWithinPartitions("block", F.col("frame").isNotNull())
    return both.mapInArrow(judge, f"{ident} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
