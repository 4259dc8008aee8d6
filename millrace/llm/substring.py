"""Substring deduplication with a log-structured fingerprint index.

Every window of `words` consecutive words belongs to the smallest hash of the word grams it holds. Consecutive
windows of the same smallest hash form a span; spans, a twentieth as many as words, are what is indexed. Equal
windows share their smallest hash, so windows can only recur under the same key.

Documents arrive in batches of ascending ids. Each batch becomes a sorted immutable run of (key, span digest,
smallest id); it is merge-joined with the earlier runs, which finds spans that recur whole and keys under which
other spans are known; runs are compacted tier by tier. An index can be kept in a folder and added to by later calls. What the joins leave open - windows
at the ends of shared passages, where spans differ - is verified window by window, on 128-bit digests of
their words, for one document of each class of equal spans only.

A window's words are removed if the same window starts in a document with a smaller id. Windows are judged on the
input. Defined cases: null, empty and blank texts have no words and keep the empty text; texts shorter than a
window lose nothing; repeats within one document stay; repeated rows of one id are one document, and if their texts
differ each loses what smaller ids have; rows without an id are kept whole. Other columns are not read, whatever
their names.
"""

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import remove, shared_folder, tidy, written

M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Odd bases of the two polynomial hashes, and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h + np.uint64(salt)
    h = (h ^ (h >> np.uint64(33))) * M1
    h = (h ^ (h >> np.uint64(29))) * M2
    return h ^ (h >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class WordHashes(dict):
    """A cache of the hashes of words, bounded in entries and, as long words aren't kept, in bytes."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 32:
            if len(self) >= 150_000:
                self.clear()
            self[word] = h
        return h


_hashes = WordHashes()


class Hashed:
    """A text's words with prefix sums, from which the digest of any run of words follows."""

    def __init__(self, text: str | None):
        self.words = (text or "").encode("utf-8", "surrogatepass").split()
        self.n = len(self.words)
        self.ids = np.fromiter(map(_hashes.__getitem__, self.words), np.uint64, self.n)
        self.sums: list[tuple[np.ndarray, np.ndarray]] = []

    def digests(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit digests of the words from start to end, whose number enters them too."""
        if not self.sums:
            for salt, (base, inverse) in enumerate(zip(BASES, INVERSES, strict=True), 1):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(self.ids, salt) * powers(base, self.n))])
                self.sums.append((total, powers(inverse, self.n)))
        size = (end - start).astype(np.uint64)
        return tuple(mixed((s[end] - s[start]) * back[start], 77) ^ mixed(size) for s, back in self.sums)

    def spans(self, words: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans of windows with the same smallest gram hash: key, first window, number of windows."""
        n = self.n - words + 1
        if n < 1:
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none, none
        at = np.arange(self.n - gram + 1)
        low, _ = self.digests(at, at + gram)
        wide, size = 1, words - gram + 1
        while wide * 2 <= size:
            low = np.minimum(low[:-wide], low[wide:])
            wide *= 2
        if rest := size - wide:
            low = np.minimum(low[:-rest], low[rest:])
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        return low[first], first, np.diff(np.r_[first, n])


def signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def span_rows(docs: DataFrame, words: int, gram: int) -> DataFrame:
    """A row for each span: id, digest of the text, batch, key, two digests, first window, number of windows."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "version", "batch", "key", "s1", "s2", "pos", "n"]
        for batch in batches:
            out = [[] for _ in names]
            for ident, version, part, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = Hashed(text)
                key, first, n = h.spans(words, gram)
                if not len(key):
                    continue
                s1, s2 = h.digests(first, first + n + words - 1)
                for to, x in zip(out, (np.full(len(key), ident), np.full(len(key), version), np.full(len(key), part, np.int32), key.view(np.int64), s1.view(np.int64), s2.view(np.int64), first.astype(np.int32), n.astype(np.int32)), strict=True):
                    to.append(x)
            if out[0]:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in out], names=names)

    return docs.select("doc_id", "version", "batch", "text").mapInArrow(work, "doc_id long, version long, batch int, key long, s1 long, s2 long, pos int, n int")


class FingerprintIndex:
    """Sorted immutable runs of (key, s1, s2, least): the smallest id in which each span has been seen.

    `fan_in` runs of a tier are merged into one of the next tier, so each entry is rewritten about log n times. An index
    of a named folder is kept: its entries also tell where in which text of `least` the span stands (version, pos, n), and
    the texts are kept beside the runs, as windows can only be verified on them. Folders count once Spark has
    committed them; a batch or a merge that died half way can be repeated.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fan_in: int = 4):
        self.spark, self.fan_in, self.kept = spark, fan_in, folder is not None
        self.folder = (folder or shared_folder(spark)).rstrip("/")
        place = ", version long, pos int, n int" if self.kept else ""
        self.schema = f"key long, s1 long, s2 long, least long{place}"
        self.runs, self.texts = self.committed("run-"), self.committed("texts-")

    def committed(self, prefix: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not self.kept or not fs.exists(path):
            return []
        found = sorted(s.getPath().getName() for s in fs.listStatus(path))
        done = [n for n in found if n.startswith(prefix) and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]
        return [f"{self.folder}/{n}" for n in done]

    def rows(self) -> DataFrame:
        """All entries; a span is in several runs only if a later one has a smaller id, or a merge died half way."""
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*self.runs) if self.runs else self.spark.createDataFrame([], self.schema)

    def least(self, entries: DataFrame) -> DataFrame:
        """One entry for each span, that of the smallest id."""
        if not self.kept:
            return entries.groupBy("key", "s1", "s2").agg(F.min("least").alias("least"))
        best = F.min(F.struct("least", "version", "pos", "n")).alias("b")
        return entries.groupBy("key", "s1", "s2").agg(best).select("key", "s1", "s2", "b.*")

    def write_run(self, entries: DataFrame, tier: int) -> str:
        path = f"{self.folder}/run-{tier}-{uuid.uuid4().hex}"
        entries.repartition("key", "s1").sortWithinPartitions("key", "s1", "s2").write.parquet(path)  # the spans of a hot key are many files
        return path

    def keep_texts(self, docs: DataFrame) -> None:
        path = f"{self.folder}/texts-{uuid.uuid4().hex}"
        docs.select("doc_id", "version", "text").where("text is not null").write.option("compression", "zstd").parquet(path)
        self.texts.append(path)

    def merge(self, spans: DataFrame) -> DataFrame | None:
        """Add a batch as a run; returns the keys of its spans that earlier runs have with other spans."""
        self.compact()
        fresh = self.least(spans.withColumnRenamed("doc_id", "least").select(*(c.split()[0] for c in self.schema.split(", "))))
        if not self.runs:
            self.runs.append(self.write_run(fresh, 0))
            return None
        seen = self.rows().select("key", "s1", "s2", F.col("least").alias("before")).hint("merge")
        same = [fresh[c] == seen[c] for c in ("key", "s1", "s2")]
        path = shared_folder(self.spark)
        new = written(fresh.join(seen, [*same, seen["before"] <= fresh["least"]], "left_anti"), path)
        if self.kept:  # a batch that is given again has no new spans, but the same keys to look under
            known = self.rows().groupBy("key").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("s1", "s2") for f in (F.min, F.max))).hint("merge")
            open_keys = fresh.join(known, "key").where("s1 <> min_s1 or s1 <> max_s1 or s2 <> min_s2 or s2 <> max_s2")
        else:
            open_keys = new.join(seen.select("key").hint("merge"), "key", "left_semi")
        open_keys = written(open_keys.select("key").distinct())
        self.runs.append(self.write_run(new, 0))
        remove(self.spark, path)
        return open_keys

    def compact(self) -> None:
        """Merge the runs of each tier that has `fan_in` of them."""
        tier_of = lambda path: int(path.rpartition("/")[2].split("-")[1])
        while full := [t for t, n in Counter(map(tier_of, self.runs)).items() if n >= self.fan_in]:
            old = [r for r in self.runs if tier_of(r) == min(full)]
            merged = self.write_run(self.least(self.spark.read.schema(self.schema).parquet(*old)), min(full) + 1)
            for path in old:
                remove(self.spark, path)
            self.runs = [r for r in self.runs if r not in old] + [merged]


def plain(docs: DataFrame, ident: str, text: str) -> DataFrame:
    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("version", F.xxhash64("text"))


def windows_at(rows: DataFrame, words: int) -> DataFrame:
    """A row for each distinct window in the spans listed with each text: its two digests, id and starts."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, version, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.unique(np.concatenate([np.arange(s["pos"], s["pos"] + s["n"]) for s in spans]))
                w1, w2 = Hashed(text).digests(at, at + words)
                order = np.lexsort((w2, w1))
                w1, w2 = w1[order], w2[order]
                first = np.flatnonzero(np.r_[True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])
                starts = pa.ListArray.from_arrays(pa.array(np.r_[first, len(at)].astype(np.int32)), pa.array(at[order].astype(np.int32)))
                yield pa.record_batch([signed(w1[first]), signed(w2[first]), pa.array(np.full(len(first), ident)), pa.array(np.full(len(first), version)), starts], names=["w1", "w2", "doc_id", "version", "starts"])

    return rows.select("doc_id", "version", "text", "spans").mapInArrow(work, "w1 long, w2 long, doc_id long, version long, starts array<int>")


def removals(docs: DataFrame, words: int = 50, gram: int = 8, batches: int = 3, index: FingerprintIndex | None = None) -> DataFrame:
    """Per text that loses something: doc_id, version and cuts, its runs of recurring windows (start, number of windows).

    docs: doc_id long, version (digest of the text) and text; only rows with an id are looked at. With an index that is
    kept, docs are its next batch.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null")
    past = None
    if index:
        batches = 1
        index.compact()
        past, texts = index.rows() if index.runs else None, list(index.texts)
        index.keep_texts(docs)
    ends = docs.selectExpr(f"percentile_approx(doc_id, array({','.join(str(i / batches) for i in range(1, batches))}), 1000) AS e").first().e if batches > 1 else []
    batch = sum(((F.col("doc_id") > e).cast("int") for e in ends or []), F.lit(0))
    path = shared_folder(spark)
    span_rows(docs.withColumn("batch", batch), words, gram).write.partitionBy("batch").parquet(path)
    spans = spark.read.schema("doc_id long, version long, key long, s1 long, s2 long, pos int, n int, batch int").parquet(path)

    runs = index or FingerprintIndex(spark, fan_in=2)
    found = [keys for k in range(batches) if (keys := runs.merge(spans.where(F.col("batch") == k))) is not None]
    # spans of one batch can differ under a key as well
    within = spans.groupBy("batch", "key").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi"), F.min("s2").alias("lo2"), F.max("s2").alias("hi2")).where("lo < hi or lo2 < hi2").select("key")
    open_keys = reduce(DataFrame.unionByName, found, within).distinct().withColumn("open", F.lit(True))
    marked = runs.least(runs.rows()).select("key", "s1", "s2", "least").join(open_keys, "key", "left")

    listed = spans.join(marked, ["key", "s1", "s2"]).where("doc_id > least or open").groupBy("doc_id", "version").agg(
        F.collect_set(F.when(F.col("doc_id") > F.col("least"), F.struct("pos", "n"))).alias("whole"),
        F.collect_set(F.when(F.col("doc_id") == F.col("least"), F.struct("pos", "n"))).alias("spans"),
    )
    listed = written(listed)
    for done in (path,) if index else (path, runs.folder):
        remove(spark, done)
    # one document of each class of equal spans stands for all; in the others every window of them recurs
    windows = written(windows_at(docs.join(listed.where("size(spans) > 0").select("doc_id", "version", "spans"), ["doc_id", "version"]), words))
    met = windows.select("w1", "w2", "doc_id")
    if past is not None:  # the same for the documents of earlier batches
        earlier = index.least(past.join(reduce(DataFrame.unionByName, found).distinct(), "key", "left_semi"))
        earlier = earlier.groupBy(F.col("least").alias("doc_id"), "version").agg(F.collect_set(F.struct("pos", "n")).alias("spans"))
        stored = spark.read.schema("doc_id long, version long, text string").parquet(*texts)
        met = met.unionByName(written(windows_at(stored.join(earlier, ["doc_id", "version"]), words).select("w1", "w2", "doc_id")))
    least = met.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    cut = windows.join(least, ["w1", "w2"]).where("doc_id > least").groupBy("doc_id", "version").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    cut = cut.select("doc_id", "version", F.transform("starts", lambda x: F.struct(x.alias("pos"), F.lit(1).alias("n"))).alias("single"))
    return listed.select("doc_id", "version", "whole").join(cut, ["doc_id", "version"], "left").select("doc_id", "version", F.concat("whole", F.coalesce("single", F.array().cast("array<struct<pos:int,n:int>>"))).alias("cuts")).where("size(cuts) > 0")


def cut_rows(docs: DataFrame, keep: tuple[str, ...] = (), words: int = 50, gram: int = 8, batches: int = 3, ident: str = "doc_id", text: str = "text", texts: bool = True, index: FingerprintIndex | None = None) -> DataFrame:
    """Per row: the columns in keep as column_0 and so on, whatever their names; then doc_id_, n_words, n_removed,
    kept_sha256 and kept_text."""
    cuts = removals(plain(docs, ident, text), words, gram, batches, index)
    made = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, digest, kept = [], [], [], []
            n = batch.num_columns - 2
            for value, spans in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                split = (value or "").encode("utf-8", "surrogatepass").split()
                total.append(len(split))
                if spans:
                    edge = np.zeros(len(split) + 1, np.int32)
                    for s in spans:
                        edge[s["pos"]] += 1
                        edge[s["pos"] + s["n"] + words - 1] -= 1
                    split = [split[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                gone.append(total[-1] - len(split))
                joined = b" ".join(split)
                digest.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode("utf-8", "surrogatepass") if texts else None)
            own = [pa.array(c, f.type) for c, f in zip((total, gone, digest, kept), made, strict=True)]
            yield pa.record_batch([*batch.columns[:n], *own], names=[*batch.schema.names[:n], *made.names])

    cuts = cuts.select(F.col("doc_id").alias("cut_id_"), F.col("version").alias("cut_version_"), F.col("cuts").alias("cuts_"))
    ids, value = docs[ident].cast("long"), docs[text].cast("string")
    joined = docs.join(cuts, (ids == F.col("cut_id_")) & (F.xxhash64(value) == F.col("cut_version_")), "left").select(*(docs[c].alias(f"column_{i}") for i, c in enumerate(keep)), ids.alias("doc_id_"), value.alias("text_"), "cuts_")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in joined.schema[: len(keep) + 1])
    return joined.mapInArrow(work, schema + "n_words long, n_removed long, kept_sha256 string, kept_text string")


def substring_dedup(docs: DataFrame, words: int = 50, gram: int = 8, batches: int = 3, ident: str = "doc_id", text: str = "text", texts: bool = True, index: FingerprintIndex | None = None) -> DataFrame:
    """Per document: id, n_words, n_removed, kept_sha256 and, if asked for, kept_text (kept words joined by one space).

    With an index of a named folder, docs are its next batch, with the same words and gram as those before: they are held
    against all that it has seen as well, and stay in it. If ids ascend from call to call, the calls give what one
    call on all documents gives; a batch that is given again gets the same answer.
    """
    out = cut_rows(docs, (), words, gram, batches, ident, text, texts, index)
    return (out if texts else out.drop("kept_text")).withColumnRenamed("doc_id_", ident)
