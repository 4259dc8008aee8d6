"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton of a bounded sample of labelled text is built; it knows every
substring of that sample. A text is parsed greedily into the longest phrases that the automaton knows;
the language that needs the fewest phrases for the same text wins. Texts are seen as lower-cased bytes of
letters, with one separator for every run of anything else; a byte that a language's sample lacks is a phrase.

Each automaton is laid out as a dense table with, for every state and symbol, the next state and whether a
new phrase starts there, so that numpy walks all segments of a batch of whole texts at once. Segments of `SEGMENT`
symbols are parsed from a fresh start first; then each is parsed on from where the one before has ended, until
both parses are in one state at one place. So the phrases are those of the whole text.

What is learned is bounded, in documents and in bytes: texts of at most `per_language` labelled documents of each language,
taken in the order of hashes of their ids until they have `symbols` bytes; texts of over `longest` characters come last, and
of a text that is longer than `symbols` characters so many are learned. What is predicted is always the whole text.

Defined cases: texts that are null or have no letter get `und` with score 0; ties go to the language with
more labelled documents, then to the smaller name; without any labelled row everything is `und`; documents without an
id are learned from and not held out.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import fold_of, tidy

SEGMENT = 256
UNKNOWN = "und"


def letters_only(raw: bytes) -> np.ndarray:
    """Byte values with one 32 for each run of bytes that are no letters; bytes over 127 count as letters."""
    b = np.frombuffer(raw, np.uint8)
    b = np.where(((b >= 97) & (b <= 122)) | (b >= 128), b, np.uint8(32))
    return b[np.r_[True, (b[1:] != 32) | (b[:-1] != 32)]] if len(b) else b


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts all substrings; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return step


class Table:
    """A language's automaton, laid out for numpy."""

    def __init__(self, sample: bytes):
        seen = letters_only(sample)
        known = np.unique(seen)
        #: Symbol of each byte; the last symbol stands for bytes that the sample lacks.
        self.code = np.full(256, len(known), np.uint8)
        self.code[known] = np.arange(len(known))
        self.next = self.laid_out(suffix_automaton(self.code[seen].tolist()), len(known) + 1)

    @staticmethod
    def laid_out(step: list[dict[int, int]], w: int) -> np.ndarray:
        """For state * w + symbol: twice the next state's row, plus 1 where a new phrase starts."""
        start = np.array([step[0].get(c, 0) * w * 2 + 1 for c in range(w)], np.int32)
        out = np.tile(start, (len(step), 1))
        for s, to in enumerate(step):
            for c, t in to.items():
                out[s, c] = t * w * 2
        out[0] = start
        return out.reshape(-1)

    def phrases(self, columns: np.ndarray, size: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Phrases that start in each segment. columns: bytes by place and segment; size: of each segment;
        follows: whether it goes on from the one before."""
        columns = self.code[columns]
        state, trail, starts = np.zeros(len(size), np.int32), np.zeros(columns.shape, np.int32), np.zeros(columns.shape, bool)
        for i in range(len(columns)):  # symbols behind a segment's end are parsed, too, and not counted
            got = self.next[state + columns[i]]
            np.right_shift(got, 1, out=state)
            trail[i], starts[i] = state, got & 1
        last = size - 1
        each = np.arange(len(size))
        begun = np.where(follows, np.r_[0, trail[last, each][:-1]], 0)  # the state in which each segment begins
        parsed = np.zeros(len(size), np.int64)
        changed = np.flatnonzero(begun != parsed)
        while len(changed):
            parsed[changed] = begun[changed]
            on, state = changed, begun[changed].astype(np.int32)
            for i in range(len(columns)):
                got = self.next[state + columns[i, on]]
                state = got >> 1
                starts[i, on] = got & 1
                apart = state != trail[i, on]
                trail[i, on] = state
                on, state = on[apart], state[apart]
                if not len(on):
                    break
            begun = np.where(follows, np.r_[0, trail[last, each][:-1]], 0)
            changed = np.flatnonzero(begun != parsed)
        return (starts & (np.arange(len(columns))[:, None] < size)).sum(0)


class CrossParser:
    """Counts the phrases that texts need in each language's automaton."""

    def __init__(self, samples: dict[str, bytes]):
        self.langs = list(samples)
        self.tables = [Table(s) for s in samples.values()]
        #: Phrases per symbol that the texts of a language need in another half of its sample, about.
        self.usual = [self.own_rate(s) for s in samples.values()]

    @staticmethod
    def own_rate(sample: bytes) -> float:
        half = len(sample) // 2
        parts = [letters_only(sample[:half]), letters_only(sample[half:])]
        if not all(map(len, parts)):
            return 1.0
        size = np.array([len(parts[1])])
        return int(Table(sample[:half]).phrases(parts[1][:, None], size, np.array([False]))[0]) / len(parts[1])

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text (rows) in each language (columns), and the texts' symbols."""
        parts = [letters_only(t.lower().encode("utf-8", "replace")) for t in texts]
        sizes = np.array([len(p) for p in parts])
        lanes = -(-sizes // SEGMENT)
        total = np.zeros((len(texts), len(self.langs)), np.int64)
        if not lanes.sum():
            return total, sizes
        grid = np.zeros((int(lanes.sum()), SEGMENT), np.uint8)
        size, follows, at = np.full(len(grid), SEGMENT), np.ones(len(grid), bool), 0
        for p, n in zip(parts, lanes, strict=True):
            if n:
                grid[at : at + n].reshape(-1)[: len(p)] = p
                size[at + n - 1] = len(p) - (n - 1) * SEGMENT
                follows[at] = False
                at += n
        columns = np.ascontiguousarray(grid[:, : size.max()].T)
        owner = np.repeat(np.arange(len(texts)), lanes)
        for k, table in enumerate(self.tables):
            total[:, k] = np.bincount(owner, table.phrases(columns, size, follows), len(texts))
        return total, sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """The language that needs the fewest phrases, the share of the runner-up's in both counts, and how many times
        the phrases that are usual in that language the text needs."""
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        langs, scores, strange = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores, strange
        at = 0
        while at < len(known):  # parts of about half a million characters
            end, chars = at, 0
            while end < len(known) and (end == at or chars < 500_000):
                chars += len(texts[known[end]])
                end += 1
            part, at = known[at:end], end
            counts, sizes = self.phrases([texts[i] for i in part])
            best = counts.argmin(1)
            for row, i, b, size in zip(counts, part, best.tolist(), sizes.tolist(), strict=True):
                first, second = int(row[b]), int(np.partition(row, 1)[1]) if len(row) > 1 else 2 * int(row[b])
                langs[i], scores[i] = self.langs[b], second / max(first + second, 1)
                strange[i] = first / max(size * self.usual[b], 1.0)
        return langs, scores, strange


_parsers: dict[tuple, CrossParser] = {}


def labelled_samples(docs: DataFrame, ident: str = "doc_id", per_language: int = 32, symbols: int = 32_000, longest: int = 6_000) -> dict[str, bytes]:
    """A bounded sample of labelled text for each language, most documents first. No text of the held-out fold is in it."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    order = F.struct((F.length("text") > longest).cast("int").alias("long"), F.xxhash64(F.col(ident), F.lit(7)).alias("draw"), F.col(ident).alias("id"), F.xxhash64("text").alias("version"))
    # the best rows of each part of the table, then of all; only these have their texts read again
    first = learn.select("lang", order.alias("o"), F.octet_length("text").alias("size")).withColumn("part", F.spark_partition_id())
    rank = lambda *by: F.dense_rank().over(Window.partitionBy(*by).orderBy("o"))
    first = first.withColumn("r", rank("lang", "part")).where(F.col("r") <= per_language).select("lang", "o", "size").distinct()
    chosen = first.withColumn("r", rank("lang")).where(F.col("r") <= per_language)
    sizes = {r.lang: r["count"] for r in learn.groupBy("lang").count().collect()}
    if not sizes:
        return {}
    # each language's texts in turn while there is room; of one that is longer than that, as much as the room is
    fits = chosen.withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy("lang").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < symbols)
    part = F.substring("text", 1, symbols)
    rows = learn.select("lang", order.alias("o"), part.alias("text")).join(F.broadcast(fits.select("lang", "o", "r")), ["lang", "o"]).dropDuplicates(["lang", "o"]).collect()
    found: dict[str, bytes] = {}
    for lang in sorted(sizes, key=lambda x: (-sizes[x], x)):
        texts = [r.text.lower().encode("utf-8", "replace") for r in sorted((r for r in rows if r.lang == lang), key=lambda r: r.r)]
        found[lang] = b" ".join(texts)[: 2 * symbols]
    return found


def identify(docs: DataFrame, samples: dict[str, bytes], ident: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: id, the columns to keep, lang_pred, score, and strangeness: the phrases that the text needs over those
    usual for its length in that language; it is about 1 for texts of the language, and over 1.5 for no language at all."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tuple(samples.items()))  # about `symbols` bytes a language

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        if own not in _parsers:
            _parsers.clear()
            _parsers[own] = CrossParser(dict(own))
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                langs, *numbers = _parsers[own].predict(batch.column(0).to_pylist())
                same = batch.columns[:1] if text in keep else []
                yield pa.record_batch([*batch.columns[1:], *same, pa.array(langs, pa.string()), *(pa.array(x, pa.float64()) for x in numbers)], names=names)

    chosen = docs.select(F.col(text).alias("text_"), ident, *(k for k in keep if k != text))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:]] + ([f"`{text}` string"] if text in keep else [])
    names = [*chosen.columns[1:], *([text] if text in keep else []), "lang_pred", "score", "strangeness"]
    return chosen.mapInArrow(work, ", ".join([*kinds, "lang_pred string", "score double", "strangeness double"]))


def language_id(docs: DataFrame, folds: int = 4, held: int = 2, ident: str = "doc_id") -> DataFrame:
    """Predictions for all documents, learned from those outside the held-out fold."""
    held_out = F.coalesce(fold_of(ident, folds) == held, F.lit(False))
    samples = labelled_samples(docs.where(~held_out), ident)
    return identify(docs, samples, ident).select(ident, held_out.alias("held_out"), "lang_pred", "score")
