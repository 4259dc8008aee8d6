"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every feature has a weight and a short vector; the model adds the weights and, for each pair of features, the
inner product of their vectors. The sum over pairs is had in linear time from the identity
sum_{i<j} <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i|^2 x_i^2) / 2.

Words are lower-cased and hashed into `BUCKETS`; statistics of the text's structure (shares of letters, digits and
signs, repetition of words and lines) and metadata (its size in bytes, words and lines) enter as one-hot bins.
The model is fitted on a bounded sample of labelled rows, at most `rows` of the smallest hashes of their ids and labels
with at most `size` bytes of text (`common.labelled_sample`); scoring covers all documents in batches. Labels, language,
source and id are no features.

Defined cases: null, empty and blank texts get the score of their structure features; an id that is labelled more
than once counts with each label; a null id is in no fold and learned from by no label; without labels every score is
0.5; repeated rows are returned each and learned from once; very long texts are whole; equal scores stay equal; an empty table
gives no rows; other columns are not read, whatever their names.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fold_of, labelled_sample

BUCKETS, BINS, RANK = 1 << 14, 24, 8
N_STATS = 14


class WordBuckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[word] = b = xxhash.xxh3_64_intdigest(word) % BUCKETS
        return b


_buckets = WordBuckets()
_KINDS = np.zeros((256, 6), np.int64)
_KINDS[[*range(65, 91)], 0] = 1
_KINDS[[*range(48, 58)], 1] = 1
_KINDS[[33, 63], 2] = 1
_KINDS[[c for c in range(33, 127) if not chr(c).isalnum() and c not in b".,!?'-;:"], 3] = 1
_KINDS[[9, 10, 11, 12, 13, 32], 4] = 1
_KINDS[range(128, 256), 5] = 1


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and values of a text's features: words (of unit length together), then the bins of its statistics."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.lower().split()
    n = len(words)
    ids, counts = np.unique(np.fromiter(map(_buckets.__getitem__, words), np.int64, n), return_counts=True)
    value = np.sqrt(counts)
    size = max(len(raw), 1)
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KINDS
    lines = raw.split(b"\n")
    distinct = len(set(words))
    shares = np.array([*(kinds / size), distinct / max(n, 1), counts.max() / n if n else 0, len(set(lines)) / len(lines), sum(len(w) > 14 for w in words) / max(n, 1), (len(raw) - kinds[4]) / max(n, 1) / 24])
    logs = np.log2([size, n + 1, len(lines)])
    bins = np.minimum(np.concatenate([np.sqrt(np.minimum(shares, 1)) * 16, logs]).astype(np.int64), BINS - 1)
    stats = BUCKETS + np.arange(N_STATS) * BINS + bins
    if n:
        value = value / np.sqrt((value * value).sum())
    return np.concatenate([ids, stats]), np.concatenate([value, np.full(N_STATS, 0.5)]).astype(np.float32)


class FactorisationMachine:
    """Weights, vectors and bias; fitted by AdaGrad on log loss."""

    def __init__(self, n: int = BUCKETS + N_STATS * BINS, rank: int = RANK, seed: int = 5):
        self.bias, self.w = 0.0, np.zeros(n, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.03, (n, rank)).astype(np.float32)

    def raw(self, ids: np.ndarray, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic function, and the sums of vectors, of documents whose features start at `first`."""
        vx = self.v[ids] * x[:, None]
        total = np.add.reduceat(vx, first)
        squares = np.add.reduceat(np.einsum("ij,ij->i", vx, vx), first)
        return self.bias + np.add.reduceat(self.w[ids] * x, first) + 0.5 * ((total * total).sum(1) - squares), total

    def score(self, ids: np.ndarray, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(ids, x, first)[0].astype(np.float64), -30, 30)))

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.1, decay: float = 1e-4, seed: int = 9) -> "FactorisationMachine":
        share = (y.sum() + 1) / (len(y) + 2)
        self.bias = float(np.log(share / (1 - share)))
        seen_w, seen_v = np.full(len(self.w), 1e-6, np.float32), np.full(self.v.shape, 1e-6, np.float32)
        rnd = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rnd.permutation(len(docs))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                ids, x = (np.concatenate([docs[i][k] for i in part]) for k in (0, 1))
                sizes = np.array([len(docs[i][0]) for i in part])
                z, total = self.raw(ids, x, np.r_[0, np.cumsum(sizes)[:-1]])
                off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]).astype(np.float32) / len(part)
                g = np.repeat(off, sizes) * x
                self.bias -= rate * float(off.sum())
                each, where = np.unique(ids, return_inverse=True)
                gw = np.bincount(where, g, len(each)).astype(np.float32) + decay * self.w[each]
                seen_w[each] += gw * gw
                gv = g[:, None] * (np.repeat(total, sizes, 0) - self.v[ids] * x[:, None])
                gv = np.stack([np.bincount(where, gv[:, k], len(each)) for k in range(gv.shape[1])], 1).astype(np.float32) + decay * self.v[each]
                seen_v[each] += gv * gv
                self.w[each] -= rate * gw / np.sqrt(seen_w[each])
                self.v[each] -= 0.3 * rate * gv / np.sqrt(seen_v[each])
        return self


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 4000, size: int = 32_000_000, ident: str = "doc_id", text: str = "text") -> FactorisationMachine | None:
    """A model from at most `rows` labelled rows and `size` bytes of their texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t) for t in b.column(0).to_pylist()]
            yield pa.record_batch([b.column(1), pa.array([i.astype(np.int32) for i, _ in got], pa.list_(pa.int32())), pa.array([x for _, x in got], pa.list_(pa.float32()))], names=["y", "ids", "x"])

    chosen = labelled_sample(docs, labels, label, rows, size, ident, text).select("text", "y")
    sample = chosen.mapInArrow(work, "y double, ids array<int>, x array<float>").toArrow()
    if not sample.num_rows:
        return None
    values = lambda name, kind: [np.asarray(c.values, kind) for c in sample.column(name)]
    found = list(zip(values("ids", np.int64), values("x", np.float32), sample.column("y").to_pylist(), strict=True))
    found.sort(key=lambda f: (f[2], f[0].tobytes(), f[1].tobytes()))  # neither order nor parts of the tables matter
    return FactorisationMachine().fit([f[:2] for f in found], np.array([f[2] for f in found]))


def score(docs: DataFrame, model: FactorisationMachine | None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id and score. The model's size is fixed by BUCKETS, BINS and RANK."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            texts = b.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                got = [features(t) for t in texts[at : at + 256]]
                if shared.value is None:
                    out += [0.5] * len(got)
                    continue
                first = np.cumsum([0, *(len(i) for i, _ in got[:-1])])
                out += shared.value.score(np.concatenate([i for i, _ in got]), np.concatenate([x for _, x in got]), first).tolist()
            yield pa.record_batch([b.column(0), pa.array(out, pa.float64())], names=[ident, "score"])

    return docs.select(F.col(ident), F.col(text)).mapInArrow(work, f"{ident} {docs.schema[ident].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, ident: str = "doc_id") -> DataFrame:
    """Scores of all documents, learned from the labels outside the held-out fold."""
    model = fit(docs, labels.where(fold_of(ident, folds) != held), ident=ident)
    held_out = F.coalesce(fold_of(ident, folds) == held, F.lit(False)).alias("held_out")
    return score(docs, model, ident).select(ident, held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
