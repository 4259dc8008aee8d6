"""A toxicity classifier that is held to judge a sentence alike whichever group it names.

The score is logistic in the rates of words and word beginnings: a document's score before the logistic function is a bias
plus the mean, over its words, of the weights of the word and of its first letters. Weights are fitted by accelerated
proximal gradient on the log loss of labelled documents with an L1 penalty, which leaves few of them, and with a
counterfactual penalty: for every labelled sentence that names a group, terms of the same category are swapped in, and
the square of the change that this makes to the sentence's score is part of the loss. What labels say about a
group alone so goes, and what they say about the words beside it stays.

The fit sees at most `ROWS` labelled rows and `BYTES` bytes of their texts (`common.labelled_sample`); features must be in
`SUPPORT` of these. Scoring covers whole texts. Labels, language, source and id are no features.

Defined cases: null, empty and blank texts have no words and get the bias; without labels every score is 0.5; an id that
is labelled more than once counts with each label; a null id is in no fold and learned from by no label; repeated
rows are returned each; other columns are not read, whatever their names.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fold_of, labelled_sample

ROWS, BYTES, SUPPORT = 4_000, 32_000_000, 5
#: First letters of a word that are features, besides the word itself.
BEGINNINGS = range(3, 9)
#: A text of few words is judged as if it had so many more, of weight zero; a rate of 1 in `RATE` counts as 1.
PRIOR, RATE = 20, 50.0
#: Penalties: of a weight, of a change by a swap; and swaps tried for each term named.
L1, SWAP, SWAPS = 5e-4, 4.0, 3

# Terms for groups by category, in English, German, French and Spanish; those of a category replace each other.
IDENTITIES: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("gay", "lesbian", "straight", "bisexual", "homosexual", "heterosexual", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "atheists"),
    ("black", "white", "asian", "african", "european", "latino", "hispanic", "arab", "indigenous"),
    ("american", "mexican", "chinese", "indian", "russian", "german", "french", "spanish", "turkish", "polish", "nigerian"),
    ("immigrants", "natives", "refugees", "foreigners", "citizens"),
    ("deaf", "blind", "disabled", "paralyzed", "autistic"),
    ("old", "elderly", "young", "teenage"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("ausländer", "deutsche", "flüchtlinge", "einheimische", "türken", "polen"),
    ("schwule", "lesben", "heterosexuelle", "homosexuelle"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "bouddhistes", "athées"),
    ("immigrés", "étrangers", "réfugiés", "citoyens"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "budistas", "ateos"),
    ("inmigrantes", "extranjeros", "refugiados", "ciudadanos"),
)

#: ASCII signs part words.
_SIGNS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
#: Words of up to so many bytes, and so many of them, are kept at hand.
SHORT, HELD = 48, 200_000


def words(text: str | None) -> list[bytes]:
    """The lower-cased words, in UTF-8."""
    return (text or "").lower().encode("utf-8", "replace").translate(_SIGNS).split()


def features(word: bytes) -> list[int]:
    """Hashes of the word and of its beginnings."""
    letters = word[: 4 * BEGINNINGS[-1]].decode("utf-8", "ignore")
    parts = [b"^" + letters[:k].encode() for k in BEGINNINGS if len(letters) >= k]
    return [xxhash.xxh3_64_intdigest(p) >> 1 for p in (b"=" + word, *parts)]


def rates(counts: dict[int, int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and values of a text of n words."""
    return np.fromiter(counts.keys(), np.int64, len(counts)), np.fromiter(counts.values(), np.float64, len(counts)) * (RATE / (n + PRIOR))


def counted(own: list[bytes], held: dict[bytes, list[int]]) -> dict[int, int]:
    out: Counter[int] = Counter()
    for word, n in Counter(own).items():
        if word not in held:
            held[word] = features(word)
        for f in held[word]:
            out[f] += n
    return out


class Rows:
    """Sparse rows of (feature, value)."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.size = np.array([len(i) for i, _ in rows], np.int64)
        self.n = len(rows)
        self.owner = np.repeat(np.arange(self.n), self.size)
        self.ids = np.concatenate([np.zeros(0, np.int64), *(i for i, _ in rows)])
        self.values = np.concatenate([np.zeros(0), *(v for _, v in rows)])

    def among(self, known: np.ndarray) -> "Rows":
        """The same rows with places in `known`, which is sorted, as features; others are left out."""
        at = np.minimum(np.searchsorted(known, self.ids), max(len(known) - 1, 0))
        keep = known[at] == self.ids if len(known) else np.zeros(len(self.ids), bool)
        out = Rows([])
        out.n, out.owner, out.ids, out.values = self.n, self.owner[keep], at[keep], self.values[keep]
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.ids] * self.values, self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.ids, g[self.owner] * self.values, size)


def swaps(text: str, identities: tuple[tuple[str, ...], ...] = IDENTITIES, times: int = SWAPS) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """Sentences that name a group, as words, with another group of the category in its place."""
    others = {t.encode(): (c, i) for c, terms in enumerate(identities) for i, t in enumerate(terms)}
    for sentence in (text or "").replace("!", ".").replace("?", ".").replace("\n", ".").split("."):
        own = words(sentence)
        for word in dict.fromkeys(w for w in own if w in others):
            c, i = others[word]
            for step in range(1, min(times, len(identities[c]) - 1) + 1):
                other = identities[c][(i + step) % len(identities[c])].encode()
                yield own, [other if w == word else w for w in own]


class Model:
    """Features with a weight, in ascending order; their weights; and the bias."""

    def __init__(self, known: np.ndarray, weights: np.ndarray, bias: float):
        self.weights = dict(zip(known.tolist(), weights.tolist(), strict=True))
        self.bias = bias
        self.held: dict[bytes, float] = {}

    def weight(self, word: bytes) -> float:
        """The sum of the weights of a word and its beginnings."""
        w = self.held.get(word)
        if w is None:
            w = sum(self.weights.get(f, 0.0) for f in features(word))
            if len(word) <= SHORT:
                if len(self.held) >= HELD:
                    self.held.clear()
                self.held[word] = w
        return w

    def raw(self, text: str | None) -> float:
        own = words(text)
        return self.bias + sum(map(self.weight, own)) * (RATE / (len(own) + PRIOR))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(text), -30, 30))))


def fit_texts(texts: list[str | None], y: np.ndarray, identities: tuple[tuple[str, ...], ...] = IDENTITIES, l1: float = L1, swap: float = SWAP, support: int = SUPPORT, rounds: int = 200) -> Model:
    """A model of labelled texts, by accelerated proximal gradient; the order of the texts doesn't matter."""
    held: dict[bytes, list[int]] = {}
    rows, pairs = [], []
    for text in texts:
        own = words(text)
        rows.append(rates(counted(own, held), len(own)))
        if swap:
            for before, after in swaps(text, identities):
                change = Counter(counted(before, held))
                change.subtract(counted(after, held))
                pairs.append(rates({f: n for f, n in change.items() if n}, len(before)))
        if len(held) > HELD:
            held.clear()
    x = Rows(rows)
    each, n = np.unique(x.ids, return_counts=True)
    known = each[n >= support]
    x, d = x.among(known), Rows(pairs).among(known)
    k = len(known)
    share = (y.sum() + 0.5) / (len(y) + 1)
    w, b = np.zeros(k), float(np.log(share / (1 - share)))
    look_w, look_b, t = w.copy(), b, 1.0
    step = 64.0  # halved until the loss is below its bound

    def loss(w: np.ndarray, b: float) -> tuple[float, np.ndarray, np.ndarray]:
        z, change = x.dot(w) + b, d.dot(w) if d.n else np.zeros(0)
        value = np.logaddexp(0, z).mean() - (y * z).mean()
        return float(value + (swap * (change**2).mean() if d.n else 0.0)), z, change

    for _ in range(rounds):
        value, z, change = loss(look_w, look_b)
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        gw, gb = x.back(off, k), float(off.sum())
        if d.n:
            gw += d.back(2 * swap / d.n * change, k)
        while True:
            new = look_w - step * gw
            new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
            new_b = look_b - step * gb
            move, move_b = new - look_w, new_b - look_b
            if loss(new, new_b)[0] <= value + gw @ move + gb * move_b + (move @ move + move_b**2) / (2 * step) + 1e-12:
                break
            step /= 2
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look_w, look_b = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    some = w != 0
    return Model(known[some], w[some], b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = ROWS, size: int = BYTES, ident: str = "doc_id", text: str = "text", **options) -> Model | None:
    """A model from at most `rows` labelled rows and `size` bytes of text."""
    sample = labelled_sample(docs, labels, label, rows, size, ident, text).collect()
    sample = sorted((r.text or "", r.y) for r in sample)
    return fit_texts([t for t, _ in sample], np.array([y for _, y in sample], np.float64), **options) if sample else None


def score(docs: DataFrame, model: Model | None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ident and score. The model has at most as many features as the sample."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out = [0.5 if own is None else own.score(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.float64())], names=[ident, "score"])

    return docs.select(F.col(ident), F.col(text).cast("string")).mapInArrow(work, f"`{ident}` {docs.schema[ident].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, ident: str = "doc_id", **options) -> DataFrame:
    """Scores of all documents, learned from the labels outside the held-out fold."""
    model = fit(docs, labels.where(fold_of(ident, folds) != held), ident=ident, **options)
    held_out = F.coalesce(fold_of(ident, folds) == held, F.lit(False)).alias("held_out")
    return score(docs, model, ident).select(ident, held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
