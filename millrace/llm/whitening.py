"""Whitening of embeddings by the eigenvectors of their exact covariance.

Entries become whole numbers, x = floor(64 * c) + 1,000,000, so that sums over any number of rows are exact. The fit list
has each distinct vector once. Its rows are centred exactly - (n * x - S) / n, with the sums S of all dimensions - and
are a `RowMatrix`, whose Gramian over n is the covariance; that matrix of dimensions alone is decomposed locally. The
components over the roots of their eigenvalues go to the tasks, which whiten rows in batches.

Defined cases: vectors that are null, hold null, NaN or infinite entries are dropped; where vectors differ in length,
those of the commonest length (the longer of two) stay; repeated rows are returned each and count once in the fit list;
rows without an id keep the null; components whose eigenvalue is not above `RANK` of the largest - all, if there is only
one distinct vector - are left out, and there are none in an empty table; entries beyond +-2**56 are held there, and a
deviation beyond a long is null; other columns are not read, whatever their names.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import written

SCALE, SHIFT, LARGEST = 64, 1_000_000, float(1 << 56)
#: Share of the largest eigenvalue that one must exceed to count.
RANK = 1e-12
COMPONENTS = 16


def integers(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """ident and x, the vector in whole numbers, of the rows whose vector has finite entries only."""
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    entry = lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-LARGEST)), F.lit(LARGEST))) + SHIFT
    sound = rows.select(F.col(ident).alias("ident"), F.col(vector).alias("v")).where("v is not null").where(~F.exists("v", odd))
    return sound.select("ident", F.transform("v", entry).alias("x"))


def stacked(column: pa.Array | pd.Series, size: int) -> np.ndarray:
    """A batch of vectors as a matrix."""
    if isinstance(column, pd.Series):
        return np.stack(column.to_list()).astype(np.int64) if len(column) else np.zeros((0, size), np.int64)
    return np.asarray(column.flatten(), np.int64).reshape(len(column), size)


def column_sums(x: DataFrame, size: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension; high and low halves are summed apart, so none overflows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            rows = stacked(batch.column(0), size)
            n += len(rows)
            low += (rows & 0xFFFFFFFF).sum(0)
            high += (rows >> 32).sum(0)
        yield pa.record_batch([pa.array(range(size), pa.int32()), pa.array(np.full(size, n)), pa.array(low), pa.array(high)], names=["at", "n", "low", "high"])

    parts = x.select("x").mapInArrow(work, "at int, n long, low long, high long")
    sums = parts.groupBy("at").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "low", "high"))).collect()  # a row for each dimension
    sums = sorted((r.at, int(r.n), (int(r.high) << 32) + int(r.low)) for r in sums)
    return (sums[0][1], [s for _, _, s in sums]) if sums else (0, [0] * size)


def off_centre(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly; as Python integers where a long can't hold it."""
    if len(x) and n * int(np.abs(x).max()) + max(map(abs, sums), default=0) >= 1 << 62:
        return n * x.astype(object) - np.array(sums, object)
    return n * x - np.array(sums, np.int64)


def deviations(off: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, or null where a long can't hold it."""
    if off.dtype != object and (not off.size or off.shape[1] * int(np.abs(off).max()) ** 2 < 1 << 63):
        return (off * off).sum(1).tolist()
    total = (off.astype(object) ** 2).sum(1)
    return [int(t) if t < 1 << 63 else None for t in total]


def gramian(rows: DataFrame, n: int, size: int) -> np.ndarray:
    """A^T A of the rows' arrays of doubles."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(F.col(rows.columns[0])).alias("v")), "v")
    return RowMatrix(vectors, n, size).computeGramianMatrix().toArray()


@dataclass
class Whitening:
    """What is learned: the number of distinct vectors, their sums, and components by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    #: Unit eigenvectors as columns, over the roots of their eigenvalues.
    matrix: np.ndarray
    explained: np.ndarray
    #: The largest absolute entry of the whitened fit list's covariance minus the identity.
    identity_error: float = 0.0

    def apply(self, x: DataFrame, schema: str, rows) -> DataFrame:
        """The rows of x (ident, x) in batches through `rows(ident, whitened, deviation) -> frame` with the schema."""
        size = len(self.sums)
        shared = x.sparkSession.sparkContext.broadcast((self.n, self.sums, self.matrix))  # as many numbers as dimensions and components

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, sums, matrix = shared.value
            for frame in frames:
                for at in range(0, len(frame), 2000):
                    part = frame.iloc[at : at + 2000]
                    off = off_centre(stacked(part["x"], size), n, sums)
                    yield rows(part["ident"], (off / n).astype(np.float64) @ matrix, off)

        # ids go as text, as pandas makes doubles of longs with nulls among them
        return x.where(F.size("x") == size).select(F.col("ident").cast("string").alias("ident"), "x").mapInPandas(work, schema)


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Learn from the distinct vectors of x; none: no rows."""
    common = x.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if not common or not common["size"]:
        return None
    size = common["size"]
    distinct = written(x.where(F.size("x") == size).select("x").distinct())
    n, sums = column_sums(distinct, size)

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = (off_centre(stacked(batch.column(0), size), n, sums) / n).astype(np.float64)
            yield pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(c.reshape(-1)), size).cast(pa.list_(pa.float64()))], names=["c"])

    covariance = gramian(distinct.mapInArrow(centred, "c array<double>"), n, size) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > RANK * max(values[0], 0)).sum()))
    if not k:
        return None
    values, vectors = values[:k], vectors[:, :k]
    found = Whitening(n, sums, values, vectors / np.sqrt(values), values / np.trace(covariance))
    white = found.apply(distinct.select(F.lit(None).cast("string").alias("ident"), "x"), "w array<double>", lambda ident, w, off: pd.DataFrame({"w": list(w)}))
    found.identity_error = float(np.abs(gramian(white, n, k) / n - np.eye(k)).max())
    return found


def whiten(rows: DataFrame, components: int = COMPONENTS, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row: ident and whitened, its coordinates on the components as an array of doubles."""
    x = integers(rows, ident, vector)
    found = fit(x, components)
    kind = rows.schema[ident].dataType
    if not found:
        return rows.sparkSession.createDataFrame([], f"`{ident}` {kind.simpleString()}, whitened array<double>")
    out = found.apply(x, "ident string, whitened array<double>", lambda ident, w, off: pd.DataFrame({"ident": ident, "whitened": list(w)}))
    return out.select(F.col("ident").cast(kind).alias(ident), "whitened")


def whitened_entries(rows: DataFrame, components: int = COMPONENTS, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row and component (from 1 on): ident, component, n, deviation, whitened, explained and identity_error."""
    x = integers(rows, ident, vector)
    found = fit(x, components)
    kind = rows.schema[ident].dataType
    schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not found:
        return rows.sparkSession.createDataFrame([], f"`{ident}` {kind.simpleString()}, {schema}")

    n, k, explained, error = found.n, len(found.values), found.explained, found.identity_error

    def each(own: pd.Series, white: np.ndarray, off: np.ndarray) -> pd.DataFrame:
        total = pd.array(deviations(off), "Int64")
        return pd.DataFrame({
            "ident": own.repeat(k).to_numpy(), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(own)), "n": n,
            "deviation": total.repeat(k), "whitened": white.reshape(-1), "explained": np.tile(explained, len(own)), "identity_error": error,
        })

    return found.apply(x, f"ident string, {schema}", each).select(F.col("ident").cast(kind).alias(ident), *(c.split()[0] for c in schema.split(", ")))
