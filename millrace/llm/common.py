"""What several operators of this subpackage share."""

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@lru_cache(1)
def own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="millrace-")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only in local mode (tests) may the session name none: one process then writes and reads a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
        base = own_folder()
    return f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None, compression: str = "snappy") -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: a cut lineage that survives lost executors."""
    spark = df.sparkSession
    path = path or shared_folder(spark)
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that an earlier step wrote in the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Whole texts go between the JVM and Python in batches of so many rows, as both ends hold a batch for each task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches that gives memory back when its task ends: workers live on beside the next stage's."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def fold_of(ident: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(F.col(ident).cast("string").cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, size: int, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Labelled rows to learn from: ident, text and y, at most `rows` of them with at most `size` bytes of text together.

    Labels come in the order of a hash of id and label, and copies of a row count once; rows that don't fit any more are
    left out. The order of the tables and their parts changes nothing. Both bounds hold for what is gathered on the driver.
    """
    spark = docs.sparkSession
    draw = F.xxhash64(F.col(ident), F.lit(3), F.col(label))
    known = labels.where(F.col(label).isNotNull() & F.col(ident).isNotNull()).select(F.col(ident).alias("i"), F.col(label).cast("double").alias("y"), draw.alias("draw"))
    chosen = known.distinct().orderBy("draw", "i", "y").limit(rows)  # at most `rows` rows, so they can be broadcast
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    whole = docs.select(F.col(ident).alias("i"), value.alias("text"))
    light = whole.select("i", F.xxhash64("text").alias("version"), F.octet_length("text").alias("bytes")).join(F.broadcast(chosen), "i").distinct()
    taken, room = [], size
    for r in light.orderBy("draw", "i", "y", "version").limit(rows).collect():
        if r.bytes <= room:
            taken.append((r.i, r.version, r.y))
            room -= r.bytes
    wanted = spark.createDataFrame(taken, f"i {docs.schema[ident].dataType.simpleString()}, version long, y double")
    found = whole.withColumn("version", F.xxhash64("text")).join(F.broadcast(wanted), ["i", "version"])
    return found.dropDuplicates(["i", "version", "y"]).select(F.col("i").alias(ident), "text", "y")
