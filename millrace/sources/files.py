"""Sources and sinks: strict and permissive JSON, delimited catalogues, append logs and snapshots."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def strict_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON corpus of a fixed schema; a broken row fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def permissive_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the raw text of broken ones."""
    rows = spark.read.schema(f"{schema}, broken_ string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken_").json(path)
    raw = spark.read.text(path)
    parsed = raw.select("value", F.from_json("value", f"{schema}, broken_ string", {"columnNameOfCorruptRecord": "broken_"}).alias("p"))
    return rows.where("broken_ is null").drop("broken_"), parsed.where("p.broken_ is not null").select("value")


def catalogue_csv(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",") -> DataFrame:
    """A delimited file with a header and quoted fields."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)


def append(df: DataFrame, path: str, columns: list[str]) -> None:
    """Append to a log; unknown columns are refused."""
    if unknown := set(df.columns) - set(columns):
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    df.select(columns).write.mode("append").parquet(path)


def snapshot(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key of an append log."""
    latest = log.groupBy(*key).agg(F.max(F.struct(*order, *(c for c in log.columns if c not in order))).alias("b"))
    return latest.select(*(F.col(f"b.{c}").alias(c) for c in log.columns))
