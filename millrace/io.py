"""Reading the tables of a data folder, and a place for what a query writes."""

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The Parquet table of that name; only the columns a query uses are read."""
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
