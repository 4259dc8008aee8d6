"""Streaming counterparts of batch operators: idempotent ingestion and the stage of each user as keyed state.

Both read a folder of Parquet files as a stream. The stage is kept by applyInPandasWithState, whose state is three
scalars a user, so late files and restarts give what the batch fold gives as long as events arrive in order per user.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from millrace.catalog import Catalog
from millrace.io import load, shared_folder

catalog = Catalog()
QUERIES, ORACLE_SQL = catalog.queries, catalog.sql

DEPTH = {"view": 0, "click": 1, "signup": 2, "purchase": 3}


def event_stream(spark: SparkSession, folder: str, schema: StructType, files: int | None = 1) -> DataFrame:
    """The Parquet files of a folder, some in each micro-batch; None: all that are there in one.

    A table's files are in no order of time, so under a watermark those of a later micro-batch would be late: tables take one.
    """
    stream = spark.readStream.schema(schema)
    return (stream if files is None else stream.option("maxFilesPerTrigger", files)).parquet(folder)


def without_repeats(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """Events observed again within the delay are dropped; state older than that is forgotten."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def stages(events: DataFrame) -> DataFrame:
    """Per user and micro-batch: the deepest stage so far and the number of events; a purchase is final."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stage, n = state.get if state.exists else ("new", 0)
        for frame in frames:
            n += len(frame)
            for kind in frame.sort_values(["ts", "event_id"])["event_type"]:
                if stage != "purchase" and DEPTH.get(kind, -1) > DEPTH.get(stage, -1):
                    stage = kind
        state.update((stage, n))
        yield pd.DataFrame({"user_id": [key[0]], "stage": [stage], "n": [n]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, stage string, n long", "stage string, n long", "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, name: str, mode: str, checkpoint: str) -> None:
    """Work off all files that are there, into a table in memory of that name."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def written_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Work off all files that are there, into a Parquet table in the shared folder, and read it."""
    spark, path = stream.sparkSession, shared_folder(stream.sparkSession)
    sink = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    if mode == "append":
        query = sink.format("parquet").option("path", path).start()
    else:  # changed rows of each micro-batch
        query = sink.foreachBatch(lambda rows, batch: rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(path)).start()
    query.awaitTermination()
    return spark.read.parquet(path)


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = load(spark, sf_dir, "events").schema
    stream = event_stream(spark, f"{sf_dir}/event[s].parquet", schema, None)  # a pattern, so that it may be one file or a folder
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@catalog.query("stream_dedup", "SELECT DISTINCT event_id FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    return written_to_end(without_repeats(events_of(spark, d)).select("event_id"))


@catalog.query("stream_stage_state", """
SELECT user_id, CASE MAX(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE -1 END) WHEN 3 THEN 'purchase' WHEN 2 THEN 'signup' WHEN 1 THEN 'click' WHEN 0 THEN 'view' ELSE 'new' END AS stage, COUNT(*) AS n FROM events GROUP BY user_id""")
def stream_stage_state(spark: SparkSession, d: str) -> DataFrame:
    """The state of each user after the last micro-batch."""
    changes = written_to_end(stages(events_of(spark, d)), "update")
    return changes.groupBy("user_id").agg(F.max_by(F.struct("stage", "n"), "batch").alias("s")).select("user_id", "s.stage", "s.n")
