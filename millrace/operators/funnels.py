"""Funnels over the events of users."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.io import load

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Depth of each stage; the last one is terminal and stands outside the chain.
STAGES = (("view", 0), ("click", 1), ("signup", 2), ("purchase", 3))


def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by their deepest stage, users who reached each stage, and the step conversion (4 digits, half up)."""
    deepest = load(spark, sf_dir, "events").groupBy("user_id").agg(*(F.max((F.col("event_type") == s).cast("int")).alias(s) for s, _ in STAGES))
    counts = deepest.agg(*(F.sum(F.greatest(F.lit(0), *(F.col(t) for t, e in STAGES if e >= d))).cast("long").alias(s) for s, d in STAGES))
    reached = F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(d).alias("depth"), F.coalesce(F.col(s), F.lit(0)).alias("reached"), (F.coalesce(F.col(STAGES[d - 1][0]), F.lit(0)) if d else F.lit(None).cast("long")).alias("previous"), (F.coalesce(F.col(STAGES[d + 1][0]), F.lit(0)) if d < 3 else F.lit(0)).alias("deeper")) for s, d in STAGES))
    rows = counts.select(F.inline(reached))
    share = F.when(F.col("previous") > 0, F.floor(F.col("reached") / F.col("previous") * 10000 + 0.5) / 10000).otherwise(0.0)
    return rows.select("stage", "depth", (F.col("reached") - F.col("deeper")).alias("here"), "reached", F.when(F.col("depth") == 0, F.lit(1.0)).otherwise(share).alias("conversion"))


QUERIES["funnel"] = funnel
ORACLE_SQL["funnel"] = """
WITH d AS (
  SELECT user_id, MAX(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE -1 END) AS depth
  FROM events GROUP BY user_id),
s(stage, depth) AS (VALUES ('view', 0), ('click', 1), ('signup', 2), ('purchase', 3)),
r AS (SELECT s.stage, s.depth, COUNT(*) FILTER (WHERE d.depth = s.depth) AS here, COUNT(*) FILTER (WHERE d.depth >= s.depth) AS reached
      FROM s, d GROUP BY s.stage, s.depth)
SELECT stage, depth, here, reached,
       CASE WHEN depth = 0 THEN 1.0 WHEN LAG(reached) OVER (ORDER BY depth) > 0
            THEN FLOOR(reached * 1.0::DOUBLE / LAG(reached) OVER (ORDER BY depth) * 10000 + 0.5) / 10000 ELSE 0.0 END::DOUBLE AS conversion
FROM r
"""
