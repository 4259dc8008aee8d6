"""Connected components of a graph of links, by alternating large and small stars.

Every round hangs each node's larger neighbours under its smallest neighbour, then each node and its
smaller neighbours under the smallest of these; the rounds end when no edge changes, after about log n of
them. Only minima per node are joined back, so no neighbourhood is ever held in one task.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import remove, shared_folder


def stars(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every linked node but the roots; root is the smallest node of its component.

    Links are pairs of longs; null ends, loops and repeated links don't matter; no links, no rows.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    before, path = None, None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # in the small star a node's neighbours are all smaller than itself, as edges point down
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        new = shared_folder(spark)
        small.write.parquet(new)
        if path:
            remove(spark, path)
        path, edges = new, spark.read.schema(small.schema).parquet(new)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
