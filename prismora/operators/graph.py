"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import written


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component of the edges (u, v); logarithmically many rounds."""
    star = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    by = Window.partitionBy("u")
    before = None
    while True:
        ways = star.union(star.select("v", "u"))
        out = ways.withColumn("m", F.least("u", F.min("v").over(by))).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = out.withColumn("m", F.min("v").over(by))
        star = written(low.select("u", "m").union(low.select("v", "m")).toDF("u", "v").where("u <> v").distinct(), "links")
        state = star.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        if state == before:
            roots = star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return star.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        before = state
