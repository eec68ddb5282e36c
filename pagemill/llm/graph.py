"""Connected components by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, materialize


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` rows -> ``(node, component)``: the smallest node that each reaches.

    Each round takes the neighbours' smallest label and then the label's own label, so
    labels travel twice as far each time. A node with very many edges costs one
    pre-aggregated minimum, and its join is split by the skew rule.
    """
    with Scratch(edges.sparkSession) as scratch:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).where("u <> v").distinct()
        both = scratch.table(both, "edges")
        labels = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")), "labels")
        while True:
            best = both.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy("u").agg(F.min("component").alias("m"))
            near = labels.join(best.withColumnRenamed("u", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
            up = labels.select(F.col("node").alias("component"), F.col("component").alias("top"))
            fresh = near.join(up, "component").select("node", "old", F.least("component", "top").alias("component"))
            fresh = scratch.table(fresh, "labels")
            labels = fresh.select("node", "component")
            if fresh.where("old <> component").isEmpty():
                return materialize(labels, "components")
