"""Connected components as joins and aggregates: smallest labels along edges, with shortcuts, each round a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm.shared import folder, remove, saved


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for every end of the edges (columns a, b); no edges, no rows."""
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    both = saved(both, "edges")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component"))
    path = folder(spark, "labels")
    labels = saved(labels, "labels", path)
    while True:
        reached = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        nearer = labels.join(reached, labels["id"] == reached["a"], "left").select("id", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("id").alias("via"), F.col("component").alias("far"))
        new = nearer.join(jump, nearer["next"] == jump["via"], "left").select("id", "component", F.least("next", "far").alias("next"))
        new_path = folder(spark, "labels")
        new = saved(new, "labels", new_path)
        changed = new.where("next <> component").limit(1).count()
        remove(spark, path)
        path, labels = new_path, new.select("id", F.col("next").alias("component"))
        if not changed:
            return labels
