"""Connected components of a table of links by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.runtime import drop_path, scratch_path


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of each linked node's component.

    Each round hooks every root onto the smallest root next to it and then
    follows two parents at once, so long chains take logarithmically many rounds.
    Nothing but the number of labels that changed reaches the driver. Links from
    a node to itself and repeated links are harmless; no links give no rows.
    """
    both = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    spark = links.sparkSession

    def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    edges, at_edges = kept(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels, at = kept(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        # the smallest label among the neighbours, offered to the node and to the root it has now
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("root").alias("of_b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("of_b").alias("offer"))
        seen = labels.join(near, "node")
        hooks = seen.where("offer < root").groupBy(F.col("root").alias("node")).agg(F.min("offer").alias("hook"))
        hooked = seen.join(hooks, "node", "left").select("node", F.col("root").alias("old"), F.least("root", "offer", F.coalesce("hook", "root")).alias("root"))
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = hooked.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("above", "root")).alias("root"))
        after, below = kept(jumped, "labels")
        drop_path(spark, at)
        labels, at = after.select("node", "root"), below
        if after.where("old <> root").isEmpty():
            drop_path(spark, at_edges)
            return labels
