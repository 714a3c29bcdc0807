"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b); comp is the smallest node it reaches.

    Each round takes the least label among neighbours and then the label of the label, so that a
    chain's length is halved. Every round is written, nothing is gathered; joins are on node ids, and
    a node with very many edges is split by Spark's skew join.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        hop = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        root = labels.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        step = written(hop.join(root, "comp", "left").select("node", "old", F.least("comp", F.coalesce("root", "comp")).alias("comp")))
        labels = step.select("node", "comp")
        if step.filter("comp <> old").isEmpty():
            return labels
