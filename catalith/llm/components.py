"""Connected components of a graph given as rows, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges (a long, b long): label is the smallest node that is reached.

    A round takes the smallest label of every node's neighbours and then the
    label's own label; rounds end when no label changes. Rows grow with edges, and
    labels are settled in the shared folder each round. Files of labels are far smaller
    than their rows, so Spark may not broadcast them by their size: joins are merge joins.
    """
    both = settle(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct(), "edges")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(seen.hint("merge"), "node").select("node", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        new = settle(new.join(jump.hint("merge"), "new", "left").select("node", F.least("new", "far").alias("label"), (F.least("new", "far") < F.col("old")).alias("moved")), "labels")
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels
