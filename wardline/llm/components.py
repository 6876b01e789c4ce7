"""Connected components of a distributed edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the least node of its component) for every node that an edge names.

    edges: a, b (long). Each round takes the least label among the neighbours and then the label's own
    label, so chains shrink by half; rounds are written tables, and only a count of changes reaches the driver.
    """
    both = materialise(
        edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        .union(edges.select(F.col("b"), F.col("a"))), "edges")
    labels = materialise(both.groupBy(F.col("u").alias("node")).agg(
        F.least(F.col("u"), F.min("v")).alias("comp")), "labels")
    while True:
        heard = (both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("comp").alias("heard")))
        lower = (labels.join(heard, labels.node == heard.u, "left")
                 .select("node", F.col("comp").alias("was"),
                         F.least("comp", F.coalesce("heard", "comp")).alias("comp")))
        # A label's own label: labels name nodes of the same component, so following them is always right.
        parent = lower.select(F.col("node").alias("p"), F.col("comp").alias("up"))
        jumped = (lower.join(parent, lower.comp == parent.p, "left")
                  .select("node", "was", F.least("comp", F.coalesce("up", "comp")).alias("comp")))
        after = materialise(jumped, "labels")
        if after.filter("comp <> was").isEmpty():
            return after.select("node", "comp")
        labels = after.select("node", "comp")
