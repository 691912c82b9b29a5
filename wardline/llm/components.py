"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import put_down, scope


def connected_components(edges: DataFrame) -> DataFrame:
    """``v, root`` for every vertex of ``edges`` (``a``, ``b``, both long); the root is the smallest vertex reachable.

    Every round takes the smallest label among the neighbours and then the label of that label, so long chains halve
    from round to round.  Labels are written to the shared folder after every round.  Minimums are folded before the
    shuffle; the joins of a vertex with many edges are ordinary equi-joins that AQE splits.
    """
    with scope():
        return put_down(_labels(edges), "components", kept=True)


def _labels(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = put_down(both.where("a <> b").distinct(), "edges")
    labels = put_down(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("root")), "labels")
    while True:
        seen = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("root").alias("near"))
        nearer = labels.join(seen, F.col("v") == F.col("a")).select("v", "root", F.least("root", "near").alias("next"))
        upper = labels.select(F.col("v").alias("u"), F.col("root").alias("top"))
        step = nearer.join(upper, F.col("next") == F.col("u")).select(
            "v", F.least("next", "top").alias("root"), (F.least("next", "top") < F.col("root")).alias("moved")
        )
        step = put_down(step, "labels")
        labels = step.select("v", "root")
        if step.where("moved").isEmpty():
            return labels
