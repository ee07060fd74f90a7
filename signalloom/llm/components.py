"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import written


#: Far more rounds than any table needs; rounds grow with the logarithm of the longest path.
GUARD = 10_000


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for each end of ``edges (a, b)``: the smallest id that can be reached.

    Each round takes the smallest label of the neighbours, hands what a label's rows have found to the row
    of the label itself, and then takes the label of that label. It ends when no label moves: then neighbours have equal labels.
    The join on a hub's edges can be split by Spark; what comes out of it is aggregated before it moves.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "cc-labels")
    for _ in range(GUARD):
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        stepped = written(labels.join(near, labels["id"] == near["a"]).select("id", F.col("label").alias("was"), F.least("label", "near").alias("label")), "cc-near")
        hooked = stepped.groupBy(F.col("was").alias("root")).agg(F.min("label").alias("low"))
        lower = stepped.join(hooked, stepped["id"] == hooked["root"], "left").select("id", "was", F.least("label", "low").alias("label"))
        jump = labels.select(F.col("id").alias("via"), F.col("label").alias("beyond"))
        new = written(lower.join(jump, lower["label"] == jump["via"], "left").select("id", "was", F.least("label", "beyond").alias("label")), "cc-labels")
        labels = new.select("id", "label")
        if not new.where("label <> was").limit(1).count():
            return labels
    raise RuntimeError(f"labels still move after {GUARD} rounds")
