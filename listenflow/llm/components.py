"""Connected components of an edge table as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenflow.session import materialize


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node, comp`` for every node of ``edges``; ``comp`` is the smallest node reached.

    Rounds of minimum over the neighbours followed by a jump to the label's
    own label, until nothing changes; each round is written to the shared
    checkpoint folder, so the lineage does not grow.  Only the number of
    changed labels comes to the driver.
    """
    both = edges.select(F.col(u).alias("u"), F.col(v).alias("v"))
    both = materialize(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("comp")))
    while True:
        near = (both.join(labels.select(F.col("node").alias("v"), "comp"), "v")
                .groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("near")))
        lower = labels.join(near, "node").select("node", F.col("comp").alias("old"),
                                                 F.least("comp", "near").alias("comp"))
        # where that label points now; a label is itself a node of the table
        target = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        labels = materialize(lower.join(target, "comp").select(
            "node", "old", F.least("comp", "up").alias("comp")))
        if labels.where("comp <> old").limit(1).count() == 0:
            return labels.select("node", "comp")
        labels = labels.select("node", "comp")
