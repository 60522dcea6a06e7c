"""Connected components of links, as repeated joins of narrow tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import stored

#: Rounds halve the distance to the smallest id at least; more than this cannot be.
MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, label) with the smallest node of each component, from links (a, b).

    Each round takes the smallest label among neighbours and then the label of
    that label.  Minima are grouped with map-side combination, so a node with
    very many links is no burden; labels are written to the shared folder."""
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    for _ in range(MOST_ROUNDS):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = stored(step.join(jump, "next", "left").select("node", F.col("label").alias("old"), F.least("next", "far").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.filter("old <> label").isEmpty():
            return labels
    raise RuntimeError("links did not settle")
