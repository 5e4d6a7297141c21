"""Connected components of a link table, without gathering any component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import written


def _roots(parent: DataFrame) -> DataFrame:
    """Follow node -> up to the end; each pass halves the depth."""
    while True:
        above = parent.select(F.col("node").alias("up"), F.col("up").alias("next"))
        jumped = written(parent.join(above, "up").select("node", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")), "jump", narrow=True)
        parent = jumped.select("node", "up")
        if jumped.where("moved").isEmpty():
            return parent


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> node, root: the smallest node of each component, for every node that has a link.

    Every node hooks onto its smallest neighbour (a minimum, so a hub is pre-aggregated), chains are shortened by
    pointer jumping, and links between different roots go to the next round.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null and a <> b")
    both = written(both.distinct(), "links", narrow=True)
    labels = None
    while True:
        up = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up"))
        up = _roots(up)
        if labels is None:
            labels = up.withColumnRenamed("up", "root")
        else:
            step = up.select(F.col("node").alias("root"), "up")
            labels = written(labels.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels", narrow=True)
        side = lambda c, to: up.select(F.col("node").alias(c), F.col("up").alias(to))
        both = both.join(side("a", "ra"), "a").join(side("b", "rb"), "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        if both.isEmpty():
            return labels
        both = written(both.distinct(), "links", narrow=True)
