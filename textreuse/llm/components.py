"""Connected components by contraction; every step is a join or an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "") -> DataFrame:
    """(u long, v long) links -> (node, label): label is the smallest node that node reaches.

    Each round points every node at its smallest neighbour, shortens those paths, and replaces the ends of
    each link by what they point at. Links within one node vanish; the rounds end when none is left.
    Nodes without links are not returned. Null ends are dropped, repeated links and loops count once.
    """
    left = scratch.put(
        edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{name}links-0"
    )
    labels, turn = None, 0
    while labels is None or not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p"))
        for _ in range(2):
            to = to.join(to.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("q").alias("p"))
        to = scratch.put(to, f"{name}parents-{turn}")
        u, v = (to.select(F.col("u").alias(end), F.col("p").alias(f"p{end}")) for end in "uv")
        turn += 1
        left = scratch.put(
            left.join(u, "u")
            .join(v, "v")
            .where("pu <> pv")
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
            .distinct(),
            f"{name}links-{turn}",
        )
        if labels is None:
            labels = to.select(F.col("u").alias("node"), F.col("p").alias("label"))
        else:
            labels = labels.join(to.withColumnRenamed("u", "label"), "label", "left").select(
                "node", F.coalesce("p", "label").alias("label")
            )
    return labels
