"""Connected components of a membership graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.session import cut_lineage, shuffled


def connected_groups(links: DataFrame) -> DataFrame:
    """Smallest node of the component of each node, for links of ``node`` to ``hub``.

    Nodes are connected through the hubs they share. Each round hands the smallest label of a
    hub to its nodes and the smallest label of a node to its hubs, as two aggregates with
    map-side sums, so a hub that most nodes share is no hot spot. Labels are nodes themselves;
    each round also offers a node the label of its label, which halves the remaining distance.
    A round is one plan of three joins without broadcasts: plans are kept in the driver's memory.
    """
    links = cut_lineage(links.select("node", "hub").filter("node is not null and hub is not null").distinct())
    labels = links.groupBy("node").agg(F.min("node").alias("group"))
    while True:
        of_hub = links.join(shuffled(labels), "node").groupBy("hub").agg(F.min("group").alias("offer"))
        offers = links.join(shuffled(of_hub), "hub").select("node", "offer", F.lit(None).alias("own"))
        beyond = labels.select(F.col("node").alias("group"), F.col("group").alias("offer"))
        jumps = labels.join(shuffled(beyond), "group").select("node", "offer", F.col("group").alias("own"))
        both = offers.unionByName(jumps).groupBy("node").agg(F.min("offer").alias("group"), F.max("own").alias("last"))
        following = cut_lineage(both)
        settled = following.filter(F.col("group") != F.col("last")).isEmpty()
        labels = following.select("node", "group")
        if settled:
            return labels
