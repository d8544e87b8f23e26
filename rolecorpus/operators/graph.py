"""Connected components of a graph given by a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import settle


def connected_components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) for every node in ``links`` (a, b): the smallest node that its links reach.

    Each round every node takes the smallest label among its neighbours' and then its label's own label, so the
    number of rounds grows with the logarithm of a component's diameter. A round is a written table; labels only
    fall, and the loop ends when a round lowers none. Hubs cost no more than their links: minima are taken
    before the shuffle and the joins are left to the planner to split.
    """
    pairs = links.filter("a != b")
    both = settle(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "graph-links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    labels = settle(labels, "graph-labels")
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        hop = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "near").alias("to"))
        ends = labels.select(F.col("node").alias("to"), F.col("component").alias("end"))
        stepped = settle(hop.join(ends, "to", "left").select("node", "old", F.least("to", F.coalesce("end", "to")).alias("component")), "graph-labels")
        changed = stepped.filter("old != component").limit(1).count()
        labels = stepped.select("node", "component")
        if not changed:
            break
    else:
        raise RuntimeError("the components did not settle")
    return labels
