"""Connected components of a graph whose links may be more than one machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import checkpointed, without_estimates

#: Each jump doubles how far a node follows smallest neighbours in a round.
JUMPS = 3


def _written(df: DataFrame) -> DataFrame:
    return without_estimates(checkpointed(df))


def components(links: DataFrame) -> DataFrame:
    """Rows (a, b) to rows (node, root): the smallest node that each linked node reaches.

    Each round gives every node its smallest neighbour, follows these a few times over, and contracts the graph; so a
    chain shrinks to a small part of its length each time. What is written after a round is all that the next one needs. Nodes must not be null; repeated links and links to oneself do no harm.
    """
    edges = _written(links.select("a", "b").where("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = _written(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("v"), F.least("a", "p").alias("p")))
        for _ in range(JUMPS):
            above = parents.select(F.col("v").alias("w"), F.col("p").alias("q"))
            parents = _written(parents.join(above, parents.p == above.w).select("v", F.col("q").alias("p")))
        if labels is None:
            labels = parents.select(F.col("v").alias("node"), F.col("p").alias("root"))
        else:
            labels = labels.join(parents, labels.root == parents.v, "left").select("node", F.coalesce("p", "root").alias("root"))
        to = lambda end: parents.select(F.col("v").alias(end), F.col("p").alias(f"{end}_p"))
        edges = _written(edges.join(to("a"), "a").join(to("b"), "b").select(F.col("a_p").alias("a"), F.col("b_p").alias("b")).where("a <> b").distinct())
        labels = _written(labels)
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
