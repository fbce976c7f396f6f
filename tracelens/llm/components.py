"""Connected components of a table of links, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import stash


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the least node of its component, for all nodes that have a link.

    A round gives every node its least neighbour (or itself) as parent, follows parents
    twice, and replaces the links by links between parents.  Hubs need no care: the least
    neighbour is a partial aggregate, and the joins are plain equi-joins that Spark splits
    where they are skewed.
    """
    both = F.explode(F.array(F.struct(F.col(a).alias("node"), F.col(b).alias("other")), F.struct(F.col(b).alias("node"), F.col(a).alias("other"))))
    links = links.select(a, b).where(F.col(a) != F.col(b)).distinct()
    root: DataFrame | None = None
    while True:
        parent = stash(links.select(both.alias("x")).select("x.*").groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root")))
        for _ in range(2):
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
            parent = parent.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        parent = stash(parent)
        at_a = parent.select(F.col("node").alias(a), F.col("root").alias("ra"))
        at_b = parent.select(F.col("node").alias(b), F.col("root").alias("rb"))
        links = stash(links.join(at_a, a).join(at_b, b).where(F.col("ra") != F.col("rb")).select(F.col("ra").alias(a), F.col("rb").alias(b)).distinct())
        if root is None:
            root = parent
        else:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
            root = root.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        if links.isEmpty():
            return root
