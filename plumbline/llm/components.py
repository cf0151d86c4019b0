"""Connected components of a link table, by repeated contraction on Spark.

Each round points every node at its smallest neighbour, follows the pointers to their ends and replaces the
ends of every link by what they point at; links within one node disappear. A round at least halves the nodes that still
have links, so a few rounds settle. Only counts reach the driver; lineage is cut in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``: root is the smallest node reachable. No links, no rows."""
    both = links.where("a <> b").select("a", "b")
    links = cut(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = None
    while links.take(1):
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
        pointers = _followed(ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root")))
        if roots is None:
            roots = pointers
        else:  # what pointed at a node of this round now points further
            step = pointers.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = cut(roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        a = pointers.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = pointers.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = links.join(a, "a").join(b, "b").where("ra <> rb")
        links = cut(links.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return roots if roots is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _followed(pointers: DataFrame) -> DataFrame:
    """Pointers to the ends of their chains; a root points at itself and pointers never go up."""
    pointers = cut(pointers)
    while True:
        step = pointers.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = pointers.join(step, "root", "left")
        if not moved.where("next is not null").take(1):
            return pointers
        pointers = cut(moved.select("node", F.coalesce("next", "root").alias("root")))
