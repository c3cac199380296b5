"""Connected components of links that no task holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duolex.session import materialize


def _flat(parents: DataFrame) -> DataFrame:
    """(node, parent) with every chain of parents followed to its end, doubling the step each time."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_above"))
        jumped = materialize(
            parents.join(above, "parent").select("node", "_above", (F.col("_above") != F.col("parent")).alias("_moved")),
            "parents",
        )
        parents = jumped.select("node", F.col("_above").alias("parent"))
        if jumped.filter("_moved").isEmpty():
            return parents


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that links lead to, for every node of a link.

    Each round lets every node point to its smallest neighbour (or itself), follows the pointers
    to their ends, and replaces nodes by these; what is left are links between fewer nodes. At
    least half of the linked nodes go in a round. Self-links only name their node; nulls link nothing.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    links = materialize(links.distinct(), "links")
    roots = None
    while True:
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            links.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        parents = both.groupBy("node").agg(F.min("other").alias("parent"))
        parents = _flat(materialize(parents.select("node", F.least("node", "parent").alias("parent")), "parents"))
        if roots is None:
            roots = parents.select("node", F.col("parent").alias("root"))
        else:
            above = parents.select(F.col("node").alias("root"), F.col("parent").alias("_above"))
            roots = roots.join(above, "root", "left").select("node", F.coalesce("_above", "root").alias("root"))
        roots = materialize(roots, "roots")
        first = parents.select(F.col("node").alias("a"), F.col("parent").alias("_a"))
        second = parents.select(F.col("node").alias("b"), F.col("parent").alias("_b"))
        links = links.join(first, "a").join(second, "b").filter("_a <> _b")
        links = materialize(links.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "links")
        if links.isEmpty():
            return roots
