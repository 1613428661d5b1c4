"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop, materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` with the smallest node reachable, for every node with a link.

    Links ``u, v`` go through alternating large-star and small-star rounds until every node but the roots has
    one link, to a root.  A round's tables are written to the shared folder and dropped when the next round's are there; the
    caller may :func:`drop` the result.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """Link neighbours of u (larger ones, or smaller ones and u) to the smallest of them and u."""
        mins = materialize(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        hung = pairs.filter("v > u") if large else pairs
        out = hung.join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            out = out.union(mins.select("u", F.col("m").alias("v")))
        out = materialize(out.filter("u != v").distinct())
        drop(mins)
        return out

    def unsettled(pairs: DataFrame) -> bool:
        """Whether some node links to two others, or is both linked to another and its end."""
        end = lambda c, out: F.struct(F.col(c).alias("node"), F.lit(out).alias("out"))
        ends = pairs.select(F.explode(F.array(end("u", 1), end("v", 0))).alias("e")).select("e.*")
        nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("least"))
        return not nodes.filter((F.col("out") > 1) | ((F.col("out") == 1) & (F.col("least") == 0))).isEmpty()

    pairs = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    while unsettled(pairs):
        large = star(pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))), True)
        small = star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False)
        drop(pairs, large)
        pairs = small
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots._written_at = pairs._written_at
    return roots
