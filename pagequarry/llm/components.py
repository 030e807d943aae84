"""Connected components by alternating large and small stars, cut to written tables between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import discard, materialize, split_join


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b bigint) -> (node, component) for every node but the smallest of each component.

    Each round a node hangs its larger neighbours, then its smaller ones, on its least neighbour, so
    stars merge in a logarithmic number of rounds.  The neighbours of a star's centre are spread over all tasks.
    Nulls and loops are ignored, repeats don't matter, no edges give no rows.
    """
    e = materialize(edges.where("a <> b").selectExpr("greatest(a, b) u", "least(a, b) v").distinct(), "cc")
    while True:
        # done when each node hangs on one other, which hangs on none
        ends = e.selectExpr("u x", "1 up", "0 down").unionByName(e.selectExpr("v x", "0 up", "1 down"))
        loose = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1")
        if loose.isEmpty():
            return e.selectExpr("u node", "v component")
        both = e.unionByName(e.selectExpr("v u", "u v"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")).selectExpr("u", "least(u, m) m", "d")
        large = materialize(split_join(both, least, "u", "d").where("v > u").selectExpr("v u", "m v").distinct(), "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
        small = split_join(large, least, "u", "d").where("v <> m").selectExpr("v u", "m v").unionByName(least.selectExpr("u", "m v"))
        after = materialize(small.distinct(), "cc")
        discard(e, large)
        e = after
