"""Connected components of a table of links, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlane.llm import common

#: Far more rounds than a graph of any size needs; passing it is an error.
MAX_ROUNDS = 60


def connected_components(links: DataFrame, hot: int = common.HOT_ROWS) -> DataFrame:
    """``node`` and ``root`` (the least node that can be reached) of every node
    that has a link.

    ``links`` has two columns of one orderable type, ``a`` and ``b``; links have
    no direction, repeated ones and loops are fine, those with a null are left
    out. Large-star and small-star rounds alternate until nothing changes; the
    number of rounds grows with the logarithm of a component's diameter. A round
    joins the links of each node with the least of its neighbours, an aggregate that
    is combined before the shuffle; a node with more than ``hot`` links is dealt to
    several tasks. Each round is staged in the shared folder. An empty table gives an
    empty one.
    """
    held = common.stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(MAX_ROUNDS):
        # large star: neighbours above a node go to the least node around it
        both = held.select("a", "b").unionAll(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        up = held.select(F.col("b").alias("u"), F.col("a").alias("v"))  # v > u
        large = common.join_hot(up, least, "u", F.xxhash64("v"), hot).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its neighbours below it go to the least of those
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        down = common.join_hot(large.select(F.col("a").alias("u"), F.col("b").alias("v")), low, "u", F.xxhash64("v"), hot)
        small = down.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        now = common.stage(small, "links")
        same = now.count() == held.count() and now.exceptAll(held).isEmpty()
        common.discard(held)
        held = now
        if same:
            break
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    return held.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(held.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
