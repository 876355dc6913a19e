"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a grouped minimum (combined map-side) and one join back; its result is written to the shared
folder, so lineage stays short. No neighbourhood is ever gathered in one place: a hub is a skewed join key,
which adaptive execution splits. The number of rounds follows the logarithm of the longest chain.
"""

from pyspark.sql import DataFrame, functions as F

from homestream.llm.common import drop_written, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b): every node hangs its larger (large star) or smaller neighbours on their minimum."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("_n"), F.least("a", "low").alias("low"))
    met = both.join(low, F.col("a") == F.col("_n"))
    if large:
        out = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        own = low.select(F.col("_n").alias("a"), F.col("low").alias("b"))
        out = met.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(own)
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a bigint, b bigint) -> (node, root): the smallest node that each node can reach.

    Nodes without a link, self-links and nulls don't appear. An empty table gives an empty result.
    """
    now = written(edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before, old = mark, now
        now = written(_star(_star(now, True), False), "links")
        drop_written(old)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
