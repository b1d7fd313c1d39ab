"""Connected components of links between numbers, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.llm.common import pin


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node of its component.

    Each round links every node's larger neighbours to its smallest one (large star), then its smaller ones and
    itself to the smallest (small star); rounds grow with the logarithm of the size. A hub costs no task more
    than others: the smallest neighbour is a partial aggregate, and the join with it splits a hub's links under
    adaptive execution, since neither side is needed in order. Each round's links go to a table.
    """
    now = pin(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # now: a < b in every row
    state = _state(now)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        ways = _both_ways(now)
        low = ways.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = ways.join(low, "a").filter("b > a").select(F.col("m").alias("a"), "b").distinct()
        # large: (m, b) with m < b; the small star works on b's smaller neighbours.
        large = pin(large)
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(low, "b")
        small = joined.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        own = low.select(F.col("m").alias("a"), "b")
        after = pin(small.unionByName(own).distinct())
        new = _state(after)
        now = after
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("root"))
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
