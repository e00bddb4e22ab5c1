"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, keep, tasks_for

#: Links above which grouped minima are written before they are joined, so that both sides of the join are plain
#: exchanges and adaptive execution can split a hub.  Below it one task holds all links of a hub with ease.
LARGE = 1_000_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another; root is the least node reached.

    Each step is a grouped minimum (combined before the shuffle) and a join; the loop ends when a step changes nothing.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = keep(edges, "cc")
    n = edges.count()
    tasks = tasks_for(n, links.sparkSession)
    old: list[DataFrame] = [edges]

    def lowest(df: DataFrame, m) -> DataFrame:
        low = df.groupBy("u").agg(m.alias("m")).coalesce(tasks)
        if n > LARGE:
            low = keep(low, "cc-low")
            old.append(low)
        return low.hint("merge")

    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = lowest(both, F.least(F.min("v"), F.col("u")))
        large = both.where("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").coalesce(tasks).distinct().coalesce(tasks)
        if n > LARGE:
            large = keep(large, "cc-large")
            old.append(large)
        small = large.join(lowest(large, F.min("v")), "u")
        down = small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = down.unionByName(small.select("u", F.col("m").alias("v"))).where("u != v")
        edges = keep(down.coalesce(tasks).distinct(), "cc", tasks=tasks)
        drop(*old)
        old = [edges]
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
    out.folio_tables = [edges]  # for drop()
    return out
