"""Connected components of a link table by large-star / small-star contraction, each round staged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstally.llm.common import discard, stage

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of a link (src, dst), longs: root is the smallest node of its component.

    Every round hangs the larger neighbours of each node on its least neighbour (large star), then the smaller ones on
    the least of them (small star). The links always describe the same components and end as one star each, after
    about log(n) rounds. The number of links never grows; tables of finished rounds are removed. Hubs are aggregated before the exchange (min), and only a
    sum of the links is compared on the driver. Self links are ignored.
    """
    edges = stage(links.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "links")
    last = None
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stage(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        old, edges = edges, stage(small.select("e.u", "e.v").filter("u <> v").distinct(), "links")
        discard(large, old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = stage(stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components")
    discard(edges)
    return found
