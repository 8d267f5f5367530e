"""Connected components of links by alternating large-star and small-star steps, as joins and aggregates.

Each round is stored in the shared folder; no link or label goes to the driver, only the count and checksum that tell
whether a round has changed anything. A node with very many links is one row per task in the aggregates, and the joins
are plain equi-joins that adaptive execution splits where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.shared import discard, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0])


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: a, b (bigint, a != b). One row per node that has a link: node, root (the least node of its component)."""
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    state = _state(edges)
    for _ in range(most_rounds if state[0] else 0):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a")
        done = small.select(F.greatest("b", "m").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(small_least.select("a", F.col("m").alias("b"))).distinct()
        before, edges = edges, stored(done, "stars")
        discard(before)
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        if state[0]:
            raise RuntimeError("components did not converge")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
