"""Connected components of links, as DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.session import stored


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) of every id in ``links`` (a, b); the component is its smallest id.

    Alternates large-star and small-star steps: every node hangs its larger
    neighbours, then its smaller ones, on the smallest node it sees. Minima
    are partial aggregates, so a hub does not meet in one task, and the number
    of edges never grows. Each round is written to the shared folder, which
    cuts the lineage; rounds end when the edges no longer change.
    """
    edges = stored(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = stored(small.select("e.a", "e.b").filter("a != b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
