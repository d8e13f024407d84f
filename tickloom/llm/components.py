"""Connected components of a link table, as joins and groupings in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links(a, b): component is the smallest id that links reach.

    Large-star and small-star steps in turn: each node hangs its larger neighbours, then its smaller ones and
    itself, below its smallest neighbour. Links shrink to stars in about log n rounds, however long the chains.
    Every round is written to the shared folder. Nothing is collected but a count and a checksum a round.
    """
    links = materialize(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = links.union(links.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # a node's minimum is summed in the map tasks; a hub's links meet it in a join that Spark can split
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").union(low.select("a", F.col("m").alias("b"))).distinct()
        new = materialize(small)
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(links)
        links = new
        if now == seen or not now[0]:
            break
        seen = now
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(links.select(F.col("b"), F.col("b"))).distinct()
