"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siltstone.llm import store


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges(a, b)``; label is the component's least node.

    Alternating large-star and small-star steps: every edge is moved towards the least
    node seen, so the number of rounds grows with the logarithm of a chain's length. Each
    round is written to the shared folder. Sums are map-side, so a hub is no hot key for
    the minimum; only edges, never rows of a whole component, are joined.
    """
    def state(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    # each step deals rows out by u once: its minima, join and distinct rows all use that
    cur = store.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    was = state(cur)
    for _ in range(max_rounds):
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition("u")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).repartition("u").distinct()
        nxt = store.table(small, "edges")
        store.drop(cur)
        cur = nxt
        now = state(cur)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    out = cur.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
    out._stored_at = cur._stored_at
    return out
