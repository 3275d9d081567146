"""Connected components of a large graph, by alternating large and small stars.

Each round replaces the neighbours of every node by edges to its least neighbour; the edges end as
stars around the least node of each component. Every step is an aggregate and a join.
"""

from pyspark.sql import functions as F


def _large_star(edges):
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges):
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    rest = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges, shared):
    """(a, b): each node and the least node of its component, which itself is not listed.

    ``edges``: columns a and b of any type with an order; loops and repeated edges do no harm.
    ``shared`` stores a table where all executors reach it and reads it back, once a round.
    """
    edges, before = shared(edges.where("a <> b").distinct()), None
    while True:
        edges = shared(_small_star(_large_star(edges).where("a <> b").distinct()).where("a <> b").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges
        before = state
