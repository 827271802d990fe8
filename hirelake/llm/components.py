"""Connected components of an edge list, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """(node, root) for each node of an undirected edge list; the root is the least node of its component.

    Alternating large-star and small-star steps: each node links its larger neighbours, then its smaller
    ones, to the least of them. Rounds grow with the logarithm of the largest path. Each round is cut
    from its lineage by a reliable checkpoint; only a count and a checksum come to the driver. Self-loops, repeated
    edges and an empty list are allowed; NULL ends are ignored.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        # large star: every neighbour above the node goes to the least of the node and its neighbours
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima combine before the shuffle, so the centre of a star that holds a third of all nodes is no burden
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the node and its neighbours below it go to the least of them
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        e = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        e = cut(e)
        # the edges as a set: their number and two combinations of different hashes of them
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(1), "v", "u"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
