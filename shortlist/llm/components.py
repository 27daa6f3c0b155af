"""Connected components of a graph in a table of edges, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import materialize

#: rounds after which the input must have been malformed (the number needed is logarithmic)
MOST_ROUNDS = 100


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """The smallest reachable vertex (``component``) of every vertex that has an edge (``vertex``).

    Edges are undirected; loops, repeated edges and edges with a null end change nothing (a
    vertex that has only such edges is not listed). In a round each vertex hands its larger
    neighbours to its smallest one, then its smaller neighbours as well, until every edge
    leads to the smallest vertex of its component. Each round is stored in the shared folder,
    so lineage stays short. A hub's rows meet its minimum in a join that can split it.
    """
    pairs = edges.select(
        F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")
    ).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = materialize(pairs.distinct(), "components")
    state = _state(now)
    for _ in range(MOST_ROUNDS):
        if state[0] == 0:
            break
        now = materialize(_small_star(_large_star(now)), "components")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(roots)


def _state(edges: DataFrame) -> tuple[int, int]:
    mixed = F.pmod(F.xxhash64("u", "v"), F.lit((1 << 31) - 1))
    found = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(mixed), F.lit(0)).alias("h"))
    row = found.collect()[0]
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    larger = both.filter("v > u")
    return larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = (
        edges.join(least, "u")
        .filter("v != m")
        .select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    )
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
