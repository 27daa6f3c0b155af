"""Approximate nearest neighbours by a hash-prefix forest.

A tree is a sorted array of long hash strings: the signs of random projections. A query
descends each tree to the entries that share the longest prefix with its own string, and
then ascends in all trees at once, one bit at a time, until enough different candidates
share a prefix of that length in some tree. The candidates are ranked by exact cosine.

The index is dealt to blocks by content, each with its own forest, and the queries to blocks
too; a task holds one block of each. Every vector is indexed. Equal vectors are one entry
with its smallest ids, as many as a result can show, so a hot vector is one entry as well.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import materialize

#: trees, and bits of a hash string
TREES, BITS = 64, 32
#: a query's candidates in a block are at least this share of it; neighbours that stand out
#: less need a larger one (this reaches recall 0.95 on vectors without any clusters)
SHARE = 0.45
#: vectors of an index block, and queries of a query block
INDEX_BLOCK, QUERY_BLOCK = 8192, 4096
SEED = 20240917


def usable(vector: Column) -> Column:
    """Not null, all components finite, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    nonzero = F.exists(vector, lambda x: x != 0)
    return F.coalesce(finite & nonzero, F.lit(False))


def content_key(*columns: str) -> list[Column]:
    """Two hashes that together stand for the content of the columns."""
    return [
        F.xxhash64(*columns).alias("_h1"),
        F.xxhash64(F.lit("second"), *reversed(columns)).alias("_h2"),
    ]


class Forest:
    """Sorted hash strings of the rows of ``vectors`` in every tree."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES) -> None:
        self.trees, bits = trees, BITS
        self.bits = bits
        rng = np.random.default_rng([SEED, vectors.shape[1]])
        self.planes = rng.standard_normal((trees, vectors.shape[1], bits))
        strings = self._strings(vectors)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def _strings(self, vectors: np.ndarray) -> np.ndarray:
        """The hash strings as numbers, first bit highest: trees x vectors."""
        out = np.empty((self.trees, len(vectors)), dtype=np.uint64)
        for t in range(self.trees):
            packed = np.packbits(vectors @ self.planes[t] > 0, axis=1)
            out[t] = packed.copy().view(">u4")[:, 0]
        return out

    def candidates(self, queries: np.ndarray, least: int):
        """For each query the rows that share the longest prefixes, ``least`` of them or more."""
        strings = self._strings(queries)
        n, size = len(queries), self.sorted.shape[1]
        least = min(least, size)
        # ranges of every tree at every prefix length: an upper bound of the candidates
        low = np.empty((self.bits + 1, self.trees, n), dtype=np.int32)
        high = np.empty_like(low)
        for depth in range(self.bits + 1):
            rest = np.uint64((1 << (self.bits - depth)) - 1)
            for t in range(self.trees):
                low[depth, t] = np.searchsorted(self.sorted[t], strings[t] & ~rest, "left")
                high[depth, t] = np.searchsorted(self.sorted[t], strings[t] | rest, "right")
        entries = (high - low).sum(axis=1)
        mask = np.zeros(size, dtype=bool)
        for q in range(n):
            # descend as far as any tree goes, then ascend synchronously
            enough = np.flatnonzero(entries[:, q] >= least)
            depth = int(enough[-1])
            while True:
                mask[:] = False
                for t in range(self.trees):
                    mask[self.order[t, low[depth, t, q] : high[depth, t, q]]] = True
                found = np.flatnonzero(mask)
                if len(found) >= least or depth == 0:
                    break
                depth -= 1
            yield found


def cosines(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines in double precision, the same for equal pairs wherever they stand."""
    dots = (vectors * queries).sum(axis=-1)
    norms = np.sqrt((vectors * vectors).sum(axis=-1)) * np.sqrt((queries * queries).sum(axis=-1))
    return dots / norms


def _cell(queries: pd.DataFrame, index: pd.DataFrame, n: int, share: float) -> pd.DataFrame:
    """The best ``n`` ids of one index block for each query of a query block."""
    columns = ["_h1", "_h2", "vec_id", "score"]
    if queries.empty or index.empty:
        return pd.DataFrame({c: [] for c in columns})
    vectors = np.stack(index["_vec"].to_numpy()).astype(np.float64)
    asked = np.stack(queries["_vec"].to_numpy()).astype(np.float64)
    units = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    ids = index["_ids"].to_numpy()
    forest = Forest(units)
    least = max(int(np.ceil(share * len(index))), 4 * n)
    out: list[tuple] = []
    keys = queries[["_h1", "_h2"]].to_numpy()
    for q, found in enumerate(forest.candidates(asked, least)):
        scores = cosines(asked[q], vectors[found])
        if len(found) > n:
            bar = np.partition(scores, len(found) - n)[len(found) - n]
            found, scores = found[scores >= bar], scores[scores >= bar]
        best = sorted((-s, i) for s, f in zip(scores.tolist(), found.tolist(), strict=True)
                      for i in ids[f])[:n]
        out += [(keys[q, 0], keys[q, 1], i, -s) for s, i in best]
    return pd.DataFrame(out, columns=columns)


def search(df: DataFrame, key: str, vector: str, is_query: Column, n: int = 5,
           share: float = SHARE) -> DataFrame:
    """The ``n`` nearest other rows of every query row: query_id, rank, vec_id, score.

    Nearest is the largest cosine, ties to the smaller id. Null ids take no part, nor do
    vectors that are null, empty, zero, or hold a null or a component that is not finite;
    vectors of different lengths are never compared. A query with fewer candidates gets
    fewer rows. Rows that repeat an id and a vector count once.
    """
    rows = df.select(
        F.col(key).cast("long").alias("_id"), F.col(vector).alias("_vec"), is_query.alias("_asks")
    ).filter(F.col("_id").isNotNull() & usable(F.col("_vec")))
    rows = rows.select("*", *content_key("_vec"))
    smallest = Window.partitionBy("_h1", "_h2").orderBy("_id")
    entries = (
        rows.select("_h1", "_h2", "_id", "_vec")
        .withColumn("_n", F.dense_rank().over(smallest))
        .filter(F.col("_n") <= n + 1)
        .groupBy("_h1", "_h2")
        .agg(F.array_sort(F.collect_set("_id")).alias("_ids"), F.first("_vec").alias("_vec"))
        .withColumn("_dim", F.size("_vec"))
    )
    entries = materialize(entries, "forest-entries")
    asking = materialize(
        rows.filter(F.coalesce("_asks", F.lit(False))).select("_h1", "_h2", "_id").distinct(),
        "forest-queries",
    )
    queries = entries.join(asking.select("_h1", "_h2").distinct(), ["_h1", "_h2"])
    blocks = -(-entries.count() // INDEX_BLOCK) or 1
    query_blocks = -(-asking.count() // QUERY_BLOCK) or 1
    index = entries.select(
        "_ids", "_vec", "_dim",
        F.pmod("_h1", F.lit(blocks)).cast("int").alias("_block"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("_asked"),
    )
    asked = queries.select(
        "_h1", "_h2", F.col("_vec").alias("_vec"), F.col("_dim").alias("_dim"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"),
        F.pmod("_h2", F.lit(query_blocks)).cast("int").alias("_asked"),
    )
    cell = ["_block", "_asked", "_dim"]
    wanted = n + 1  # the query itself is among them

    def work(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        return _cell(q, i, wanted, share)

    near = (
        asked.groupBy(*cell)
        .cogroup(index.groupBy(*cell))
        .applyInPandas(work, "_h1 long, _h2 long, vec_id long, score double")
    )
    order = [F.desc("score"), F.asc("vec_id")]
    of_content = Window.partitionBy("_h1", "_h2").orderBy(*order)
    best = near.withColumn("_n", F.row_number().over(of_content)).filter(F.col("_n") <= wanted)
    own = best.join(asking, ["_h1", "_h2"]).filter(F.col("_id") != F.col("vec_id"))
    of_query = Window.partitionBy("_id").orderBy(*order)
    return (
        own.withColumn("rank", F.row_number().over(of_query))
        .filter(F.col("rank") <= n)
        .select(F.col("_id").alias("query_id"), "rank", "vec_id", "score")
    )
