"""Exact nearest neighbours by inner product, over blocks of vectors.

Every query has to meet every document, so the work is a matrix product and the plan
decides what moves:

* few queries (a checked bound): the query matrix is copied to the executors and the
  documents are scored where they are scanned, without a shuffle;
* many queries: both sides are cut into blocks on a grid, each cell receives one query
  block and one document part, and tasks stream the documents past the query block. How
  many parts and blocks there are follows from the bytes that their copies take.

Either way a task emits only rows that can still be among its best ``n`` per query, and
a window with ``row_number() <= n`` merges tasks (Spark prunes that before the shuffle).
Ties on the score, rounded to nine digits, go to the lower id at each step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..storage import materialize
from .grid import grid_shape
from .restricted import best_allowed

SCORE_DIGITS = 9
#: documents scored in one matrix product
CHUNK_ROWS = 8192
#: queries scored in one matrix product
QUERY_ROWS = 1024
#: largest query table copied to every executor, and its largest running state (rows * n)
BROADCAST_QUERIES = 16_384
BROADCAST_STATE = 1 << 24
#: documents per grid part and queries per grid block, at most
PART_ROWS, BLOCK_ROWS = 1_000_000, 32_768
#: bytes of a number of a vector and of a row of the result on the way, about
VALUE_BYTES, RESULT_BYTES = 8, 40
#: largest whole number up to which sums of single precision are exact
EXACT_FLOAT = 1 << 24

RESULT = "query_id string, paper_id string, score double"


def _codes_type(precision: str, dim: int) -> type:
    """Single precision where inner products of codes are small whole numbers."""
    largest = {"bool": 1, "int4": 8**2, "int8": 128**2}.get(precision)
    return np.float32 if largest and largest * dim <= EXACT_FLOAT else np.float64


def _matrix(column: pa.ChunkedArray | pa.Array, precision: str, dim: int) -> np.ndarray:
    """Rows of ``dim`` numbers. Sign bits become -1 and 1."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = array.flatten().to_numpy(zero_copy_only=False)
    if len(array) == 0:
        return np.zeros((0, dim))
    rows = flat.reshape(len(array), -1)
    if precision == "bool":
        chunks = rows.astype("<u4").view(np.uint8).reshape(len(array), -1)
        bits = np.unpackbits(chunks, axis=1, bitorder="little")[:, :dim]
        return bits.astype(_codes_type(precision, dim)) * 2 - 1
    return rows.astype(_codes_type(precision, dim))


def _scores(queries: np.ndarray, docs: np.ndarray, precision: str) -> np.ndarray:
    product = queries @ docs.T
    if precision == "bool":
        # equal bits add one and different bits subtract one
        return (product + queries.shape[1]) / 2.0
    return product


def _best_mask(scores: np.ndarray, n: int) -> np.ndarray:
    """The best ``n`` of each row; among equals, the leftmost."""
    if scores.shape[1] <= n:
        return np.ones(scores.shape, dtype=bool)
    cut = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n, None]
    above = scores > cut
    ties = scores == cut
    room = n - above.sum(axis=1, keepdims=True)
    return above | (ties & (np.cumsum(ties, axis=1) <= room))


class _Scan:
    """Scores a stream of documents against one block of queries."""

    def __init__(self, ids: pa.Array, matrix: np.ndarray, n: int, precision: str):
        self.ids, self.matrix, self.n, self.precision = ids, matrix, n, precision
        # best scores so far per query, and the least of them: the score to reach
        self.best = np.full((len(ids), n), -np.inf)
        self.floor = np.full(len(ids), -np.inf)

    def add(self, ids: pa.Array, vecs: pa.Array) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(ids), CHUNK_ROWS):
            chunk_ids = ids.slice(at, CHUNK_ROWS)
            order = pc.sort_indices(chunk_ids)
            chunk_ids = chunk_ids.take(order)
            docs = _matrix(
                vecs.slice(at, CHUNK_ROWS).take(order), self.precision, self.matrix.shape[1]
            )
            for q in range(0, len(self.ids), QUERY_ROWS):
                yield self._score(slice(q, q + QUERY_ROWS), chunk_ids, docs)

    def _score(self, rows: slice, ids: pa.Array, docs: np.ndarray) -> pa.RecordBatch:
        with np.errstate(invalid="ignore", over="ignore"):
            exact = _scores(self.matrix[rows], docs, self.precision)
        floor = self.floor[rows]
        if np.isinf(floor).any():
            query_at, doc_at = self._first(rows, exact)
        else:
            query_at, doc_at = self._later(rows, exact, floor)
        return pa.record_batch(
            {
                "query_id": self.ids.slice(rows.start).take(pa.array(query_at)),
                "paper_id": ids.take(pa.array(doc_at)),
                "score": pa.array(exact[query_at, doc_at].astype(np.float64)),
            }
        )

    def _first(self, rows: slice, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is kept while lists are not full yet: the best of every row."""
        with np.errstate(invalid="ignore"):
            rounded = np.round(exact.astype(np.float64), SCORE_DIGITS)
        scores = np.where(np.isfinite(exact), rounded, -np.inf)
        best = self.best[rows]
        keep = _best_mask(scores, self.n) & (scores >= best.min(axis=1, keepdims=True))
        keep &= scores > -np.inf
        seen = np.concatenate([best, np.where(keep, scores, -np.inf)], axis=1)
        self.best[rows] = np.partition(seen, seen.shape[1] - self.n, axis=1)[:, -self.n :]
        self.floor[rows] = self.best[rows].min(axis=1)
        return np.nonzero(keep)

    def _later(
        self, rows: slice, exact: np.ndarray, floor: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """The same for full lists: only the few scores that reach them are looked at."""
        least = np.nextafter((floor - 10.0**-SCORE_DIGITS).astype(exact.dtype), -np.inf)
        found = np.flatnonzero(exact >= least[:, None])
        query_at, doc_at = np.divmod(found, exact.shape[1])
        scores = np.round(exact[query_at, doc_at].astype(np.float64), SCORE_DIGITS)
        able = np.flatnonzero(np.isfinite(scores) & (scores >= floor[query_at]))
        query_at, doc_at, scores = query_at[able], doc_at[able], scores[able]
        if not len(able):
            return query_at, doc_at
        order = np.lexsort((doc_at, -scores, query_at))
        query_at, doc_at, scores = query_at[order], doc_at[order], scores[order]
        place = np.arange(len(query_at)) - np.searchsorted(query_at, query_at)
        kept = place < self.n
        query_at, doc_at, scores, place = (x[kept] for x in (query_at, doc_at, scores, place))
        hit, line = np.unique(query_at, return_inverse=True)
        added = np.full((len(hit), place.max() + 1), -np.inf)
        added[line, place] = scores
        at = hit + rows.start
        seen = np.concatenate([self.best[at], added], axis=1)
        self.best[at] = np.partition(seen, seen.shape[1] - self.n, axis=1)[:, -self.n :]
        self.floor[at] = self.best[at].min(axis=1)
        return query_at, doc_at


def _keyed(df: DataFrame, key: str, vec: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("id"), F.col(vec).alias("vec"))


def _by_broadcast(queries: pa.Table, docs: DataFrame, n: int, precision: str, dim: int):
    ids = queries["id"].combine_chunks()
    matrix = _matrix(queries["vec"], precision, dim)
    shared = docs.sparkSession.sparkContext.broadcast((ids, matrix))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _Scan(*shared.value, n, precision)
        for batch in batches:
            yield from scan.add(batch["id"], batch["vec"])

    return docs.mapInArrow(score, RESULT)


def _by_grid(
    queries: DataFrame, docs: DataFrame, n: int, precision: str, dim: int,
    part_rows: int, query_rows: int, min_parts: int,
) -> DataFrame:
    n_docs, n_queries = docs.count(), queries.count()
    n_parts, n_blocks = grid_shape(
        min_parts,
        n_docs * dim * VALUE_BYTES,
        n_queries * (dim * VALUE_BYTES + n * RESULT_BYTES),
        (math.ceil(n_docs / part_rows), math.ceil(n_queries / query_rows)),
        (min_parts, n_queries),
    )

    def bucket(n_buckets: int):
        return F.pmod(F.xxhash64("id"), F.lit(n_buckets)).cast("int")

    def every(n_buckets: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n_buckets - 1)))

    query_cells = queries.withColumn("block", bucket(n_blocks)).select(
        every(n_parts).alias("part"), "block", F.lit(0).alias("side"), "id", "vec"
    )
    doc_cells = docs.withColumn("part", bucket(n_parts)).select(
        "part", every(n_blocks).alias("block"), F.lit(1).alias("side"), "id", "vec"
    )
    # one task per cell, so that a task's share does not grow with the data
    grid = (
        query_cells.unionByName(doc_cells)
        .repartitionById(n_parts * n_blocks, F.col("part") * n_blocks + F.col("block"))
        .sortWithinPartitions("part", "block", "side")
    )

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        keys = np.stack([batch[c].to_numpy() for c in ("part", "block", "side")], axis=1)
        starts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        edges = [0, *starts.tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            yield tuple(keys[lo].tolist()), batch.slice(lo, hi - lo)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, scan = None, [], None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for (part, block, side), rows in runs(batch):
                if (part, block) != cell:
                    cell, waiting, scan = (part, block), [], None
                if side == 0:
                    waiting.append(rows)
                elif waiting:
                    if scan is None:
                        block_rows = pa.Table.from_batches(waiting)
                        scan = _Scan(
                            block_rows["id"].combine_chunks(),
                            _matrix(block_rows["vec"], precision, dim),
                            n,
                            precision,
                        )
                    yield from scan.add(rows["id"], rows["vec"])

    return grid.mapInArrow(score, RESULT)


def rank_top(scored: DataFrame, n: int) -> DataFrame:
    """Keep the best ``n`` rows per query, by score and then by id; add ``rank`` from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("_rounded"), "paper_id")
    return (
        scored.withColumn("_rounded", F.round("score", SCORE_DIGITS))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select("query_id", "paper_id", "rank", F.col("score").cast("double").alias("score"))
    )


def _allowed_best(
    queries: DataFrame, docs: DataFrame, allowed: DataFrame, n: int, precision: str, dim: int,
    part_rows: int, min_parts: int,
) -> DataFrame:
    """The best allowed pairs of each grid cell."""

    def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        return _matrix(column, precision, dim)

    def score(queries: np.ndarray, docs: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", over="ignore"):
            product = (queries * docs).sum(axis=1)
        return (product + dim) / 2.0 if precision == "bool" else product

    return best_allowed(
        queries, docs, allowed, n, matrix, score, SCORE_DIGITS, part_rows, min_parts
    )


def knn(
    queries: DataFrame,
    docs: DataFrame,
    n: int,
    dim: int,
    precision: str = "float32",
    allowed: DataFrame | None = None,
    broadcast_queries: int = BROADCAST_QUERIES,
    part_rows: int = PART_ROWS,
    min_parts: int | None = None,
) -> DataFrame:
    """The ``n`` documents with the largest inner product for every query.

    ``queries(query_id, vec)`` and ``docs(paper_id, vec)`` hold vectors of ``dim``
    numbers in the same ``precision``. ``allowed(paper_id)`` restricts the documents of
    all queries, ``allowed(query_id, paper_id)`` those of each query. When there are
    fewer than ``n`` documents all are returned. Pairs whose inner product is not a finite
    number (a vector holds NaN or an infinity) are no neighbours. ``broadcast_queries = 0``
    always takes the grid.
    """
    q, d = _keyed(queries, "query_id", "vec"), _keyed(docs, "paper_id", "vec")
    if min_parts is None:
        min_parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if allowed is not None and "query_id" in allowed.columns:
        best = _allowed_best(q, d, allowed, n, precision, dim, part_rows, min_parts)
        return rank_top(best, n)
    if allowed is not None:
        only = allowed.select(F.col("paper_id").cast("string").alias("id"))
        d = d.join(only, "id", "left_semi")
    limit = min(broadcast_queries, BROADCAST_STATE // n)
    if limit > 0:
        # at most limit + 1 rows of dim numbers ever leave the executors
        head = q.limit(limit + 1).toArrow()
        if head.num_rows <= limit:
            return rank_top(_by_broadcast(head, d, n, precision, dim), n)
    query_rows = max(1, min(BLOCK_ROWS, (BROADCAST_STATE >> 2) // n))
    q = materialize(q, "query-vectors")
    return rank_top(_by_grid(q, d, n, precision, dim, part_rows, query_rows, min_parts), n)
