"""Nearest neighbours where every query has documents of its own to choose from.

Documents are dealt to parts and queries to blocks, as for the plain search over a grid. In a part the
documents are numbered by id, and what a query may see there is a compressed list of numbers: a
bitmap or the bare numbers, whichever is shorter. A query travels once to each part that holds
a document of it, a document once to each query block, and a pair never: its score is made
where the two meet, and only the best ``n`` of a query leave the cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

#: pairs that a cell holds on average, at most
CELL_PAIRS = 2_000_000
#: pairs scored at a time
CHUNK_PAIRS = 65_536


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Ascending numbers from 0 as a bitmap (first byte 1) or as 32-bit integers (0)."""
    if not len(numbers):
        return b"\0"
    if int(numbers[-1]) // 8 + 1 < 4 * len(numbers):
        bits = np.zeros(int(numbers[-1]) + 1, dtype=np.uint8)
        bits[numbers] = 1
        return b"\1" + np.packbits(bits, bitorder="little").tobytes()
    return b"\0" + numbers.astype("<i4").tobytes()


def unpack_numbers(packed: bytes) -> np.ndarray:
    """The numbers of :func:`pack_numbers`."""
    body = np.frombuffer(packed, dtype=np.uint8, offset=1)
    if packed[:1] == b"\1":
        return np.flatnonzero(np.unpackbits(body, bitorder="little"))
    return body.view("<i4").astype(np.int64)


def _packed(pairs: DataFrame, docs: DataFrame, parts: int) -> DataFrame:
    """``(query_id, part, allowed)``: the numbers that each query may see in each part."""
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    numbered = docs.select("id", part.alias("part")).withColumn(
        "number", F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    )
    lists = (
        pairs.join(numbered.withColumnRenamed("id", "paper_id"), "paper_id")
        .groupBy("query_id", "part")
        .agg(F.array_sort(F.collect_list("number")).alias("numbers"))
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.asarray(lists.value_lengths())).tolist()
            packed = [pack_numbers(flat[a:b]) for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(packed, type=pa.binary())],
                ["query_id", "part", "allowed"],
            )

    return lists.mapInArrow(pack, "query_id string, part int, allowed binary")


class _Cell:
    """One query block and one part: scores of the allowed pairs, as documents come by in order."""

    def __init__(self, rows: pa.Table, matrix, n: int) -> None:
        self.ids = rows["id"].combine_chunks()
        self.queries, self.n = matrix(rows["vec"]), n
        numbers = [unpack_numbers(a) for a in rows["allowed"].to_pylist()]
        query = np.repeat(np.arange(len(numbers)), [len(x) for x in numbers])
        number = np.concatenate(numbers)
        order = np.argsort(number, kind="stable")
        self.query, self.number = query[order], number[order]
        self.score = np.full(len(order), -np.inf)
        self.docs: list[pa.Array] = []
        self.seen = 0

    def add(self, ids: pa.Array, docs: np.ndarray, score) -> None:
        lo, hi = np.searchsorted(self.number, [self.seen, self.seen + len(ids)])
        for a in range(lo, hi, CHUNK_PAIRS):
            b = min(a + CHUNK_PAIRS, hi)
            self.score[a:b] = score(
                self.queries[self.query[a:b]], docs[self.number[a:b] - self.seen]
            )
        self.docs.append(ids)
        self.seen += len(ids)

    def best(self, digits: int) -> pa.RecordBatch:
        """The best ``n`` of each query; of equal scores the lower ids."""
        with np.errstate(invalid="ignore"):
            shown = np.where(np.isfinite(self.score), np.round(self.score, digits), -np.inf)
        able = np.flatnonzero(shown > -np.inf)
        order = able[np.lexsort((self.number[able], -shown[able], self.query[able]))]
        query = self.query[order]
        first = np.searchsorted(query, query)
        order = order[np.arange(len(order)) - first < self.n]
        ids = pa.chunked_array(self.docs, type=pa.string()).combine_chunks()
        return pa.record_batch(
            {
                "query_id": self.ids.take(pa.array(self.query[order])),
                "paper_id": ids.take(pa.array(self.number[order])),
                "score": pa.array(self.score[order]),
            }
        )


def best_allowed(
    queries: DataFrame, docs: DataFrame, allowed: DataFrame, n: int, matrix, score, digits: int,
    part_rows: int, min_parts: int, cell_pairs: int = CELL_PAIRS,
) -> DataFrame:
    """The best ``n`` allowed documents of each query and cell: ``query_id``, ``paper_id``, ``score``.

    ``queries(id, vec)``, ``docs(id, vec)``, ``allowed(query_id, paper_id)``; ``matrix`` turns a
    column of vectors into rows, ``score`` two equally long lists of rows into numbers.
    Pairs whose query or document does not exist are left out, as are scores that are not
    finite.
    """
    pairs = materialize(
        allowed.select(
            F.col("query_id").cast("string"), F.col("paper_id").cast("string")
        ).distinct(),
        "allowed",
    )
    n_parts = max(min_parts, math.ceil(docs.count() / part_rows))
    n_blocks = max(1, math.ceil(pairs.count() / (n_parts * cell_pairs)))
    packed = _packed(pairs, docs, n_parts).withColumnRenamed("query_id", "id")
    block = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block")
    none = F.lit(None).cast("binary").alias("allowed")
    query_cells = queries.join(packed, "id").select(
        "part", block, F.lit(0).alias("side"), "id", "vec", "allowed"
    )
    part = F.pmod(F.xxhash64("id"), F.lit(n_parts)).cast("int").alias("part")
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    doc_cells = docs.select(part, every, F.lit(1).alias("side"), "id", "vec", none)
    grid = (
        query_cells.unionByName(doc_cells)
        .repartitionById(n_parts * n_blocks, F.col("part") * n_blocks + F.col("block"))
        .sortWithinPartitions("part", "block", "side", "id")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, cell = None, [], None
        for batch in batches:
            keys = np.stack([batch[c].to_numpy() for c in ("part", "block", "side")], axis=1)
            cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if lo == hi:
                    continue
                here, rows = tuple(keys[lo, :2].tolist()), batch.slice(lo, hi - lo)
                if here != at:
                    if cell is not None:
                        yield cell.best(digits)
                    at, waiting, cell = here, [], None
                if keys[lo, 2] == 0:
                    waiting.append(rows)
                elif waiting:
                    cell = cell or _Cell(pa.Table.from_batches(waiting), matrix, n)
                    cell.add(rows["id"], matrix(rows["vec"]), score)
        if cell is not None:
            yield cell.best(digits)

    return grid.mapInArrow(run, "query_id string, paper_id string, score double")
