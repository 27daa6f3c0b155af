"""Reading one huge JSON object or array in parallel.

Spark's text source cuts a file into byte ranges at any separator, so it is read with ``}`` as the
line separator. A ``}`` may stand in a string or close something deeper, and a task that starts in
the middle of a file cannot tell. So each block of a file first says what it does to both states
it may start in (in a string or not), one short row per block; from these follows the
state that every block starts in, and a second pass cuts the blocks where a value of the
outermost object or array ends. What a block border cuts through is put together by a
shuffle of those ends alone. Escapes never reach over a separator, and multi-byte letters
hold none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialize

_ESCAPE = re.compile(r"\\.", re.DOTALL)
_BLOCK = ["file", "block"]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text between separators, in the order of the file inside each block."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        "value",
    )


def _depths(piece: str, inside: bool) -> tuple[int, bool]:
    """How much deeper a piece ends than it starts, and whether it ends in a string."""
    parts = (_ESCAPE.sub("", piece) if "\\" in piece else piece).split('"')
    open_parts = parts[1::2] if inside else parts[::2]
    deeper = sum(p.count("{") + p.count("[") - p.count("]") for p in open_parts)
    return deeper, inside ^ (len(parts) % 2 == 0)


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict, list[str]]]:
    """Rows of one block at a time, in several calls if it reaches over batches."""
    for batch in batches:
        columns = batch.to_pydict()
        at = 0
        for i in range(1, batch.num_rows + 1):
            same = i < batch.num_rows and all(columns[c][i] == columns[c][at] for c in _BLOCK)
            if not same:
                first = {c: columns[c][at] for c in columns if c != "value"}
                yield (first["file"], first["block"]), first, columns["value"][at:i]
                at = i


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: for both start states the depth gained and the state at the end."""
    found: dict[tuple, list] = {}
    for key, first, pieces in _blocks_of(batches):
        # depth and state from outside and from inside a string; bytes; file size
        now = found.setdefault(key, [0, False, 0, True, 0, first["size"]])
        for piece in pieces:
            for at, start in ((0, now[1]), (2, now[3])):
                deeper, inside = _depths(piece, start)
                now[at] += deeper - (not inside)  # the separator closes unless it is in a string
                now[at + 1] = inside
            now[4] += len(piece.encode()) + 1
    names = ["file", "block", "d0", "s0", "d1", "s1", "bytes", "size"]
    rows = [dict(zip(names, (*key, *now))) for key, now in found.items()]
    yield pa.RecordBatch.from_pylist(rows, schema=_SUMMARY_ARROW)


_SUMMARY = "file string, block long, d0 long, s0 boolean, d1 long, s1 boolean, bytes long, size long"
_SUMMARY_ARROW = pa.schema(
    [("file", pa.string()), ("block", pa.int64()), ("d0", pa.int64()), ("s0", pa.bool_()),
     ("d1", pa.int64()), ("s1", pa.bool_()), ("bytes", pa.int64()), ("size", pa.int64())]
)


def _states(pieces: DataFrame) -> dict[tuple[str, int], tuple[int, bool]]:
    """Depth and state at the start of each block; fails on a file that does not end closed."""
    rows = pieces.mapInArrow(_summaries, _SUMMARY).orderBy("file", "block").collect()
    start: dict[tuple[str, int], tuple[int, bool]] = {}
    files: dict[str, list] = {}
    for r in rows:
        depth, inside, length, _ = files.get(r["file"], (0, False, 0, 0))
        start[r["file"], r["block"]] = (depth, inside)
        deeper, after = (r["d1"], r["s1"]) if inside else (r["d0"], r["s0"])
        files[r["file"]] = [depth + deeper, after, length + r["bytes"], r["size"]]
    for name, (depth, inside, length, size) in files.items():
        # the last separator is not there unless the file ends with it; sizes of compressed
        # files tell nothing
        missing = 1 if length == size + 1 else 0
        packed = length not in (size, size + 1)
        if inside or (depth + missing != 0 and not (packed and depth == -1)):
            raise ValueError(f"{name} is not one whole JSON object or array")
    return start


def _opened(text: str, outermost: bool, name: str) -> str:
    """A chunk without the bracket or comma before its first entry."""
    text = text.lstrip("\ufeff \t\r\n")
    if text[:1] in ("{", "[") if outermost else text[:1] in (",", "]", ""):
        return text if text[:1] == "]" else text[1:]
    raise ValueError(f"{name}: no comma before {text[:40]!r}")


_CHUNKS = "file string, block long, place int, first boolean, last boolean, chunk string"


def _chunks(pieces: DataFrame, states: dict[tuple[str, int], tuple[int, bool]]) -> DataFrame:
    """The text of the outermost values, a row each, and of what block borders cut through.

    ``first`` and ``last`` say that a row holds the beginning and the end of its chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, depth, inside, begins, place = None, [], 0, False, True, 0

        def row(last: bool) -> dict:
            text = "".join(held)
            if begins:
                text = _opened(text, key[1] == 0 and place == 0, key[0])
            if last and depth < 0:  # the outer array is closed in here
                text = text.rstrip().removesuffix("]")
            return {"file": key[0], "block": key[1], "place": place, "first": begins,
                    "last": last, "chunk": text}

        for new, _, block in _blocks_of(batches):
            out = []
            if new != key:
                if held:
                    out.append(row(False))
                key, held, place = new, [], 0
                depth, inside = states[new]
                # a file begins a chunk, and so does a block after the end of a value
                begins = new[1] == 0 or (depth == 1 and not inside)
            for piece in block:
                deeper, inside = _depths(piece, inside)
                depth += deeper
                held.append(piece)
                if inside:
                    held.append("}")
                    continue
                depth -= 1
                if depth >= 1:
                    held.append("}")
                if depth <= 1:
                    done = row(True)
                    if done["chunk"].strip() or not begins:
                        out.append(done)
                    held, begins, place = [], True, place + 1
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_CHUNK_ARROW)
        if held:
            yield pa.RecordBatch.from_pylist([row(False)], schema=_CHUNK_ARROW)

    return pieces.mapInArrow(run, _CHUNKS)


_CHUNK_ARROW = pa.schema(
    [("file", pa.string()), ("block", pa.int64()), ("place", pa.int32()), ("first", pa.bool_()),
     ("last", pa.bool_()), ("chunk", pa.string())]
)


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """``value``: strings that each hold some entries of the outermost object or array.

    An entry of an object is ``"key": value``; entries are parted by commas and the outer
    brackets are gone. Every file is one object or one array; a file that is not closed
    fails. Files are read in blocks of ``spark.sql.files.maxPartitionBytes``, unless compressed.
    """
    pieces = _pieces(spark, path)
    chunks = materialize(_chunks(pieces, _states(pieces)), "json-values")
    whole = chunks.filter("first and last").select("chunk")
    # the parts of a cut chunk follow each other; each chunk is known by where it begins
    cut = chunks.filter("not (first and last)")
    begin = F.max(F.when(F.col("first"), F.struct("block", "place")))
    joined = (
        cut.withColumn("_start", begin.over(Window.partitionBy("file").orderBy("block", "place")))
        .groupBy("file", "_start")
        .agg(F.array_sort(F.collect_list(F.struct("block", "place", "chunk"))).alias("parts"))
        .select(F.array_join("parts.chunk", "").alias("chunk"))
    )
    values = whole.unionByName(joined).select(F.col("chunk").alias("value"))
    return values.filter(F.trim("value") != "")
