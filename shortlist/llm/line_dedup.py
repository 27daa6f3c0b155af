"""Removal of lines that several documents share, as keep bitmaps, with DataFrame functions only.

Each line of enough characters becomes a row of its document, its position and two hashes of
its key. The rows are partitioned by ranges of the hash and sorted by hash, document and
position, so a window streams over each hash and its first row names the document that keeps
the line. A hash that very many rows share is cut into slices, which are neighbours in the
order of ranges; the first documents of its slices are combined by a partial aggregation.
No text travels: what goes back to the documents are the positions to drop, stored as a
bitmap in runs.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import free_name, materialize

#: code points that a key has at least
LEAST_LENGTH = 10
#: white space that is stripped from both ends of a line
SPACE = " \t\n\x0b\x0c\r"
#: a hash with more than one in this many rows is cut into slices (so fewer than this many are)
SHARES = 1000
#: rows in this many, by hash, are counted to find such hashes; a miss costs balance, not results
COUNTED = 32


def content_hash(key: str, text: str) -> Column:
    """Tells the rows of one key apart by their texts."""
    return F.xxhash64(F.col(key), F.coalesce(F.col(text), F.lit("")))


def lines_of(text: Column) -> Column:
    """The lines of a text; a null or empty one is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """The key of each line: A-Z in lower case, no white space at either end."""
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.transform(lines_of(lowered), lambda line: F.btrim(line, F.lit(SPACE)))


def keyed_lines(df: DataFrame, key: str, text: str, least: int = LEAST_LENGTH) -> DataFrame:
    """``(_doc, _row, _pos, _h1, _h2)`` of every line long enough, stored; null keys have none."""
    rows = df.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_doc"),
        content_hash(key, text).alias("_row"),
        F.posexplode(line_keys(F.col(text))).alias("_pos", "_line"),
    )
    found = rows.filter(F.length("_line") >= least).select(
        "_doc", "_row", "_pos",
        F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit(12), F.col("_line")).alias("_h2"),
    )
    return materialize(found, "line-keys")


def _slices(lines: DataFrame) -> DataFrame:
    """``(_h1, _slices)`` of the hashes with more than 1 / SHARES of all rows; few and stored."""
    counted = lines.filter(F.pmod(F.xxhash64("_doc", "_row", "_pos"), F.lit(COUNTED)) == 0)
    counts = counted.groupBy("_h1").agg(F.count("*").alias("_n"))
    share = F.ceil(F.col("_n") * SHARES / counted.groupBy().count().scalar()).cast("int")
    return materialize(
        counts.select("_h1", share.alias("_slices")).filter("_slices > 1"), "line-slices"
    )


def dropped_lines(df: DataFrame, key: str, text: str, least: int = LEAST_LENGTH) -> DataFrame:
    """``(_doc, _row, _drop)``: the positions each row loses, ascending; rows that lose some."""
    lines = keyed_lines(df, key, text, least)
    slices = F.broadcast(_slices(lines))
    slice_of = F.pmod(F.xxhash64("_doc", "_row", "_pos"), F.coalesce("_slices", F.lit(1)))
    placed = lines.join(slices, "_h1", "left").withColumn("_slice", slice_of)
    # first documents of the hashes in slices: as few rows as there are such hashes
    owners = (
        lines.join(slices, "_h1").groupBy("_h1", "_h2").agg(F.min("_doc").alias("_owner"))
    )
    owners = materialize(owners, "line-owners").withColumnsRenamed({"_h1": "_o1", "_h2": "_o2"})
    ranged = placed.repartitionByRange("_h1", "_slice").sortWithinPartitions(
        "_h1", "_h2", "_slice", "_doc", "_row", "_pos"
    )
    stream = Window.partitionBy("_h1", "_h2", "_slice").orderBy("_doc", "_row", "_pos")
    first = ranged.withColumn("_first", F.first("_doc").over(stream))
    many = F.col("_slices").isNotNull()
    owned = first.join(
        F.broadcast(owners),
        many & (F.col("_h1") == F.col("_o1")) & (F.col("_h2") == F.col("_o2")),
        "left",
    )
    return (
        owned.filter(F.col("_doc") > F.coalesce("_owner", "_first"))
        .groupBy("_doc", "_row")
        .agg(F.array_sort(F.collect_set("_pos")).alias("_drop"))
    )


def _run_ends(dropped: DataFrame) -> DataFrame:
    """Add ``_starts`` and ``_ends``, the first and last position of each run in ``_drop``."""
    before = F.filter("_drop", lambda x, i: (i == 0) | (F.get("_drop", i - 1) != x - 1))
    last = F.size("_drop") - 1
    after = F.filter("_drop", lambda x, i: (i == last) | (F.get("_drop", i + 1) != x + 1))
    return dropped.select("_doc", "_row", F.size("_drop").alias("_dropped"),
                          before.alias("_starts"), after.alias("_ends"))


def _kept_runs(lines: Column) -> Column:
    """The runs of kept lines that lie before, between and after the dropped runs."""
    none = F.array().cast("array<int>")
    begins = F.transform(F.coalesce("_ends", none), lambda x: x + 1)
    runs = F.zip_with(
        F.concat(F.array(F.lit(0)), begins),
        F.concat(F.coalesce("_starts", none), F.array(lines)),
        lambda begin, end: F.struct(begin.alias("start"), (end - begin).alias("length")),
    )
    return F.filter(runs, lambda run: run.length > 0)


def keep_bitmaps(df: DataFrame, key: str, text: str, least: int = LEAST_LENGTH) -> DataFrame:
    """One row per row of ``df``: key, ``text_hash``, ``n_lines``, ``n_dropped``, ``keep``.

    A line whose key has at least ``least`` code points and is found in two documents or more
    (two values of the key column) is dropped, except all its lines in the smallest document.
    ``keep`` is the bitmap of kept lines as its runs of ones (``start``, ``length``; ascending,
    none if all lines go). A null or empty text is one empty line. Rows with a null key keep all lines and hold none back in other
    documents. Rows that repeat a key are one document, so a line in both stays in both (and is
    dropped in both if a smaller document has it); ties cannot arise otherwise. Keys are
    compared by 128 bits of hash. An empty table gives no rows; other columns are dropped.
    """
    dropped = _run_ends(dropped_lines(df, key, text, least))
    rows = df.select(
        F.col(key).alias("_key"),
        content_hash(key, text).alias("text_hash"),
        F.size(lines_of(F.col(text))).alias("n_lines"),
    )
    met = rows.join(
        dropped, (F.col("_key") == F.col("_doc")) & (F.col("text_hash") == F.col("_row")), "left"
    )
    return met.select(
        F.col("_key").alias(key),
        "text_hash",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.coalesce("_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        _kept_runs(F.col("n_lines")).alias("keep"),
    )


def drop_lines(df: DataFrame, key: str, text: str, bitmaps: DataFrame) -> DataFrame:
    """``df`` with ``text`` cut down to its kept lines, and ``n_lines`` and ``n_dropped``.

    ``bitmaps`` are those of :func:`keep_bitmaps` for the same rows. Only texts that lose lines
    are taken apart. A null text becomes an empty one, unless nothing of it would change:
    then it stays as it is. Columns named like the added ones are replaced.
    """
    names = {n: free_name(df, f"_{n}") for n in ("key", "hash", "keep", "dropped")}
    cut = (
        bitmaps.filter("n_dropped > 0")
        .dropDuplicates([key, "text_hash"])
        .select(
            F.col(key).alias(names["key"]), F.col("text_hash").alias(names["hash"]),
            F.col("keep").alias(names["keep"]), F.col("n_dropped").alias(names["dropped"]),
        )
    )
    same = (F.col(key) == F.col(names["key"])) & (content_hash(key, text) == F.col(names["hash"]))
    met = df.join(cut, same, "left")
    lines, count = free_name(df, "_lines"), F.coalesce(names["dropped"], F.lit(0).cast("long"))
    # the list of lines is a column of its own, so that it is made once and not for each run
    met = met.withColumn(lines, lines_of(F.col(text))).withColumn(
        "n_lines", F.size(lines).cast("long")
    )
    runs = F.transform(
        names["keep"], lambda run: F.slice(lines, run.start + 1, run.length)
    )
    short = F.array_join(F.flatten(runs), "\n")
    shown = F.when(F.col(names["keep"]).isNull(), F.col(text)).otherwise(short)
    return met.withColumns({"n_dropped": count, text: shown}).drop(lines, *names.values())
