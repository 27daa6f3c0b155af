"""Joins on keys of which a few hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import fits_broadcast, materialize

SLICE = "_slice"
#: a key with more than 1 / SHARES of all rows is cut into slices
SHARES = 1000


def spread_heavy(
    big: DataFrame, small: DataFrame, key: str, salt_by: str, counts: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Add a slice number to both sides, to be joined on ``[key, SLICE]``.

    The rows of a heavy key in ``big`` are dealt to slices by a hash of ``salt_by`` and
    its rows in ``small`` are repeated for each slice. Fewer than ``SHARES`` keys can be
    heavy, so their table is safe to copy to the executors. ``counts(key, df)`` may pass
    the rows per key if they are known.
    """
    if counts is None:
        counts = big.groupBy(key).agg(F.count("*").alias("df"))
    share = counts.agg((F.sum("df") / SHARES).alias("n")).scalar()
    heavy = F.broadcast(
        counts.withColumn("_slices", F.ceil(F.col("df") / share).cast("int"))
        .filter(F.col("_slices") > 1)
        .select(key, "_slices")
    )
    slices = F.coalesce(F.col("_slices"), F.lit(1))
    sliced = F.pmod(F.xxhash64(salt_by), slices).cast("int")
    repeated = F.explode(F.sequence(F.lit(0), slices - 1))
    return (
        big.join(heavy, key, "left").withColumn(SLICE, sliced).drop("_slices"),
        small.join(heavy, key, "left").withColumn(SLICE, repeated).drop("_slices"),
    )


def needed(side: DataFrame, pairs: DataFrame, key: str = "paper_id") -> DataFrame:
    """The rows of ``side`` that ``pairs`` refer to.

    Keys that are few are copied, so that no text is shuffled to meet them; ``pairs`` should
    be stored, as they are read for this. Cut texts down before they are tokenized.
    """
    keys = pairs.select(key).distinct()
    if fits_broadcast(keys):
        keys = F.broadcast(keys)
    return side.join(keys, key, "left_semi")


def lookup(rows: DataFrame, table: DataFrame, key: str, max_rows: int) -> DataFrame:
    """Left join of many rows with a table of one row per key.

    A table of at most ``max_rows`` rows is copied to the executors, so ``rows`` stay
    where they are, and so are its entries for the keys of ``rows`` if these are as few. Beyond
    that, only the entries of the most frequent keys are copied, ``max_rows`` at most; the
    other keys have few rows each and meet their entries in a shuffle. What is copied passes the
    driver, so ``max_rows`` should not follow the size of the data.
    """
    if fits_broadcast(table.select(key), max_rows):
        return rows.join(F.broadcast(table), key, "left")
    rows = materialize(rows, "lookup")
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    counts = materialize(counts, "lookup-counts")
    # how many keys have 1, 2 to 3, 4 to 7, .. rows: a few short rows
    sizes = counts.groupBy((F.length(F.bin("_n")) - 1).alias("size")).agg(F.count("*").alias("n"))
    found = sorted((r["size"], r["n"]) for r in sizes.collect())
    if sum(n for _, n in found) <= max_rows:
        asked = table.join(F.broadcast(counts.select(key)), key, "left_semi")
        return rows.join(F.broadcast(asked), key, "left")
    total, least = 0, None
    for size, n in reversed(found):
        total += n
        if total > max(max_rows, SHARES):
            break
        least = 2**size
    if least is None:  # no key has more than its share
        return rows.join(table, key, "left")
    frequent = F.broadcast(counts.filter(F.col("_n") >= least).select(key))
    head = F.broadcast(table.join(frequent, key, "left_semi"))
    marked = rows.join(frequent.withColumn("_head", F.lit(True)), key, "left")
    done = marked.filter("_head").drop("_head").join(head, key, "left")
    rest = marked.filter("_head is null").drop("_head").join(table, key, "left")
    return done.unionByName(rest)
