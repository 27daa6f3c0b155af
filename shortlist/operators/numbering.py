"""Row numbering and sampling without a single-partition sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import hashing
from ..storage import materialize

#: largest slice taken by a plain ``ORDER BY .. LIMIT``, which ends in one task
MAX_LIMIT_ROWS = 100_000
#: rows that a bucket holds at most on average; the number of buckets follows from it
BUCKET_ROWS = 100_000


def _number_buckets(df: DataFrame, bucket: str, order: list[str], out: str) -> DataFrame:
    """Number rows 0, 1, .. along (bucket, order), one window partition per bucket.

    Buckets must not depend on how the rows are laid out. Their counts form a table of
    one row per bucket, the only thing that is ordered in a single task.
    """
    counts = df.groupBy(bucket).agg(F.count("*").alias("_n"))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(bucket).orderBy(*order)
    return (
        df.join(offsets, bucket)
        .withColumn(out, F.row_number().over(within) - 1 + F.col("_offset"))
        .drop("_offset")
    )


def dense_index(df: DataFrame, key: str, seed: int = 0, out: str = "row_idx") -> DataFrame:
    """Number rows 0 .. n-1 in the order of a seeded hash of ``key``.

    The leading hash digits name the bucket, so bucket order is hash order and buckets
    hold about equally many distinct keys. There are as many digits as the rows need.
    """
    digits = 1
    n_rows = df.count()
    while n_rows > BUCKET_ROWS * 16**digits:
        digits += 1
    hashed = df.withColumn("_hash", hashing.seeded_hash(seed, F.col(key))).withColumn(
        "_bucket", F.substring("_hash", 1, digits)
    )
    return _number_buckets(hashed, "_bucket", ["_hash", key], out).drop("_hash", "_bucket")


def ordered_index(df: DataFrame, key: str, out: str = "row_idx") -> DataFrame:
    """Number rows 0 .. n-1 in the order of ``key``.

    Range boundaries come from a sample, so the range of each row is written down
    before ranges are counted.
    """
    ranged = df.repartitionByRange(key).withColumn("_range", F.spark_partition_id())
    return _number_buckets(materialize(ranged, "ranges"), "_range", [key], out).drop("_range")


def sample_rows(
    df: DataFrame, key: str, size: int = 0, start: int = 0, shuffle: bool = True, seed: int = 0
) -> DataFrame:
    """The rows of ``size`` keys from position ``start`` (0 = all the rest) in hash or key order.

    Distinct keys are counted, and all rows of a chosen key are taken. Only bare keys are
    ordered or numbered, so whole rows never gather or move for it.
    """
    if size == 0 and start == 0:
        return df
    keys = df.select(key).distinct()
    if size and start + size <= MAX_LIMIT_ROWS:
        order = [F.col(key)]
        if shuffle:
            order.insert(0, hashing.seeded_hash(seed, F.col(key)))
        ordered = keys.orderBy(*order)
        chosen = (ordered.offset(start) if start else ordered).limit(size)
        return df.join(F.broadcast(chosen), key, "left_semi")
    numbered = dense_index(keys, key, seed, "_pos") if shuffle else ordered_index(keys, key, "_pos")
    picked = F.col("_pos") >= start
    if size:
        picked &= F.col("_pos") < start + size
    return df.join(numbered.filter(picked).select(key), key, "left_semi")
