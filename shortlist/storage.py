"""Size checks and intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Session settings the operators are written for. Adaptive execution splits the hot
#: partitions of shuffle joins, also where that costs another exchange, and resizes the
#: number of partitions to the data.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "8192",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8000000",
}

#: Largest table (in rows and bytes) we are willing to copy to every executor.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 256_000_000
#: what a row and a value of fixed width are taken to need in memory
ROW_BYTES, VALUE_BYTES = 32, 8


def apply_settings(spark: SparkSession) -> None:
    """Set :data:`SETTINGS` in a running session."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Another value of a session setting for the jobs that run inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _bytes_of(df: DataFrame) -> Column:
    sizes: list[Column] = [F.lit(ROW_BYTES)]
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        column = F.col(f"`{field.name}`")
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(column), F.lit(0)))
        elif kind.startswith(("array", "map")):
            sizes.append(F.greatest(F.size(column), F.lit(0)) * VALUE_BYTES)
        else:
            sizes.append(F.lit(VALUE_BYTES))
    return reduce(lambda a, b: a + b, sizes).cast("long")


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and about ``max_bytes`` bytes.

    Rows and bytes are summed where they are, one short row per partition is sent on.
    ``df`` should be stored, as it is read for this and again for its use.
    """
    if max_rows <= 0:
        return False
    found = df.agg(F.count("*").alias("n"), F.sum(_bytes_of(df)).alias("size")).first()
    return found["n"] <= max_rows and (found["size"] or 0) <= max_bytes


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables (``spark.checkpoint.dir``).

    Where that is unset, the checkpoint folder of the session is used; only a local
    session without either gets a temporary one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shortlist-"))
    return context.getCheckpointDir()


#: folders that this process has stored tables in
_WRITTEN: list[str] = []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below :func:`scratch_dir`, which :func:`clear_scratch` deletes."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def arrow_place(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path by which Arrow reaches a folder of :func:`scratch_folder`."""
    known = re.match(r"[a-z0-9+.-]+:", folder)
    return fs.FileSystem.from_uri(folder if known else f"file://{folder}")


def clear_scratch(spark: SparkSession) -> int:
    """Delete the folders of :func:`scratch_folder`; returns how many.

    Only folders that this process wrote are touched. Frames that read them are void after.
    """
    context = spark.sparkContext
    paths, _WRITTEN[:] = list(_WRITTEN), []
    for path in paths:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def materialize(
    df: DataFrame, name: str, partition_by: list[str] | None = None, codec: str | None = None
) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and lets every later
    reader prune columns and push filters down. ``codec`` is that of the session if left out.
    """
    path = scratch_folder(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    if codec:
        writer = writer.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
