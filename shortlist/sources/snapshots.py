"""A stored embedding index that is refreshed bucket by bucket and read as a snapshot.

Rows lie in buckets by a hash of their id. A refresh writes the buckets that it touches to a
folder of their own and then a new version: a small table that says which folder holds which
bucket. Nothing is overwritten, so readers of an older version go on undisturbed, and a
refresh that dies before its version is complete changes nothing that anyone reads.

``path/buckets/<write>/bucket=<k>/`` holds rows, ``path/versions/<version>/`` the tables.
"""

from __future__ import annotations

import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize
from . import schemas

VERSION = "bucket int, folder string, n_buckets int"
#: present in a folder that a Spark job has written to its end
COMPLETE = "_SUCCESS"


def _children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if it does not exist."""
    place, system = _place(spark, path)
    if not system.exists(place):
        return []
    return [status.getPath().getName() for status in system.listStatus(place)]


def _place(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of an index, in order."""
    names = [name for name in _children(spark, f"{path}/versions") if name.isdigit()]
    done = [n for n in names if COMPLETE in _children(spark, f"{path}/versions/{n}")]
    return sorted(int(n) for n in done)


def _bucket(n_buckets: int) -> Column:
    return F.pmod(F.xxhash64("paper_id"), F.lit(n_buckets)).cast("int")


def _write_rows(rows: DataFrame, path: str, n_buckets: int) -> dict[int, str]:
    """Write rows to a new folder; the folder of every bucket that has any."""
    folder = uuid.uuid4().hex
    placed = rows.select("paper_id", F.col("vec").cast("array<float>").alias("vec"))
    placed = placed.withColumn("bucket", _bucket(n_buckets)).repartition("bucket")
    sorted_rows = placed.sortWithinPartitions("bucket", "paper_id")
    sorted_rows.write.partitionBy("bucket").parquet(f"{path}/buckets/{folder}")
    names = _children(rows.sparkSession, f"{path}/buckets/{folder}")
    return {int(n.split("=")[1]): folder for n in names if n.startswith("bucket=")}


def _write_version(spark: SparkSession, path: str, held: dict[int, str], n_buckets: int) -> int:
    """Make a new version known; this is what ends a write."""
    taken = [int(n) for n in _children(spark, f"{path}/versions") if n.isdigit()]
    version = max(taken, default=0) + 1
    # the row without a bucket keeps the number of buckets of an index without rows
    rows = [(None, None, n_buckets), *((b, f, n_buckets) for b, f in sorted(held.items()))]
    table = spark.createDataFrame(rows, VERSION).coalesce(1)
    table.write.mode("errorifexists").parquet(f"{path}/versions/{version:010d}")
    return version


def _held(spark: SparkSession, path: str, version: int | None) -> tuple[dict[int, str], int]:
    """The folder of every bucket, one short row each, and the number of buckets."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"no complete version {'' if version is None else version} in {path}")
    name = f"{known[-1] if version is None else version:010d}"
    rows = spark.read.schema(VERSION).parquet(f"{path}/versions/{name}").collect()
    return {r.bucket: r.folder for r in rows if r.bucket is not None}, rows[0].n_buckets


def _read_buckets(spark: SparkSession, path: str, held: dict[int, str]) -> DataFrame:
    if not held:
        return spark.createDataFrame([], schemas.EMBEDDINGS)
    places = [f"{path}/buckets/{folder}/bucket={b}" for b, folder in sorted(held.items())]
    return spark.read.schema(schemas.EMBEDDINGS).parquet(*places)


def write_snapshot(embeddings: DataFrame, path: str, n_buckets: int) -> int:
    """Store ``(paper_id, vec)`` in ``n_buckets`` buckets as a new version; returns its number.

    A bucket is what a refresh rewrites at least, and one file: take as many as make files of
    some 100 MB. Rows that repeat an id are all kept.
    """
    held = _write_rows(embeddings, path, n_buckets)
    return _write_version(embeddings.sparkSession, path, held, n_buckets)


def refresh_snapshot(path: str, changed: DataFrame, removed: DataFrame | None = None) -> int:
    """A new version in which the rows of ``changed(paper_id, vec)`` replace those of their ids.

    Ids that the index lacks are added; those of ``removed(paper_id)`` that are not in
    ``changed`` go. Only buckets with such ids are read and written. Versions are meant for one
    writer at a time: of two that end together one fails, and its rows stay unread.
    """
    spark = changed.sparkSession
    held, n_buckets = _held(spark, path, None)
    rows = materialize(changed.select("paper_id", "vec"), "changed-vectors")
    ids = rows.select("paper_id")
    if removed is not None:
        ids = materialize(ids.union(removed.select("paper_id")), "changed-ids")
    # at most n_buckets numbers
    touched = {r[0] for r in ids.select(_bucket(n_buckets)).distinct().collect()}
    before = {b: folder for b, folder in held.items() if b in touched}
    kept = _read_buckets(spark, path, before).join(ids, "paper_id", "left_anti")
    new = _write_rows(kept.union(rows), path, n_buckets)
    rest = {b: folder for b, folder in held.items() if b not in touched}
    return _write_version(spark, path, {**rest, **new}, n_buckets)


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version (the last complete one), whatever is written meanwhile."""
    return _read_buckets(spark, path, _held(spark, path, version)[0])
