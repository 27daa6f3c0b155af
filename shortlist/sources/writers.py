"""Writers. Everything is Parquet but the metric log, which is JSON Lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_index(
    embeddings: DataFrame, path: str, converted: bool = False, mode: str = "errorifexists"
) -> None:
    """Store an embedding index, sorted by id inside each file.

    Vectors are kept as 4-byte floats, or as they are if ``converted`` says that they are
    quantized. The key travels with its vector, so there is no id mapping to keep aligned.
    """
    vec = F.col("vec") if converted else F.col("vec").cast("array<float>")
    index = embeddings.select("paper_id", vec.alias("vec"))
    index.sortWithinPartitions("paper_id").write.mode(mode).parquet(path)


def write_postings(
    postings: DataFrame, doc_stats: DataFrame, path: str, mode: str = "errorifexists"
) -> None:
    """Store a lexical index. Sorting by term lets readers skip row groups."""
    postings.sortWithinPartitions("term", "paper_id").write.mode(mode).parquet(f"{path}/postings")
    doc_stats.write.mode(mode).parquet(f"{path}/doc_stats")


def write_block_index(index: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store a block-max index. A file holds whole parts, sorted so that readers skip terms."""
    index.sortWithinPartitions("term", "part").write.mode(mode).parquet(path)


def write_candidates(candidates: DataFrame, path: str, mode: str = "errorifexists") -> None:
    candidates.write.mode(mode).parquet(path)


def write_hits(hits: DataFrame, path: str, slice_name: str = "all") -> None:
    """Store labelled ranked lists; each sliced run has its own partition, which a rerun replaces."""
    sliced = hits.withColumn("slice", F.lit(slice_name)).write.partitionBy("slice")
    sliced.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def append_metrics(metrics: DataFrame, path: str, **tags: str) -> None:
    """Append metric rows, with the time and any tags, to a JSON Lines log."""
    record = metrics.withColumn("logged_at", F.current_timestamp())
    for name, value in tags.items():
        record = record.withColumn(name, F.lit(value))
    record.write.mode("append").json(path)
