"""From raw documents to packed training sequences: four operators of ``shortlist.llm`` in a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shortlist.llm import stages
from shortlist.llm.batches import materialize

STAGES = [
    ("language ID", stages.keep_identified),
    ("n-gram Jaccard join", stages.drop_near_duplicates),
    ("secret scans", stages.mask_secrets),
    ("packing", stages.pack_tokens),
]
#: languages, similarity groups and packing have no SQL form; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each but the last is written and read again.

    What each stage does with null, empty and repeated rows is stated there; an empty table gives
    an empty result, and other columns than ``doc_id`` and ``text`` do not change it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
