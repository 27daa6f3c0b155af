"""Readers. Schemas are always given, never inferred.

A format is one of ``parquet``, ``jsonl`` (one record per line) or ``json``. The last
is how such data is usually published: one JSON object keyed by id, or one JSON array. Such a file is
read in blocks in parallel (``json_parts``), which takes a pass of its own when the reader is
called, so convert it to Parquet (see ``writers.write_table``) if it is read often.
Malformed JSON fails the read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .json_parts import read_values
from ..functions import vectors
from ..operators.quantize import quantize


#: broken records raise instead of turning into nulls
STRICT = {"mode": "FAILFAST"}


def _keyed_objects(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """Rows ``(key, value)`` of files holding one JSON object keyed by id."""
    some = F.concat(F.lit("{"), "value", F.lit("}"))
    entries = F.from_json(some, f"map<string,{value_schema}>", STRICT)
    return read_values(spark, path).select(F.explode(entries).alias("key", "value"))


def _objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files holding one JSON array of objects."""
    some = F.concat(F.lit("["), "value", F.lit("]"))
    rows = F.from_json(some, f"array<struct<{schema}>>", STRICT)
    return read_values(spark, path).select(F.inline(rows))


def _table(spark: SparkSession, path: str, schema: str, fmt: str) -> DataFrame:
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    if fmt == "jsonl":
        return spark.read.schema(schema).options(**STRICT).json(path)
    raise ValueError(f"unknown format {fmt!r}")


def read_papers(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "json":
        objects = _keyed_objects(spark, path, "struct<title:string,abstract:string>")
        return objects.select(F.col("key").alias("paper_id"), "value.title", "value.abstract")
    return _table(spark, path, schemas.PAPERS, fmt)


def read_contexts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "json":
        objects = _keyed_objects(
            spark, path, "struct<masked_text:string,citing_id:string,refid:string>"
        )
        return objects.select(
            F.col("key").alias("context_id"), "value.masked_text", "value.citing_id", "value.refid"
        )
    return _table(spark, path, schemas.CONTEXTS, fmt)


def read_corpus(
    spark: SparkSession, path: str, fmt: str = "parquet", candidates: bool = False
) -> DataFrame:
    """One split: query contexts and their positives, optionally with candidate lists."""
    schema = schemas.CORPUS_WITH_CANDIDATES if candidates else schemas.CORPUS
    if fmt == "json":
        return _objects(spark, path, schema)
    return _table(spark, path, schema, fmt)


def read_vocabulary(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _table(spark, path, schemas.VOCABULARY, fmt)


def read_word_vectors(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _table(spark, path, schemas.WORD_VECTORS, fmt)


def read_index(
    spark: SparkSession, path: str, precision: str = "float32", converted: bool = False
) -> DataFrame:
    """An embedding index ``(paper_id, vec)`` ready to search.

    Vectors are scaled to length one and then quantized to ``precision``; ``converted``
    says that the stored vectors already went through both steps.
    """
    if converted:
        return spark.read.parquet(path)
    index = spark.read.schema(schemas.EMBEDDINGS).parquet(path)
    unit = index.select("paper_id", vectors.l2_normalize(F.col("vec")).alias("vec"))
    return quantize(unit, precision)


def read_postings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The postings and the per-document lengths of a lexical index."""
    return (
        _table(spark, f"{path}/postings", schemas.POSTINGS, "parquet"),
        _table(spark, f"{path}/doc_stats", schemas.DOC_STATS, "parquet"),
    )


def read_block_index(spark: SparkSession, path: str) -> DataFrame:
    """The block-max index of a lexical index."""
    return _table(spark, path, schemas.BLOCK_INDEX, "parquet")
