"""Queries from contexts, and ranked candidate lists without the citing paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as T
from .skew import needed

EXCLUDE = ("never", "always", "unless_positive")


def missing_contexts(corpus: DataFrame, contexts: DataFrame) -> DataFrame:
    """Corpus rows whose context does not exist."""
    return corpus.join(contexts.select("context_id"), "context_id", "left_anti")


def resolve_contexts(corpus: DataFrame, contexts: DataFrame, strict: bool = False) -> DataFrame:
    """Corpus rows with their context. ``strict`` fails on a missing one, at run time."""
    if not strict:
        return corpus.join(contexts, "context_id")
    marked = contexts.withColumn("_known", F.lit(True))
    found = F.when(F.col("_known"), F.col("context_id")).otherwise(
        F.raise_error(F.concat(F.lit("unknown context: "), F.col("context_id")))
    )
    joined = corpus.join(marked, "context_id", "left")
    return joined.withColumn("context_id", found).drop("_known")


def resolve_papers(df: DataFrame, papers: DataFrame, key: str) -> DataFrame:
    """Add ``title`` and ``abstract`` of the paper in column ``key``; "" if missing."""
    info = papers.select(F.col("paper_id").alias(key), "title", "abstract")
    return (
        df.join(needed(info, df, key), key, "left")
        .withColumn("title", T.or_empty(F.col("title")))
        .withColumn("abstract", T.or_empty(F.col("abstract")))
    )


def context_queries(
    corpus: DataFrame, contexts: DataFrame, papers: DataFrame, strict: bool = False
) -> DataFrame:
    """One query per corpus row, with the citing paper's text and the positives."""
    resolved = resolve_papers(resolve_contexts(corpus, contexts, strict), papers, "citing_id")
    return resolved.select(
        F.col("context_id").alias("query_id"),
        "citing_id",
        "positive_ids",
        F.col("title").alias("citing_title"),
        F.col("abstract").alias("citing_abstract"),
        F.col("masked_text").alias("local_context"),
    )


def query_document(queries: DataFrame) -> Column:
    return T.query_paragraphs(
        queries["citing_title"], queries["citing_abstract"], queries["local_context"]
    )


def drop_citing(candidates: DataFrame, queries: DataFrame, n: int, exclude: str) -> DataFrame:
    """Take the citing paper out of each list, close the gap, keep ``n``.

    ``always`` does so for every query; ``unless_positive`` keeps it where it is one of
    the positives.
    """
    if exclude not in EXCLUDE:
        raise ValueError(f"unknown exclusion rule {exclude!r}")
    if exclude == "never":
        return candidates.filter(F.col("rank") <= n)
    barred = queries
    if exclude == "unless_positive":
        barred = barred.filter(~F.array_contains("positive_ids", F.col("citing_id")))
    # one row per query: joining on the query alone keeps the lists where they are
    citing = barred.select("query_id", F.col("citing_id").alias("_citing"))
    order = Window.partitionBy("query_id").orderBy("rank")
    return (
        candidates.join(citing, "query_id", "left")
        .filter(F.col("_citing").isNull() | (F.col("paper_id") != F.col("_citing")))
        .drop("_citing")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
    )


def candidates_from_lists(corpus: DataFrame) -> DataFrame:
    """``(query_id, paper_id, rank)`` from the stored lists of corpus rows.

    The inverse of :func:`with_candidates`. Ranks count from 1 in list order; an empty or
    missing list gives no row, and of a paper that a list repeats the first place counts.
    """
    listed = corpus.select(
        F.col("context_id").alias("query_id"),
        F.posexplode(F.array_distinct("prefetched_ids")).alias("_place", "paper_id"),
    )
    return listed.select("query_id", "paper_id", (F.col("_place") + 1).alias("rank"))


def with_candidates(corpus: DataFrame, candidates: DataFrame) -> DataFrame:
    """Corpus rows with ``prefetched_ids`` in rank order; an empty list if there is none.

    Ranked lists have a fixed length, so what is gathered per query is bounded.
    """
    lists = (
        candidates.groupBy(F.col("query_id").alias("context_id"))
        .agg(F.array_sort(F.collect_list(F.struct("rank", "paper_id"))).alias("_ranked"))
        .select("context_id", F.transform("_ranked", lambda r: r["paper_id"]).alias("_ids"))
    )
    empty = F.array().cast("array<string>")
    return (
        corpus.drop("prefetched_ids")
        .join(lists, "context_id", "left")
        .withColumn("prefetched_ids", F.coalesce("_ids", empty))
        .drop("_ids")
    )
