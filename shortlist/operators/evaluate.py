"""Recall, precision and F1 at K, hit rate, and positions.

One pass over the lists serves all K: ranks are compared with each K in the aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import defaults as D

MODES = ("prefetch", "rerank")


def _require(condition: Column, message: str, value: Column) -> Column:
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))


def _per_query(candidates: DataFrame, queries: DataFrame, ks: Sequence[int], mode: str) -> DataFrame:
    """Hits within each K, and the list's length, for every query with its positives."""
    positives = queries.select(
        "query_id",
        F.explode(F.array_distinct("positive_ids")).alias("paper_id"),
        F.lit(True).alias("_hit"),
    )
    ranked = candidates.select("query_id", "paper_id", "rank")
    if mode == "prefetch":
        # a paper listed twice counts once
        ranked = ranked.groupBy("query_id", "paper_id").agg(F.min("rank").alias("rank"))
    lists = (
        ranked.join(positives, ["query_id", "paper_id"], "left")
        .groupBy("query_id")
        .agg(
            F.count("*").alias("length"),
            *[F.count_if(F.col("_hit") & (F.col("rank") <= k)).alias(f"hit_{k}") for k in ks],
        )
    )
    return queries.join(lists, "query_id", "left")


def evaluate(
    candidates: DataFrame,
    queries: DataFrame,
    ks: Sequence[int] | None = None,
    mode: str = "prefetch",
    strict: bool = False,
) -> DataFrame:
    """``(k, recall, precision, f1, n_queries, n_skipped)`` of ranked lists.

    Means are taken over queries and F1 over the two means. The modes differ: for
    ``prefetch`` positives are a set and precision divides by K; for ``rerank`` repeated
    positives count in the denominator of recall, and precision divides by K or by the
    length of the longest list, whichever is smaller. Queries without positives are left
    out and counted in ``n_skipped``; ``strict`` makes them an error.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    ks = tuple(ks or (D.PREFETCH_K if mode == "prefetch" else D.RERANK_K))
    per_query = _per_query(candidates, queries, ks, mode)
    wanted = F.array_distinct("positive_ids") if mode == "prefetch" else F.col("positive_ids")
    n_positive = F.coalesce(F.size(wanted), F.lit(0))
    counted = F.col("_n") > 0
    hit = {k: F.coalesce(f"hit_{k}", F.lit(0)) for k in ks}
    totals = per_query.withColumn("_n", n_positive).agg(
        F.sum(counted.cast("int")).alias("n_queries"),
        F.sum((~counted).cast("int")).alias("n_skipped"),
        F.max(F.when(counted, F.coalesce("length", F.lit(0)))).alias("longest"),
        *[F.avg(F.when(counted, hit[k] / F.col("_n"))).alias(f"r{k}") for k in ks],
        *[F.avg(F.when(counted, hit[k].cast("double"))).alias(f"h{k}") for k in ks],
    )

    def at(k: int) -> Column:
        width = F.lit(k) if mode == "prefetch" else F.least(F.lit(k), F.col("longest"))
        precision = F.when(width > 0, F.col(f"h{k}") / width).otherwise(0.0)
        return F.struct(
            F.lit(k).alias("k"), F.col(f"r{k}").alias("recall"), precision.alias("precision")
        )

    n_skipped = F.col("n_skipped")
    if strict:
        n_skipped = _require(n_skipped == 0, "a query has no positives", n_skipped)
    f1 = F.lit(2.0) / (
        1 / (F.col("recall") + F.lit(D.EPSILON)) + 1 / (F.col("precision") + F.lit(D.EPSILON))
    )
    return (
        totals.select(
            F.explode(F.array(*[at(k) for k in ks])).alias("m"),
            "n_queries",
            n_skipped.alias("n_skipped"),
        )
        .select("m.*", "n_queries", "n_skipped")
        .select("k", "recall", "precision", f1.alias("f1"), "n_queries", "n_skipped")
    )


def truth_position(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """``(query_id, refid, position)``, counted from 0; null if not in the list."""
    ranked = candidates.select("query_id", F.col("paper_id").alias("refid"), "rank")
    return truth.join(ranked, ["query_id", "refid"], "left").select(
        "query_id", "refid", (F.col("rank") - 1).alias("position")
    )


def hit_rate(candidates: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: the share of queries whose true paper is among the first ``k``."""
    placed = truth_position(candidates, truth)
    hit = F.coalesce((F.col("position") < k).cast("int"), F.lit(0))
    return placed.agg(
        F.lit(k).alias("k"), F.avg(hit).alias("hit_rate"), F.count("*").alias("n_queries")
    )
