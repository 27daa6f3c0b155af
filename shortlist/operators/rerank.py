"""Scoring and reordering of candidate lists, and learning the scorer."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types

from .. import defaults as D
from ..functions import hashing
from ..functions import text as T
from ..functions import vectors
from ..storage import materialize
from .mining import exclusions, jaccard_pairs, pick_positives
from .skew import needed

FEATURES = ("bm25", "cosine", "jaccard", "inverse_rank")

Scorer = Callable[[DataFrame], DataFrame]


# --- lists ------------------------------------------------------------------------------


def limit_candidates(candidates: DataFrame, top_k: int | None = None) -> DataFrame:
    """The first ``top_k`` of each list; all of them by default."""
    return candidates if top_k is None else candidates.filter(F.col("rank") <= top_k)


def with_ranks(lists: DataFrame, candidates: DataFrame) -> DataFrame:
    """Add the ``rank`` that each listed paper has among the query's candidates.

    A paper that was not retrieved stands behind the whole list of its query, and behind
    ``TOP_K_RERANK`` rows at least.
    """
    ranks = candidates.select("query_id", "paper_id", "rank")
    behind = candidates.groupBy("query_id").agg((F.max("rank") + 1).alias("_behind"))
    least = F.lit(D.TOP_K_RERANK + 1)
    return (
        lists.join(ranks, ["query_id", "paper_id"], "left")
        .join(behind, "query_id", "left")
        .withColumn("rank", F.coalesce("rank", F.greatest("_behind", least)))
        .drop("_behind")
    )


def label_candidates(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Add ``is_hit``, and ``level``: 0 for a positive of the query, else 1."""
    positives = queries.select("query_id", F.explode("positive_ids").alias("paper_id")).distinct()
    return (
        candidates.join(positives.withColumn("_hit", F.lit(True)), ["query_id", "paper_id"], "left")
        .withColumn("is_hit", F.coalesce("_hit", F.lit(False)))
        .withColumn("level", F.when(F.col("is_hit"), 0).otherwise(1))
        .drop("_hit")
    )


def negative_pools(
    candidates: DataFrame, queries: DataFrame, top_k: int | None, seed: int
) -> DataFrame:
    """``(query_id, pool)``: negatives among the first ``top_k`` of a query, in hash order."""
    negatives = (
        limit_candidates(candidates, top_k)
        .select("query_id", "paper_id")
        .distinct()
        .join(exclusions(queries), ["query_id", "paper_id"], "left_anti")
    )
    hashed = F.struct(
        hashing.seeded_hash(seed, F.col("query_id"), F.col("paper_id")).alias("h"), "paper_id"
    )
    return (
        negatives.groupBy("query_id")
        .agg(F.array_sort(F.collect_list(hashed)).alias("_sorted"))
        .select("query_id", F.transform("_sorted", lambda s: s["paper_id"]).alias("pool"))
    )


def queries_without_negatives(
    candidates: DataFrame, queries: DataFrame, top_k: int | None = None
) -> DataFrame:
    """Queries for which :func:`rerank_training_lists` gives no list."""
    pools = negative_pools(candidates, queries, top_k, 0)
    return queries.select("query_id").join(pools, "query_id", "left_anti")


def rerank_training_lists(
    candidates: DataFrame,
    queries: DataFrame,
    n_document: int = D.N_DOCUMENT,
    max_positive: int = D.MAX_POSITIVE,
    top_k: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """``(query_id, position, paper_id, level)``: lists of ``n_document`` papers.

    Positives (level 0) are taken without replacement, the rest (level 1) is drawn with
    replacement from the negatives among the first ``top_k`` candidates (all by default).
    """
    positives = pick_positives(F.col("query_id"), F.col("positive_ids"), max_positive, seed)
    lists = queries.join(negative_pools(candidates, queries, top_k, seed), "query_id").select(
        "query_id", "pool", positives.alias("_positives")
    )
    n_positive = F.size("_positives")
    size = F.size("pool")

    def document(i: Column) -> Column:
        drawn = hashing.draw(seed, size, F.col("query_id"), i).cast("int")
        is_positive = i <= n_positive
        return F.struct(
            i.alias("position"),
            F.when(is_positive, F.get("_positives", i - 1))
            .otherwise(F.get("pool", drawn))
            .alias("paper_id"),
            F.when(is_positive, 0).otherwise(1).alias("level"),
        )

    documents = F.transform(F.sequence(F.lit(1), F.lit(n_document)), document)
    return lists.select("query_id", F.explode(documents).alias("d")).select("query_id", "d.*")


# --- scores -----------------------------------------------------------------------------


def pair_texts(
    candidates: DataFrame,
    queries: DataFrame,
    papers: DataFrame,
    max_input_length: int = D.MAX_INPUT_LENGTH,
    mask: bool = True,
) -> DataFrame:
    """Add the two texts a pair scorer reads: ``query_text`` and ``candidate_text``."""
    query_text = T.rerank_query_text(
        F.col("citing_title"), F.col("citing_abstract"), F.col("local_context"),
        max_input_length, mask,
    )
    texts = needed(papers, candidates).select(
        "paper_id", T.candidate_text(F.col("title"), F.col("abstract")).alias("candidate_text")
    )
    return (
        candidates.join(texts, "paper_id", "left")
        .withColumn("candidate_text", F.coalesce("candidate_text", F.lit(" ")))
        .join(queries.select("query_id", query_text.alias("query_text")), "query_id")
    )


def pair_features(
    candidates: DataFrame,
    bm25: DataFrame,
    query_vectors: DataFrame,
    paper_vectors: DataFrame,
    query_sets: DataFrame,
    paper_sets: DataFrame,
) -> DataFrame:
    """Add the columns in ``FEATURES`` to ``(query_id, paper_id, rank, ..)`` rows.

    Each side table has one row per key, so the joins never multiply candidates, and is
    first cut down to the papers that are candidates.
    """
    listed = materialize(candidates.select("paper_id").distinct(), "pair-papers")
    paper_sets, paper_vectors = (needed(side, listed) for side in (paper_sets, paper_vectors))
    lexical = bm25.select("query_id", "paper_id", F.col("score").alias("bm25"))
    q = query_vectors.select("query_id", F.col("vec").alias("_q"))
    d = paper_vectors.select("paper_id", F.col("vec").alias("_d"))
    pairs = (
        candidates.join(lexical, ["query_id", "paper_id"], "left")
        .join(d, "paper_id", "left")
        .join(q, "query_id", "left")
        .withColumn("cosine", F.coalesce(vectors.cosine(F.col("_q"), F.col("_d")), F.lit(0.0)))
        .drop("_q", "_d")
    )
    return (
        jaccard_pairs(pairs, query_sets, paper_sets)
        .withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
        .withColumn("inverse_rank", 1 / F.col("rank"))
    )


def linear_score(weights: Mapping[str, float], bias: float = 0.0) -> Column:
    total = F.lit(bias)
    for name, weight in weights.items():
        total = total + F.lit(weight) * F.col(name)
    return total


def score_pairs(features: DataFrame, weights: Mapping[str, float], bias: float = 0.0) -> DataFrame:
    """Add ``score`` in (0, 1): the logistic function of a weighted sum of columns."""
    score = 1 / (1 + F.exp(-linear_score(weights, bias)))
    return features.withColumn("score", score)


def model_scorer(make_predict_fn: Callable, batch_size: int = 50) -> Scorer:
    """Any external pair model over ``query_text`` and ``candidate_text`` columns."""
    predict = predict_batch_udf(
        make_predict_fn, return_type=types.DoubleType(), batch_size=batch_size
    )
    return lambda pairs: pairs.withColumn("score", predict("query_text", "candidate_text"))


def rerank(scored: DataFrame, top_k: int | None = None) -> DataFrame:
    """Reorder each list by score; equal scores keep their retrieval order.

    Adds ``rank`` and keeps the old one as ``first_rank``. ``top_k`` limits the lists
    before they are reordered.
    """
    limited = scored if top_k is None else limit_candidates(scored, top_k)
    order = Window.partitionBy("query_id").orderBy(F.desc("_rounded"), "first_rank")
    return (
        limited.withColumnRenamed("rank", "first_rank")
        .withColumn("_rounded", F.round("score", 9))
        .withColumn("rank", F.row_number().over(order))
        .drop("_rounded")
    )


# --- learning ---------------------------------------------------------------------------


def pairwise_rank_loss(
    scored: DataFrame,
    base_margin: float = D.RERANK_MARGIN,
    levels: Sequence[int] = (0, 1),
    only_positive: bool = True,
) -> DataFrame:
    """``(query_id, loss)`` from ``(query_id, score, level)`` rows.

    For a better row i and a worse row j the loss is
    ``max(0, s_j - s_i + margin * (level_j - level_i))``, summed over pairs. Pairs are
    not formed: with the worse rows shifted up by their margin and all rows in score
    order, each worse row needs only the count and the sum of the better ones below it.
    ``levels`` are the values of ``level``; with ``only_positive`` i has level 0.
    """
    bases = [0] if only_positive else list(levels)
    base = F.explode(
        F.filter(F.array(*[F.lit(b) for b in bases]), lambda b: b <= F.col("level"))
    )
    rows = scored.select(
        "query_id", F.col("score").cast("double").alias("s"), "level", base.alias("base")
    )
    better = F.col("level") == F.col("base")
    shifted = rows.select(
        "query_id",
        "base",
        better.alias("better"),
        (F.col("s") + F.lit(base_margin) * (F.col("level") - F.col("base"))).alias("x"),
    )
    below = (
        Window.partitionBy("query_id", "base")
        .orderBy("x")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    count = F.sum(F.when(F.col("better"), 1).otherwise(0)).over(below)
    total = F.sum(F.when(F.col("better"), F.col("x")).otherwise(0.0)).over(below)
    row_loss = F.when(~F.col("better"), count * F.col("x") - total).otherwise(0.0)
    summed = shifted.withColumn("_loss", row_loss)
    return summed.groupBy("query_id").agg(F.sum("_loss").alias("loss"))


def mean_loss(losses: DataFrame) -> DataFrame:
    return losses.agg(F.avg("loss").alias("loss"), F.count("*").alias("n_queries"))


def fit_pairwise_ranker(
    lists: DataFrame,
    features: Sequence[str] = FEATURES,
    reg: float = 1e-3,
    max_iter: int = 50,
) -> dict[str, float]:
    """Weights of a linear scorer that puts positives before negatives.

    ``lists(query_id, level, <features>)`` are the short lists of
    :func:`rerank_training_lists`. A logistic model without intercept is fitted to the
    feature differences of positive and negative rows and to their mirror images.
    """
    values = F.array(*[F.col(f).cast("double") for f in features])
    # features are costly and every pass of the fit reads them
    rows = materialize(lists.select("query_id", "level", values.alias("x")), "ranker-rows")
    better = rows.filter(F.col("level") == 0).select("query_id", F.col("x").alias("p"))
    worse = rows.filter(F.col("level") != 0).select("query_id", F.col("x").alias("n"))
    differences = better.join(worse, "query_id").select(
        F.zip_with("p", "n", lambda p, n: p - n).alias("d")
    )
    mirrored = F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("d").alias("x")),
        F.struct(F.lit(0.0).alias("label"), F.transform("d", lambda v: -v).alias("x")),
    )
    examples = differences.select(F.explode(mirrored).alias("e")).select(
        F.col("e.label").alias("label"), array_to_vector(F.col("e.x")).alias("features")
    )
    model = LogisticRegression(fitIntercept=False, regParam=reg, maxIter=max_iter).fit(examples)
    return {name: float(w) for name, w in zip(features, model.coefficients)}
