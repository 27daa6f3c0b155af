"""Graded training examples from ranked lists, and the ranking loss over them.

Levels: 0 the query itself, 1 a positive, 2 a hard negative at least as close to the
query as its positives are on average, 3 any other negative.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import defaults as D
from ..functions import hashing
from ..functions import text as T
from ..functions import vectors
from .lexical import term_counts
from .numbering import dense_index
from .skew import needed

#: anchors of a batch whose similarities are held at a time
ANCHOR_ROWS = 256

SAMPLE_COLUMNS = ["query_id", "paper_id", "level", "role", "draw"]


# --- similarity of texts ----------------------------------------------------------------


def token_sets(
    df: DataFrame,
    key: str,
    text: Column,
    stopwords: Iterable[str] | None = None,
    lemmas: DataFrame | None = None,
) -> DataFrame:
    """``(key, tokens)``: the distinct tokens of each text.

    Texts are distributed by key before they are tokenized, which is where the join
    with pairs needs them; the texts are smaller than their token sets.
    """
    words = T.default_stopwords() if stopwords is None else stopwords
    tokens = T.tokenize(text, words, D.JACCARD_STOPWORDS)
    if lemmas is None:
        return df.repartition(key).select(key, F.array_distinct(tokens).alias("tokens"))
    counts = term_counts(df, key, tokens, lemmas, keep_empty=True)
    return counts.groupBy(key).agg(F.collect_set("term").alias("tokens"))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets of tokens; 0 when both are empty."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common + F.lit(D.EPSILON))


def jaccard_pairs(pairs: DataFrame, query_sets: DataFrame, paper_sets: DataFrame) -> DataFrame:
    """Add ``jaccard`` to given ``(query_id, paper_id)`` rows; unknown papers are empty."""
    left = query_sets.select("query_id", F.col("tokens").alias("_a"))
    right = paper_sets.select("paper_id", F.col("tokens").alias("_b"))
    none = F.array().cast("array<string>")
    return (
        pairs.join(right, "paper_id", "left")
        .join(left, "query_id", "left")
        .withColumn("jaccard", jaccard(F.coalesce("_a", none), F.coalesce("_b", none)))
        .drop("_a", "_b")
    )


def positive_threshold(
    queries: DataFrame, query_sets: DataFrame, paper_sets: DataFrame
) -> DataFrame:
    """``(query_id, threshold)``: mean similarity of a query and its positives."""
    pairs = queries.select("query_id", F.explode("positive_ids").alias("paper_id"))
    scored = jaccard_pairs(pairs, query_sets, needed(paper_sets, pairs))
    return scored.groupBy("query_id").agg(F.avg("jaccard").alias("threshold"))


# --- sampling ---------------------------------------------------------------------------


def exclusions(queries: DataFrame) -> DataFrame:
    """Papers that can be no negative of a query: its positives and its citing paper."""
    barred = F.concat(F.col("positive_ids"), F.array("citing_id"))
    return queries.select("query_id", F.explode(barred).alias("paper_id")).distinct()


def hard_negative_pool(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Distinct candidates minus positives minus the citing paper."""
    listed = candidates.join(queries.select("query_id"), "query_id", "left_semi")
    return (
        listed.select("query_id", "paper_id")
        .distinct()
        .join(exclusions(queries), ["query_id", "paper_id"], "left_anti")
    )


def pick_positives(query_id: Column, positive_ids: Column, n: int, seed: int) -> Column:
    """Up to ``n`` positives without replacement, as an array."""
    keyed = F.transform(
        positive_ids,
        lambda p, i: F.struct(hashing.seeded_hash(seed, query_id, p, i).alias("h"), p.alias("id")),
    )
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda s: s["id"])


def sample_positives(queries: DataFrame, n: int = D.MAX_POSITIVE, seed: int = 0) -> DataFrame:
    picked = pick_positives(F.col("query_id"), F.col("positive_ids"), n, seed)
    return queries.select("query_id", F.explode(picked).alias("paper_id"))


def sample_hard_negatives(pool: DataFrame, n: int = D.MAX_HARD_NEGATIVE, seed: int = 0) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("_hash", "paper_id")
    return (
        pool.withColumn("_hash", hashing.seeded_hash(seed, F.col("query_id"), F.col("paper_id")))
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= n)
        .select("query_id", "paper_id")
    )


def mine_hard_negatives(
    pool: DataFrame,
    queries: DataFrame,
    query_sets: DataFrame,
    paper_sets: DataFrame,
    n: int = D.MAX_HARD_NEGATIVE,
    seed: int = 0,
) -> DataFrame:
    """``(query_id, paper_id, jaccard, level)`` of up to ``n`` negatives per query.

    Level 2 is given to those at least as similar to the query as its positives are on
    average (:func:`positive_threshold`); all negatives of a query without positives have
    level 3. Only sampled rows and positives are compared,
    and both in one pass over the texts.
    """
    sampled = sample_hard_negatives(pool, n, seed).withColumn("_positive", F.lit(False))
    positives = queries.select(
        "query_id", F.explode("positive_ids").alias("paper_id"), F.lit(True).alias("_positive")
    )
    pairs = sampled.unionByName(positives)
    scored = jaccard_pairs(pairs, query_sets, needed(paper_sets, pairs))
    # positives are averaged on the map side; at most n negatives per query are gathered
    negative = F.when(~F.col("_positive"), F.struct("paper_id", "jaccard"))
    return (
        scored.groupBy("query_id")
        .agg(
            F.avg(F.when(F.col("_positive"), F.col("jaccard"))).alias("_threshold"),
            F.collect_list(negative).alias("_negatives"),
        )
        .select("query_id", "_threshold", F.explode("_negatives").alias("_n"))
        .withColumn("level", F.when(F.col("_n.jaccard") >= F.col("_threshold"), 2).otherwise(3))
        .select("query_id", "_n.paper_id", "_n.jaccard", "level")
    )


def sample_easy_negatives(
    queries: DataFrame, papers: DataFrame, n: int = D.MAX_EASY_NEGATIVE, seed: int = 0
) -> DataFrame:
    """``(query_id, draw, paper_id)``: ``n`` draws with replacement over all papers."""
    n_papers = papers.agg(F.count("*")).scalar()
    draws = queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw"))
    drawn = draws.withColumn(
        "row_idx", hashing.draw(seed, n_papers, F.col("query_id"), F.col("draw"))
    )
    numbered = dense_index(papers.select("paper_id"), "paper_id", seed)
    return drawn.join(numbered, "row_idx").select("query_id", "draw", "paper_id")


def training_samples(
    queries: DataFrame,
    candidates: DataFrame,
    papers: DataFrame,
    query_sets: DataFrame,
    paper_sets: DataFrame,
    n_positive: int = D.MAX_POSITIVE,
    n_hard: int = D.MAX_HARD_NEGATIVE,
    n_easy: int = D.MAX_EASY_NEGATIVE,
    seed: int = 0,
) -> DataFrame:
    """``(query_id, paper_id, level, role, draw)``; the query's own row has no paper."""

    def rows(df: DataFrame, level: Column, role: str, draw: Column) -> DataFrame:
        return df.select(
            "query_id",
            "paper_id",
            level.cast("int").alias("level"),
            F.lit(role).alias("role"),
            draw.cast("int").alias("draw"),
        )

    anchors = queries.withColumn("paper_id", F.lit(None).cast("string"))
    pool = hard_negative_pool(candidates, queries)
    hard = mine_hard_negatives(pool, queries, query_sets, paper_sets, n_hard, seed)
    zero = F.lit(0)
    return (
        rows(anchors, zero, "query", zero)
        .unionByName(
            rows(sample_positives(queries, n_positive, seed), F.lit(1), "positive", zero)
        )
        .unionByName(rows(hard, F.col("level"), "hard", zero))
        .unionByName(
            rows(
                sample_easy_negatives(queries, papers, n_easy, seed), F.lit(3), "easy", F.col("draw")
            )
        )
    )


def assign_batches(
    samples: DataFrame, budget: int = D.ROWS_PER_BATCH, seed: int = 0, bucket_queries: int = 10_000
) -> DataFrame:
    """Add ``batch_id`` and ``row_id``: whole query groups, filled up to ``budget`` rows.

    Queries are dealt to buckets of about ``bucket_queries`` by a seeded hash and put in
    hash order there. A batch takes the groups that start before its budget is reached,
    so the last group may run over it, and the last batch of a bucket may be short. No
    window spans more than a bucket.
    """
    sizes = samples.groupBy("query_id").agg(F.count("*").alias("_size"))
    n_buckets = sizes.agg(F.ceil(F.count("*") / bucket_queries)).scalar()
    hashed = sizes.withColumn("_hash", hashing.seeded_hash(seed, F.col("query_id"))).withColumn(
        "_bucket", F.pmod(hashing.hash_int(F.col("_hash")), n_buckets)
    )
    before = (
        Window.partitionBy("_bucket")
        .orderBy("_hash", "query_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    number = F.floor(F.coalesce(F.sum("_size").over(before), F.lit(0)) / budget)
    batches = hashed.select(
        "query_id", F.format_string("%d-%d", F.col("_bucket"), number).alias("batch_id")
    )
    row_id = F.concat_ws("|", "query_id", "role", F.coalesce("paper_id", F.lit("")), "draw")
    return samples.join(batches, "query_id").withColumn("row_id", row_id)


# --- triplets ---------------------------------------------------------------------------


def build_triplets(
    samples: DataFrame, positive_levels: Sequence[int] = D.POSITIVE_LEVELS
) -> DataFrame:
    """``(batch_id, anchor, positive, negative, anchor_class, ..)`` inside each batch.

    An anchor has level 0, its positives its own class and a positive level. A negative
    is no anchor and, within the class, less relevant than the positive. A batch holds
    at most its budget plus one group, so the rows that meet are bounded.
    """

    def side(name: str) -> DataFrame:
        return samples.select(
            "batch_id",
            F.col("row_id").alias(name),
            F.col("query_id").alias(f"{name}_class"),
            F.col("level").alias(f"{name}_level"),
        )

    anchors = side("anchor").filter(F.col("anchor_level") == 0)
    positives = side("positive").filter(F.col("positive_level").isin(list(positive_levels)))
    negatives = side("negative").filter(F.col("negative_level") != 0)
    pairs = anchors.join(positives, "batch_id").filter(
        (F.col("anchor_class") == F.col("positive_class")) & (F.col("anchor") != F.col("positive"))
    )
    return pairs.join(negatives, "batch_id").filter(
        (F.col("negative") != F.col("anchor"))
        & (F.col("negative") != F.col("positive"))
        & (
            (F.col("negative_class") != F.col("positive_class"))
            | (F.col("negative_level") > F.col("positive_level"))
        )
    )


def _similarities(anchors: np.ndarray, rows: np.ndarray, kind: str) -> np.ndarray:
    """Similarity of every anchor to every row, as :func:`vectors.pair_similarity` defines it."""
    if kind == "cosine":
        sizes = [np.sqrt((m * m).sum(axis=1)) + D.EPSILON for m in (anchors, rows)]
        return (anchors / sizes[0][:, None]) @ (rows / sizes[1][:, None]).T
    # differences, not the expanded square: rows that nearly agree must not cancel
    out = np.empty((len(anchors), len(rows)))
    for i, anchor in enumerate(anchors):
        out[i] = -np.sqrt(((rows - anchor) ** 2).sum(axis=1))
    return out


def _hinges(values: np.ndarray, floors: np.ndarray) -> float:
    """The sum of ``max(0, value - floor)`` over all pairs, by running sums of sorted values."""
    ordered = np.sort(values)
    # the sum from a position on; taken from the middle, so that it stays small and exact
    middle = ordered.mean() if len(ordered) else 0.0
    tails = np.append(np.cumsum((ordered - middle)[::-1])[::-1], 0.0)
    first = np.searchsorted(ordered, floors, side="right")
    return float((tails[first] - (len(ordered) - first) * (floors - middle)).sum())


def _batch_loss(
    rows: pa.Table, positive_levels: Sequence[int], base_margin: float, similarity: str
) -> float | None:
    """The loss of one batch; None if no anchor has a positive."""
    ids, groups = (
        np.unique(rows[c].to_numpy(), return_inverse=True)[1] for c in ("row_id", "query_id")
    )
    level = rows["level"].to_numpy().astype(np.int64)
    vec = rows["vec"].combine_chunks()
    matrix = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = matrix.reshape(len(ids), -1)
    total, seen = 0.0, False
    anchors = np.flatnonzero(level == 0)
    for at in range(0, len(anchors), ANCHOR_ROWS):
        some = anchors[at : at + ANCHOR_ROWS]
        for anchor, sim in zip(some, _similarities(matrix[some], matrix, similarity), strict=True):
            same = groups == groups[anchor]
            other = ids != ids[anchor]
            positive = np.flatnonzero(other & same & np.isin(level, list(positive_levels)))
            if not len(positive) or not (other & (level != 0)).any():
                continue
            seen = True
            floor = sim[positive] + base_margin * level[positive]
            far = ~same & (level != 0)
            total += _hinges(sim[far] + base_margin * D.OTHER_QUERY_LEVEL, floor)
            near = np.flatnonzero(other & same & (level != 0))
            gaps = (sim[near] + base_margin * level[near])[None, :] - floor[:, None]
            valid = (level[near][None, :] > level[positive][:, None]) & (
                ids[near][None, :] != ids[positive][:, None]
            )
            total += float(np.maximum(gaps, 0.0)[valid].sum())
    return total if seen else None


def triplet_loss(
    samples: DataFrame,
    positive_levels: Sequence[int] = D.POSITIVE_LEVELS,
    base_margin: float = D.PREFETCH_MARGIN,
    similarity: str = "cosine",
) -> DataFrame:
    """``(batch_id, loss)`` for samples with a vector in column ``vec``.

    A batch, which its budget bounds, is one matrix of similarities of its anchors to its
    rows. The rows of other queries are sorted once per anchor, and running sums give what
    all triplets of a positive add up to, so no triplet and no pair is ever a row, and
    samples are exchanged once. Batches without an anchor that has a positive are left out,
    as are samples without a batch, a level, a query or a vector. The vectors of a batch must
    be equally long.
    """
    if similarity not in ("cosine", "euclidean"):
        raise ValueError(f"unknown similarity {similarity!r}: use 'cosine' or 'euclidean'")
    used = ["batch_id", "row_id", "query_id", "level", "vec"]
    batch_type = samples.schema["batch_id"].dataType.simpleString()

    def losses(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        loss = _batch_loss(rows, positive_levels, base_margin, similarity)
        found = [] if loss is None else [loss]
        return pa.table(
            {
                "batch_id": pa.array([key[0].as_py()] * len(found), rows["batch_id"].type),
                "loss": pa.array(found, pa.float64()),
            }
        )

    whole = samples.select(*used[:-1], vectors.as_double(F.col("vec")).alias("vec")).dropna()
    return whole.groupBy("batch_id").applyInArrow(losses, f"batch_id {batch_type}, loss double")
