"""Graded samples, losses, reranking, and the two-stage jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from shortlist.operators import mining as M
from shortlist.operators import rerank as R
from shortlist.plans import jobs
from shortlist.plans.retrievers import dense_retriever, embed_queries

from . import sql
from .registry import register, rounded
from .search_queries import METRICS
from .views import STOPWORDS, WORD_DIM, Tables

SEED = 7
BUDGET = 20
BUCKET = 8
N_EASY = 2


def _sets(t: Tables):
    return jobs.text_sets(t.queries, t.papers, STOPWORDS)


def _mine(t: Tables):
    return jobs.mine_samples(
        t.answerable_queries, t.candidates, t.papers, STOPWORDS, budget=BUDGET, seed=SEED,
        bucket_queries=BUCKET, n_easy=N_EASY,
    )


def _samples(t: Tables):
    return t.stored("samples", lambda: _mine(t))


def _sample_vectors(t: Tables):
    return t.stored(
        "sample-vectors",
        lambda: jobs.sample_vectors(_samples(t), embed_queries(t.queries, t.encoder), t.index),
    )


@register(
    "jaccard_pairs",
    sql.query(
        "SELECT query_id, paper_id, round(jaccard, 6) AS jaccard FROM features"
    ),
)
def jaccard_pairs(t: Tables):
    scored = M.jaccard_pairs(t.candidates, *_sets(t))
    return scored.select("query_id", "paper_id", *rounded("jaccard"))


@register(
    "positive_threshold",
    sql.query("SELECT query_id, round(threshold, 6) AS threshold FROM thresholds"),
)
def positive_threshold(t: Tables):
    found = M.positive_threshold(t.answerable_queries, *_sets(t))
    return found.select("query_id", *rounded("threshold"))


@register("hard_negative_pool", sql.query("SELECT query_id, paper_id FROM pool"))
def hard_negative_pool(t: Tables):
    return M.hard_negative_pool(t.candidates, t.answerable_queries)


@register("sample_positives", sql.query("SELECT query_id, paper_id FROM picked"))
def sample_positives(t: Tables):
    return M.sample_positives(t.answerable_queries, 1, SEED)


@register(
    "mine_hard_negatives",
    sql.query("SELECT query_id, paper_id, round(jaccard, 6) AS jaccard, level FROM hard"),
)
def mine_hard_negatives(t: Tables):
    queries = t.answerable_queries
    pool = M.hard_negative_pool(t.candidates, queries)
    mined = M.mine_hard_negatives(pool, queries, *_sets(t), 3, SEED)
    return mined.select("query_id", "paper_id", *rounded("jaccard"), "level")


@register("sample_easy_negatives", sql.query("SELECT query_id, draw, paper_id FROM easy"))
def sample_easy_negatives(t: Tables):
    return M.sample_easy_negatives(t.answerable_queries, t.papers, N_EASY, SEED)


@register(
    "training_samples",
    sql.query("SELECT query_id, coalesce(paper_id, '') AS paper_id, level, role, draw FROM samples"),
)
def training_samples(t: Tables):
    return _mine(t).select(
        "query_id", F.coalesce("paper_id", F.lit("")).alias("paper_id"), "level", "role", "draw"
    )


@register("assign_batches", sql.query("SELECT batch_id, query_id, row_id, level FROM batched"))
def assign_batches(t: Tables):
    return _mine(t).select("batch_id", "query_id", "row_id", "level")


@register(
    "build_triplets",
    sql.query("SELECT batch_id, anchor, positive, negative FROM triplets"),
)
def build_triplets(t: Tables):
    return M.build_triplets(_samples(t)).select("batch_id", "anchor", "positive", "negative")


def _triplet_loss_sql(similarity: str) -> str:
    return sql.query(
        "SELECT batch_id, round(sum(greatest(0, sn - sp + 0.05 * (negative_level "
        "- positive_level))), 6) AS loss FROM gaps GROUP BY batch_id",
        gaps=f"""
            SELECT t.*, {similarity.format(x="p")} AS sp, {similarity.format(x="n")} AS sn
            FROM triplets t
            JOIN sample_vectors a ON a.batch_id = t.batch_id AND a.row_id = anchor
            JOIN sample_vectors p ON p.batch_id = t.batch_id AND p.row_id = positive
            JOIN sample_vectors n ON n.batch_id = t.batch_id AND n.row_id = negative""",
    )


@register("triplet_loss", _triplet_loss_sql("list_inner_product(a.vec, {x}.vec)"))
def triplet_loss(t: Tables):
    return M.triplet_loss(_sample_vectors(t)).select("batch_id", *rounded("loss"))


@register("triplet_loss_euclidean", _triplet_loss_sql("-list_distance(a.vec, {x}.vec)"))
def triplet_loss_euclidean(t: Tables):
    losses = M.triplet_loss(_sample_vectors(t), similarity="euclidean")
    return losses.select("batch_id", *rounded("loss"))


@register(
    "mining_round",
    sql.query(
        f"""
        SELECT 'loss' AS name, count(*) AS k, round(avg(loss), 6) AS value FROM (
            SELECT batch_id, sum(greatest(0, sn - sp + 0.05 * (negative_level
                   - positive_level))) AS loss FROM gaps GROUP BY batch_id)
        UNION ALL SELECT 'recall', k, recall
        FROM ({sql.metrics("unless_citing", (10, 20, 50, 100), "prefetch")})""",
        over_fetched=sql.ranked("cosines", 101),
        unless_citing=sql.without_citing(100, True),
        candidates=sql.without_citing(100),
        gaps="""
            SELECT t.*, list_inner_product(a.vec, p.vec) AS sp, list_inner_product(a.vec, n.vec)
                   AS sn
            FROM triplets t
            JOIN sample_vectors a ON a.batch_id = t.batch_id AND a.row_id = anchor
            JOIN sample_vectors p ON p.batch_id = t.batch_id AND p.row_id = positive
            JOIN sample_vectors n ON n.batch_id = t.batch_id AND n.row_id = negative""",
    ),
)
def mining_round(t: Tables):
    """Embed, list candidates, sample, then the loss of the index and its recall."""
    done = jobs.mining_round(
        t.answerable, t.corpus, t.contexts, t.papers, t.encoder,
        lambda encoder, index: dense_retriever(encoder, index, WORD_DIM),
        ks=(10, 20, 50, 100), seed=SEED, stopwords=STOPWORDS, budget=BUDGET,
        bucket_queries=BUCKET, n_easy=N_EASY,
    )
    loss = done.losses.agg(F.avg("loss").alias("value"), F.count("*").alias("k"))
    recall = done.metrics.select(
        F.lit("recall").alias("name"), F.col("k").cast("bigint").alias("k"), F.col("recall").alias("value")
    )
    return (
        loss.select(F.lit("loss").alias("name"), "k", "value")
        .unionByName(recall)
        .select("name", "k", *rounded("value"))
    )


N_REFRESHED = 150
_REFRESHED = {
    "index_papers": f"""
        SELECT paper_id FROM papers ORDER BY md5('7|' || paper_id), paper_id LIMIT {N_REFRESHED}""",
    "reachable": "SELECT * FROM cosines WHERE paper_id IN (SELECT paper_id FROM index_papers)",
    "over_fetched": sql.ranked("reachable", 101),
    "unless_citing": sql.without_citing(100, True),
    "candidates": sql.without_citing(100),
}


def _refreshed(t: Tables):
    return t.stored(
        "refreshed-samples",
        lambda: jobs.mining_round(
            t.answerable, t.corpus, t.contexts, t.papers, t.encoder,
            lambda encoder, index: dense_retriever(encoder, index, WORD_DIM),
            n_refreshed=N_REFRESHED, ks=(10, 20), seed=SEED, stopwords=STOPWORDS, budget=BUDGET,
            bucket_queries=BUCKET, n_easy=N_EASY,
        ).samples,
    )


@register(
    "mining_round_refreshed",
    sql.query(
        "SELECT batch_id, query_id, row_id, level FROM batched", **_REFRESHED
    ),
)
def mining_round_refreshed(t: Tables):
    """A round whose index holds a part of the papers; levels come from all texts."""
    return _refreshed(t).select("batch_id", "query_id", "row_id", "level")


@register(
    "mining_round_refreshed_report",
    sql.query(
        f"""
        SELECT 'loss' AS name, count(*) AS k, round(avg(loss), 6) AS value FROM (
            SELECT batch_id, sum(greatest(0, sn - sp + 0.05 * (negative_level
                   - positive_level))) AS loss FROM gaps GROUP BY batch_id)
        UNION ALL SELECT 'recall', k, recall
        FROM ({sql.metrics("unless_citing", (10, 20), "prefetch")})""",
        **_REFRESHED,
        gaps="""
            SELECT t.*, list_inner_product(a.vec, p.vec) AS sp, list_inner_product(a.vec, n.vec)
                   AS sn
            FROM triplets t
            JOIN sample_vectors a ON a.batch_id = t.batch_id AND a.row_id = anchor
            JOIN sample_vectors p ON p.batch_id = t.batch_id AND p.row_id = positive
            JOIN sample_vectors n ON n.batch_id = t.batch_id AND n.row_id = negative""",
    ),
)
def mining_round_refreshed_report(t: Tables):
    """Loss over all samples, also those outside the index, and recall of that index."""
    done = jobs.mining_round(
        t.answerable, t.corpus, t.contexts, t.papers, t.encoder,
        lambda encoder, index: dense_retriever(encoder, index, WORD_DIM),
        n_refreshed=N_REFRESHED, ks=(10, 20, 100), seed=SEED, stopwords=STOPWORDS, budget=BUDGET,
        bucket_queries=BUCKET, n_easy=N_EASY,
    )
    loss = done.losses.agg(F.avg("loss").alias("value"), F.count("*").alias("k"))
    recall = done.metrics.filter("k < 100").select(
        F.lit("recall").alias("name"), F.col("k").cast("bigint").alias("k"), F.col("recall").alias("value")
    )
    return (
        loss.select(F.lit("loss").alias("name"), "k", "value")
        .unionByName(recall)
        .select("name", "k", *rounded("value"))
    )


# --- reranking --------------------------------------------------------------------------


@register(
    "pair_features",
    sql.query(
        "SELECT query_id, paper_id, rank, round(bm25, 6) AS bm25, round(cosine, 6) AS cosine, "
        "round(jaccard, 6) AS jaccard, round(inverse_rank, 6) AS inverse_rank FROM features"
    ),
)
def pair_features(t: Tables):
    features = t.feature_tables.features(t.candidates)
    return features.select("query_id", "paper_id", "rank", *rounded(*R.FEATURES))


@register(
    "score_pairs",
    sql.query("SELECT query_id, paper_id, round(score, 6) AS score FROM scored"),
)
def score_pairs(t: Tables):
    return t.scorer(t.candidates.drop("score")).select("query_id", "paper_id", *rounded("score"))


@register(
    "rerank",
    sql.query(
        "SELECT query_id, paper_id, rank, first_rank, round(score, 6) AS score FROM reranked"
    ),
)
def rerank(t: Tables):
    ranked = jobs.rerank_candidates(t.candidates, t.scorer)
    return ranked.select("query_id", "paper_id", "rank", "first_rank", *rounded("score"))


@register(
    "rerank_top_10",
    sql.query(
        "SELECT query_id, paper_id, first_rank, row_number() OVER (PARTITION BY query_id "
        "ORDER BY round(score, 9) DESC, first_rank) AS rank FROM reranked WHERE first_rank <= 10"
    ),
)
def rerank_top_10(t: Tables):
    ranked = jobs.rerank_candidates(t.candidates, t.scorer, 10)
    return ranked.select("query_id", "paper_id", "first_rank", "rank")


@register(
    "rerank_with_model",
    sql.query(
        "SELECT query_id, paper_id, first_rank, round(score, 6) AS score, row_number() OVER "
        "(PARTITION BY query_id ORDER BY round(score, 9) DESC, first_rank) AS rank FROM word_shares",
        pair_words=f"""
            SELECT c.query_id, c.paper_id, c.rank AS first_rank,
                   list_distinct({sql.words(
                       "array_to_string(" + sql.words("citing_title || ' ' || citing_abstract")
                       + "[1:179], ' ') || '<sep>' || replace(local_context, 'TARGETCIT', '<cit>')"
                   )}) AS a,
                   list_distinct({sql.words("title || ' ' || abstract")}) AS b
            FROM candidates c JOIN queries USING (query_id) JOIN papers USING (paper_id)""",
        word_shares="""
            SELECT *, len(list_intersect(a, b))
                   / greatest(len(a) + len(b) - len(list_intersect(a, b)), 1) AS score
            FROM pair_words""",
    ),
)
def rerank_with_model(t: Tables):
    """An external pair model in the scorer slot: here, the share of common words."""

    def make_predict_fn():
        import numpy as np

        def predict(query_text, candidate_text):
            scores = []
            for q, c in zip(query_text, candidate_text):
                q, c = set(q.split()), set(c.split())
                scores.append(len(q & c) / max(len(q | c), 1))
            return np.array(scores)

        return predict

    texts = R.pair_texts(t.candidates.drop("score"), t.queries, t.papers)
    ranked = R.rerank(R.model_scorer(make_predict_fn)(texts))
    return ranked.select("query_id", "paper_id", "rank", "first_rank", *rounded("score"))


@register(
    "rerank_training_lists",
    sql.query("SELECT query_id, position, paper_id, level FROM lists"),
)
def rerank_training_lists(t: Tables):
    return R.rerank_training_lists(t.candidates, t.answerable_queries, seed=SEED)


_RANK_LOSS = """
    SELECT i.query_id, sum(greatest(0, j.score - i.score + 0.1 * (j.level - i.level))) AS loss
    FROM graded i JOIN graded j ON j.query_id = i.query_id AND j.level > i.level AND i.level = 0
    GROUP BY ALL"""
_GRADED = """
    SELECT query_id, score, CASE WHEN is_hit THEN 0 ELSE 1 END AS level FROM labelled"""


@register(
    "pairwise_rank_loss",
    sql.query(
        "SELECT DISTINCT g.query_id, round(coalesce(loss, 0), 6) AS loss FROM graded g "
        "LEFT JOIN losses USING (query_id)",
        graded=_GRADED,
        losses=_RANK_LOSS,
    ),
)
def pairwise_rank_loss(t: Tables):
    scored = t.scorer(t.candidates.drop("score"))
    labelled = R.label_candidates(scored, t.queries)
    return R.pairwise_rank_loss(labelled).select("query_id", *rounded("loss"))


@register(
    "pairwise_rank_loss_all_levels",
    sql.query(
        "SELECT DISTINCT g.query_id, round(coalesce(loss, 0), 6) AS loss FROM graded g "
        "LEFT JOIN losses USING (query_id)",
        graded="SELECT query_id, score, CASE WHEN is_hit THEN 0 WHEN first_rank <= 20 THEN 1 "
        "ELSE 2 END AS level FROM labelled",
        losses=_RANK_LOSS.replace(" AND i.level = 0", ""),
    ),
)
def pairwise_rank_loss_all_levels(t: Tables):
    """Three levels, any better row against any worse one."""
    labelled = R.label_candidates(t.scorer(t.candidates.drop("score")), t.queries)
    graded = labelled.withColumn(
        "level",
        F.when(F.col("is_hit"), 0).when(F.col("rank") <= 20, 1).otherwise(2),
    )
    losses = R.pairwise_rank_loss(graded, levels=(0, 1, 2), only_positive=False)
    return losses.select("query_id", *rounded("loss"))


@register(
    "validation_loss",
    sql.query(
        "SELECT round(avg(loss), 6) AS loss, count(*) AS n_queries FROM losses",
        graded="""
            SELECT l.query_id, l.level, 1 / (1 + exp(-(-2.0 + 0.02 * coalesce(m.score, 0)
                   + coalesce(v.score, 0) + 3.0 * len(list_intersect(a, b)) / (len(a) + len(b)
                   - len(list_intersect(a, b)) + 1e-12)
                   + 0.5 / coalesce(c.rank, 2001)))) AS score
            FROM lists l LEFT JOIN candidates c USING (query_id, paper_id)
            LEFT JOIN bm25 m USING (query_id, paper_id)
            LEFT JOIN cosines v USING (query_id, paper_id)
            JOIN query_sets USING (query_id) JOIN paper_sets USING (paper_id)""",
        losses=_RANK_LOSS,
    ),
)
def validation_loss(t: Tables):
    loss = jobs.validation_loss(t.candidates, t.answerable_queries, t.scorer, seed=SEED)
    return loss.select(*rounded("loss"), "n_queries")


@register("fit_pairwise_ranker")
def fit_pairwise_ranker(t: Tables):
    """Learn the feature weights from mined lists, then score with them."""
    lists = R.rerank_training_lists(t.candidates, t.answerable_queries, seed=SEED)
    features = t.feature_tables.features(R.with_ranks(lists, t.candidates))
    weights = R.fit_pairwise_ranker(features)
    scored = R.score_pairs(t.feature_tables.features(t.candidates.drop("score")), weights)
    return R.rerank(scored).select("query_id", "paper_id", "rank", *rounded("score"))


@register(
    "fit_pairwise_ranker_report",
    sql.query(
        "SELECT count(DISTINCT query_id) AS n_queries, 1 AS loss_fell, 1 AS positives_ahead "
        "FROM lists"
    ),
)
def fit_pairwise_ranker_report(t: Tables):
    """Learned weights against none, over the lists they were learned from."""
    lists = R.rerank_training_lists(t.candidates, t.answerable_queries, seed=SEED)
    features = t.stored(
        "ranker-features", lambda: t.feature_tables.features(R.with_ranks(lists, t.candidates))
    )
    weights = R.fit_pairwise_ranker(features)
    after = R.score_pairs(features, weights)
    before = R.score_pairs(features, dict.fromkeys(R.FEATURES, 0.0))
    mean = F.avg(F.when(F.col("level") == 0, F.col("score")))
    other = F.avg(F.when(F.col("level") != 0, F.col("score")))
    ahead = after.agg((mean > other).cast("int").alias("positives_ahead"))
    old = R.mean_loss(R.pairwise_rank_loss(before)).select(F.col("loss").alias("_before"))
    new = R.mean_loss(R.pairwise_rank_loss(after))
    report = new.join(F.broadcast(old)).join(F.broadcast(ahead))
    fell = (F.col("loss") < F.col("_before")).cast("int")
    return report.select("n_queries", fell.alias("loss_fell"), "positives_ahead")


_LONGEST = """
    SELECT count(*) AS n FROM candidates JOIN queries USING (query_id)
    WHERE len(positive_ids) > 0 GROUP BY query_id"""


@register(
    "evaluate_rerank",
    sql.query(sql.metrics("reranked", (10, 20), "rerank"), longest=_LONGEST),
)
def evaluate_rerank(t: Tables):
    metrics = jobs.evaluate_rerank(t.candidates, t.queries, t.scorer)
    return metrics.select("k", *rounded(*METRICS), "n_queries", "n_skipped")


@register(
    "evaluate_two_stage",
    sql.query(
        """
        SELECT t.stage, 10 AS k, round(avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END), 6) AS hit_rate,
               count(*) AS n_queries
        FROM (SELECT s.stage, t.query_id, t.refid FROM truth t,
                     (VALUES ('retrieved'), ('reranked')) s(stage)) t
        LEFT JOIN (SELECT 'retrieved' AS stage, query_id, paper_id, rank FROM first_hundred
                   UNION ALL SELECT 'reranked', query_id, paper_id, rank FROM second) c
             ON c.stage = t.stage AND c.query_id = t.query_id AND c.paper_id = t.refid
        GROUP BY t.stage""",
        first_hundred=sql.ranked("bm25", 100),
        candidates="SELECT * FROM first_hundred",
        second="""
            SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id
                   ORDER BY round(score, 9) DESC, rank) AS rank FROM scored""",
    ),
)
def evaluate_two_stage(t: Tables):
    """Flagship: 100 candidates by BM25, reranked, hit rate at 10 before and after."""
    rates = jobs.evaluate_two_stage(t.queries, t.truth, t.bm25, t.scorer, 100, 10)
    return rates.select("stage", "k", *rounded("hit_rate"), "n_queries")


