"""Whole jobs: build an index, retrieve, mine, rerank, evaluate."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import defaults as D
from ..functions import text as T
from ..functions import vectors
from ..operators import candidates as C
from ..operators import evaluate as E
from ..operators import mining as M
from ..operators import rerank as R
from ..operators.encode import Encoder, embed_documents
from ..operators.lexical import bm25_pairs, corpus_stats, query_terms
from ..operators.numbering import sample_rows
from ..operators.skew import needed
from ..sources import snapshots, writers
from ..storage import materialize
from .retrievers import Retriever, embed_queries, lexical_retriever


# --- indexing and retrieval -------------------------------------------------------------


def embed_papers(papers: DataFrame, encoder: Encoder) -> DataFrame:
    document = T.paper_paragraphs(F.col("title"), F.col("abstract"))
    return embed_documents(papers, "paper_id", document, encoder)


def build_index(
    papers: DataFrame, encoder: Encoder, path: str, size: int = 0, seed: int = 0,
    mode: str = "errorifexists",
) -> None:
    """Embed all papers, or a seeded sample of ``size``, and store the index."""
    chosen = sample_rows(papers, "paper_id", size, seed=seed)
    writers.write_index(embed_papers(chosen, encoder), path, mode=mode)


def refresh_index(
    papers: DataFrame, encoder: Encoder, path: str, removed: DataFrame | None = None,
    n_buckets: int = 1024,
) -> int:
    """Embed new or changed papers into the versioned index at ``path``; returns its version.

    Where there is none yet, ``papers`` are the whole index, in ``n_buckets`` buckets. A round
    of mining that re-embeds a subset writes the buckets of that subset only; read the result
    with :func:`snapshots.read_snapshot`.
    """
    embedded = embed_papers(papers, encoder)
    if not snapshots.versions(papers.sparkSession, path):
        return snapshots.write_snapshot(embedded, path, n_buckets)
    return snapshots.refresh_snapshot(path, embedded, removed)


def bm25_search(
    queries: DataFrame, postings: DataFrame, doc_stats: DataFrame, n: int, **options
) -> DataFrame:
    return lexical_retriever(postings, doc_stats, **options)(queries, n)


def prefetch(
    queries: DataFrame, retriever: Retriever, n: int = 10, exclude: str = "never"
) -> DataFrame:
    """Ranked candidates for a table of queries.

    One more than ``n`` is fetched when the citing paper may have to go.
    """
    fetched = retriever(queries, n if exclude == "never" else n + 1)
    return C.drop_citing(fetched, queries, n, exclude)


def stored_queries(
    corpus: DataFrame, contexts: DataFrame, papers: DataFrame, strict: bool = False
) -> DataFrame:
    """Queries of a corpus, resolved once: retrieval and metrics both read them.

    ``strict`` fails on a corpus row whose context is missing; otherwise such rows are left
    out, and ``candidates.missing_contexts`` lists them.
    """
    return materialize(C.context_queries(corpus, contexts, papers, strict), "queries")


def generate_candidates(
    corpus: DataFrame,
    contexts: DataFrame,
    papers: DataFrame,
    retriever: Retriever,
    top_k: int = D.TOP_K_RERANK,
    size: int = 0,
    start: int = 0,
    shuffle: bool = True,
    seed: int = 0,
    strict_contexts: bool = False,
) -> DataFrame:
    """Candidates of (a sample of) a corpus, never containing the citing paper."""
    chosen = sample_rows(corpus, "context_id", size, start, shuffle, seed)
    queries = stored_queries(chosen, contexts, papers, strict_contexts)
    return prefetch(queries, retriever, top_k, "always")


def evaluate_prefetch(
    corpus: DataFrame,
    contexts: DataFrame,
    papers: DataFrame,
    retriever: Retriever,
    ks: Sequence[int] = D.PREFETCH_K,
    size: int = 0,
    start: int = 0,
    strict: bool = False,
    strict_contexts: bool = False,
) -> DataFrame:
    """Metrics of a retriever over a corpus split, from one search with the largest K.

    ``strict`` fails on a query without positives, ``strict_contexts`` on a missing context.
    """
    chosen = sample_rows(corpus, "context_id", size, start, shuffle=False)
    queries = stored_queries(chosen, contexts, papers, strict_contexts)
    found = prefetch(queries, retriever, max(ks), "unless_positive")
    return E.evaluate(found, queries, ks, "prefetch", strict)


# --- mining -----------------------------------------------------------------------------


def text_sets(
    queries: DataFrame,
    papers: DataFrame,
    stopwords: Iterable[str] | None = None,
    lemmas: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Token sets of whole query documents and of papers."""
    query_text = T.document_text(C.query_document(queries))
    paper_text = T.candidate_text(papers["title"], papers["abstract"])
    return (
        M.token_sets(queries, "query_id", query_text, stopwords, lemmas),
        M.token_sets(papers, "paper_id", paper_text, stopwords, lemmas),
    )


@dataclass
class MiningRound:
    """What one round leaves behind: candidate lists, batches of samples, two reports."""

    candidates: DataFrame
    samples: DataFrame
    losses: DataFrame
    metrics: DataFrame


def mine_samples(
    queries: DataFrame,
    candidates: DataFrame,
    papers: DataFrame,
    stopwords: Iterable[str] | None = None,
    lemmas: DataFrame | None = None,
    budget: int = D.ROWS_PER_BATCH,
    seed: int = 0,
    bucket_queries: int = 10_000,
    **counts: int,
) -> DataFrame:
    """Graded samples of every query, put into batches."""
    query_sets, paper_sets = text_sets(queries, papers, stopwords, lemmas)
    samples = M.training_samples(
        queries, candidates, papers, query_sets, paper_sets, seed=seed, **counts
    )
    # groups are measured first and then dealt to batches
    return M.assign_batches(materialize(samples, "samples"), budget, seed, bucket_queries)


def sample_vectors(
    samples: DataFrame, query_vectors: DataFrame, paper_vectors: DataFrame
) -> DataFrame:
    """Add ``vec``: of the query for its own row, of the paper for all others."""
    q = query_vectors.select("query_id", F.col("vec").alias("_q"))
    p = M.needed(paper_vectors, samples).select("paper_id", F.col("vec").alias("_p"))
    return (
        samples.join(p, "paper_id", "left")
        .join(q, "query_id", "left")
        .withColumn("vec", F.when(F.col("role") == "query", F.col("_q")).otherwise(F.col("_p")))
        .drop("_q", "_p")
    )


def sampled_papers(samples: DataFrame, index: DataFrame, papers: DataFrame) -> DataFrame:
    """The sampled papers that the index lacks, unknown ones with empty texts."""
    wanted = samples.select("paper_id").filter(F.col("paper_id").isNotNull()).distinct()
    return C.resolve_papers(wanted.join(index, "paper_id", "left_anti"), papers, "paper_id")


def mining_round(
    train: DataFrame,
    validation: DataFrame,
    contexts: DataFrame,
    papers: DataFrame,
    encoder: Encoder,
    make_retriever: Callable[[Encoder, DataFrame], Retriever],
    n_examples: int = 0,
    n_refreshed: int = 0,
    n_validation: int = 0,
    top_k: int = D.TOP_K_HARD_NEGATIVES,
    ks: Sequence[int] = D.PREFETCH_K,
    seed: int = 0,
    strict_contexts: bool = False,
    **options,
) -> MiningRound:
    """One round: embed papers, list candidates, sample graded examples, validate.

    The encoder is trained elsewhere; a new round is called with the new encoder. Index
    and candidates are written down once, because samples, loss and metrics read them.
    ``n_examples``, ``n_refreshed`` and ``n_validation`` sample the training rows, the papers
    of the index and the validation rows (0 = all). Texts and easy negatives always come from
    all papers, and a sampled paper outside the index is encoded for the loss.
    """
    refreshed = sample_rows(papers, "paper_id", n_refreshed, seed=seed)
    embedded = materialize(embed_papers(refreshed, encoder), "embeddings")
    index = embedded.withColumn("vec", vectors.l2_normalize(F.col("vec")))
    retriever = make_retriever(encoder, index)
    chosen = sample_rows(train, "context_id", n_examples, seed=seed)
    queries = stored_queries(chosen, contexts, papers, strict_contexts)
    candidates = materialize(prefetch(queries, retriever, top_k, "always"), "candidates")
    samples = materialize(
        mine_samples(queries, candidates, papers, seed=seed, **options), "samples"
    )
    absent = embed_papers(sampled_papers(samples, index, papers), encoder)
    paper_vectors = index.unionByName(
        absent.withColumn("vec", vectors.l2_normalize(F.col("vec"))).select(*index.columns)
    )
    with_vectors = materialize(
        sample_vectors(samples, embed_queries(queries, encoder), paper_vectors), "sample-vectors"
    )
    losses = M.triplet_loss(with_vectors)
    checked = sample_rows(validation, "context_id", n_validation, seed=seed)
    metrics = evaluate_prefetch(
        checked, contexts, papers, retriever, ks, strict_contexts=strict_contexts
    )
    return MiningRound(candidates, samples, losses, metrics)


# --- reranking --------------------------------------------------------------------------


@dataclass
class FeatureTables:
    """The side tables that pair features are looked up in."""

    queries: DataFrame
    terms: DataFrame
    postings: DataFrame
    stats: DataFrame
    query_vectors: DataFrame
    paper_vectors: DataFrame
    query_sets: DataFrame
    #: token sets of the papers that the given rows refer to
    paper_sets: Callable[[DataFrame], DataFrame]

    def features(self, candidates: DataFrame) -> DataFrame:
        # each side table is cut down to the listed papers, so lists are read many times;
        # a pair is few bytes but much work, so tasks are not sized by bytes, and pairs of
        # a hot query or paper are dealt to all of them
        n_tasks = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pairs = materialize(candidates, "pairs")
        candidates = pairs.repartition(n_tasks, "query_id", "paper_id")
        bm25 = bm25_pairs(candidates, self.terms, self.postings, self.stats)
        return R.pair_features(
            candidates, bm25, self.query_vectors, self.paper_vectors, self.query_sets,
            self.paper_sets(pairs),
        )


def feature_tables(
    queries: DataFrame,
    papers: DataFrame,
    postings: DataFrame,
    doc_stats: DataFrame,
    encoder: Encoder,
    paper_vectors: DataFrame,
    stopwords: Iterable[str] | None = None,
) -> FeatureTables:
    query_sets, _ = text_sets(queries, papers, stopwords)

    def paper_sets(pairs: DataFrame) -> DataFrame:
        # cut down here: Spark moves no semi join below the exchange of the texts
        return text_sets(queries, needed(papers, pairs), stopwords)[1]

    return FeatureTables(
        queries,
        materialize(query_terms(queries, queries["local_context"]), "query-terms"),
        postings,
        corpus_stats(doc_stats),
        materialize(embed_queries(queries, encoder), "query-vectors"),
        paper_vectors,
        query_sets,
        paper_sets,
    )


def rerank_candidates(
    candidates: DataFrame, scorer: R.Scorer, top_k: int | None = None
) -> DataFrame:
    """Score the pairs of each list and reorder it; an empty list stays empty."""
    limited = candidates if top_k is None else R.limit_candidates(candidates, top_k)
    pairs = limited.withColumnRenamed("score", "first_score")
    return R.rerank(scorer(pairs))


def evaluate_rerank(
    candidates: DataFrame,
    queries: DataFrame,
    scorer: R.Scorer,
    top_k: int | None = None,
    ks: Sequence[int] = D.RERANK_K,
    strict: bool = False,
    hits_path: str | None = None,
    slice_name: str = "all",
) -> DataFrame:
    """Metrics after reranking; ``hits_path`` also stores the labelled lists."""
    ranked = rerank_candidates(candidates, scorer, top_k)
    labelled = R.label_candidates(ranked, queries)
    if hits_path is not None:
        labelled = materialize(labelled, "labelled")
        kept = labelled.select("query_id", "paper_id", "rank", "score", "is_hit")
        writers.write_hits(kept, hits_path, slice_name)
    return E.evaluate(labelled, queries, ks, "rerank", strict)


def validation_loss(
    candidates: DataFrame,
    queries: DataFrame,
    scorer: R.Scorer,
    size: int = 0,
    n_document: int = D.N_DOCUMENT,
    seed: int = 0,
) -> DataFrame:
    """Mean ranking loss over the training lists of validation queries (``size`` of them; 0 = all)."""
    chosen = sample_rows(queries, "query_id", size, seed=seed)
    lists = R.rerank_training_lists(candidates, chosen, n_document, seed=seed)
    return R.mean_loss(R.pairwise_rank_loss(scorer(R.with_ranks(lists, candidates))))


def evaluate_two_stage(
    queries: DataFrame,
    truth: DataFrame,
    retriever: Retriever,
    scorer: R.Scorer,
    n_candidates: int = 100,
    k: int = 10,
    exclude: str = "never",
) -> DataFrame:
    """Hit rate at ``k`` before and after reranking ``n_candidates`` per query."""
    found = materialize(prefetch(queries, retriever, n_candidates, exclude), "candidates")
    ranked = rerank_candidates(found, scorer)

    def rate(lists: DataFrame, stage: str) -> DataFrame:
        return E.hit_rate(lists, truth, k).withColumn("stage", F.lit(stage))

    return rate(found, "retrieved").unionByName(rate(ranked, "reranked"))
