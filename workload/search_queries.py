"""Lexical search, candidate lists, and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from shortlist.operators import candidates as C
from shortlist.operators import evaluate as E
from shortlist.operators import lexical, rerank
from shortlist.operators.block_index import build_block_index, search_blocks
from shortlist.operators.numbering import dense_index, ordered_index, sample_rows
from shortlist.plans import jobs

from . import sql
from .registry import joined, register, rounded
from .views import STOPWORDS, Tables

KS = (10, 20, 50, 100, 200, 500, 1000, 2000)
METRICS = ("recall", "precision", "f1")


def _metrics(df):
    return df.select("k", *rounded(*METRICS), "n_queries", "n_skipped")


def _list_columns(df):
    return df.select("query_id", "paper_id", "rank", *rounded("score"))


_LIST = "SELECT query_id, paper_id, rank, round(score, 6) AS score FROM best"


@register("build_postings", sql.query(
    "SELECT term, paper_id, tf, doc_len FROM postings JOIN doc_stats USING (paper_id)"))
def build_postings(t: Tables):
    return lexical.build_postings(t.papers)


@register("document_frequency", sql.query("SELECT term, df FROM freq"))
def document_frequency(t: Tables):
    return lexical.document_frequency(t.postings)


@register("corpus_stats", sql.query("SELECT n_docs, round(avg_len, 6) AS avg_len FROM stats"))
def corpus_stats(t: Tables):
    return t.stats.select("n_docs", *rounded("avg_len"))


@register(
    "bm25_scores", sql.query("SELECT query_id, paper_id, round(score, 6) AS score FROM bm25")
)
def bm25_scores(t: Tables):
    terms = lexical.query_terms(t.queries, F.col("local_context"))
    scores = lexical.bm25_scores(terms, t.postings, t.stats)
    return scores.select("query_id", "paper_id", *rounded("score"))


@register(
    "bm25_scores_shuffled",
    sql.query("SELECT query_id, paper_id, round(score, 6) AS score FROM bm25"),
)
def bm25_scores_shuffled(t: Tables):
    """The plan for query tables too large to copy: heavy terms are cut into slices."""
    terms = lexical.query_terms(t.queries, F.col("local_context"))
    scores = lexical.bm25_scores(terms, t.postings, t.stats, broadcast_rows=0)
    return scores.select("query_id", "paper_id", *rounded("score"))


@register("bm25_search", sql.query(_LIST, best=sql.ranked("bm25", 100)))
def bm25_search(t: Tables):
    found = jobs.bm25_search(t.queries, t.postings, t.doc_stats, 100, index=t.blocks)
    return _list_columns(found)


@register("bm25_search_turns", sql.query(
    _LIST,
    qterms=f"""
        SELECT query_id, term, count(*) AS qtf
        FROM (SELECT concat_ws('-', conv_id, turn) AS query_id,
                     unnest({sql.tokens("text")}) AS term FROM conversations) GROUP BY ALL""",
    best=sql.ranked("bm25", 20),
))
def bm25_search_turns(t: Tables):
    """All turns of all conversations, in several query blocks."""
    asked = lexical.query_terms(t.turns, F.col("local_context"))
    terms = t.stored("turn-terms", lambda: asked)
    return _list_columns(search_blocks(terms, t.blocks, t.stats, 20, block_terms=10_000))


@register("build_block_index", sql.query("""
    SELECT term, count(*) AS df, max(tf) AS most_tf, min(doc_len) AS least_len, sum(tf) AS occurrences
    FROM postings JOIN doc_stats USING (paper_id) GROUP BY term"""))
def build_block_index_(t: Tables):
    """The block-max index, its blocks put together for each term."""
    rows = build_block_index(t.postings).filter("term is not null")
    return rows.groupBy("term").agg(
        F.sum(F.size("docs")).alias("df"),
        F.max(F.array_max("most_tf")).alias("most_tf"),
        F.min(F.array_min("least_len")).alias("least_len"),
        F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)).alias("occurrences"),
    )


def _with_lemmas(terms: str, weight: str) -> str:
    return (
        f"SELECT * EXCLUDE (term, {weight}, lemma, token), coalesce(lemma, term) AS term, "
        f"sum({weight}) AS {weight} FROM ({terms}) LEFT JOIN lemmas ON token = term GROUP BY ALL"
    )


@register(
    "bm25_search_lemmas",
    sql.query(
        _LIST,
        best=sql.ranked("bm25", 100),
        postings=_with_lemmas("SELECT term, paper_id, count(*) AS tf FROM paper_terms GROUP BY ALL",
                              "tf"),
        qterms=_with_lemmas(sql.CTES["qterms"], "qtf"),
    ),
)
def bm25_search_lemmas(t: Tables):
    """Lemmas on both sides."""
    lemmas = t.stored(
        "lemmas", lambda: lexical.build_lemmas(t.postings.select(F.col("term").alias("token")))
    )
    postings = t.stored("lemma-postings", lambda: lexical.build_postings(t.papers, lemmas=lemmas))
    found = jobs.bm25_search(t.queries, postings, t.doc_stats, 100, lemmas=lemmas)
    return _list_columns(found)


@register(
    "bm25_search_stopwords",
    sql.query(
        _LIST,
        best=sql.ranked("bm25", 100),
        paper_terms=f"""
            SELECT paper_id, unnest({sql.tokens("title || ' ' || abstract", STOPWORDS)}) AS term
            FROM papers""",
        doc_stats=f"""
            SELECT paper_id, len({sql.tokens("title || ' ' || abstract", STOPWORDS)}) AS doc_len
            FROM papers""",
        qterms=f"""
            SELECT query_id, term, count(*) AS qtf
            FROM (SELECT query_id, unnest({sql.tokens("local_context", STOPWORDS)}) AS term
                  FROM queries) GROUP BY ALL""",
    ),
)
def bm25_search_stopwords(t: Tables):
    """Stop words left out of index and queries."""
    postings = t.stored("stop-postings", lambda: lexical.build_postings(t.papers, STOPWORDS))
    stats = t.stored("stop-stats", lambda: lexical.build_doc_stats(t.papers, STOPWORDS))
    return _list_columns(jobs.bm25_search(t.queries, postings, stats, 100, stopwords=STOPWORDS))


@register(
    "bm25_search_pretokenized",
    sql.query(
        _LIST,
        best=sql.ranked("bm25", 100),
        qterms=f"""
            SELECT query_id, term, count(*) AS qtf
            FROM (SELECT query_id, unnest({sql.words("local_context")}) AS term FROM queries)
            GROUP BY ALL""",
    ),
)
def bm25_search_pretokenized(t: Tables):
    """Queries whose words are terms already."""
    return _list_columns(
        jobs.bm25_search(t.queries, t.postings, t.doc_stats, 100, pretokenized=True)
    )


@register(
    "bm25_search_filled",
    sql.query(
        _LIST,
        every="SELECT query_id, paper_id, coalesce(score, 0) AS score "
        "FROM queries CROSS JOIN papers LEFT JOIN bm25 USING (query_id, paper_id)",
        best=sql.ranked("every", 900),
    ),
)
def bm25_search_filled(t: Tables):
    """Lists of 900: papers without a common term complete them."""
    return _list_columns(jobs.bm25_search(t.queries, t.postings, t.doc_stats, 900, fill=True))


@register("bm25_candidates", sql.query(_LIST, best="SELECT * FROM candidates"))
def bm25_candidates(t: Tables):
    """Candidates that never contain the citing paper."""
    found = jobs.generate_candidates(t.corpus, t.contexts, t.papers, t.bm25, 50)
    return _list_columns(found)


@register("dense_prefetch", sql.query(_LIST, best=sql.ranked("cosines", 50)))
def dense_prefetch(t: Tables):
    """Encode the queries, search the vector index."""
    return _list_columns(jobs.prefetch(t.queries, t.dense, 50))


@register(
    "dense_prefetch_turns",
    sql.query(
        _LIST,
        paragraphs=sql.CTES["paragraphs"]
        + """
        UNION ALL SELECT 't', concat_ws('-', conv_id, turn), 3, 3.0, text FROM conversations""",
        turn_scores="""
            SELECT q.id AS query_id, p.id AS paper_id, list_inner_product(q.vec, p.vec) AS score
            FROM unit_vectors q, unit_vectors p WHERE q.kind = 't' AND p.kind = 'p'""",
        best=sql.ranked("turn_scores", 20),
    ),
)
def dense_prefetch_turns(t: Tables):
    """All turns of all conversations against the vector index."""
    return _list_columns(jobs.prefetch(t.turns, t.dense, 20))


@register(
    "prefetch_unless_positive",
    sql.query(
        _LIST,
        over_fetched=sql.ranked("bm25", 21),
        best=sql.without_citing(20, True),
    ),
)
def prefetch_unless_positive(t: Tables):
    return _list_columns(jobs.prefetch(t.queries, t.bm25, 20, "unless_positive"))


@register(
    "generate_candidates",
    sql.query(
        _LIST,
        over_fetched=sql.ranked("cosines", 101),
        best=sql.without_citing(100),
    ),
)
def generate_candidates(t: Tables):
    return _list_columns(
        jobs.generate_candidates(t.corpus, t.contexts, t.papers, t.dense, top_k=100)
    )


@register(
    "with_candidates",
    sql.query(
        """
        SELECT context_id, array_to_string(positive_ids, ',') AS positive_ids,
               coalesce(array_to_string(ids, ','), '') AS prefetched_ids
        FROM corpus LEFT JOIN (SELECT query_id, list(paper_id ORDER BY rank) AS ids
                               FROM candidates GROUP BY ALL) ON query_id = context_id"""
    ),
)
def with_candidates(t: Tables):
    return C.with_candidates(t.corpus, t.candidates).select(
        "context_id",
        joined(F.col("positive_ids")).alias("positive_ids"),
        joined(F.col("prefetched_ids")).alias("prefetched_ids"),
    )


@register(
    "label_candidates",
    sql.query(
        "SELECT query_id, paper_id, rank, CAST(list_contains(positive_ids, paper_id) AS INTEGER) "
        "AS is_hit, CASE WHEN list_contains(positive_ids, paper_id) THEN 0 ELSE 1 END AS level "
        "FROM candidates JOIN queries USING (query_id)"
    ),
)
def label_candidates(t: Tables):
    return rerank.label_candidates(t.candidates, t.queries).select(
        "query_id", "paper_id", "rank", F.col("is_hit").cast("int").alias("is_hit"), "level"
    )


# --- evaluation -------------------------------------------------------------------------


@register("evaluate_lists", sql.query(sql.metrics("candidates", KS, "prefetch")))
def evaluate_lists(t: Tables):
    return _metrics(E.evaluate(t.candidates, t.queries, KS))


_LONGEST = """
    SELECT count(*) AS n FROM candidates JOIN queries USING (query_id)
    WHERE len(positive_ids) > 0 GROUP BY query_id"""


@register(
    "evaluate_lists_as_reranked",
    sql.query(sql.metrics("candidates", (10, 20, 100), "rerank"), longest=_LONGEST),
)
def evaluate_lists_as_reranked(t: Tables):
    """The rerank definitions; the lists are shorter than the last K."""
    return _metrics(E.evaluate(t.candidates, t.queries, (10, 20, 100), "rerank"))


@register(
    "evaluate_prefetch",
    sql.query(
        sql.metrics("unless_citing", KS, "prefetch"),
        over_fetched=sql.ranked("cosines", 2001),
        unless_citing=sql.without_citing(2000, True),
    ),
)
def evaluate_prefetch(t: Tables):
    return _metrics(jobs.evaluate_prefetch(t.corpus, t.contexts, t.papers, t.dense, KS))


@register(
    "evaluate_bm25",
    sql.query(
        sql.metrics("unless_citing", KS, "prefetch"),
        over_fetched=sql.ranked("bm25", 2001),
        unless_citing=sql.without_citing(2000, True),
    ),
)
def evaluate_bm25(t: Tables):
    return _metrics(jobs.evaluate_prefetch(t.corpus, t.contexts, t.papers, t.bm25, KS))


@register(
    "truth_position",
    sql.query(
        "SELECT t.query_id, refid, rank - 1 AS position FROM truth t LEFT JOIN candidates c "
        "ON c.query_id = t.query_id AND c.paper_id = refid"
    ),
)
def truth_position(t: Tables):
    return E.truth_position(t.candidates, t.truth)


@register(
    "hit_rate",
    sql.query(
        "SELECT 10 AS k, round(avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END), 6) AS hit_rate, "
        "count(*) AS n_queries FROM truth t LEFT JOIN candidates c "
        "ON c.query_id = t.query_id AND c.paper_id = refid"
    ),
)
def hit_rate(t: Tables):
    rate = E.hit_rate(t.candidates, t.truth, 10)
    return rate.select("k", *rounded("hit_rate"), "n_queries")


# --- sampling ---------------------------------------------------------------------------


@register(
    "sample_papers",
    sql.query("SELECT paper_id FROM papers ORDER BY md5('3|' || paper_id), paper_id "
              "LIMIT 100 OFFSET 50"),
)
def sample_papers(t: Tables):
    return sample_rows(t.papers, "paper_id", 100, 50, seed=3).select("paper_id")


@register(
    "slice_papers", sql.query("SELECT paper_id FROM papers ORDER BY paper_id LIMIT 100 OFFSET 20")
)
def slice_papers(t: Tables):
    return sample_rows(t.papers, "paper_id", 100, 20, shuffle=False).select("paper_id")


@register(
    "shuffled_papers",
    sql.query("SELECT paper_id, row_number() OVER (ORDER BY md5('3|' || paper_id), paper_id) - 1 "
              "AS row_idx FROM papers"),
)
def shuffled_papers(t: Tables):
    return dense_index(t.papers, "paper_id", 3).select("paper_id", "row_idx")


@register(
    "numbered_papers",
    sql.query("SELECT paper_id, row_number() OVER (ORDER BY paper_id) - 1 AS row_idx FROM papers"),
)
def numbered_papers(t: Tables):
    return ordered_index(t.papers.select("paper_id"), "paper_id").select("paper_id", "row_idx")
