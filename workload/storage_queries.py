"""Sources and sinks: each query writes a table with the library and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shortlist.functions import vectors as V
from shortlist.operators import candidates as C
from shortlist.plans import jobs
from shortlist.sources import readers, snapshots, writers
from shortlist.storage import scratch_dir

from . import sql
from .registry import digest, joined, register, rounded
from .search_queries import METRICS
from .vector_queries import _listed, _listed_sql
from .views import Tables


#: rows of a file whose order is checked together
RUN_ROWS = 20_000
#: files that the papers are dealt to where each file is one object
PARTS = 64


def _folder(t: Tables, name: str) -> str:
    return f"{scratch_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _as_lines(df: DataFrame, path: str) -> None:
    """One JSON record per line, as data is often given."""
    df.write.json(path)


_PAPERS = sql.query(
    "SELECT paper_id, md5(title) AS title_md5, length(title) AS title_chars, "
    "md5(abstract) AS abstract_md5, length(abstract) AS abstract_chars FROM papers"
)


def _paper_digests(papers: DataFrame) -> DataFrame:
    return papers.select(
        "paper_id", *digest(F.col("title"), "title"), *digest(F.col("abstract"), "abstract")
    )


@register("read_papers", _PAPERS)
def read_papers(t: Tables):
    """All papers through JSON lines."""
    path = _folder(t, "papers")
    _as_lines(t.papers, path)
    return _paper_digests(readers.read_papers(t.spark, path, "jsonl"))


@register("read_papers_by_id", _PAPERS)
def read_papers_by_id(t: Tables):
    """All papers through JSON objects keyed by id."""
    path = _folder(t, "papers-by-id")
    pair = F.struct("paper_id", F.struct("title", "abstract"))
    # such a file is one object; a folder of them holds a part of the papers each
    parts = t.papers.withColumn("_part", F.pmod(F.xxhash64("paper_id"), F.lit(PARTS)))
    objects = parts.groupBy("_part").agg(
        F.to_json(F.map_from_entries(F.collect_list(pair))).alias("value")
    )
    objects.write.partitionBy("_part").text(path)
    return _paper_digests(readers.read_papers(t.spark, path, "json"))


@register(
    "read_contexts",
    sql.query("SELECT context_id, masked_text, citing_id, coalesce(refid, '') AS refid FROM contexts"),
)
def read_contexts(t: Tables):
    path = _folder(t, "contexts")
    _as_lines(t.contexts, path)
    read = readers.read_contexts(t.spark, path, "jsonl")
    return read.withColumn("refid", F.coalesce("refid", F.lit("")))


@register(
    "read_corpus",
    sql.query("SELECT context_id, array_to_string(positive_ids, ',') AS positive_ids FROM corpus"),
)
def read_corpus(t: Tables):
    path = _folder(t, "corpus")
    writers.write_table(t.corpus, path)
    read = readers.read_corpus(t.spark, path)
    return read.select("context_id", joined(F.col("positive_ids")).alias("positive_ids"))


@register(
    "candidates_from_lists", sql.query("SELECT query_id, paper_id, rank FROM candidates")
)
def candidates_from_lists(t: Tables):
    """Candidate lists stored with the corpus, read again as a candidate table."""
    return _stored_lists(t)


def _stored_lists(t: Tables) -> DataFrame:
    path = _folder(t, "lists")
    _as_lines(C.with_candidates(t.corpus, t.candidates), path)
    return C.candidates_from_lists(readers.read_corpus(t.spark, path, "jsonl", candidates=True))


_LONGEST = """
    SELECT count(*) AS n FROM candidates JOIN queries USING (query_id)
    WHERE len(positive_ids) > 0 GROUP BY query_id"""


@register(
    "evaluate_stored_lists",
    sql.query(sql.metrics("reranked", (10, 20), "rerank"), longest=_LONGEST),
)
def evaluate_stored_lists(t: Tables):
    """Reranking that starts from stored lists."""
    metrics = jobs.evaluate_rerank(_stored_lists(t), t.queries, t.scorer)
    return metrics.select("k", *rounded(*METRICS), "n_queries", "n_skipped")


@register("read_vocabulary", sql.query("SELECT word, idx FROM vocabulary"))
def read_vocabulary(t: Tables):
    path = _folder(t, "vocabulary")
    _as_lines(t.vocabulary, path)
    return readers.read_vocabulary(t.spark, path, "jsonl")


_WORD_VECTORS = """
    SELECT word, list(v ORDER BY i) AS vec FROM word_values GROUP BY word"""


@register(
    "read_word_vectors",
    sql.query(f"SELECT word, {_listed_sql('vec')} AS vector FROM listed", listed=_WORD_VECTORS),
)
def read_word_vectors(t: Tables):
    path = _folder(t, "word-vectors")
    writers.write_table(t.word_vectors, path)
    read = readers.read_word_vectors(t.spark, path)
    return read.select("word", _listed(V.as_double(F.col("vector"))).alias("vector"))


@register(
    "build_index",
    sql.query(
        "SELECT id AS paper_id, len(vec) AS n, 1 AS near FROM unit_vectors WHERE kind = 'p'"
    ),
)
def build_index(t: Tables):
    """Embed all papers, store them as four-byte floats, read them scaled to length one."""
    path = _folder(t, "index")
    jobs.build_index(t.papers, t.encoder, path)
    read = readers.read_index(t.spark, path).select("paper_id", F.col("vec").alias("_read"))
    # floats hold seven digits, so they are compared with a tolerance
    gaps = F.zip_with("_read", "vec", lambda a, b: F.abs(a - b))
    return read.join(t.index, "paper_id").select(
        "paper_id", F.size("_read").alias("n"), (F.array_max(gaps) < 1e-6).cast("int").alias("near")
    )


@register(
    "read_index_sorted",
    "SELECT count(*) AS n_rows, 0 AS n_unsorted FROM documents",
)
def read_index_sorted(t: Tables):
    """A stored index is in the order of its ids inside each file."""
    path = _folder(t, "index")
    writers.write_index(t.index, path, converted=True)
    read = readers.read_index(t.spark, path, converted=True)

    # the row index says where a row stands in its file
    placed = read.select("paper_id", "_metadata.file_path", "_metadata.row_index")
    return _order_report(placed)


def _order_report(placed: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """Rows, and rows behind a larger id in their file; a file is checked in runs of rows."""
    run = F.floor(F.col("row_index") / run_rows).alias("run")
    rows = placed.select("file_path", run, "row_index", "paper_id")
    ahead = Window.partitionBy("file_path", "run").orderBy("row_index")
    behind = F.lag("paper_id").over(ahead) > F.col("paper_id")
    runs = (
        rows.withColumn("_behind", behind.cast("int"))
        .groupBy("file_path", "run")
        .agg(
            F.count("*").alias("n"),
            F.sum(F.coalesce("_behind", F.lit(0))).alias("unsorted"),
            F.min_by("paper_id", "row_index").alias("first"),
            F.max_by("paper_id", "row_index").alias("last"),
        )
    )
    # one short row per run: the first row of a run stands behind the last of the run before
    between = F.lag("last").over(Window.partitionBy("file_path").orderBy("run")) > F.col("first")
    unsorted = F.col("unsorted") + F.coalesce(between.cast("int"), F.lit(0))
    return runs.select("n", unsorted.alias("unsorted")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.sum("unsorted").alias("n_unsorted")
    )


@register(
    "refresh_index",
    sql.query(
        """SELECT id AS paper_id, CASE WHEN id IN (SELECT paper_id FROM positives) THEN 1
           ELSE len(vec) END AS n, len(vec) AS n_before
           FROM unit_vectors WHERE kind = 'p'"""
    ),
)
def refresh_index(t: Tables):
    """New vectors for all cited papers, written to their buckets; both versions are read."""
    path = _folder(t, "snapshots")
    first = snapshots.write_snapshot(t.index, path, PARTS)
    cited = t.positives.select("paper_id").distinct()
    snapshots.refresh_snapshot(path, cited.withColumn("vec", F.array(F.lit(1.0))))
    before = snapshots.read_snapshot(t.spark, path, first)
    sizes = before.select("paper_id", F.size("vec").alias("n_before"))
    after = snapshots.read_snapshot(t.spark, path)
    return after.select("paper_id", F.size("vec").alias("n")).join(sizes, "paper_id")


@register("read_postings", sql.query(
    "SELECT term, paper_id, tf, doc_len FROM postings JOIN doc_stats USING (paper_id)"))
def read_postings(t: Tables):
    path = _folder(t, "lexical")
    writers.write_postings(t.postings, t.doc_stats, path)
    postings, _ = readers.read_postings(t.spark, path)
    return postings


@register("read_doc_stats", sql.query("SELECT paper_id, doc_len FROM doc_stats"))
def read_doc_stats(t: Tables):
    path = _folder(t, "lexical")
    writers.write_postings(t.postings, t.doc_stats, path)
    return readers.read_postings(t.spark, path)[1]


@register(
    "write_candidates",
    sql.query("SELECT query_id, paper_id, rank, round(score, 6) AS score FROM candidates"),
)
def write_candidates(t: Tables):
    path = _folder(t, "candidates")
    writers.write_candidates(t.candidates, path)
    read = t.spark.read.parquet(path)
    return read.select("query_id", "paper_id", "rank", *rounded("score"))


@register(
    "write_hits",
    sql.query(
        "SELECT query_id, paper_id, rank, CAST(list_contains(positive_ids, paper_id) AS INTEGER) "
        "AS is_hit, CASE WHEN rank <= 25 THEN 'head' ELSE 'tail' END AS slice "
        "FROM candidates JOIN queries USING (query_id)"
    ),
)
def write_hits(t: Tables):
    """Two slices, one of them written twice: a rerun replaces its slice."""
    from shortlist.operators import rerank

    path = _folder(t, "hits")
    hits = rerank.label_candidates(t.candidates, t.queries)
    kept = hits.select("query_id", "paper_id", "rank", "is_hit")
    writers.write_hits(kept.filter("rank <= 25"), path, "head")
    writers.write_hits(kept.filter("rank > 25"), path, "tail")
    writers.write_hits(kept.filter("rank <= 25"), path, "head")
    read = t.spark.read.parquet(path)
    return read.select("query_id", "paper_id", "rank", F.col("is_hit").cast("int"), "slice")


@register(
    "append_metrics",
    sql.query(
        "SELECT m.*, run FROM metric_rows m CROSS JOIN (VALUES ('a'), ('b')) r(run)",
        metric_rows=sql.metrics("candidates", (10, 50), "prefetch"),
    ),
)
def append_metrics(t: Tables):
    """Metric rows of two runs in one log."""
    from shortlist.operators import evaluate

    path = _folder(t, "metrics")
    metrics = evaluate.evaluate(t.candidates, t.queries, (10, 50))
    for run in ("a", "b"):
        writers.append_metrics(metrics, path, run=run)
    read = t.spark.read.json(path)
    return read.select("k", *rounded(*METRICS), "n_queries", "n_skipped", "run")
