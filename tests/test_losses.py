"""Rows that must not go missing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shortlist import storage
from shortlist.functions import hashing
from shortlist.operators import candidates as C
from shortlist.operators import mining as M
from shortlist.operators import rerank as R
from shortlist.operators.encode import model_encoder
from shortlist.operators.knn import knn
from shortlist.operators.numbering import sample_rows
from shortlist.plans import jobs
from shortlist.plans.retrievers import dense_retriever
from shortlist.sources import readers, writers
from workload.views import Tables


def test_short_passages_have_positives(spark, tmp_path):
    documents = [(0, "x alpha beta y"), (1, "alphabeta red"), (2, "xalpha betay reddish"), (3, None)]
    passages = [(0, "alpha beta"), (1, "red"), (2, "x alpha beta y"), (3, "no such words here")]
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    found = Tables(spark, str(tmp_path)).positives.collect()
    want = {("b0", "0"), ("b0", "2"), ("b1", "1"), ("b1", "2"), ("b2", "0")}
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_negatives_of_a_query_without_positives(spark):
    queries = spark.createDataFrame(
        [("q", "c", [])], "query_id string, citing_id string, positive_ids array<string>"
    )
    pool = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, paper_id string")
    sets = spark.createDataFrame([("q", ["x"])], "query_id string, tokens array<string>")
    papers = spark.createDataFrame(
        [("a", ["x"]), ("b", ["y"])], "paper_id string, tokens array<string>"
    )
    mined = M.mine_hard_negatives(pool, queries, sets, papers)
    assert sorted((r.paper_id, r.level) for r in mined.collect()) == [("a", 3), ("b", 3)]


@pytest.mark.parametrize("copied", [16_384, 0])
def test_neighbours_beside_a_broken_vector(spark, copied):
    rows = [(f"d{i}", [1.0, float(i)]) for i in range(8)]
    rows += [("nan", [float("nan"), 1.0]), ("inf", [float("inf"), 0.0])]
    docs = spark.createDataFrame(rows, "paper_id string, vec array<double>").coalesce(1)
    queries = spark.createDataFrame([("q", [0.0, 1.0])], "query_id string, vec array<double>")
    found = knn(queries, docs, 3, 2, broadcast_queries=copied).orderBy("rank")
    assert [r.paper_id for r in found.collect()] == ["d7", "d6", "d5"]
    allowed = docs.select(F.lit("q").alias("query_id"), "paper_id")
    listed = knn(queries, docs, 3, 2, allowed=allowed).orderBy("rank")
    assert [r.paper_id for r in listed.collect()] == ["d7", "d6", "d5"]


def test_draws_reach_beyond_32_bits(spark):
    size = 1 << 40
    drawn = spark.range(200).select(hashing.draw(1, F.lit(size), F.col("id")).alias("d"))
    values = [r.d for r in drawn.collect()]
    assert max(values) > 1 << 38 and 0 <= min(values) and max(values) < size


def test_malformed_json_fails(spark, tmp_path):
    (tmp_path / "papers.json").write_text('{"a": {"title": "t", "abstract": "x"}, "b": {"ti')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_papers(spark, str(tmp_path / "papers.json"), "json").collect()
    (tmp_path / "papers.jsonl").write_text('{"paper_id": "a"}\n{"paper_id": \n')
    with pytest.raises(Exception, match="(?i)malformed|FAILED_READ"):
        readers.read_papers(spark, str(tmp_path / "papers.jsonl"), "jsonl").collect()


@pytest.mark.parametrize("limit", [100_000, 0])
def test_sampling_takes_all_rows_of_a_key(spark, monkeypatch, limit):
    from shortlist.operators import numbering

    monkeypatch.setattr(numbering, "MAX_LIMIT_ROWS", limit)
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "k string, v int")
    for key, count in (("a", 3), ("b", 1)):
        picked = sample_rows(rows, "k", 1, 0 if key == "a" else 1, shuffle=False)
        assert picked.count() == count and {r.k for r in picked.collect()} == {key}


def test_missing_context_fails_when_asked(spark):
    corpus = spark.createDataFrame(
        [("c1", ["p"]), ("c2", ["p"])], "context_id string, positive_ids array<string>"
    )
    contexts = spark.createDataFrame(
        [("c1", "text", "p", "p")],
        "context_id string, masked_text string, citing_id string, refid string",
    )
    papers = spark.createDataFrame(
        [("p", "t", "a")], "paper_id string, title string, abstract string"
    )

    def retrieve(queries, n):
        return queries.select("query_id", F.lit("p").alias("paper_id"), F.lit(1).alias("rank"),
                              F.lit(0.5).alias("score"))

    assert C.missing_contexts(corpus, contexts).count() == 1
    loose = jobs.generate_candidates(corpus, contexts, papers, retrieve)
    assert loose.select("query_id").distinct().count() <= 1
    with pytest.raises(Exception, match="unknown context"):
        jobs.generate_candidates(corpus, contexts, papers, retrieve, strict_contexts=True).collect()


def test_rerun_of_a_slice_replaces_it(spark, tmp_path):
    hits = spark.createDataFrame([("q", "a", True)], "query_id string, paper_id string, is_hit boolean")
    for name in ("one", "two", "one"):
        writers.write_hits(hits, f"{tmp_path}/hits", name)
    assert spark.read.parquet(f"{tmp_path}/hits").count() == 2


def test_stored_lists_become_candidates(spark):
    corpus = spark.createDataFrame(
        [("c1", ["b", "a", "b"]), ("c2", []), ("c3", None)],
        "context_id string, prefetched_ids array<string>",
    )
    got = C.candidates_from_lists(corpus).collect()
    assert [tuple(r) for r in got] == [("c1", "b", 1), ("c1", "a", 2)]


def test_an_absent_positive_stands_behind_a_long_list(spark):
    lists = spark.createDataFrame([("q", "x"), ("q", "p7")], "query_id string, paper_id string")
    long_list = spark.range(3000).select(
        F.lit("q").alias("query_id"), F.concat(F.lit("p"), "id").alias("paper_id"),
        (F.col("id") + 1).cast("int").alias("rank"),
    )
    ranks = {r.paper_id: r["rank"] for r in R.with_ranks(lists, long_list).collect()}
    assert ranks == {"x": 3001, "p7": 8}


def test_a_refreshed_round_keeps_levels_and_samples(spark):
    words = "red green blue gold pink gray teal plum".split()
    papers = spark.createDataFrame(
        [(f"p{i}", words[i % 8], f"{words[i % 8]} {words[(i + 1) % 8]} paper {i}") for i in range(40)],
        "paper_id string, title string, abstract string",
    )
    contexts = spark.createDataFrame(
        [(f"c{i}", f"{words[i % 8]} {words[(i + 1) % 8]} TARGETCIT", f"p{i + 8}", f"p{i}") for i in range(8)],
        "context_id string, masked_text string, citing_id string, refid string",
    )
    corpus = contexts.select("context_id", F.array("refid").alias("positive_ids"))

    def make():
        import numpy as np

        return lambda texts: np.array(
            [[t.count(c) for c in "abcdefghijklmnop"] for t in texts], dtype=np.float32
        )

    done = jobs.mining_round(
        corpus, corpus, contexts, papers, model_encoder(make),
        lambda encoder, index: dense_retriever(encoder, index, 16),
        n_refreshed=12, n_validation=5, top_k=6, ks=(5,), seed=1, budget=20, bucket_queries=4,
    )
    samples = done.samples
    assert done.candidates.select("paper_id").distinct().count() <= 12
    assert samples.filter("role = 'positive'").count() == 8
    queries = jobs.stored_queries(corpus, contexts, papers)
    sets = jobs.text_sets(queries, papers)
    thresholds = {r.query_id: r.threshold for r in M.positive_threshold(queries, *sets).collect()}
    assert min(thresholds.values()) > 0.1
    hard = samples.filter("role = 'hard'").select("query_id", "paper_id", "level")
    for r in M.jaccard_pairs(hard, *sets).collect():
        assert r.level == (2 if r.jaccard >= thresholds[r.query_id] else 3)
    batches = samples.select("batch_id").distinct().count()
    assert done.losses.count() == batches and done.losses.filter("loss is null").count() == 0
    assert done.metrics.first()["n_queries"] == 5


def test_size_check_counts_bytes(spark):
    wide = spark.range(100).select(F.repeat(F.lit("x"), 10_000).alias("t"))
    assert storage.fits_broadcast(wide, 100)
    assert not storage.fits_broadcast(wide, 100, max_bytes=500_000)
    vectors = spark.range(100).select(F.array_repeat(F.lit(0.5), 5_000).alias("v"))
    assert not storage.fits_broadcast(vectors, 100, max_bytes=1_000_000)


def test_clearing_deletes_only_own_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "_WRITTEN", [])
    monkeypatch.setattr(storage, "scratch_dir", lambda _: f"file://{tmp_path}")
    (tmp_path / "other").mkdir()
    for name in ("a", "b"):
        assert storage.materialize(spark.range(3), name).count() == 3
    assert storage.clear_scratch(spark) == 2
    assert [p.name for p in tmp_path.iterdir()] == ["other"]
    assert storage.clear_scratch(spark) == 0
