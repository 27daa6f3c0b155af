import pytest
from pyspark.sql import functions as F

from shortlist.operators import candidates as C
from shortlist.operators import lexical as L
from shortlist.operators.encode import hierarchical_encoder
from shortlist.plans import jobs
from shortlist.plans.retrievers import dense_retriever, lexical_retriever
from shortlist.sources import readers, snapshots
from shortlist.storage import materialize

WORDS = [f"w{i}" for i in range(30)]


@pytest.fixture(scope="module")
def world(spark):
    papers = spark.createDataFrame(
        [
            (f"p{i:02d}", f"{WORDS[i]} study", f"{WORDS[(i * 3) % 30]} {WORDS[(i + 1) % 30]} common")
            for i in range(30)
        ],
        "paper_id string, title string, abstract string",
    )
    contexts = spark.createDataFrame(
        [
            (f"c{i}", f"as in {WORDS[i]} {WORDS[(i * 3) % 30]} TARGETCIT", f"p{(i + 5) % 30:02d}", f"p{i:02d}")
            for i in range(20)
        ],
        "context_id string, masked_text string, citing_id string, refid string",
    )
    corpus = contexts.select("context_id", F.array("refid").alias("positive_ids"))
    vectors = spark.createDataFrame(
        [(w, [float(i == j) for j in range(30)]) for i, w in enumerate(WORDS)],
        "word string, vector array<float>",
    )
    encoder = hierarchical_encoder(vectors, 30, {3: 5.0})
    index = (
        materialize(L.build_postings(papers), "postings"),
        materialize(L.build_doc_stats(papers), "doc-stats"),
    )
    return papers, contexts, corpus, encoder, index


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["paper_id"])
    return out


def test_index_is_refreshed(spark, world, tmp_path):
    (papers, _, _, encoder, _), path = world, f"{tmp_path}/versions"
    assert jobs.refresh_index(papers, encoder, path, n_buckets=8) == 1
    retitled = papers.withColumn("title", F.lit("w0 w0 w0"))
    changed = retitled.filter("paper_id < 'p03'")
    assert jobs.refresh_index(changed, encoder, path) == 2
    jobs.build_index(changed.union(papers.filter("paper_id >= 'p03'")), encoder, f"{tmp_path}/all")
    whole = spark.read.parquet(f"{tmp_path}/all").select("paper_id", "vec")
    found = snapshots.read_snapshot(spark, path)
    assert sorted(found.collect()) == sorted(whole.collect())


def test_index_is_reproducible(spark, world, tmp_path):
    papers, _, _, encoder, _ = world
    jobs.build_index(papers, encoder, f"{tmp_path}/a")
    jobs.build_index(papers.repartition(5), encoder, f"{tmp_path}/b")
    a, b = (
        sorted(map(tuple, readers.read_index(spark, f"{tmp_path}/{x}").collect())) for x in "ab"
    )
    assert a == b and len(a) == 30
    jobs.build_index(papers, encoder, f"{tmp_path}/c", size=7, seed=2)
    assert readers.read_index(spark, f"{tmp_path}/c").count() == 7


def test_both_retrievers_find_the_cited_paper(spark, world, tmp_path):
    papers, contexts, corpus, encoder, index = world
    jobs.build_index(papers, encoder, f"{tmp_path}/index")
    dense = dense_retriever(encoder, readers.read_index(spark, f"{tmp_path}/index"), 30)
    for retriever in (lexical_retriever(*index), dense):
        metrics = jobs.evaluate_prefetch(corpus, contexts, papers, retriever, (1, 10)).collect()
        recall = {r["k"]: r["recall"] for r in metrics}
        assert recall[10] == 1.0 and recall[1] > 0.5
        found = lists(jobs.generate_candidates(corpus, contexts, papers, retriever, 5))
        citing = {r["context_id"]: r["citing_id"] for r in contexts.collect()}
        assert set(found) == set(citing)
        assert all(citing[q] not in ids and len(ids) <= 5 for q, ids in found.items())
        sampled = jobs.generate_candidates(corpus, contexts, papers, retriever, 5, size=4, seed=1)
        assert {q: found[q] for q in lists(sampled)} == lists(sampled)
        assert len(lists(sampled)) == 4


def test_reranking(spark, world, tmp_path):
    papers, contexts, corpus, encoder, index = world
    queries = jobs.stored_queries(corpus, contexts, papers)
    retriever = lexical_retriever(*index)
    vectors = materialize(jobs.embed_papers(papers, encoder), "index")
    tables = jobs.feature_tables(queries, papers, *index, encoder, vectors, ["as", "in"])

    def scorer(pairs):
        return jobs.R.score_pairs(tables.features(pairs), {"bm25": 1.0, "cosine": 1.0}, -3.0)

    truth = contexts.select(F.col("context_id").alias("query_id"), "refid")
    rates = jobs.evaluate_two_stage(queries, truth, retriever, scorer, 10, 3).collect()
    rate = {r["stage"]: r["hit_rate"] for r in rates}
    assert rate["reranked"] >= rate["retrieved"] > 0.5
    candidates = materialize(jobs.prefetch(queries, retriever, 10, "unless_positive"), "lists")
    for start in (0, 10):
        metrics = jobs.evaluate_rerank(
            candidates, queries, scorer, 10, (3,), strict=True,
            hits_path=f"{tmp_path}/hits", slice_name=f"{start}_10",
        ).first()
        assert metrics["recall"] == pytest.approx(rate["reranked"])
    assert spark.read.parquet(f"{tmp_path}/hits").count() == 2 * candidates.count()
    loss = jobs.validation_loss(candidates, queries, scorer, size=8, n_document=4).first()
    assert loss["n_queries"] == 8 and loss["loss"] >= 0


def test_mining_round(spark, world):
    papers, contexts, corpus, encoder, _ = world
    done = jobs.mining_round(
        corpus, corpus, contexts, papers, encoder,
        lambda e, index: dense_retriever(e, index, 30),
        n_examples=12, top_k=8, ks=(5, 8), seed=3, stopwords=["as"], budget=20, bucket_queries=6,
    )
    assert len(lists(done.candidates)) == 12
    assert done.samples.filter("role = 'query'").count() == 12
    assert done.samples.filter("role = 'hard'").count() == 36
    assert done.losses.count() == done.samples.select("batch_id").distinct().count()
    assert [r["k"] for r in done.metrics.orderBy("k").collect()] == [5, 8]


def test_one_call_may_ask_nothing(spark, world):
    papers, contexts, corpus, encoder, index = world
    queries = C.context_queries(corpus.filter("false"), contexts, papers)
    assert jobs.prefetch(queries, lexical_retriever(*index), 5).count() == 0
    assert jobs.prefetch(queries, dense_retriever(encoder, jobs.embed_papers(papers, encoder), 30), 5).count() == 0


def test_short_passages_in_any_number(spark, tmp_path, monkeypatch):
    """Passages of one or two words beyond one block are matched too."""
    from workload import views

    monkeypatch.setattr(views, "SHORT_PASSAGES", 40)
    docs = [(i, f"word{i} pair{i} end") for i in range(130)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    passages = [(i, f"word{i}" if i % 2 else f"word{i} pair{i}") for i in range(100, 230)]
    passages += [(500, "pair7 end"), (501, "word8 pair8 end")]
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = views.Tables(spark, str(tmp_path)).positives.collect()
    want = {(f"b{i}", str(d)) for i, p in passages for d, text in docs if p in text}
    assert {(r["context_id"], r["paper_id"]) for r in rows} == want and len(want) > 30


def test_token_sets_are_made_for_listed_papers_only(spark, world):
    papers, contexts, corpus, encoder, (postings, doc_stats) = world
    queries = jobs.stored_queries(corpus, contexts, papers)
    index = jobs.embed_papers(papers, encoder)
    tables = jobs.feature_tables(queries, papers, postings, doc_stats, encoder, index)
    pairs = spark.createDataFrame([("c0", "p01"), ("c1", "p01")], "query_id string, paper_id string")
    found = {r["paper_id"]: set(r["tokens"]) for r in tables.paper_sets(pairs).collect()}
    assert found == {"p01": {"w1", "w2", "w3", "study", "common"}}


def test_encoder_moves_no_text(spark, world):
    papers, encoder = world[0], world[3]
    plan = jobs.embed_papers(papers, encoder)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY" not in plan
