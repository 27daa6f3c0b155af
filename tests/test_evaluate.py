import pytest

from shortlist.operators import candidates as C
from shortlist.operators import evaluate as E


def queries(spark, rows):
    full = [(q, c, p) for q, c, p in rows]
    return spark.createDataFrame(full, "query_id string, citing_id string, positive_ids array<string>")


def candidates(spark, lists):
    rows = [(q, p, i + 1, 1.0 / (i + 1)) for q, ps in lists.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "query_id string, paper_id string, rank int, score double")


def metrics(spark, lists, positives, **options):
    asked = queries(spark, [(q, "-", p) for q, p in positives.items()])
    rows = E.evaluate(candidates(spark, lists), asked, **options).collect()
    return {r["k"]: r for r in rows}


def test_f1_comes_from_the_means(spark):
    lists = {"1": ["a", "x", "y", "z"], "2": ["x", "y", "z", "w"]}
    got = metrics(spark, lists, {"1": ["a", "b"], "2": ["c"]}, ks=(2,))[2]
    assert (got["recall"], got["precision"]) == (0.25, 0.25)
    assert got["f1"] == pytest.approx(0.25)


def test_prefetch_positives_are_a_set_and_precision_divides_by_k(spark):
    got = metrics(spark, {"1": ["a", "b"]}, {"1": ["a", "a", "c"]}, ks=(1, 10))
    assert got[10]["recall"] == 0.5 and got[10]["precision"] == pytest.approx(0.1)
    assert got[1]["recall"] == 0.5 and got[1]["precision"] == 1.0


def test_rerank_divides_by_list_lengths(spark):
    lists = {"1": ["a", "b"], "2": ["x", "y", "z"]}
    got = metrics(spark, lists, {"1": ["a", "a"], "2": ["y"]}, ks=(2, 10), mode="rerank")
    # recall counts the repeated positive; precision divides by the longest list, 3
    assert got[10]["recall"] == pytest.approx((1 / 2 + 1) / 2)
    assert got[10]["precision"] == pytest.approx((1 / 3 + 1 / 3) / 2)
    assert got[2]["precision"] == pytest.approx((1 / 2 + 1 / 2) / 2)


def test_queries_without_candidates_count_as_misses(spark):
    got = metrics(spark, {"1": ["a"]}, {"1": ["a"], "2": ["b"]}, ks=(5,))[5]
    assert (got["recall"], got["n_queries"]) == (0.5, 2)


def test_queries_without_positives(spark):
    got = metrics(spark, {"1": ["a"], "2": ["a"]}, {"1": ["a"], "2": []}, ks=(5,))[5]
    assert (got["recall"], got["n_queries"], got["n_skipped"]) == (1.0, 1, 1)
    with pytest.raises(Exception, match="no positives"):
        metrics(spark, {"1": ["a"]}, {"1": ["a"], "2": []}, ks=(5,), strict=True)
    with pytest.raises(ValueError):
        metrics(spark, {}, {}, mode="other")


def test_recall_grows_with_k(spark):
    lists = {str(q): [str((q * 7 + i) % 50) for i in range(40)] for q in range(10)}
    got = metrics(spark, lists, {str(q): ["3", "17", "42"] for q in range(10)}, ks=range(1, 41))
    recalls = [got[k]["recall"] for k in sorted(got)]
    assert recalls == sorted(recalls) and recalls[-1] > 0


def test_position_and_hit_rate(spark):
    found = candidates(spark, {"1": ["a", "b", "c"], "2": ["a"]})
    truth = spark.createDataFrame(
        [("1", "b"), ("2", "z"), ("3", "a")], "query_id string, refid string"
    )
    rows = E.truth_position(found, truth).collect()
    assert {r["query_id"]: r["position"] for r in rows} == {"1": 1, "2": None, "3": None}
    assert E.hit_rate(found, truth, 1).first()["hit_rate"] == 0.0
    assert E.hit_rate(found, truth, 2).first()["hit_rate"] == pytest.approx(1 / 3)


def listed(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["paper_id"]))
    return out


def test_citing_paper_rules(spark):
    found = candidates(spark, {"1": ["a", "me", "b"], "2": ["me", "a", "b"], "3": ["a", "b", "c"]})
    asked = queries(spark, [("1", "me", ["me"]), ("2", "me", ["a"]), ("3", "me", [])])
    always = listed(C.drop_citing(found, asked, 2, "always"))
    assert always == {q: [(1, "a"), (2, "b")] for q in "123"}
    unless = listed(C.drop_citing(found, asked, 2, "unless_positive"))
    assert unless["1"] == [(1, "a"), (2, "me")] and unless["2"] == [(1, "a"), (2, "b")]
    assert listed(C.drop_citing(found, asked, 2, "never"))["2"] == [(1, "me"), (2, "a")]
    with pytest.raises(ValueError):
        C.drop_citing(found, asked, 2, "sometimes")


def test_contexts_and_papers(spark):
    contexts = spark.createDataFrame(
        [("c1", "see TARGETCIT", "p1", "p2"), ("c2", "x", "p9", "p1")],
        "context_id string, masked_text string, citing_id string, refid string",
    )
    papers = spark.createDataFrame(
        [("p1", "t", None)], "paper_id string, title string, abstract string"
    )
    corpus = spark.createDataFrame(
        [("c1", ["p2"]), ("c2", ["p1"]), ("c3", [])], "context_id string, positive_ids array<string>"
    )
    asked = {r["query_id"]: r for r in C.context_queries(corpus, contexts, papers).collect()}
    assert set(asked) == {"c1", "c2"}
    assert (asked["c1"]["citing_title"], asked["c1"]["citing_abstract"]) == ("t", "")
    assert asked["c2"]["citing_title"] == ""
    assert [r["context_id"] for r in C.missing_contexts(corpus, contexts).collect()] == ["c3"]
    with pytest.raises(Exception, match="unknown context: c3"):
        C.context_queries(corpus, contexts, papers, strict=True).collect()


def test_corpus_starts_without_candidates(spark):
    corpus = spark.createDataFrame(
        [("1", ["a"]), ("2", [])], "context_id string, positive_ids array<string>"
    )
    rows = C.with_candidates(corpus, candidates(spark, {"1": ["b", "a"]})).collect()
    assert {r["context_id"]: r["prefetched_ids"] for r in rows} == {"1": ["b", "a"], "2": []}
