import numpy as np
import pytest
from pyspark.sql import functions as F

from shortlist.operators import rerank as R
from tests.test_mining import make_candidates, make_queries


def listed(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["paper_id"])
    return out


def test_equal_scores_keep_their_order(spark):
    rows = [("q", "a", 1, 0.5), ("q", "b", 2, 0.9), ("q", "c", 3, 0.5), ("q", "d", 4, 0.9)]
    scored = spark.createDataFrame(rows, "query_id string, paper_id string, rank int, score double")
    assert listed(R.rerank(scored)) == {"q": ["b", "d", "a", "c"]}
    assert listed(R.rerank(scored, 3)) == {"q": ["b", "a", "c"]}
    assert listed(R.rerank(scored.filter("false"))) == {}


def test_labels(spark):
    queries, candidates = make_queries(spark), make_candidates(spark)
    positives = {r["query_id"]: r["positive_ids"] for r in queries.collect()}
    labelled = R.label_candidates(candidates, queries).collect()
    assert len(labelled) == candidates.count()
    for r in labelled:
        hit = r["paper_id"] in positives[r["query_id"]]
        assert r["is_hit"] == hit and r["level"] == (0 if hit else 1)


def test_training_lists(spark):
    queries, candidates = make_queries(spark), make_candidates(spark)
    info = {r["query_id"]: r for r in queries.collect()}
    lists = {}
    for r in R.rerank_training_lists(candidates, queries, 10, 2, top_k=8, seed=1).collect():
        lists.setdefault(r["query_id"], []).append(r)
    allowed = {}
    for r in candidates.filter("rank <= 8").collect():
        allowed.setdefault(r["query_id"], set()).add(r["paper_id"])
    assert set(lists) == set(info)
    for query, rows in lists.items():
        assert sorted(r["position"] for r in rows) == list(range(1, 11))
        positives = [r["paper_id"] for r in rows if r["level"] == 0]
        assert len(positives) == min(2, len(info[query]["positive_ids"]))
        barred = set(info[query]["positive_ids"]) | {info[query]["citing_id"]}
        for r in rows:
            if r["level"]:
                assert r["paper_id"] in allowed[query] - barred
    again = R.rerank_training_lists(candidates.repartition(9), queries, 10, 2, 8, 1).collect()
    assert sorted(again) == sorted(r for rows in lists.values() for r in rows)


def test_queries_without_negatives_are_reported(spark):
    queries = make_queries(spark)
    candidates = make_candidates(spark).filter("query_id != 'q3'")
    got = R.queries_without_negatives(candidates, queries).collect()
    assert [r["query_id"] for r in got] == ["q3"]
    assert "q3" not in {r[0] for r in R.rerank_training_lists(candidates, queries).collect()}


def test_pair_texts_of_unknown_papers(spark):
    queries = spark.createDataFrame(
        [("q", "t", "a", "see TARGETCIT")],
        "query_id string, citing_title string, citing_abstract string, local_context string",
    )
    papers = spark.createDataFrame(
        [("p", "x", None)], "paper_id string, title string, abstract string"
    )
    pairs = spark.createDataFrame(
        [("q", "p", 1), ("q", "z", 2)], "query_id string, paper_id string, rank int"
    )
    rows = R.pair_texts(pairs, queries, papers).orderBy("rank").collect()
    assert [r["candidate_text"] for r in rows] == ["x ", " "]
    assert {r["query_text"] for r in rows} == {"t a<sep>see <cit>"}


def test_external_pair_model(spark):
    def make_predict_fn():
        import numpy as np

        def predict(query_text, candidate_text):
            return np.array([float(len(q) * len(c)) for q, c in zip(query_text, candidate_text)])

        return predict

    rows = [("q", "a", 1, "xx", "y"), ("q", "b", 2, "xx", "yyy")]
    pairs = spark.createDataFrame(
        rows,
        "query_id string, paper_id string, rank int, query_text string, candidate_text string",
    )
    scored = R.model_scorer(make_predict_fn, 1)(pairs)
    assert listed(R.rerank(scored)) == {"q": ["b", "a"]}


def test_scores_lie_between_zero_and_one(spark):
    df = spark.createDataFrame([(1.0, -30.0), (0.0, 0.0)], "x double, y double")
    got = [r["score"] for r in R.score_pairs(df, {"x": 2.0, "y": 1.0}, 0.5).collect()]
    assert 0 < got[0] < 1e-6 and got[1] == pytest.approx(0.6224593)


def test_learning_lowers_the_loss(spark):
    rows = [
        (f"q{q}", i, 0 if i == 0 else 1, float(i == 0) + ((q * 7 + i * 3) % 5) / 4, float((q + i) % 3))
        for q in range(40) for i in range(8)
    ]
    lists = spark.createDataFrame(
        rows, "query_id string, position int, level int, good double, noise double"
    )
    weights = R.fit_pairwise_ranker(lists, ("good", "noise"))
    assert weights["good"] > abs(weights["noise"])

    def loss(w):
        return R.mean_loss(R.pairwise_rank_loss(R.score_pairs(lists, w))).first()["loss"]

    assert loss(weights) < loss({"good": 0.0, "noise": 0.0})
    assert lists.select(F.max("level")).first()[0] == 1


def test_learned_weights_equal_a_plain_solution(spark):
    """Newton's method on the logistic loss of all pairs, written out."""
    rng = np.random.default_rng(12)
    rows = []
    for q in range(40):
        for i in range(8):
            level = 0 if i < 2 else 1
            rows.append((f"q{q}", level, float(rng.normal() + (level == 0)), float(rng.normal() * 3),
                         float(rng.normal() - 0.5 * (level == 0))))
    lists = spark.createDataFrame(rows, "query_id string, level int, one double, two double, three double")
    got = R.fit_pairwise_ranker(lists, ("one", "two", "three"), reg=0.05, max_iter=200)
    apart = [np.subtract(a[2:], b[2:]) for a in rows for b in rows
             if a[0] == b[0] and a[1] == 0 and b[1] != 0]
    x = np.concatenate([apart, np.negative(apart)])
    y = np.repeat([1.0, 0.0], len(apart))
    scale = x.std(axis=0, ddof=1)  # the penalty is on weights of scaled features
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (p - y) / len(x) + 0.05 * scale**2 * w
        bend = (x * (p * (1 - p))[:, None]).T @ x / len(x) + np.diag(0.05 * scale**2)
        w -= np.linalg.solve(bend, slope)
    assert [got[n] for n in ("one", "two", "three")] == pytest.approx(w.tolist(), rel=1e-3, abs=1e-4)


def test_few_keys_are_copied_to_the_texts(spark):
    queries, candidates = make_queries(spark), make_candidates(spark)
    rows = [(f"x{i}", "title", "text") for i in range(50)]
    papers = spark.createDataFrame(rows, "paper_id string, title string, abstract string")
    queries = queries.selectExpr("*", "'' citing_title", "'' citing_abstract", "'' local_context")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = R.pair_texts(candidates, queries, papers)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftSemi, BuildRight" in plan.toString()
