from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shortlist.operators import mining as M
from shortlist.operators import rerank as R
from shortlist.operators.numbering import dense_index, ordered_index, sample_rows


def make_queries(spark, n=12):
    rows = [(f"q{i}", f"p{i}", [f"p{i + 1}", f"p{i + 2}", f"p{i + 1}"][: i % 3 + 1]) for i in range(n)]
    return spark.createDataFrame(
        rows, "query_id string, citing_id string, positive_ids array<string>"
    )


def make_candidates(spark, n=12, length=15):
    rows = [
        (f"q{i}", f"p{(i + 3 * j) % 40}", j + 1, 1.0 / (j + 1)) for i in range(n) for j in range(length)
    ]
    return spark.createDataFrame(rows, "query_id string, paper_id string, rank int, score double")


def make_papers(spark, n=40):
    return spark.createDataFrame([(f"p{i}",) for i in range(n)], "paper_id string")


def sets(spark, key, rows):
    return spark.createDataFrame(rows, f"{key} string, tokens array<string>")


def test_jaccard(spark):
    a, b = sets(spark, "query_id", [("q", ["x", "y", "z"]), ("e", [])]), sets(
        spark, "paper_id", [("p", ["y", "z", "u", "v"]), ("n", [])]
    )
    pairs = spark.createDataFrame(
        [("q", "p"), ("e", "n"), ("q", "missing")], "query_id string, paper_id string"
    )
    got = {(r["query_id"], r["paper_id"]): r["jaccard"] for r in M.jaccard_pairs(pairs, a, b).collect()}
    assert got[("q", "p")] == pytest.approx(0.4)
    assert got[("e", "n")] == 0.0 and got[("q", "missing")] == 0.0


def test_token_sets_with_lemmas(spark):
    df = spark.createDataFrame([("1", "the cats, cat"), ("2", "")], "query_id string, text string")
    table = spark.createDataFrame([("cats", "cat")], "token string, lemma string")
    got = M.token_sets(df, "query_id", F.col("text"), ["the"], table).collect()
    assert {r["query_id"]: r["tokens"] for r in got} == {"1": ["cat"], "2": []}


def test_pool_has_neither_positives_nor_the_citing_paper(spark):
    queries, candidates = make_queries(spark), make_candidates(spark)
    pool = defaultdict(set)
    for r in M.hard_negative_pool(candidates.union(candidates), queries).collect():
        assert r["paper_id"] not in pool[r["query_id"]]
        pool[r["query_id"]].add(r["paper_id"])
    listed = defaultdict(set)
    for r in candidates.collect():
        listed[r["query_id"]].add(r["paper_id"])
    for r in queries.collect():
        want = listed[r["query_id"]] - set(r["positive_ids"]) - {r["citing_id"]}
        assert pool[r["query_id"]] == want


def test_levels_of_hard_negatives(spark):
    queries = spark.createDataFrame(
        [("q", "me", ["a", "b"])], "query_id string, citing_id string, positive_ids array<string>"
    )
    pool = spark.createDataFrame([("q", "near"), ("q", "far")], "query_id string, paper_id string")
    query_sets = sets(spark, "query_id", [("q", ["x", "y"])])
    paper_sets = sets(
        spark, "paper_id",
        [("a", ["x", "y"]), ("b", ["z"]), ("near", ["x", "u"]), ("far", ["x", "y", "z", "u", "v"])],
    )
    threshold = M.positive_threshold(queries, query_sets, paper_sets).first()["threshold"]
    assert threshold == pytest.approx(0.5)
    got = M.mine_hard_negatives(pool, queries, query_sets, paper_sets, 9).collect()
    assert {r["paper_id"]: r["level"] for r in got} == {"near": 3, "far": 3}
    closer = paper_sets.filter("paper_id != 'near'").union(sets(spark, "paper_id", [("near", ["x"])]))
    got = M.mine_hard_negatives(pool, queries, query_sets, closer, 9).collect()
    assert {r["paper_id"]: r["level"] for r in got} == {"near": 2, "far": 3}
    assert M.mine_hard_negatives(pool, queries, query_sets, closer, 1).count() == 1


def test_samples_do_not_depend_on_partitioning(spark):
    queries, candidates, papers = make_queries(spark), make_candidates(spark), make_papers(spark)
    query_sets = sets(spark, "query_id", [(f"q{i}", [f"w{i}", "w"]) for i in range(12)])
    paper_sets = sets(spark, "paper_id", [(f"p{i}", [f"w{i % 5}", "w"]) for i in range(40)])

    def draw(parts, seed=0):
        frames = [df.repartition(parts) for df in (queries, candidates, papers, query_sets, paper_sets)]
        samples = M.assign_batches(
            M.training_samples(*frames, n_positive=2, n_easy=2, seed=seed), 12, seed, 5
        )
        return sorted(tuple(r) for r in samples.select(
            "batch_id", "row_id", "level", "role", F.coalesce("paper_id", F.lit(""))
        ).collect())

    first = draw(1)
    assert first == draw(7) and first != draw(1, seed=1)
    roles = Counter(r[3] for r in first)
    assert roles["query"] == 12 and roles["hard"] == 36 and roles["easy"] == 24
    assert roles["positive"] == sum(min(i % 3 + 1, 2) for i in range(12))
    assert len({r[1] for r in first}) + 4 >= len(first)  # only repeated positives repeat


def test_easy_negatives_are_uniform_draws(spark):
    queries = spark.createDataFrame([(f"q{i}",) for i in range(400)], "query_id string")
    drawn = M.sample_easy_negatives(queries, make_papers(spark, 10), 5, 1).collect()
    counts = Counter(r["paper_id"] for r in drawn)
    assert len(drawn) == 2000 and len(counts) == 10 and max(counts.values()) < 300


def test_batches_hold_whole_groups_up_to_the_budget(spark):
    rows = [(f"q{i}", f"p{j}", 3, "hard", 0) for i in range(60) for j in range(i % 7 + 1)]
    samples = spark.createDataFrame(
        rows, "query_id string, paper_id string, level int, role string, draw int"
    )
    batches, homes = Counter(), defaultdict(set)
    largest = defaultdict(int)
    for r in M.assign_batches(samples, 20, 3, 25).collect():
        batches[r["batch_id"]] += 1
        homes[r["query_id"]].add(r["batch_id"])
    assert all(len(h) == 1 for h in homes.values()) and len(homes) == 60
    assert max(batches.values()) < 20 + 7 and len({b.split("-")[0] for b in batches}) == 3
    assert largest is not None


GOLDEN = [
    # row, class, level, vector with the wanted cosines to both anchors
    ("0", "A", 0, [1.0, 0.0]), ("1", "A", 1, [0.8, 0.0]), ("2", "A", 2, [0.7, 0.0]),
    ("3", "A", 3, [0.75, 0.0]), ("4", "B", 0, [0.0, 1.0]), ("5", "B", 1, [0.2, 0.6]),
]


def batch(spark, rows):
    full = []
    for row, group, level, (x, y) in rows:
        rest = max(0.0, 1 - x * x - y * y) ** 0.5
        full.append(("b", row, group, level, [x, y, rest]))
    return spark.createDataFrame(
        full, "batch_id string, row_id string, query_id string, level int, vec array<double>"
    )


def test_golden_triplet_loss(spark):
    samples = batch(spark, GOLDEN)
    triplets = M.build_triplets(samples)
    assert triplets.count() == 8
    assert M.triplet_loss(samples).first()["loss"] == pytest.approx(0.15)
    only_first = M.triplet_loss(samples, positive_levels=[1]).first()["loss"]
    assert only_first == pytest.approx(0.05)


@pytest.mark.parametrize("similarity", ["cosine", "euclidean"])
def test_triplet_loss_equals_its_definition(spark, similarity):
    rng = np.random.default_rng(4)
    n = 24
    groups = [f"g{i % 5}" for i in range(n)]
    levels = [0 if i < 5 else int(rng.integers(1, 4)) for i in range(n)]
    vecs = rng.normal(size=(n, 4))
    rows = [("b", f"r{i}", groups[i], levels[i], vecs[i].tolist()) for i in range(n)]
    samples = spark.createDataFrame(
        rows, "batch_id string, row_id string, query_id string, level int, vec array<double>"
    )
    if similarity == "cosine":
        unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
        sim = unit @ unit.T
    else:
        sim = -np.linalg.norm(vecs[:, None] - vecs[None], axis=2)
    want, count = 0.0, 0
    for a in range(n):
        for p in range(n):
            for x in range(n):
                if len({a, p, x}) < 3 or levels[a] or groups[a] != groups[p]:
                    continue
                if levels[p] not in (1, 2) or levels[x] == 0:
                    continue
                same = groups[x] == groups[p]
                if same and levels[x] <= levels[p]:
                    continue
                level = levels[x] if same else 4
                count += 1
                want += max(0.0, sim[a, x] - sim[a, p] + 0.05 * (level - levels[p]))
    assert M.build_triplets(samples).count() == count
    got = M.triplet_loss(samples, similarity=similarity).first()["loss"]
    assert got == pytest.approx(want)


def test_triplet_loss_is_one_exchange(spark, monkeypatch):
    samples = batch(spark, GOLDEN)
    both = samples.union(samples.withColumn("batch_id", F.lit("c")))
    alone = samples.filter("level > 0").withColumn("batch_id", F.lit("no anchor"))
    broken = samples.withColumn("vec", F.lit(None).cast("array<double>"))
    losses = M.triplet_loss(both.union(alone).union(broken))
    plan = losses._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    found = {r.batch_id: r.loss for r in losses.collect()}
    assert found == {"b": pytest.approx(0.15), "c": pytest.approx(0.15)}
    monkeypatch.setattr(M, "ANCHOR_ROWS", 1)
    assert M.triplet_loss(samples).first()["loss"] == pytest.approx(0.15)
    assert M.triplet_loss(samples.limit(0)).count() == 0
    with pytest.raises(ValueError, match="unknown similarity"):
        M.triplet_loss(samples, similarity="dot")


def scored(spark, lists):
    rows = [(q, f"p{i}", s, v) for q, xs in lists.items() for i, (s, v) in enumerate(xs)]
    return spark.createDataFrame(rows, "query_id string, paper_id string, score double, level int")


def test_golden_rank_loss(spark):
    lists = {"q": [(0.9, 0), (0.4, 1), (0.85, 1), (0.95, 1)], "r": [(0.9, 1)]}
    losses = R.pairwise_rank_loss(scored(spark, lists))
    got = {r["query_id"]: r["loss"] for r in losses.collect()}
    assert got["q"] == pytest.approx(0.2) and got["r"] == 0.0
    assert R.mean_loss(losses).first()["loss"] == pytest.approx(0.1)


@pytest.mark.parametrize("only_positive", [True, False])
def test_rank_loss_equals_its_definition(spark, only_positive):
    rng = np.random.default_rng(5)
    lists = {
        f"q{q}": [(round(float(rng.random()), 1), int(rng.integers(0, 3))) for _ in range(30)]
        for q in range(6)
    }
    losses = R.pairwise_rank_loss(
        scored(spark, lists), levels=(0, 1, 2), only_positive=only_positive
    )
    got = {r["query_id"]: r["loss"] for r in losses.collect()}
    for q, xs in lists.items():
        want = sum(
            max(0.0, sj - si + 0.1 * (lj - li))
            for si, li in xs for sj, lj in xs
            if lj > li and (li == 0 or not only_positive)
        )
        assert got[q] == pytest.approx(want)


def test_row_numbers(spark):
    papers = make_papers(spark, 500)
    for numbered in (dense_index(papers, "paper_id", 3), ordered_index(papers, "paper_id")):
        rows = numbered.collect()
        assert sorted(r["row_idx"] for r in rows) == list(range(500))
    by_key = sorted(ordered_index(papers, "paper_id").collect(), key=lambda r: r["row_idx"])
    assert [r["paper_id"] for r in by_key] == sorted(f"p{i}" for i in range(500))
    again = dense_index(papers.repartition(13), "paper_id", 3).collect()
    assert sorted(again) == sorted(dense_index(papers, "paper_id", 3).collect())


@pytest.mark.parametrize("shuffle", [True, False])
def test_large_samples_equal_small_ones(spark, monkeypatch, shuffle):
    papers = make_papers(spark, 300)

    def take(size, start):
        return {r[0] for r in sample_rows(papers, "paper_id", size, start, shuffle, 9).collect()}

    small = [take(50, 0), take(50, 20), take(50, 280)]
    monkeypatch.setattr("shortlist.operators.numbering.MAX_LIMIT_ROWS", 0)
    assert [take(50, 0), take(50, 20), take(50, 280)] == small
    assert len(small[0]) == 50 and len(small[2]) == 20 and len(take(0, 100)) == 200
    assert len(take(0, 0)) == 300
