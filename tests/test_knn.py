import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shortlist.operators import knn as K
from shortlist.operators.quantize import quantize


def table(spark, key, matrix, ids=None):
    ids = ids or [f"{i:03d}" for i in range(len(matrix))]
    rows = [(k, [float(x) for x in v]) for k, v in zip(ids, matrix)]
    return spark.createDataFrame(rows, f"{key} string, vec array<double>")


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["paper_id"])
        assert r["rank"] == len(out[r["query_id"]])
    return out


def brute(queries, docs, n):
    scores = np.round(queries @ docs.T, 9)
    return {
        f"{q:03d}": [f"{d:03d}" for d in np.lexsort((np.arange(len(docs)), -scores[q]))[:n]]
        for q in range(len(queries))
    }


def data(seed=0, n_docs=300, copies=100):
    rng = np.random.default_rng(seed)
    docs = rng.normal(size=(n_docs, 6))
    docs[rng.permutation(n_docs)[:copies]] = docs[0]  # a third are copies of one vector
    return rng.normal(size=(12, 6)), docs


@pytest.mark.parametrize("n", [1, 7, 120, 1000])
@pytest.mark.parametrize("broadcast_queries", [0, 5, 100])
def test_equals_brute_force(spark, n, broadcast_queries):
    q, d = data()
    got = K.knn(
        table(spark, "query_id", q), table(spark, "paper_id", d).repartition(4), n, 6,
        broadcast_queries=broadcast_queries, part_rows=40,
    )
    assert lists(got) == brute(q, d, n)


def test_block_sizes_do_not_matter(spark, monkeypatch):
    q, d = data(3)
    want = brute(q, d, 20)
    for parts, state in [(1, 1 << 24), (5, 400), (3, 40)]:
        monkeypatch.setattr(K, "BROADCAST_STATE", state)
        got = K.knn(
            table(spark, "query_id", q), table(spark, "paper_id", d), 20, 6,
            broadcast_queries=0, part_rows=50, min_parts=parts,
        )
        assert lists(got) == want


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10_000), st.integers(1, 30), st.integers(1, 40), st.integers(1, 9))
def test_chunks_keep_the_best(seed, n, n_docs, chunk):
    """The scan of a task, without Spark: small integers give many ties."""
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    q, d = rng.integers(-1, 2, size=(3, 2)).astype(float), rng.integers(-1, 2, size=(n_docs, 2))
    scan = K._Scan(pa.array(["000", "001", "002"]), q, n, "float32")
    rows = []
    order = rng.permutation(n_docs)
    for at in range(0, n_docs, chunk):
        part = order[at : at + chunk]
        ids = pa.array([f"{i:03d}" for i in part])
        vecs = pa.array([d[i].astype(float).tolist() for i in part])
        for batch in scan.add(ids, vecs):
            rows += batch.to_pylist()
    for query, want in brute(q, d, n).items():
        mine = [(-r["score"], r["paper_id"]) for r in rows if r["query_id"] == query]
        assert [p for _, p in sorted(mine)][:n] == want


def test_restriction_equals_filtering(spark):
    q, d = data(1)
    queries, docs = table(spark, "query_id", q), table(spark, "paper_id", d)
    some = docs.filter("cast(paper_id as int) % 3 = 0").select("paper_id")
    want = lists(K.knn(queries, docs.join(some, "paper_id"), 9, 6))
    assert lists(K.knn(queries, docs, 9, 6, allowed=some.union(some))) == want
    per_query = queries.select("query_id").crossJoin(some)
    assert lists(K.knn(queries, docs, 9, 6, allowed=per_query)) == want
    nothing = some.filter("false")
    assert lists(K.knn(queries, docs, 9, 6, allowed=nothing)) == {}


@pytest.mark.parametrize("precision", ["bool", "int4", "int8"])
@pytest.mark.parametrize("broadcast_queries", [0, 100])
def test_quantized_modes(spark, precision, broadcast_queries):
    q, d = data(2, n_docs=90, copies=30)
    queries, docs = table(spark, "query_id", q), table(spark, "paper_id", d)
    got = lists(
        K.knn(
            quantize(queries, precision, per_row=True), quantize(docs, precision), 15, 6,
            precision, broadcast_queries=broadcast_queries,
        )
    )
    if precision == "bool":
        qc, dc = np.where(q > 0, 1.0, -1.0), np.where(d > 0, 1.0, -1.0)
    else:
        steps = {"int4": 8, "int8": 128}[precision]

        def code(x, scale):
            return np.clip(np.round(x / scale * steps), -steps, steps - 1)

        qc = code(q, 4 * np.abs(q).std(axis=1, keepdims=True))
        dc = code(d, 4 * np.abs(d).std())
    assert got == brute(qc, dc, 15)


def test_no_queries_and_no_documents(spark):
    q, d = data()
    queries, docs = table(spark, "query_id", q), table(spark, "paper_id", d)
    for broadcast_queries in (0, 100):
        options = {"broadcast_queries": broadcast_queries}
        assert lists(K.knn(queries.filter("false"), docs, 3, 6, **options)) == {}
        assert lists(K.knn(queries, docs.filter("false"), 3, 6, **options)) == {}


def test_ties_of_merged_tasks_go_to_the_lower_id(spark):
    rows = [("q", "b", 1.0), ("q", "a", 1.0 + 1e-12), ("q", "c", 2.0)]
    scored = spark.createDataFrame(rows, "query_id string, paper_id string, score double")
    assert lists(K.rank_top(scored, 2)) == {"q": ["c", "a"]}
    assert "WindowGroupLimit" in K.rank_top(scored, 2)._jdf.queryExecution().toString()


def test_broadcast_plan_does_not_shuffle_documents(spark):
    q, d = data()
    found = K.knn(table(spark, "query_id", q), table(spark, "paper_id", d), 5, 6)
    below = found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[1]
    assert "Exchange" not in below
    assert found.filter(F.col("rank") == 1).count() == len(q)


@pytest.mark.parametrize("precision,high", [("float32", 0), ("int8", 128), ("int4", 8)])
def test_later_chunks_keep_what_the_first_ones_do(precision, high):
    """Full lists look at few scores only; ties, NaN and infinity are treated as before."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    q, d = rng.normal(size=(9, 5)), rng.normal(size=(700, 5))
    if high:
        q, d = (np.clip(np.round(x * high / 2), -high, high) for x in (q, d))
    else:
        d[50], d[60, 2] = np.nan, np.inf
    d[100:400] = d[7]
    ids = pa.array([f"{i:04}" for i in range(len(d))])
    scan = K._Scan(pa.array([str(i) for i in range(9)]), q, 6, precision)
    kept, calls = [], []
    for at in range(0, len(d), 35):
        calls.append(np.isinf(scan.floor).any())
        out = scan._score(slice(0, 9), ids.slice(at, 35), d[at : at + 35]).to_pylist()
        kept += [(r["query_id"], -round(r["score"], 9), r["paper_id"]) for r in out]
        assert all(sum(r["query_id"] == str(i) for r in out) <= 6 for i in range(9))
    assert calls.count(True) == 1
    finite = np.where(np.isfinite(q @ d.T), q @ d.T, -np.inf)
    for i in range(9):
        best = sorted((s, p) for query, s, p in kept if query == str(i))[:6]
        order = np.lexsort((np.arange(len(d)), -np.round(finite[i], 9)))[:6]
        assert [p for _, p in best] == [f"{j:04}" for j in order]


def test_codes_are_multiplied_in_single_precision_only_where_that_is_exact():
    assert K._codes_type("int8", 1024) is np.float32 and K._codes_type("int8", 1025) is np.float64
    assert K._codes_type("bool", 64) is np.float32 and K._codes_type("float32", 2) is np.float64


def test_grid_copies_follow_the_sizes_of_the_sides():
    """100,000 queries once went to each of 200 parts, and 20 rows of each came back from it."""
    value = 64 * K.VALUE_BYTES
    parts, blocks = K.grid_shape(
        200, 100_000 * value, 100_000 * (value + 20 * K.RESULT_BYTES), (1, 4), (200, 100_000)
    )
    assert parts <= 10 and blocks <= 25 and parts * blocks >= 190
