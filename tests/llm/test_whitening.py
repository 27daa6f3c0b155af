"""Whitening against a plain eigenvalue decomposition with exact integers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from shortlist.llm import whitening
from shortlist.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, _key string, component string, n int"


def _table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "k", "c", 1) for i, v in rows], SCHEMA)


def _integers(vectors):
    return [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]


def _check(found, rows, components=8):
    """Compare rows of the operator with eigenvectors of the covariance of all usable rows."""
    xs = _integers([v for _, v in rows])
    n, dim = len(xs), len(xs[0])
    sums = [sum(x[d] for x in xs) for d in range(dim)]
    centred = np.array([[(n * x[d] - sums[d]) / n for d in range(dim)] for x in xs])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    rank = int((values > 1e-11 * values.max()).sum())
    count = min(components, dim, rank)
    assert len(found) == n * count
    exact = sorted((str(i), sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)))
                   for (i, _), x in zip(rows, xs, strict=True))
    for c in range(1, count + 1):
        of = [r for r in found if r["component"] == c]
        assert sorted((str(r["vec_id"]), int(r["deviation"])) for r in of) == exact
        assert {r["n"] for r in of} == {n}
        e = values[order[c - 1]]
        assert of[0]["explained"] == pytest.approx(e / values.sum(), rel=1e-9)
        assert of[0]["identity_error"] < 1e-9
        want = centred @ vectors[:, order[c - 1]] / np.sqrt(e)
        gaps = np.delete(np.abs(values - e), order[c - 1])
        if gaps.size and gaps.min() < 1e-6 * values.max():
            continue  # equal eigenvalues: any directions of their span
        got = np.array([r["whitened"] for r in of])
        if len({i for i, _ in rows}) == n:
            place = {i: k for k, (i, _) in enumerate(rows)}
            sign = np.sign(got @ want[[place[r["vec_id"]] for r in of]])
            assert np.allclose(got, sign * want[[place[r["vec_id"]] for r in of]], atol=1e-8)


@pytest.mark.parametrize("dim,n", [(1, 5), (5, 40), (12, 9), (40, 300)])
def test_equals_eigenvectors(spark, dim, n):
    rng = np.random.default_rng(dim)
    stretch = rng.random(dim) + 0.1
    rows = [(i, (rng.standard_normal(dim) * stretch).astype(np.float32).tolist()) for i in range(n)]
    found = whitening.whiten(_table(spark, rows).repartition(5), "vec_id", "embedding").collect()
    _check(found, rows)


def test_equal_eigenvalues_are_all_found(spark):
    rows = [(2 * d + s, [(1.0 - 2 * s) * (d == k) for k in range(10)]) for d in range(10)
            for s in range(2)]
    found = whitening.whiten(_table(spark, rows), "vec_id", "embedding").collect()
    _check(found, rows)
    assert {round(r["explained"], 9) for r in found} == {0.1}


def test_decaying_spectrum_takes_fewer_steps_than_entries(spark):
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.standard_normal((96, 96)))[0]
    spread = 100.0 * 0.6 ** np.arange(96)
    rows = [(i, ((rng.standard_normal(96) * spread) @ turn).tolist()) for i in range(200)]
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    table = _table(spark, rows)
    _check(whitening.whiten(table, "vec_id", "embedding").collect(), rows)
    kept = whitening.integer_rows(table, "vec_id", "embedding")
    assert whitening.fit_rows(kept).passes < 60


def test_unusable_rows_and_odd_tables(spark):
    rng = np.random.default_rng(4)
    good = [(i, np.float32(rng.standard_normal(6)).tolist()) for i in range(30)]
    good += [(100, [0.0] * 6), (3, good[3][1]), (None, good[5][1])]  # zero, repeated, no key
    bad = [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (203, [float("nan")] * 6),
           (204, [float("inf")] + [0.0] * 5), (205, [1.0, 2.0]), (206, [3e38] * 6)]
    found = whitening.whiten(_table(spark, good + bad), "vec_id", "embedding").collect()
    _check(found, good)
    for rows in ([], good[:1], [good[0]] * 4, bad[:2]):
        empty = whitening.whiten(_table(spark, rows), "vec_id", "embedding")
        assert empty.columns[:2] == ["vec_id", "component"] and empty.collect() == []


def test_deviations_are_exact_at_any_size():
    x = np.array([[1 << 50, -(1 << 40)], [5, 7], [100_001, 99_000]], dtype=np.int64)
    for n, sums in ((3, [1, 2]), (10**6, [10**11, 10**11]), (10**12, [10**30, -(10**25)])):
        want = [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
        assert whitening._deviations(x, n, sums) == want
        small = x[1:]
        assert whitening._deviations(small, n, sums) == want[1:]


def test_registered_query(spark):
    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    rows = [(r["vec_id"], r["embedding"]) for r in table if r["embedding"] is not None
            and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    result = QUERIES["op11_whiten_vectors"](spark, folder)
    assert dict(result.dtypes)["deviation"] == "bigint"
    _check(result.collect(), rows)
