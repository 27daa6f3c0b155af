"""Search with documents of its own for every query, against plain loops."""

from __future__ import annotations

import numpy as np
import pytest

from shortlist.operators import knn as K
from shortlist.operators import restricted as R


@pytest.mark.parametrize("numbers", [[], [0], [5], [0, 1, 2, 3, 4, 9], list(range(500)), [3, 100_000]])
def test_packed_numbers_come_back(numbers):
    packed = R.pack_numbers(np.array(numbers, dtype=np.int64))
    assert R.unpack_numbers(packed).tolist() == numbers
    assert len(packed) <= 1 + 4 * len(numbers)


@pytest.mark.parametrize("n,cell_pairs", [(1, 40), (4, 300), (50, 10**6)])
def test_equals_plain_loops(spark, n, cell_pairs, monkeypatch):
    monkeypatch.setattr(R, "CELL_PAIRS", cell_pairs)
    monkeypatch.setattr(R.best_allowed, "__defaults__", (cell_pairs,))
    rng = np.random.default_rng(n)
    docs = {f"d{i}": rng.integers(-3, 4, 6).astype(float).tolist() for i in range(300)}
    docs["bad"] = [float("nan")] * 6
    queries = {f"q{i}": rng.integers(-3, 4, 6).astype(float).tolist() for i in range(25)}
    allowed = [(q, d) for q in queries for d in docs if rng.random() < (0.9 if q == "q3" else 0.1)]
    allowed += [("q1", "unknown"), ("unknown", "d1"), allowed[0], allowed[0]]
    found = K.knn(
        spark.createDataFrame(list(queries.items()), "query_id string, vec array<double>"),
        spark.createDataFrame(list(docs.items()), "paper_id string, vec array<double>"),
        n, 6, allowed=spark.createDataFrame(allowed, "query_id string, paper_id string"),
        part_rows=70, min_parts=2,
    ).collect()
    want = {}
    for q, v in queries.items():
        pairs = {(d, float(np.dot(v, docs[d]))) for a, d in allowed if a == q and d in docs}
        best = sorted((x for x in pairs if np.isfinite(x[1])), key=lambda x: (-x[1], x[0]))[:n]
        want.update({(q, i + 1): x for i, x in enumerate(best)})
    assert {(r["query_id"], r["rank"]): (r["paper_id"], r["score"]) for r in found} == want


def test_vectors_move_once_per_cell(spark):
    """No vector is joined to the allowed pairs."""
    docs = spark.createDataFrame([(f"d{i}", [1.0, float(i)]) for i in range(50)], "paper_id string, vec array<double>")
    queries = spark.createDataFrame([("q", [1.0, 1.0])], "query_id string, vec array<double>")
    allowed = docs.selectExpr("'q' as query_id", "paper_id")
    found = K.knn(queries, docs, 3, 2, allowed=allowed)
    assert [r["paper_id"] for r in found.orderBy("rank").collect()] == ["d49", "d48", "d47"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 2  # queries with their packed lists, and bare ids with their numbers
