"""Nearest neighbours, near-duplicate vectors and components against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shortlist.llm import ann_forest, embedding_dedup
from shortlist.llm.components import connected_components
from shortlist.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, _h1 string, rank string"


def _table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def _usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def _cos(a, b):
    a, b = np.array(a, dtype=np.float32).astype(float), np.array(b, dtype=np.float32).astype(float)
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def _rows(seed, n=120, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        kind = i % 6
        if kind < 3 or not rows:
            v = rng.standard_normal(dim)
        else:
            base = np.array(rows[rng.integers(0, len(rows))][1])
            v = base if kind == 3 else base + rng.standard_normal(dim) * (0.02 if kind == 4 else 0.1)
        rows.append((i, np.asarray(v, dtype=np.float32).tolist(), int(rng.integers(0, 2))))
    odd = [None, [], [0.0] * dim, [1.0] * (dim - 1) + [float("nan")], [float("inf")] + [1.0] * 15,
           [1.0] * (dim - 1) + [None], [1.0, 2.0, 3.0], [2.0, 4.0, 6.0]]
    rows += [(1000 + i, v, 0) for i, v in enumerate(odd)]
    return [*rows, (None, rows[0][1], 0), (2000, rows[0][1], None)]


def _links(rows, least):
    able = [r for r in rows if r[0] is not None and r[2] is not None and _usable(r[1])]
    return [(a[0], b[0]) for i, a in enumerate(able) for b in able[:i]
            if a[2] == b[2] and len(a[1]) == len(b[1]) and _cos(a[1], b[1]) >= least]


def test_near_duplicates(spark):
    rows = _rows(1)
    rows.append(rows[5])  # a repeated row is a vector of its own
    links = _links(rows, 0.93)
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    count = {}
    for a, b in links:
        one, two = sorted((find(a), find(b)))
        parent[two] = one
        for x in (a, b):
            count[x] = count.get(x, 0) + 1
    got = embedding_dedup.near_duplicates(_table(spark, rows), "vec_id", "embedding", "label")
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    found = got.collect()
    assert len(found) == len(rows) and len(links) > 30
    repeated = rows[5][0]
    for r in found:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, False)
            continue
        expected = count.get(r.vec_id, 0)
        if r.vec_id == repeated:
            expected //= 2  # both rows were counted under one id
        assert (r.vec_id, r.n_links) == (r.vec_id, expected)
        assert r.component_id == find(r.vec_id) and r.kept == (r.component_id == r.vec_id)
    empty = embedding_dedup.near_duplicates(_table(spark, []), "vec_id", "embedding", "label")
    assert empty.count() == 0


def test_codes_are_balanced_and_learned():
    rng = np.random.default_rng(2)
    sample = embedding_dedup._unit(rng.standard_normal((4000, 64)) @ np.diag(np.linspace(2, 1, 64)))
    rotations = embedding_dedup.Rotations(sample, 64)
    signs = np.concatenate([(sample - rotations.mean) @ p > 0 for p in rotations.planes], axis=1)
    assert np.abs(signs.mean(axis=0) - 0.5).max() < 0.1
    near = embedding_dedup._unit(sample + rng.standard_normal(sample.shape) * 0.35 / 8)
    cosines = (near * sample).sum(axis=1)
    one, two = rotations.parts(sample), rotations.parts(near)
    found = (one == two).any(axis=1)
    assert 0.93 < cosines.mean() < 0.96 and found.mean() > 0.99


@pytest.mark.parametrize("common", [0.0, 0.64, 0.8])
def test_recall_with_a_common_mean(spark, common):
    """Pairs just above the least cosine, among vectors whose mean cosine is ``common``."""
    rng = np.random.default_rng(7)
    unit = embedding_dedup._unit
    own = unit(rng.standard_normal((500, 64)))
    base = unit(np.sqrt(common) * unit(np.ones((1, 64))) + np.sqrt(1 - common) * own)
    there = rng.standard_normal(base.shape)
    there = unit(there - (there * base).sum(axis=1, keepdims=True) * base)
    near = 0.935 * base + np.sqrt(1 - 0.935**2) * there
    vectors = np.concatenate([base, near]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    units = unit(vectors.astype(float))
    links = (units @ units.T >= 0.93).sum(axis=1) - 1
    got = embedding_dedup.near_duplicates(_table(spark, rows), "vec_id", "embedding", "label")
    found = {r.vec_id: r.n_links for r in got.collect()}
    assert links.sum() >= 1000 and all(found[i] <= links[i] for i in found)
    assert sum(found.values()) >= 0.97 * links.sum()


def test_near_copies_are_not_paired(spark, monkeypatch):
    """Groups of near copies of several widths: exact link counts, rows in proportion to members."""
    rng = np.random.default_rng(11)
    unit = embedding_dedup._unit

    def copies(n, spread):
        base = unit(rng.standard_normal((1, 64)))
        return unit(base + spread * unit(rng.standard_normal((n, 64))))

    tight = np.concatenate([copies(900, 0.08), copies(300, 0.1)])
    wide = copies(60, 0.3)  # cosines on both sides of the bound
    vectors = np.concatenate([tight, wide, unit(rng.standard_normal((300, 64)))])
    vectors = vectors.astype(np.float32)
    units = unit(vectors.astype(float))
    links = (units @ units.T >= 0.93).sum(axis=1) - 1
    stored, write = {}, embedding_dedup.materialize

    def counted(df, name):
        done = write(df, name)
        stored[name] = done.count()
        return done

    monkeypatch.setattr(embedding_dedup, "materialize", counted)
    df = _table(spark, [(i, v.tolist(), 0) for i, v in enumerate(vectors)])
    got = embedding_dedup.near_duplicates(df, "vec_id", "embedding", "label").collect()
    found = {r.vec_id: r.n_links for r in got}
    assert [found[i] for i in range(1200)] == links[:1200].tolist()
    assert all(found[i] <= links[i] for i in found)
    assert sum(found[i] for i in range(1200, 1260)) >= 0.97 * links[1200:1260].sum() > 0
    component = {r.vec_id: r.component_id for r in got}
    assert {component[i] for i in range(900)} == {0} and component[1199] == 900
    made = sum(stored[f"dedup-{k}"] for k in ("near", "met", "judged", "border", "single"))
    assert made < 12 * len(vectors)


@pytest.mark.parametrize("bits", [12, 15, 20])
def test_longer_substrings_find_as_many(bits):
    rng = np.random.default_rng(12)
    unit = embedding_dedup._unit
    sample = unit(rng.standard_normal((4000, 64)))
    there = rng.standard_normal(sample.shape)
    there = unit(there - (there * sample).sum(axis=1, keepdims=True) * sample)
    near = 0.93 * sample + np.sqrt(1 - 0.93**2) * there
    for taught in (sample, sample[:0]):
        rotations = embedding_dedup.Rotations(taught, 64, 0.93, bits)
        one, two = rotations.parts(sample), rotations.parts(near)
        assert (one == two).any(axis=1).mean() > 0.97
        strangers = (one == np.roll(one, 1, axis=0)).sum() / len(one)
        assert strangers < 3 * rotations.tables / (1 << bits) + 0.01
    assert [embedding_dedup.part_bits(n) for n in (0, 1 << 14, 1 << 15, 1 << 22)] == [12, 12, 15, 20]


def test_search_small(spark):
    rows = _rows(3)
    rows += [(3000 + i, [1.0] * 16, 0) for i in range(12)]  # ties: the smaller ids win
    rows.append((3000, [1.0] * 16, 0))
    df = _table(spark, rows)
    got = ann_forest.search(df, "vec_id", "embedding", F.col("vec_id") % 3 == 0, 5, share=1.0)
    able = {r[0]: r[1] for r in rows if r[0] is not None and _usable(r[1])}
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) <= {k for k in able if k % 3 == 0}
    for q in [k for k in able if k % 3 == 0]:
        scored = sorted((-_cos(able[q], v), k) for k, v in able.items()
                        if k != q and len(v) == len(able[q]))[:5]
        mine = sorted(found.get(q, []))
        assert [m[0] for m in mine] == list(range(1, len(scored) + 1))
        assert [m[2] for m in mine] == pytest.approx([-s for s, _ in scored])
        for (_, k, _), (s, want) in zip(mine, scored, strict=True):
            assert k == want or abs(_cos(able[q], able[k]) + s) < 1e-12
    assert [m[1] for m in sorted(found[3000])] == [3001, 3002, 3003, 3004, 3005]
    nothing = ann_forest.search(_table(spark, []), "vec_id", "embedding", F.lit(True))
    assert nothing.count() == 0


def test_search_recall(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    units = embedding_dedup._unit(np.array([r.embedding for r in rows], dtype=float))
    hits = total = 0
    found = {}
    for r in QUERIES["op5_search_vectors"](spark, folder).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for q in np.flatnonzero(ids % 50 == 0):
        scores = units @ units[q]
        scores[q] = -2
        best = set(ids[np.argsort(-scores, kind="stable")[:5]].tolist())
        hits += len(best & found[int(ids[q])])
        total += 5
    assert total == 5 * len(found) and hits / total >= 0.9


def test_candidates_grow_with_the_prefix():
    rng = np.random.default_rng(4)
    vectors = embedding_dedup._unit(rng.standard_normal((500, 8)))
    forest = ann_forest.Forest(vectors)
    for least in (1, 50, 500):
        for q, found in enumerate(forest.candidates(vectors[:20], least)):
            assert len(found) >= least and q in found


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, size=(70, 2))]
    edges += [(k, k + 1) for k in range(500, 560)] + [(1, 1), (5, None)] + edges[:3]
    df = spark.createDataFrame(edges, "a long, b long")
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            one, two = sorted((find(a), find(b)))
            parent[two] = one
    got = connected_components(df, "a", "b").collect()
    assert {r.vertex: r.component for r in got} == {x: find(x) for x in parent}
    assert len(got) == len(parent)
    assert connected_components(df.limit(0), "a", "b").count() == 0
