"""An index whose touched buckets alone are written anew."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from shortlist.sources import snapshots

N = 400


def vectors(spark, values):
    rows = [(f"p{i}", [float(i), v]) for i, v in values]
    return spark.createDataFrame(rows, "paper_id string, vec array<double>")


def rows(df):
    return {r.paper_id: list(r.vec) for r in df.collect()}


def files(path):
    found = (os.path.join(d, f) for d, _, fs in os.walk(f"{path}/buckets") for f in fs)
    return {f for f in found if f.endswith(".parquet")}


def test_refresh_equals_a_full_rebuild(spark, tmp_path):
    path, whole = f"{tmp_path}/index", f"{tmp_path}/whole"
    first = snapshots.write_snapshot(vectors(spark, [(i, 0.0) for i in range(N)]), path, 32)
    old = files(path)
    changed = vectors(spark, [(i, 1.0) for i in (3, 77, 150, N)])  # 1 % of the papers, one new
    gone = spark.createDataFrame([("p9",), ("p3",), ("never",)], "paper_id string")
    second = snapshots.refresh_snapshot(path, changed, gone)
    assert snapshots.versions(spark, path) == [first, second] == [1, 2]
    want = {i: float(i in (3, 77, 150, N)) for i in range(N + 1) if i != 9}
    snapshots.write_snapshot(vectors(spark, list(want.items())), whole, 8)
    assert rows(snapshots.read_snapshot(spark, path)) == rows(snapshots.read_snapshot(spark, whole))
    assert len(rows(snapshots.read_snapshot(spark, path, first))) == N
    # only the buckets of changed and removed ids are written again, and no old file is touched
    ids = changed.select("paper_id").union(gone).select(snapshots._bucket(32).alias("b"))
    touched = {r.b for r in ids.collect()}
    new = files(path) - old
    written = {int(f.split("bucket=")[1].split("/")[0]) for f in new}
    assert old <= files(path) and written <= touched and len(touched) <= 6


def test_a_refresh_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/index"
    snapshots.write_snapshot(vectors(spark, [(i, 0.0) for i in range(N)]), path, 16)
    before = rows(snapshots.read_snapshot(spark, path))
    changed = vectors(spark, [(5, 1.0)])

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(snapshots, "_write_version", die)
        with pytest.raises(RuntimeError, match="lost"):
            snapshots.refresh_snapshot(path, changed)
    # a version folder that was never completed is no version either
    os.makedirs(f"{path}/versions/{2:010d}")
    assert snapshots.versions(spark, path) == [1]
    assert rows(snapshots.read_snapshot(spark, path)) == before
    assert snapshots.refresh_snapshot(path, changed) == 3
    assert rows(snapshots.read_snapshot(spark, path)) == {**before, "p5": [5.0, 1.0]}


def test_empty_and_missing_indexes(spark, tmp_path):
    path = f"{tmp_path}/index"
    with pytest.raises(ValueError, match="no complete version"):
        snapshots.read_snapshot(spark, path)
    nothing = vectors(spark, [(1, 0.0)]).filter(F.lit(False))
    assert snapshots.write_snapshot(nothing, path, 4) == 1
    assert snapshots.read_snapshot(spark, path).count() == 0
    assert snapshots.refresh_snapshot(path, vectors(spark, [(1, 2.0)])) == 2
    assert rows(snapshots.read_snapshot(spark, path)) == {"p1": [1.0, 2.0]}
    all_gone = spark.createDataFrame([("p1",)], "paper_id string")
    snapshots.refresh_snapshot(path, nothing, all_gone)
    assert snapshots.read_snapshot(spark, path).count() == 0
    with pytest.raises(ValueError, match="no complete version 9"):
        snapshots.read_snapshot(spark, path, 9)
