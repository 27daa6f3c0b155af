"""Huge JSON files read in blocks, against the json module."""

from __future__ import annotations

import json
import random

import pytest

from shortlist.sources import readers
from shortlist.sources.json_parts import read_values

NASTY = ['}', '{', '"', '\\', '\\"}', ']', '[{', 'é', '日本', '\U0001f600', '\n', '", "x": {', ' ', 'a' * 70]


@pytest.fixture(params=[97, 1000, 10_000_000])
def blocks(spark, request):
    """Small blocks, so that borders fall anywhere."""
    old = {n: spark.conf.get(n, None) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    for name, value in old.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _text(rng):
    return "".join(rng.choice(NASTY) for _ in range(rng.randrange(0, 9)))


@pytest.mark.parametrize("style", [{}, {"indent": 2}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_keyed_objects_equal_the_json_module(spark, tmp_path, blocks, style):
    rng = random.Random(blocks)
    papers = {f"{i}{_text(rng)}": {"title": _text(rng), "abstract": _text(rng), "more": [{"a": {}}, []]}
              for i in range(14)}
    papers["none"] = None
    papers["last"] = {"title": None}
    (tmp_path / "p.json").write_text(json.dumps(papers, **style) + rng.choice(["", "\n \n"]), encoding="utf-8")
    (tmp_path / "q.json").write_text('﻿ {"z": {"title": "t"}}', encoding="utf-8")
    df = readers.read_papers(spark, str(tmp_path), "json")
    want = {k: ((v or {}).get("title"), (v or {}).get("abstract")) for k, v in papers.items()}
    want["z"] = ("t", None)
    rows = df.collect()
    assert len(rows) == len(want)
    assert {r["paper_id"]: (r["title"], r["abstract"]) for r in rows} == want
    if blocks == 97:
        assert read_values(spark, str(tmp_path)).rdd.getNumPartitions() > 1


@pytest.mark.parametrize("style", [{}, {"indent": 1}])
def test_arrays_equal_the_json_module(spark, tmp_path, blocks, style):
    rng = random.Random(blocks + 1)
    corpus = [{"context_id": f"{i}{_text(rng)}", "positive_ids": [_text(rng) for _ in range(i % 4)]}
              for i in range(14)]
    (tmp_path / "c.json").write_text(json.dumps(corpus, **style) + rng.choice(["", "\n"]), encoding="utf-8")
    rows = readers.read_corpus(spark, str(tmp_path), "json").collect()
    assert sorted((r["context_id"], r["positive_ids"]) for r in rows) == sorted(
        (c["context_id"], c["positive_ids"]) for c in corpus
    )


@pytest.mark.parametrize("text", ["{}", "[]", " {\n}\n", '{"a": null}', "[ ]\n", ""])
def test_files_without_objects(spark, tmp_path, text):
    (tmp_path / "e.json").write_text(text)
    found = readers.read_papers(spark, str(tmp_path / "e.json"), "json") if "[" not in text else (
        readers.read_corpus(spark, str(tmp_path / "e.json"), "json"))
    assert found.count() == (1 if "null" in text else 0)


@pytest.mark.parametrize("text", ['{"a": {"title": "x"}', '{"a": {"title": "x"}\n', '{"a": {"title": "x}}',
                                  '{"a": {} "b": {}}', '{"a": {}}\n{"b": {}}', '{"a": {"title": 1,}}', '{"a": {}}}'])
def test_broken_files_fail(spark, tmp_path, text):
    (tmp_path / "b.json").write_text(text)
    with pytest.raises(Exception):
        readers.read_papers(spark, str(tmp_path / "b.json"), "json").collect()


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    papers = {str(i): {"title": f"title {i}", "abstract": "word } " * 40} for i in range(20_000)}
    path = tmp_path / "big.json"
    path.write_text(json.dumps(papers))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000000")
    try:
        df = readers.read_papers(spark, str(path), "json")
        assert df.rdd.getNumPartitions() >= 4
        assert df.count() == 20_000 and df.filter("abstract like 'word } word%'").count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
