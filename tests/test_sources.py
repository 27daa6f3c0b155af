import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from shortlist import storage
from workload.storage_queries import _order_report
from shortlist.operators.encode import BROADCAST_VECTOR_BYTES, BROADCAST_WORDS
from shortlist.operators.skew import SLICE, lookup, spread_heavy
from shortlist.sources import readers, writers


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_objects_keyed_by_id(spark, tmp_path):
    papers = {"p1": {"title": "t", "abstract": "a", "year": 2020}, "p2": {"title": "u"}}
    contexts = {"c1": {"masked_text": "m\n", "context_id": "c1", "citing_id": "p1", "refid": "p2"}}
    corpus = [{"context_id": "c1", "positive_ids": ["p2"]}, {"context_id": "c2", "positive_ids": []}]
    for name, data in [("papers", papers), ("contexts", contexts), ("corpus", corpus)]:
        (tmp_path / f"{name}.json").write_text(json.dumps(data, indent=1))
    got = readers.read_papers(spark, f"{tmp_path}/papers.json", "json")
    assert rows(got, "paper_id") == [("p1", "t", "a"), ("p2", "u", None)]
    got = readers.read_contexts(spark, f"{tmp_path}/contexts.json", "json")
    assert rows(got, "context_id") == [("c1", "m\n", "p1", "p2")]
    got = readers.read_corpus(spark, f"{tmp_path}/corpus.json", "json")
    assert rows(got, "context_id") == [("c1", ["p2"]), ("c2", [])]


def test_lines_and_tables(spark, tmp_path):
    (tmp_path / "papers.jsonl").write_text('{"paper_id": "p", "title": "t"}\n')
    papers = readers.read_papers(spark, f"{tmp_path}/papers.jsonl", "jsonl")
    assert rows(papers, "paper_id") == [("p", "t", None)]
    writers.write_table(papers, f"{tmp_path}/papers")
    assert rows(readers.read_papers(spark, f"{tmp_path}/papers"), "paper_id") == [("p", "t", None)]
    with pytest.raises(ValueError):
        readers.read_papers(spark, "x", "csv")
    words = spark.createDataFrame([("a", [1.0])], "word string, vector array<float>")
    writers.write_table(words, f"{tmp_path}/words")
    assert rows(readers.read_word_vectors(spark, f"{tmp_path}/words"), "word") == [("a", [1.0])]
    vocab = spark.createDataFrame([("a", 3)], "word string, idx int")
    writers.write_table(vocab, f"{tmp_path}/vocab")
    assert rows(readers.read_vocabulary(spark, f"{tmp_path}/vocab"), "word") == [("a", 3)]


def test_embedding_index(spark, tmp_path):
    vecs = spark.createDataFrame(
        [("b", [3.0, 4.0]), ("a", [0.0, 2.0])], "paper_id string, vec array<float>"
    )
    writers.write_index(vecs, f"{tmp_path}/index")
    unit = rows(readers.read_index(spark, f"{tmp_path}/index"), "paper_id")
    assert [r[0] for r in unit] == ["a", "b"]
    assert np.allclose([r[1] for r in unit], [[0, 1], [0.6, 0.8]])
    packed = readers.read_index(spark, f"{tmp_path}/index", "bool")
    assert rows(packed, "paper_id") == [("a", [2]), ("b", [3])]
    writers.write_index(packed, f"{tmp_path}/packed", converted=True)
    again = readers.read_index(spark, f"{tmp_path}/packed", "bool", converted=True)
    assert rows(again, "paper_id") == rows(packed, "paper_id")


def test_lexical_index(spark, tmp_path):
    postings = spark.createDataFrame(
        [("x", "a", 1, 2)], "term string, paper_id string, tf int, doc_len int"
    )
    stats = spark.createDataFrame([("a", 2), ("b", 0)], "paper_id string, doc_len int")
    writers.write_postings(postings, stats, f"{tmp_path}/lexical")
    got = readers.read_postings(spark, f"{tmp_path}/lexical")
    assert [rows(df, "paper_id") for df in got] == [[("x", "a", 1, 2)], [("a", 2), ("b", 0)]]


def test_lists_hits_and_metrics(spark, tmp_path):
    lists = spark.createDataFrame(
        [("q", "a", 1, 0.5)], "query_id string, paper_id string, rank int, score double"
    )
    writers.write_candidates(lists, f"{tmp_path}/lists")
    assert spark.read.parquet(f"{tmp_path}/lists").count() == 1
    for name in ("0_100", "100_100"):
        writers.write_hits(lists.withColumn("is_hit", F.lit(True)), f"{tmp_path}/hits", name)
    hits = spark.read.parquet(f"{tmp_path}/hits")
    assert hits.count() == 2 and hits.filter("slice = '100_100'").count() == 1
    metrics = spark.createDataFrame([(10, 0.5)], "k int, recall double")
    for name in ("one", "two"):
        writers.append_metrics(metrics, f"{tmp_path}/log", run=name)
    logged = spark.read.json(f"{tmp_path}/log")
    assert {r["run"] for r in logged.collect()} == {"one", "two"} and "logged_at" in logged.columns


def test_size_check(spark):
    assert storage.fits_broadcast(spark.range(10), 10)
    assert not storage.fits_broadcast(spark.range(11), 10)
    assert not storage.fits_broadcast(spark.range(0), 0)


class Session:
    """Stands in for a session: its settings, master and checkpoint folder."""

    def __init__(self, master, configured=None):
        self.conf = {"spark.checkpoint.dir": configured} if configured else {}
        self.sparkContext, self.master, self.folder = self, master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_intermediate_tables_go_to_the_shared_folder(spark):
    assert storage.scratch_dir(Session("yarn", "hdfs:///shared")) == "hdfs:///shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.scratch_dir(Session("yarn"))
    local = Session("local[2]")
    assert storage.scratch_dir(local) == storage.scratch_dir(local) == local.folder
    df = storage.materialize(spark.range(3), "numbers")
    assert df.count() == 3 and storage.scratch_dir(spark) in df.inputFiles()[0]


def hot_rows(spark):
    """A third of all rows share one key."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 997))
    return spark.range(9000).select(F.col("id").cast("string").alias("row"), key.alias("key"))


def test_heavy_keys_meet_in_slices(spark):
    big = hot_rows(spark)
    small = big.select("key").distinct().withColumn("value", F.length("key"))
    left, right = spread_heavy(big, small, "key", "row")
    joined = left.join(right, ["key", SLICE])
    assert rows(joined.select("row", "key", "value"), "row") == rows(
        big.join(small, "key").select("row", "key", "value"), "row"
    )
    per_slice = left.filter("key = 'hot'").groupBy(SLICE).count().collect()
    assert len(per_slice) > 200 and max(r["count"] for r in per_slice) < 60


@pytest.mark.parametrize("max_rows", [0, 5000])
def test_lookup(spark, max_rows):
    big = hot_rows(spark)
    table = big.select("key").distinct().filter("key != 'k5'").withColumn("value", F.length("key"))
    got = lookup(big, table, "key", max_rows).select("row", "key", "value")
    assert rows(got, "row") == rows(big.join(table, "key", "left").select("row", "key", "value"), "row")


def test_what_lookup_copies_does_not_follow_the_table(spark):
    """Of 6,000 keys only the hot ones are copied; a few asked keys are copied alone."""
    big = hot_rows(spark).unionByName(
        spark.range(5000).select(
            F.concat(F.lit("r"), "id").alias("row"), F.concat(F.lit("rare"), "id").alias("key")
        )
    )
    table = big.select("key").distinct().withColumn("value", F.length("key"))
    want = rows(big.join(table, "key", "left").select("row", "key", "value"), "row")
    got = lookup(big, table, "key", 1500).select("row", "key", "value")
    assert rows(got, "row") == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_n#" in plan and ">= 4" in plan  # keys of at least so many rows
    few = lookup(hot_rows(spark).limit(50), table, "key", 1500)
    assert few.count() == 50
    assert "LeftSemi" in few._jdf.queryExecution().optimizedPlan().toString()
    # a million word vectors of 16 numbers are never copied whole
    assert BROADCAST_VECTOR_BYTES // (4 * 16 + 64) < 300_000 and BROADCAST_WORDS < 300_000


def test_order_of_files_is_checked_in_runs(spark):
    placed = spark.createDataFrame(
        [("f", i, f"{k:02}") for i, k in enumerate([1, 2, 3, 2, 5, 4, 4, 9, 1])]
        + [("g", i, f"{i:02}") for i in range(7)],
        "file_path string, row_index long, paper_id string",
    )
    for run_rows in (1, 2, 3, 100):
        row = _order_report(placed, run_rows).first()
        assert (row["n_rows"], row["n_unsorted"]) == (16, 3)
    plan = _order_report(placed)._jdf.queryExecution().optimizedPlan().toString()
    assert "[file_path#" in plan and "run#" in plan.split("windowspecdefinition(")[-1]
