import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from shortlist.operators import lexical as L


def papers(spark, rows):
    full = [(p, t, "") for p, t in rows]
    return spark.createDataFrame(full, "paper_id string, title string, abstract string")


def queries(spark, rows):
    return spark.createDataFrame(rows, "query_id string, text string")


@pytest.fixture(scope="module")
def small(spark):
    docs = papers(spark, [("a", "x y y"), ("b", "x z"), ("c", "w w w z")])
    return L.build_postings(docs), L.build_doc_stats(docs), docs


def scores(spark, small, rows, **options):
    postings, doc_stats, _ = small
    asked = queries(spark, rows)
    terms = L.query_terms(asked, F.col("text"), pretokenized=options.pop("pretokenized", False))
    found = L.bm25_scores(terms, postings, L.corpus_stats(doc_stats), **options)
    return {(r["query_id"], r["paper_id"]): round(r["score"], 6) for r in found.collect()}


GOLDEN = {
    ("1", "a"): 2.288647,
    ("1", "b"): 1.088429,
    ("2", "b"): 0.544215,
    ("2", "c"): 0.413603,
}


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_golden_scores(spark, small, broadcast_rows):
    got = scores(
        spark, small, [("1", "x y x"), ("2", "z"), ("3", "unknown")], broadcast_rows=broadcast_rows
    )
    assert got == GOLDEN


def test_pretokenized_queries_keep_their_case(spark, small):
    assert scores(spark, small, [("2", "Z z")], pretokenized=True) == {
        k: v for k, v in GOLDEN.items() if k[0] == "2"
    }


def test_scores_of_given_pairs(spark, small):
    postings, doc_stats, _ = small
    terms = L.query_terms(queries(spark, [("1", "x y x"), ("2", "z")]), F.col("text"))
    pairs = spark.createDataFrame(
        [("1", "a"), ("1", "c"), ("2", "c"), ("2", "c"), ("9", "a")],
        "query_id string, paper_id string",
    )
    got = L.bm25_pairs(pairs, terms, postings, L.corpus_stats(doc_stats))
    values = {(r["query_id"], r["paper_id"]): round(r["score"], 6) for r in got.collect()}
    assert values == {
        ("1", "a"): 2.288647, ("1", "c"): 0.0, ("2", "c"): 0.413603, ("9", "a"): 0.0,
    }


def test_a_term_held_by_every_document(spark):
    """One term has a third of all rows; slices do not change any score."""
    rows = [(f"{i:03d}", f"the the u{i} v{i % 7}") for i in range(2000)]
    docs = papers(spark, rows)
    index = L.build_postings(docs), L.build_doc_stats(docs), docs
    asked = [("q", "the v3"), ("r", "the the u9"), ("s", "v1 v2")]
    copied = scores(spark, index, asked)
    assert scores(spark, index, asked, broadcast_rows=0) == copied
    assert len([k for k in copied if k[0] == "q"]) == 2000


def test_fill_completes_lists_with_the_lowest_ids(spark, small):
    postings, doc_stats, docs = small
    asked = queries(spark, [("2", "z"), ("3", "unknown")])
    terms = L.query_terms(asked, F.col("text"))
    found = L.bm25_scores(terms, postings, L.corpus_stats(doc_stats))

    def lists(n, fill):
        top = L.bm25_top_n(found, n, asked, docs, fill).orderBy("query_id", "rank").collect()
        return [(r["query_id"], r["rank"], r["paper_id"]) for r in top]

    assert lists(9, False) == [("2", 1, "b"), ("2", 2, "c")]
    assert lists(9, True) == [
        ("2", 1, "b"), ("2", 2, "c"), ("2", 3, "a"), ("3", 1, "a"), ("3", 2, "b"), ("3", 3, "c"),
    ]
    assert lists(1, True) == [("2", 1, "b"), ("3", 1, "a")]


def test_statistics_count_documents_without_terms(spark):
    docs = papers(spark, [("a", "x y"), ("b", " !")])
    stats = L.corpus_stats(L.build_doc_stats(docs)).first()
    assert (stats["n_docs"], stats["avg_len"]) == (2, 1.0)


def lemmas(spark, words, dictionary=None, odd=None):
    tokens = spark.createDataFrame([(w,) for w in words], "token string")
    known = dictionary and spark.createDataFrame([(w,) for w in dictionary], "token string")
    table = odd and spark.createDataFrame(odd, "token string, lemma string")
    return {r["token"]: r["lemma"] for r in L.build_lemmas(tokens, known, table).collect()}


def test_lemmas_need_a_dictionary_word(spark):
    words = ["cats", "cat", "churches", "church", "bus", "wolves", "wolf", "women", "cities", "as"]
    assert lemmas(spark, words) == {"cats": "cat", "churches": "church", "wolves": "wolf"}
    assert lemmas(spark, words, ["woman", "city", "bus", "cats", "a"]) == {
        "women": "woman", "cities": "city", "as": "a",
    }


def test_lemmas_of_irregular_nouns(spark):
    known = ["child", "mouse", "goose", "index", "axis", "axe", "ax", "man", "men", "datum", "news"]
    assert lemmas(spark, ["children", "mice", "geese", "indices", "axes", "men", "news"], known) == {
        "children": "child", "mice": "mouse", "geese": "goose", "indices": "index", "axes": "axis",
    }  # men is a word itself and as short; axes has an exception, so axe and ax do not count
    odd = [("axes", "ax"), ("axes", "axis"), ("data", "datum"), ("news", "new")]
    assert lemmas(spark, ["axes", "data", "children", "news", "gnus"], known, odd) == {
        "axes": "ax", "data": "datum",
    }


def test_lemmas_prefer_the_shortest_then_the_earlier_rule(spark):
    assert lemmas(spark, ["women", "masses", "boxes"], ["women", "woman", "masses", "masse", "mass",
                                                        "boxe", "box"]) == {"masses": "mass", "boxes": "box"}
    # no form is a word after one replacement: endings are replaced again
    assert lemmas(spark, ["glasses", "abcss", "zzz", "s"], ["glas", "abc"]) == {
        "glasses": "glas", "abcss": "abc",
    }


def test_lemmas_merge_counts(spark):
    docs = papers(spark, [("a", "cat cats dog")])
    table = spark.createDataFrame([("cats", "cat")], "token string, lemma string")
    rows = L.build_postings(docs, lemmas=table).collect()
    assert {(r["term"], r["tf"], r["doc_len"]) for r in rows} == {("cat", 2, 3), ("dog", 1, 3)}


def test_scoring_keeps_documents_in_place(spark, small):
    """Between the index exchange and the top-n exchange the sums need none."""
    postings, doc_stats, _ = small
    terms = L.query_terms(queries(spark, [("1", "x")]), F.col("text"))
    found = L.bm25_scores(terms, postings, L.corpus_stats(doc_stats))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan.split("BroadcastExchange")[0]


def test_tokens_are_counted_in_pieces():
    """A batch of long texts is cut; a text longer than a piece is a piece of its own."""
    lists = [["a"] * 5, [], None, ["b", "c"], ["a"] * 30, ["d"]]
    batch = pa.record_batch({"key": pa.array(range(6)), "tokens": pa.array(lists)})
    cut = list(L.pieces([batch], 8))
    assert [p.num_rows for p in cut] == [4, 1, 1]
    assert pa.Table.from_batches(cut).to_pylist() == pa.Table.from_batches([batch]).to_pylist()


def test_term_lists_hold_the_postings_and_lengths(spark, small):
    docs = papers(spark, [("a", "x y y"), ("b", "x z"), ("c", "w w w z"), ("d", "..."), ("e", None)])
    lists = L.build_term_lists(docs)
    assert sorted(map(tuple, L.list_postings(lists).collect())) == sorted(map(tuple, small[0].collect()))
    lengths = dict(map(tuple, L.build_doc_stats(lists).collect()))
    assert lengths == {"a": 3, "b": 2, "c": 4, "d": 0, "e": 0}
