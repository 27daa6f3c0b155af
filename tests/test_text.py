from pyspark.sql import functions as F

from shortlist import defaults as D
from shortlist.functions import text as T
from shortlist.operators import encode


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column).first()[0]


def test_tokens_are_unicode_words(spark):
    got = one(spark, T.tokenize(F.col("t")), t="Vièle, l’Été_2 x-1  ")
    assert got == ["vièle", "l", "été_2", "x", "1"]


def test_stop_words_are_matched_before_punctuation_is_cut(spark):
    assert one(spark, T.tokenize(F.col("t"), ["the"]), t="The the, cat") == ["the", "cat"]


def test_extra_stop_words(spark):
    got = one(spark, T.tokenize(F.col("t"), ["a"], D.JACCARD_STOPWORDS), t="a <CIT> b <num> <cit>,")
    assert got == ["b", "cit"]


def test_missing_text_has_no_tokens(spark):
    assert one(spark, T.tokenize(F.col("t")), t=None) == []


def test_default_stop_words(spark):
    words = T.default_stopwords()
    assert "the" in words and one(spark, T.tokenize(F.col("t"), words), t="the cat") == ["cat"]


def test_words_split_at_any_white_space(spark):
    assert one(spark, T.split_words(F.col("t")), t="  a\t b c d\n") == ["a", "b", "c", "d"]


def test_padding_marks_blank_paragraphs(spark):
    document = T.pad_paragraphs(T.paper_paragraphs(F.col("a"), F.col("b")), 3)
    got = [tuple(p) for p in one(spark, document, a="title", b="   ")]
    assert got == [("title", 0, False), ("   ", 1, True), ("", 10, True)]
    cut = T.pad_paragraphs(T.query_paragraphs(F.col("a"), F.col("b"), F.lit("c")), 2)
    assert [p["ptype"] for p in one(spark, cut, a="x", b=None)] == [0, 1]


def test_document_text_keeps_empty_paragraphs(spark):
    document = T.query_paragraphs(F.col("a"), F.col("b"), F.lit("c"))
    assert one(spark, T.document_text(document), a="x", b=None) == "x  c"


def test_rerank_query_text(spark):
    text = T.rerank_query_text(F.col("a"), F.col("b"), F.col("c"))
    long = " ".join(f"w{i}" for i in range(300))
    got = one(spark, text, a="t", b=long, c="see TARGETCIT and OTHERCIT")
    kept = ["t"] + [f"w{i}" for i in range(178)]
    assert got == " ".join(kept) + "<sep>see <cit> and OTHERCIT"
    raw = T.rerank_query_text(F.col("a"), F.col("b"), F.col("c"), mask=False)
    assert one(spark, raw, a=None, b=None, c="TARGETCIT") == "<sep>TARGETCIT"


def vocabulary(spark):
    words = ["<pad>", "<eos>", "a", "b", "c"]
    return spark.createDataFrame(list(zip(words, range(5))), "word string, idx int")


def sequences(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = encode.encode_sequences(df, "id", F.col("text"), vocabulary(spark), **options)
    return [r["seq"] for r in out.orderBy("id").collect()]


def test_sequences_drop_unknown_words_before_cutting(spark):
    texts = ["A x b x c a", "", "zzz", None]
    assert sequences(spark, texts) == [[2, 3, 4, 2], [], [], []]
    assert sequences(spark, texts, max_len=3) == [[2, 3, 4], [0, 0, 0], [0, 0, 0], [0, 0, 0]]
    assert sequences(spark, ["A b"], lower=False) == [[3]]


def test_sequences_without_a_copied_vocabulary(spark):
    texts = ["a b " * 50 + "zzz", "c", "zzz " * 90]
    assert sequences(spark, texts, broadcast_words=0) == sequences(spark, texts)


def test_sequences_back_to_text(spark):
    rows = [(0, [2, 99, 3, 1, 4]), (1, [4, 0, 2]), (2, []), (3, [0, 2])]
    df = spark.createDataFrame(rows, "id int, seq array<int>")
    out = encode.decode_sequences(df, "id", F.col("seq"), vocabulary(spark)).orderBy("id")
    assert [r["text"] for r in out.collect()] == ["a <unk> b", "c", "", ""]


def test_encoded_paragraphs(spark):
    df = spark.createDataFrame([("p", "a b", None)], "id string, t string, a string")
    document = T.paper_paragraphs(F.col("t"), F.col("a"))
    out = encode.encode_paragraphs(df, "id", document, vocabulary(spark), 3, 3).first()
    got = [(p["seq"], p["ptype"], p["is_empty"]) for p in out["paragraphs"]]
    assert got == [([2, 3, 0], 0, False), ([0, 0, 0], 1, True), ([0, 0, 0], 10, True)]
