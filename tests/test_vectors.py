import numpy as np
import pytest
from pyspark.sql import functions as F

from shortlist.functions import text as T
from shortlist.functions import vectors as V
from shortlist.operators import encode
from shortlist.operators.quantize import quantize, value_scale

MATRIX = [[0.5, -0.25, 0.1], [0.9, -1.0, 0.05]]


def table(spark, matrix):
    rows = [(str(i), [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "paper_id string, vec array<double>")


def codes(df):
    return [list(r["vec"]) for r in df.orderBy("paper_id").collect()]


def test_shared_scale_and_codes(spark):
    df = table(spark, MATRIX)
    assert value_scale(df).first()[0] == pytest.approx(1.486233, abs=1e-6)
    assert codes(quantize(df, "int8")) == [[43, -22, 9], [78, -86, 4]]
    assert codes(quantize(df, "int4")) == [[3, -1, 1], [5, -5, 0]]
    assert codes(quantize(df, "bool")) == [[0b101], [0b101]]
    assert codes(quantize(df, "float32")) == MATRIX
    with pytest.raises(ValueError):
        quantize(df, "int2")


def test_scale_of_each_row(spark):
    values = np.random.default_rng(0).normal(size=(5, 40))
    scale = 4 * np.abs(values).std(axis=1, keepdims=True)
    want = np.clip(np.round(values / scale * 128), -128, 127).astype(int)
    assert codes(quantize(table(spark, values), "int8", per_row=True)) == want.tolist()


def test_constant_matrix_becomes_zeros(spark):
    df = table(spark, [[0.5, -0.5], [0.5, 0.5]])
    assert codes(quantize(df, "int8")) == [[0, 0], [0, 0]]


def test_normalising_a_zero_vector(spark):
    unit = table(spark, [[0, 0], [3, 4]]).select(
        "paper_id", V.l2_normalize(F.col("vec")).alias("vec")
    )
    zero, five = codes(unit)
    assert zero == [0.0, 0.0] and five == pytest.approx([0.6, 0.8])


def test_similarities(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 2.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(V.dot(a, b), V.pair_similarity(a, b), V.pair_similarity(a, b, "euclidean"))
    assert list(got.first()) == pytest.approx([8.0, 0.8, -(13**0.5)])
    with pytest.raises(ValueError):
        V.pair_similarity(a, b, "manhattan")


def test_hamming_similarity_over_several_chunks(spark):
    values = np.random.default_rng(1).normal(size=(2, 70))
    df = table(spark, values).withColumn("bits", V.pack_sign_bits(F.col("vec")))
    (x,), (y,) = ([r["bits"]] for r in df.orderBy("paper_id").collect())
    assert len(x) == 3
    pair = spark.createDataFrame([(x, y)], "x array<bigint>, y array<bigint>")
    got = pair.select(V.hamming_similarity(F.col("x"), F.col("y"), 70)).first()[0]
    assert got == int(((values[0] > 0) == (values[1] > 0)).sum())


def word_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])]
    return spark.createDataFrame(rows, "word string, vector array<float>")


def embedded(spark, encoder):
    papers = spark.createDataFrame(
        [("1", "a a", "b x"), ("2", "", None), ("3", "x y", " "), ("4", "c", "")],
        "paper_id string, title string, abstract string",
    )
    document = T.paper_paragraphs(F.col("title"), F.col("abstract"))
    out = encode.embed_documents(papers, "paper_id", document, encoder).orderBy("paper_id")
    return [r["vec"] for r in out.collect()]


@pytest.mark.parametrize("vector_bytes", [1 << 20, 0])
def test_mean_vectors(spark, vector_bytes):
    encoder = encode.mean_vector_encoder(word_vectors(spark), 2, vector_bytes=vector_bytes)
    got = embedded(spark, encoder)
    want = [[2 / 3, 1 / 3], [0, 0], [0, 0], [1, 1]]
    assert np.allclose(got, want)


@pytest.mark.parametrize("vector_bytes", [1 << 20, 0])
def test_hierarchical_vectors(spark, vector_bytes):
    encoder = encode.hierarchical_encoder(
        word_vectors(spark), 2, {0: 3.0}, vector_bytes=vector_bytes
    )
    got = embedded(spark, encoder)
    # title weighs 3 and abstract 1; empty paragraphs weigh nothing; unknown words are zeros
    want = [[0.75, 0.25], [0, 0], [0, 0], [1, 1]]
    assert np.allclose(got, want)


def test_external_model(spark):
    def make_predict_fn():
        def predict(texts):
            return np.array([[len(t), t.count("a")] for t in texts], dtype=np.float32)

        return predict

    assert embedded(spark, encode.model_encoder(make_predict_fn))[0] == [7.0, 2.0]
