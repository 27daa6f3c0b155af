"""Token sequences and document encoders.

An encoder is a callable that takes ``(doc_id, document)`` rows, where ``document`` is
an array of labelled paragraphs, and returns ``(doc_id, vec)`` for every one of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from .. import defaults as D
from ..functions import text as T
from .lexical import apply_lemmas, term_lists
from .skew import lookup

Encoder = Callable[[DataFrame], DataFrame]

#: largest vocabulary (in words) and word-vector table copied to the executors; both pass the
#: driver, which holds a copy several times as long as the bare words or numbers
BROADCAST_WORDS = 250_000
BROADCAST_VECTOR_BYTES = 32 << 20


# --- sequences --------------------------------------------------------------------------


def encode_sequences(
    df: DataFrame,
    key: str,
    text: Column,
    vocab: DataFrame,
    max_len: int | None = None,
    lower: bool = True,
    broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """``(key, seq)``: vocabulary indexes of the white-space words, unknown ones left out.

    With ``max_len`` the sequence is then cut, or filled with the index of ``<pad>``.
    """
    source = T.normalize_text(T.or_empty(text)) if lower else T.or_empty(text)
    placed = df.repartition(key).select(key, T.split_words(source).alias("_words"))
    words = placed.select(key, F.posexplode_outer("_words").alias("_pos", "word"))
    found = lookup(words, vocab.select("word", "idx"), "word", broadcast_words)
    seq = found.groupBy(key).agg(
        F.array_sort(
            F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("_pos", "idx")))
        ).alias("_found")
    )
    indexes = F.transform("_found", lambda p: p["idx"])
    if max_len is not None:
        pad = vocab.filter(F.col("word") == D.PAD_TOKEN).select("idx").scalar()
        indexes = T.pad_sequence(indexes, max_len, pad)
    return seq.select(key, indexes.alias("seq"))


def encode_paragraphs(
    df: DataFrame,
    key: str,
    document: Column,
    vocab: DataFrame,
    max_seq_len: int = D.MAX_SEQ_LEN,
    max_doc_len: int = D.MAX_DOC_LEN,
) -> DataFrame:
    """``(key, paragraphs)`` with an index sequence, a label and an empty mark for each."""
    padded = df.select(key, F.posexplode(T.pad_paragraphs(document, max_doc_len)).alias("_at", "p"))
    parts = padded.select(F.struct(key, "_at", "p.ptype", "p.is_empty").alias("_part"), "p.text")
    encoded = encode_sequences(parts, "_part", F.col("text"), vocab, max_seq_len)
    paragraph = F.struct("_part._at", "seq", "_part.ptype", "_part.is_empty")
    return (
        encoded.select(F.col(f"_part.{key}").alias(key), paragraph.alias("p"))
        .groupBy(key)
        .agg(F.array_sort(F.collect_list("p")).alias("_all"))
        .select(
            key,
            F.transform(
                "_all",
                lambda p: F.struct(
                    p["seq"].alias("seq"),
                    p["ptype"].alias("ptype"),
                    p["is_empty"].alias("is_empty"),
                ),
            ).alias("paragraphs"),
        )
    )


def decode_sequences(df: DataFrame, key: str, seq: Column, vocab: DataFrame) -> DataFrame:
    """``(key, text)``: words up to the first ``<eos>`` or ``<pad>``; others ``<unk>``."""

    def index_of(word: str) -> Column:
        return vocab.filter(F.col("word") == word).select("idx").scalar()

    marked = df.select(
        key, seq.alias("_seq"), index_of(D.EOS_TOKEN).alias("_eos"), index_of(D.PAD_TOKEN).alias("_pad")
    )
    end = F.least(
        *[
            F.when(F.array_contains("_seq", F.col(c)), F.array_position("_seq", F.col(c)) - 1)
            .otherwise(F.size("_seq").cast("bigint"))
            for c in ("_eos", "_pad")
        ]
    )
    kept = marked.repartition(key).select(
        key, F.posexplode_outer(F.slice("_seq", F.lit(1), end.cast("int"))).alias("_pos", "idx")
    )
    found = lookup(kept, vocab.select("idx", "word"), "idx", BROADCAST_WORDS)
    word = F.struct("_pos", F.coalesce("word", F.lit(D.UNK_TOKEN)).alias("word"))
    return (
        found.groupBy(key)
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("_pos").isNotNull(), word))).alias("_words")
        )
        .select(key, F.array_join(F.transform("_words", lambda w: w["word"]), " ").alias("text"))
    )


# --- encoders ---------------------------------------------------------------------------


def embed_documents(df: DataFrame, key: str, document: Column, encoder: Encoder) -> DataFrame:
    """``(key, vec)`` for every row of ``df``."""
    documents = df.select(F.col(key).alias("doc_id"), document.alias("document"))
    return encoder(documents).select(F.col("doc_id").alias(key), "vec")


def _paragraph_means(
    documents: DataFrame,
    word_vectors: DataFrame,
    dim: int,
    stopwords: Iterable[str] | None,
    lemmas: DataFrame | None,
    vector_bytes: int,
) -> DataFrame:
    """Mean word vector of each ``(doc_id, at, ptype, is_empty, text)``.

    Words are counted in their row, before they meet their vectors, so no text is shuffled
    and no task keeps the words of many rows. Sums are plain columns, so vectors are added
    up on the map side and never travel per word.
    """
    group = ["doc_id", "at", "ptype", "is_empty"]
    max_words = vector_bytes // (4 * dim + 64)
    rows = documents.select(F.struct(*group).alias("_row"), "text")
    counts = (
        term_lists(rows, "_row", T.tokenize(F.col("text"), stopwords))
        .select("_row.*", F.explode_outer(F.arrays_zip("terms", "tfs")).alias("_t"))
        .select(*group, F.col("_t.terms").alias("word"), F.col("_t.tfs").alias("tf"))
    )
    if lemmas is not None:
        counts = apply_lemmas(counts, lemmas, "word")
    found = lookup(counts, word_vectors.select("word", "vector"), "word", max_words)
    known = F.sum(F.when(F.col("vector").isNotNull(), F.col("tf")))
    sums = found.groupBy(*group).agg(
        known.alias("_n"),
        *[
            F.sum(F.col("tf") * F.col("vector")[i].cast("double")).alias(f"_s{i}")
            for i in range(dim)
        ],
    )
    means = [F.coalesce(F.col(f"_s{i}") / F.col("_n"), F.lit(0.0)) for i in range(dim)]
    return sums.select(*group, *[m.alias(f"_m{i}") for i, m in enumerate(means)])


def mean_vector_encoder(
    word_vectors: DataFrame,
    dim: int = D.EMBED_DIM,
    stopwords: Iterable[str] | None = None,
    lemmas: DataFrame | None = None,
    vector_bytes: int = BROADCAST_VECTOR_BYTES,
) -> Encoder:
    """Mean of the vectors of a document's known words; all zeros if it has none."""

    def encode(documents: DataFrame) -> DataFrame:
        whole = documents.select(
            "doc_id",
            F.lit(0).alias("at"),
            F.lit(0).alias("ptype"),
            F.lit(False).alias("is_empty"),
            T.document_text(F.col("document")).alias("text"),
        )
        means = _paragraph_means(whole, word_vectors, dim, stopwords, lemmas, vector_bytes)
        return means.select("doc_id", F.array(*[f"_m{i}" for i in range(dim)]).alias("vec"))

    return encode


def hierarchical_encoder(
    word_vectors: DataFrame,
    dim: int = D.EMBED_DIM,
    type_weights: Mapping[int, float] | None = None,
    max_doc_len: int = D.MAX_DOC_LEN,
    stopwords: Iterable[str] | None = None,
    lemmas: DataFrame | None = None,
    vector_bytes: int = BROADCAST_VECTOR_BYTES,
) -> Encoder:
    """Words to paragraph vectors, then a weighted mean over the paragraphs.

    Empty paragraphs are masked, and a paragraph counts with the weight of its label
    (1 unless ``type_weights`` says otherwise). A document without text is all zeros.
    """

    def encode(documents: DataFrame) -> DataFrame:
        padded = T.pad_paragraphs(F.col("document"), max_doc_len)
        paragraphs = documents.select("doc_id", F.posexplode(padded).alias("at", "p")).select(
            "doc_id", "at", "p.ptype", "p.is_empty", "p.text"
        )
        weight = F.lit(1.0)
        for label, value in (type_weights or {}).items():
            weight = F.when(F.col("ptype") == label, F.lit(float(value))).otherwise(weight)
        weight = F.when(F.col("is_empty"), F.lit(0.0)).otherwise(weight)
        means = _paragraph_means(
            paragraphs, word_vectors, dim, stopwords, lemmas, vector_bytes
        )
        total = F.sum(weight)
        vec = [
            F.when(total > 0, F.sum(weight * F.col(f"_m{i}")) / total).otherwise(F.lit(0.0))
            for i in range(dim)
        ]
        return means.groupBy("doc_id").agg(F.array(*vec).alias("vec"))

    return encode


def model_encoder(make_predict_fn: Callable, batch_size: int = 16) -> Encoder:
    """Any external text model: it is loaded once per worker and fed Arrow batches.

    ``make_predict_fn`` returns a function from an array of texts to a matrix.
    """
    predict = predict_batch_udf(
        make_predict_fn, return_type=types.ArrayType(types.FloatType()), batch_size=batch_size
    )

    def encode(documents: DataFrame) -> DataFrame:
        return documents.select("doc_id", predict(T.document_text(F.col("document"))).alias("vec"))

    return encode
