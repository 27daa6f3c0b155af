"""Inverted index as tables, and BM25 over it.

The index has one row per (term, document), which carries the document's length, so
that scoring needs no second lookup. Where the query side is small enough to be copied, the
matching postings of a document meet in one task, its sums need no further shuffle, and only
the best ``n`` rows per query and task travel.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import defaults as D
from ..functions import text as T
from ..storage import BROADCAST_ROWS, fits_broadcast, materialize
from .knn import rank_top
from .skew import SLICE, lookup, needed, spread_heavy


#: tokens that are counted at a time
PIECE_TOKENS = 250_000


def term_counts(
    df: DataFrame,
    key: str,
    tokens: Column,
    lemmas: DataFrame | None = None,
    keep_empty: bool = False,
) -> DataFrame:
    """``(key, term, doc_len, tf)`` for each row of ``df``, one row per distinct term.

    Tokens are counted inside their row, an Arrow batch at a time, so nothing is shuffled
    unless lemmas make terms of a row equal. ``keep_empty`` keeps a row without term for
    texts without tokens. ``key`` is unique.
    """
    rows = df.select(F.col(key).alias("key"), tokens.alias("tokens"))
    kind = rows.schema["key"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            keys = batch.column(0)
            lengths, row, terms, times = _distinct_tokens(batch.column(1))
            yield _counted(keys, row, terms, lengths, times)
            if keep_empty:
                bare = np.flatnonzero(lengths == 0)
                none = pa.nulls(len(bare), pa.string())
                yield _counted(keys, bare, none, lengths, np.ones(len(bare), dtype=np.int64))

    schema = f"key {kind}, term string, doc_len int, tf int"
    counts = rows.mapInArrow(count, schema).withColumnRenamed("key", key)
    if lemmas is None:
        return counts
    return (
        apply_lemmas(counts, lemmas, "term")
        .groupBy(key, "term", "doc_len")
        .agg(F.sum("tf").cast("int").alias("tf"))
    )


def term_lists(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``(key, doc_len, terms, tfs)``: what :func:`term_counts` gives, in one row per row of ``df``.

    A tenth of the work to store, shuffle or hand on, as lists move in whole.
    """
    rows = df.select(F.col(key).alias("key"), tokens.alias("tokens"))
    kind = rows.schema["key"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            lengths, row, terms, times = _distinct_tokens(batch.column(1))
            ends = np.cumsum(np.bincount(row, minlength=len(lengths)))
            offsets = pa.array(np.append(0, ends).astype(np.int32))
            columns = [
                batch.column(0),
                pa.array(lengths.astype(np.int32)),
                pa.ListArray.from_arrays(offsets, terms.cast(pa.string())),
                pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "doc_len", "terms", "tfs"])

    schema = f"key {kind}, doc_len int, terms array<string>, tfs array<int>"
    return rows.mapInArrow(count, schema).withColumnRenamed("key", key)


def _distinct_tokens(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """The length of each list, and its distinct tokens: list number, token, how often."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    coded = pc.dictionary_encode(lists.flatten())
    width = max(len(coded.dictionary), 1)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs = np.repeat(np.arange(len(lengths)), lengths) * width + codes
    found, times = np.unique(pairs, return_counts=True)
    row, code = found // width, found % width
    return lengths, row, coded.dictionary.take(pa.array(code)), times


def pieces(batches: Iterable[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the lists of their second column hold ``most`` values (a row at least)."""
    most = PIECE_TOKENS if most is None else most
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(batch.column(1)), 0)))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            last = max(int(np.searchsorted(ends, before + most, side="right")), at + 1)
            yield batch.slice(at, last - at)
            at = last


def _counted(keys: pa.Array, row, terms: pa.Array, lengths, times) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            keys.take(pa.array(row)),
            terms.cast(pa.string()),
            pa.array(lengths[row].astype(np.int32)),
            pa.array(times.astype(np.int32)),
        ],
        ["key", "term", "doc_len", "tf"],
    )


# --- lemmas -----------------------------------------------------------------------------

# Noun endings and what they may be replaced with.
NOUN_ENDINGS = (
    ("s", ""),
    ("ses", "s"),
    ("ves", "f"),
    ("xes", "x"),
    ("zes", "z"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
)


# Common nouns with an irregular plural.
IRREGULAR_NOUNS = (
    ("analyses", "analysis"), ("appendices", "appendix"), ("axes", "axis"), ("bases", "basis"),
    ("children", "child"), ("crises", "crisis"), ("criteria", "criterion"), ("feet", "foot"),
    ("geese", "goose"), ("halves", "half"), ("hypotheses", "hypothesis"), ("indices", "index"),
    ("knives", "knife"), ("lice", "louse"), ("lives", "life"), ("matrices", "matrix"),
    ("men", "man"), ("mice", "mouse"), ("oases", "oasis"), ("oxen", "ox"),
    ("parentheses", "parenthesis"), ("phenomena", "phenomenon"), ("syntheses", "synthesis"),
    ("teeth", "tooth"), ("theses", "thesis"), ("vertices", "vertex"), ("wives", "wife"),
    ("women", "woman"),
)


def noun_exceptions(spark: SparkSession) -> DataFrame:
    """:data:`IRREGULAR_NOUNS` as a table ``(token, lemma)``."""
    return spark.createDataFrame(list(IRREGULAR_NOUNS), "token string, lemma string")


def _without_endings(forms: DataFrame) -> DataFrame:
    """Every form with one of its noun endings replaced; ``path`` is the order of preference."""
    rules = [
        F.when(
            F.col("form").endswith(old),
            F.struct(
                F.concat(F.expr(f"left(form, length(form) - {len(old)})"), F.lit(new)).alias("form"),
                F.concat("path", F.lit(f"{i:02}")).alias("path"),
            ),
        )
        for i, (old, new) in enumerate(NOUN_ENDINGS, start=1)
    ]
    made = forms.select("token", F.explode(F.array_compact(F.array(*rules))).alias("made"))
    return made.select("token", "made.form", "made.path")


def build_lemmas(
    tokens: DataFrame, dictionary: DataFrame | None = None, exceptions: DataFrame | None = None
) -> DataFrame:
    """``(token, lemma)`` for the distinct tokens whose lemma differs from them.

    A lemma is the shortest dictionary word among the token and what may stand for it; of
    equally short ones the token itself comes first, then the earlier rule. For a token in
    ``exceptions(token, lemma)`` (by default :func:`noun_exceptions`) that is its exceptions and
    nothing else. Otherwise noun endings are replaced once, and again while no form of the
    token is a dictionary word. The default dictionary is the set of tokens itself.
    """
    spark = tokens.sparkSession
    distinct = tokens.select("token").filter("token is not null").distinct()
    words = distinct if dictionary is None else dictionary.select("token").distinct()
    words = words.select(F.col("token").alias("form"))
    odd = (noun_exceptions(spark) if exceptions is None else exceptions).select("token", "lemma")
    given = odd.join(distinct, "token", "left_semi").select(
        "token", F.col("lemma").alias("form"), F.concat(F.lit("01"), "lemma").alias("path")
    )
    endings = "|".join(sorted({old for old, _ in NOUN_ENDINGS}))
    plain = distinct.filter(F.col("token").rlike(f"({endings})$")).join(odd, "token", "left_anti")
    itself = plain.select("token", F.col("token").alias("form"), F.lit("").alias("path"))
    own = given.select("token").distinct().select("token", F.col("token").alias("form"), F.lit("").alias("path"))

    def best(forms: DataFrame) -> DataFrame:
        order = F.struct(F.length("form").alias("n"), "path", "form")
        found = forms.join(words, "form", "left_semi").groupBy("token")
        return found.agg(F.min(order).alias("best")).select("token", "best.form")

    forms = materialize(_without_endings(itself), "lemma-forms")
    found = [best(given.unionByName(own)), materialize(best(forms.unionByName(itself)), "lemmas")]
    if dictionary is not None:  # else every token is a word itself
        while True:
            rest = forms.join(found[-1].select("token"), "token", "left_anti")
            forms = materialize(_without_endings(rest), "lemma-forms")
            if forms.isEmpty():
                break
            found.append(materialize(best(forms), "lemmas"))
    every = reduce(DataFrame.unionByName, found)
    return every.select("token", F.col("form").alias("lemma")).filter("token <> lemma")


def apply_lemmas(df: DataFrame, lemmas: DataFrame, token: str = "token") -> DataFrame:
    """Replace column ``token`` by its lemma where it has one."""
    named = lemmas.select(F.col("token").alias(token), F.col("lemma").alias("_lemma"))
    found = lookup(df, named, token, BROADCAST_ROWS)
    return found.withColumn(token, F.coalesce("_lemma", token)).select(*df.columns)


# --- index ------------------------------------------------------------------------------


def paper_tokens(
    papers: DataFrame,
    stopwords: Iterable[str] | None = None,
    extra_stopwords: Iterable[str] = (),
) -> Column:
    return T.tokenize(
        T.candidate_text(papers["title"], papers["abstract"]), stopwords, extra_stopwords
    )


def build_term_lists(papers: DataFrame, stopwords: Iterable[str] | None = None) -> DataFrame:
    """``(paper_id, doc_len, terms, tfs)``: the postings of each paper in one row.

    Papers without a term are rows too. Store this where postings, lengths and a block index
    are wanted, as texts are then read once.
    """
    return term_lists(papers, "paper_id", paper_tokens(papers, stopwords))


def list_postings(lists: DataFrame) -> DataFrame:
    """The rows of :func:`build_postings` from those of :func:`build_term_lists`."""
    each = F.explode(F.arrays_zip("terms", "tfs")).alias("t")
    return lists.select("paper_id", "doc_len", each).select(
        F.col("t.terms").alias("term"), "paper_id", F.col("t.tfs").alias("tf"), "doc_len"
    )


def build_postings(
    papers: DataFrame, stopwords: Iterable[str] | None = None, lemmas: DataFrame | None = None
) -> DataFrame:
    """``(term, paper_id, tf, doc_len)`` of title and abstract."""
    if lemmas is None:
        return list_postings(build_term_lists(papers, stopwords))
    counts = term_counts(papers, "paper_id", paper_tokens(papers, stopwords), lemmas)
    return counts.select("term", "paper_id", "tf", "doc_len")


def build_doc_stats(papers: DataFrame, stopwords: Iterable[str] | None = None) -> DataFrame:
    """``(paper_id, doc_len)`` for all papers, those without any term included.

    ``papers`` may be the rows of :func:`build_term_lists`, whose lengths are known.
    """
    if "terms" in papers.columns:
        return papers.select("paper_id", "doc_len")
    return papers.select("paper_id", F.size(paper_tokens(papers, stopwords)).alias("doc_len"))


def corpus_stats(doc_stats: DataFrame) -> DataFrame:
    """One row: number of documents and mean length."""
    return doc_stats.agg(
        F.count("*").alias("n_docs"), F.avg(F.col("doc_len").cast("double")).alias("avg_len")
    )


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


# --- queries ----------------------------------------------------------------------------


def query_terms(
    queries: DataFrame,
    text: Column,
    stopwords: Iterable[str] | None = None,
    lemmas: DataFrame | None = None,
    pretokenized: bool = False,
) -> DataFrame:
    """``(query_id, term, qtf)``. Pre-tokenized queries are only split at white space."""
    tokens = T.split_words(T.or_empty(text)) if pretokenized else T.tokenize(text, stopwords)
    counts = term_counts(queries, "query_id", tokens, None if pretokenized else lemmas)
    return counts.select("query_id", "term", F.col("tf").alias("qtf"))


# --- scores -----------------------------------------------------------------------------


def _idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def _gain(tf: Column, doc_len: Column, avg_len: Column, k: float, b: float) -> Column:
    return tf * (1 + k) / (tf + k * (1 - b + b * doc_len / avg_len))


def _term_weights(terms: DataFrame, df: DataFrame, stats: DataFrame) -> DataFrame:
    """``(query_id, term, _weight)`` with weight ``qtf * idf``, for indexed terms."""
    return _weighted(terms.join(df, "term"), stats)


def _weighted(terms: DataFrame, stats: DataFrame) -> DataFrame:
    idf = _idf(stats.select("n_docs").scalar(), F.col("df"))
    return terms.select("query_id", "term", (F.col("qtf") * idf).alias("_weight"))


def bm25_scores(
    terms: DataFrame,
    postings: DataFrame,
    stats: DataFrame,
    k: float = D.BM25_K,
    b: float = D.BM25_B,
    df: DataFrame | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``(query_id, paper_id, score)`` for every document sharing a term with a query.

    ``terms(query_id, term, qtf)``; ``stats`` is the one row of :func:`corpus_stats`.
    """
    small = fits_broadcast(terms, broadcast_rows)
    if small:
        known = F.broadcast(terms.select("term").distinct())
        hits = postings.join(known, "term", "left_semi")
        df = document_frequency(hits) if df is None else df
        weights = _term_weights(terms, df, stats)
    else:
        # counts are summed where the postings are; no posting moves by its bare term
        hits = postings
        df = materialize(document_frequency(postings), "term-counts") if df is None else df
        known = lookup(terms, df.select("term", "df"), "term", BROADCAST_ROWS)
        weights = _weighted(known.filter(F.col("df").isNotNull()), stats)
    avg_len = stats.select("avg_len").scalar()
    gain = _gain(F.col("tf"), F.col("doc_len"), avg_len, k, b)
    hits = hits.select("term", "paper_id", gain.alias("_gain"))
    if small:
        # all rows of a document meet in one task and stay there
        matched = hits.repartition("paper_id").join(F.broadcast(weights), "term")
    else:
        hits, weights = spread_heavy(hits, weights, "term", "paper_id", df)
        matched = hits.join(weights, ["term", SLICE])
    return matched.groupBy("query_id", "paper_id").agg(
        F.sum(F.col("_weight") * F.col("_gain")).alias("score")
    )


def bm25_pairs(
    pairs: DataFrame,
    terms: DataFrame,
    postings: DataFrame,
    stats: DataFrame,
    k: float = D.BM25_K,
    b: float = D.BM25_B,
    df: DataFrame | None = None,
) -> DataFrame:
    """BM25 of given ``pairs(query_id, paper_id)``; 0 where they share no term."""
    wanted = pairs.select("query_id", "paper_id").distinct()
    known = terms.select("term").distinct()
    if fits_broadcast(terms):
        known = F.broadcast(known)
    hits = postings.join(known, "term", "left_semi")
    weights = _term_weights(terms, document_frequency(hits) if df is None else df, stats)
    gain = _gain(F.col("tf"), F.col("doc_len"), stats.select("avg_len").scalar(), k, b)
    relevant = needed(hits.select("paper_id", "term", gain.alias("_gain")), wanted)
    scored = (
        wanted.join(weights, "query_id")
        .join(relevant, ["paper_id", "term"])
        .groupBy("query_id", "paper_id")
        .agg(F.sum(F.col("_weight") * F.col("_gain")).alias("score"))
    )
    return wanted.join(scored, ["query_id", "paper_id"], "left").select(
        "query_id", "paper_id", F.coalesce("score", F.lit(0.0)).alias("score")
    )


def bm25_top_n(
    scores: DataFrame,
    n: int,
    queries: DataFrame | None = None,
    papers: DataFrame | None = None,
    fill: bool = False,
) -> DataFrame:
    """Best ``n`` papers per query.

    With ``fill``, lists shorter than ``n`` are completed with unscored papers of the
    lowest ids and score 0. Those are always among the ``n`` lowest ids of all papers.
    """
    top = rank_top(scores, n)
    return fill_lists(top, n, queries, papers) if fill else top


def fill_lists(top: DataFrame, n: int, queries: DataFrame, papers: DataFrame) -> DataFrame:
    """Lists shorter than ``n`` completed with the lowest ids of ``papers``, at score 0."""
    lowest = papers.select("paper_id").distinct().orderBy("paper_id").limit(n)
    filler = lowest.agg(F.array_sort(F.collect_list("paper_id")).alias("ids")).scalar()
    found = top.groupBy("query_id").agg(F.count("*").alias("_found"))
    short = (
        queries.select("query_id")
        .join(found, "query_id", "left")
        .withColumn("_found", F.coalesce("_found", F.lit(0)))
        .filter(F.col("_found") < n)
    )
    order = Window.partitionBy("query_id").orderBy("paper_id")
    added = (
        short.select("query_id", "_found", F.explode(filler).alias("paper_id"))
        .join(top, ["query_id", "paper_id"], "left_anti")
        .withColumn("rank", (F.row_number().over(order) + F.col("_found")).cast("int"))
        .filter(F.col("rank") <= n)
        .select("query_id", "paper_id", "rank", F.lit(0.0).alias("score"))
    )
    return top.unionByName(added)
