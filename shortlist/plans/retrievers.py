"""Retrievers: callables from a table of queries and ``n`` to ranked candidates.

A query row is ``(query_id, citing_title, citing_abstract, local_context)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import defaults as D
from ..functions import vectors
from ..operators.block_index import search_blocks
from ..operators.candidates import query_document
from ..operators.encode import Encoder, embed_documents
from ..operators.knn import knn, rank_top
from ..operators.lexical import bm25_scores, corpus_stats, fill_lists, query_terms
from ..operators.quantize import quantize
from ..storage import materialize

Retriever = Callable[[DataFrame, int], DataFrame]


def local_context(queries: DataFrame) -> Column:
    return queries["local_context"]


def embed_queries(queries: DataFrame, encoder: Encoder, precision: str = "float32") -> DataFrame:
    """``(query_id, vec)``, scaled to length one and quantized one by one."""
    embedded = embed_documents(queries, "query_id", query_document(queries), encoder)
    unit = embedded.select("query_id", vectors.l2_normalize(F.col("vec")).alias("vec"))
    return quantize(unit, precision, per_row=True)


def dense_retriever(
    encoder: Encoder,
    index: DataFrame,
    dim: int = D.EMBED_DIM,
    precision: str = "float32",
    allowed: DataFrame | None = None,
) -> Retriever:
    """Nearest papers in ``index(paper_id, vec)``, which is already normalised."""

    def retrieve(queries: DataFrame, n: int) -> DataFrame:
        embedded = embed_queries(queries, encoder, precision)
        return knn(embedded, index, n, dim, precision, allowed)

    return retrieve


def lexical_retriever(
    postings: DataFrame,
    doc_stats: DataFrame,
    text: Callable[[DataFrame], Column] = local_context,
    k: float = D.BM25_K,
    b: float = D.BM25_B,
    stopwords: Iterable[str] | None = None,
    lemmas: DataFrame | None = None,
    pretokenized: bool = False,
    fill: bool = False,
    index: DataFrame | None = None,
) -> Retriever:
    """Best papers by BM25.

    With ``index``, the block-max index of the same postings (``block_index``), documents that
    cannot be among the best are not scored and sums stay in their task.
    """

    def retrieve(queries: DataFrame, n: int) -> DataFrame:
        asked = query_terms(queries, text(queries), stopwords, lemmas, pretokenized)
        terms = materialize(asked, "query-terms")
        stats = corpus_stats(doc_stats)
        if index is None:
            top = rank_top(bm25_scores(terms, postings, stats, k, b), n)
        else:
            top = search_blocks(terms, index, stats, n, k, b)
        return fill_lists(top, n, queries, doc_stats) if fill else top

    return retrieve
