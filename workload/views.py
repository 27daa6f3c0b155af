"""Library tables as views over the given tables.

Papers are all ``documents``. Contexts are all ``benchmark`` passages: the passage is
the local context, the documents that contain it are its positives, and the document
with the same number plays the citing paper. Vectors are all ``embeddings``. Word
vectors are derived from the vocabulary with md5, so that SQL can repeat them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist import defaults as D
from shortlist.functions import text as T
from shortlist.functions import vectors
from shortlist.operators import lexical
from shortlist.operators.block_index import build_block_index
from shortlist.operators.candidates import context_queries
from shortlist.operators.encode import hierarchical_encoder
from shortlist.operators.numbering import dense_index
from shortlist.operators.rerank import score_pairs
from shortlist.plans.jobs import FeatureTables, embed_papers, feature_tables, prefetch
from shortlist.plans.retrievers import Retriever, dense_retriever, lexical_retriever
from shortlist.shipping import ship_package
from shortlist.storage import apply_settings, fits_broadcast, materialize

VECTOR_DIM = 64
WORD_DIM = 16
TYPE_WEIGHTS = {D.TITLE_LABEL: 2.0, D.ABSTRACT_LABEL: 1.0, D.CONTEXT_LABEL: 3.0}
WEIGHTS = {"bm25": 0.02, "cosine": 1.0, "jaccard": 3.0, "inverse_rank": 0.5}
BIAS = -2.0
#: passages of one or two words that are compared with every document at once, about
SHORT_PASSAGES = 10_000
STOPWORDS = ["the", "and", "of", "in", "is", "to", "le", "la", "de", "der", "die", "el"]


def blocks_of(rows: DataFrame, key: str, size: int) -> list[DataFrame]:
    """``rows`` in blocks of about ``size`` rows, dealt by a hash of ``key``."""
    n = -(-rows.count() // size)
    block = F.pmod(F.xxhash64(key), F.lit(n))
    return [rows.filter(block == i) for i in range(n)]


class Tables:
    """Views and stored indexes of one data folder. Indexes are written once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._stored: dict[str, DataFrame] = {}

    def stored(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._stored:
            self._stored[name] = materialize(make(), name)
        return self._stored[name]

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def papers(self) -> DataFrame:
        title = F.substring_index("text", "\n", 1)
        return self.base("documents").select(
            F.col("doc_id").cast("string").alias("paper_id"),
            title.alias("title"),
            F.substr("text", F.length(title) + 2).alias("abstract"),
        )

    @cached_property
    def positives(self) -> DataFrame:
        """``(context_id, paper_id)``: documents that contain a passage.

        Such a document contains every inner word of the passage, so the rarest of them finds
        the documents worth reading by an equality join. Passages without an inner word are
        compared with every document, a block of about ``SHORT_PASSAGES`` at a time, as they
        are part of a given list of queries.
        """
        documents = self.base("documents").select("doc_id", "text")
        words = F.array_distinct(T.split_words(F.col("text")))
        passages = self.base("benchmark").select("item_id", F.col("text").alias("passage"))
        split = T.split_words(F.col("passage"))
        inner = F.array_distinct(F.slice(split, F.lit(2), F.greatest(F.size(split) - 2, F.lit(0))))
        keyed = passages.select("item_id", F.explode(inner).alias("word"))
        asked = keyed.select("word").distinct()
        # the folder may hold one file of one row group: deal its texts to all tasks
        listed = (
            documents.repartition("doc_id")
            .select("doc_id", F.explode(words).alias("word"))
            .join(asked, "word", "left_semi")
        )
        listed = materialize(listed, "passage-words")
        counts = listed.groupBy("word").agg(F.count("*").alias("n"))
        rarest = (
            keyed.join(counts, "word", "left")
            .groupBy("item_id")
            .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("_r"))
            .select("item_id", "_r.word")
        )
        found = listed.join(rarest, "word").select("doc_id", "item_id")
        found = materialize(found, "passage-documents")
        few = fits_broadcast(found)  # then texts stay where they are
        pairs = documents.join(F.broadcast(found) if few else found, "doc_id")
        pairs = pairs.join(passages, "item_id")
        matched = pairs.filter(F.contains("text", "passage")).select("item_id", "doc_id")
        for block in blocks_of(passages.filter(F.size(inner) == 0), "item_id", SHORT_PASSAGES):
            direct = documents.join(F.broadcast(block), F.contains("text", "passage"))
            matched = matched.unionByName(direct.select("item_id", "doc_id"))
        every = matched.select(
            F.concat(F.lit("b"), "item_id").alias("context_id"),
            F.col("doc_id").cast("string").alias("paper_id"),
        )
        return materialize(every, "positives")

    @property
    def contexts(self) -> DataFrame:
        first = self.positives.groupBy("context_id").agg(F.min("paper_id").alias("refid"))
        return (
            self.base("benchmark")
            .select(
                F.concat(F.lit("b"), "item_id").alias("context_id"),
                F.concat("text", F.lit(f" {D.TARGET_MARK}")).alias("masked_text"),
                F.col("item_id").cast("string").alias("citing_id"),
            )
            .join(first, "context_id", "left")
        )

    @property
    def corpus(self) -> DataFrame:
        lists = self.positives.groupBy("context_id").agg(
            F.array_sort(F.collect_list("paper_id")).alias("positive_ids")
        )
        empty = F.array().cast("array<string>")
        return (
            self.base("benchmark")
            .select(F.concat(F.lit("b"), "item_id").alias("context_id"))
            .join(lists, "context_id", "left")
            .withColumn("positive_ids", F.coalesce("positive_ids", empty))
        )

    @property
    def answerable(self) -> DataFrame:
        """Corpus rows with a positive, as training and mining need them."""
        return self.corpus.filter(F.size("positive_ids") > 0)

    @cached_property
    def queries(self) -> DataFrame:
        found = context_queries(self.corpus, self.contexts, self.papers)
        return materialize(found, "queries")

    @property
    def turns(self) -> DataFrame:
        """All turns of all conversations as queries without a citing paper."""
        return self.base("conversations").select(
            F.concat_ws("-", "conv_id", "turn").alias("query_id"),
            F.lit("").alias("citing_title"),
            F.lit("").alias("citing_abstract"),
            F.col("text").alias("local_context"),
        )

    @property
    def answerable_queries(self) -> DataFrame:
        return self.queries.filter(F.size("positive_ids") > 0)

    @property
    def truth(self) -> DataFrame:
        known = self.contexts.filter(F.col("refid").isNotNull())
        return known.select(F.col("context_id").alias("query_id"), "refid")

    @cached_property
    def term_lists(self) -> DataFrame:
        return materialize(lexical.build_term_lists(self.papers), "term-lists", codec="zstd")

    @property
    def postings(self) -> DataFrame:
        return lexical.list_postings(self.term_lists)

    @cached_property
    def doc_stats(self) -> DataFrame:
        return materialize(lexical.build_doc_stats(self.term_lists), "doc-stats")

    @property
    def stats(self) -> DataFrame:
        return lexical.corpus_stats(self.doc_stats)

    @cached_property
    def vocabulary(self) -> DataFrame:
        """Distinct terms numbered from 2 in hash order, after ``<pad>`` and ``<eos>``."""
        words = self.postings.select(F.col("term").alias("word")).distinct()
        numbered = dense_index(words, "word").select(
            "word", (F.col("row_idx") + 2).cast("int").alias("idx")
        )
        marks = F.explode(
            F.array(
                F.struct(F.lit(D.PAD_TOKEN).alias("word"), F.lit(0).alias("idx")),
                F.struct(F.lit(D.EOS_TOKEN).alias("word"), F.lit(1).alias("idx")),
            )
        )
        special = self.stats.select(marks.alias("m")).select("m.word", "m.idx")
        return materialize(special.unionByName(numbered), "vocabulary")

    @cached_property
    def word_vectors(self) -> DataFrame:
        words = self.postings.select(F.col("term").alias("word")).distinct()

        def element(i):
            byte = F.conv(F.substr(F.col("_h"), i * 2 + 1, F.lit(2)), 16, 10).cast("double")
            return ((byte - 128) / 127).cast("float")

        vector = F.transform(F.sequence(F.lit(0), F.lit(WORD_DIM - 1)), element)
        return materialize(
            words.withColumn("_h", F.md5("word")).select("word", vector.alias("vector")),
            "word-vectors",
        )

    @cached_property
    def encoder(self):
        return hierarchical_encoder(self.word_vectors, WORD_DIM, TYPE_WEIGHTS)

    @cached_property
    def index(self) -> DataFrame:
        """Unit vectors of all papers."""
        unit = embed_papers(self.papers, self.encoder).withColumn(
            "vec", vectors.l2_normalize(F.col("vec"))
        )
        return materialize(unit, "index")

    @cached_property
    def blocks(self) -> DataFrame:
        """The block-max index of the postings."""
        return materialize(build_block_index(self.term_lists), "block-index", codec="zstd")

    @property
    def bm25(self) -> Retriever:
        return lexical_retriever(self.postings, self.doc_stats, index=self.blocks)

    @property
    def dense(self) -> Retriever:
        return dense_retriever(self.encoder, self.index, WORD_DIM)

    @cached_property
    def candidates(self) -> DataFrame:
        """The 50 best papers by BM25 for each query, without its citing paper."""
        found = prefetch(self.queries, self.bm25, 50, "always")
        return materialize(found, "candidates")

    @cached_property
    def feature_tables(self) -> FeatureTables:
        return feature_tables(
            self.queries, self.papers, self.postings, self.doc_stats, self.encoder, self.index,
            STOPWORDS,
        )

    def scorer(self, pairs: DataFrame) -> DataFrame:
        return score_pairs(self.feature_tables.features(pairs), WEIGHTS, BIAS)

    @property
    def vectors(self) -> DataFrame:
        return self.base("embeddings").select(
            F.col("vec_id").cast("string").alias("paper_id"),
            vectors.as_double(F.col("embedding")).alias("vec"),
        )

    @property
    def vector_queries(self) -> DataFrame:
        return self.vectors.withColumnRenamed("paper_id", "query_id")


@lru_cache(maxsize=8)
def _shipped(application: str, spark: SparkSession) -> bool:
    ship_package(spark)
    return True


@lru_cache(maxsize=8)
def _tables(application: str, spark: SparkSession, folder: str) -> Tables:
    return Tables(spark, folder)


def tables(spark: SparkSession, folder: str) -> Tables:
    application = spark.sparkContext.applicationId
    _shipped(application, spark)
    apply_settings(spark)
    return _tables(application, spark, folder)
