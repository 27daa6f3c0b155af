"""The stages of the corpus pipeline: documents in, documents out (the last one packs).

Each takes (spark, docs, sf_dir) and uses whole texts. All but the last return the columns of
``docs`` in their order; other columns than ``doc_id`` and ``text`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import dense_index
from . import langid, ngram_join, packing, secret_scan
from .batches import bound_batches, free_name, materialize
from .queries import PACKING_VOCABULARY, SECRET_RULES, tokenizer_path

#: a document stays if one language covers this share of its letters
LEAST_SCORE = 0.5
#: near-duplicates are documents whose sets of this many words overlap by this many percent
SHINGLE_WORDS, SHINGLE_PERCENT = 5, 80
#: ids of dropped documents are copied to the executors up to this many (8 bytes each)
COPIED_IDS = 1_000_000


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters of which at least half are of one learned language.

    Learns from the labelled documents; where none is labelled, every document with a letter
    stays. Null and empty texts and texts without letters go. Of equally likely languages
    the first by name is taken; repeated rows are judged alike; very long texts are read whole.
    """
    bound_batches(spark)
    model = langid.fit(docs, "text", "lang", "doc_id", F.lit(True))
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(docs, "text", model, spans=False)
    kept = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*docs.columns)


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a number of its own for every row, of which equal rows are one.

    A row whose id no other row has is numbered by it. Of rows with one id the first by text
    is; the others, and rows with a null id, get numbers above all ids, and of those with
    equal text only one is kept. Numbers follow from the rows, not from how they are laid out.
    """
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    odd = materialize(odd.filter("n > 1 or doc_id is null").select("doc_id"), "odd-ids")
    plain = docs.withColumn(key, F.col("doc_id").cast("long"))
    if odd.isEmpty():
        return plain
    name = free_name(docs, "_odd")
    ids = odd.select(F.col("doc_id").alias(name))
    same = F.col("doc_id").eqNullSafe(F.col(name))
    several = docs.join(ids, same, "left_semi").dropDuplicates(["doc_id", "text"])
    mark = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    several = several.withColumn(name, F.concat(mark, F.col("text").isNull().cast("string")))
    several = materialize(several, "odd-rows")
    firsts = several.filter("doc_id is not null").groupBy("doc_id").agg(F.min(name).alias("_mark"))
    others = several.select(F.col(name).alias("_mark")).join(firsts.select("_mark"), "_mark", "left_anti")
    numbered = dense_index(others, "_mark").select("_mark", "row_idx")
    largest = docs.agg(F.coalesce(F.max("doc_id").cast("long"), F.lit(0).cast("long"))).scalar()
    met = several.join(numbered, F.col(name) == F.col("_mark"), "left")
    above = largest + 1 + F.col("row_idx")
    placed = met.withColumn(key, F.coalesce(above, F.col("doc_id").cast("long")))
    rest = plain.join(ids, same, "left_anti")
    return rest.unionByName(placed.select(*docs.columns, key))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id.

    Rows that repeat an id or have none are documents of their own: of those with equal text
    one stays, and they give way to near-duplicates with an id of their own. Documents without
    words are in no group and stay, but for such repeated rows. Whole texts are compared.
    """
    bound_batches(spark)
    key = free_name(docs, "_row")
    rows = _keyed(docs, key)
    groups = ngram_join.join_groups(rows, key, "text", SHINGLE_WORDS, SHINGLE_PERCENT)
    name = free_name(docs, "_gone")
    dropped = materialize(
        groups.filter(F.col("component_id") != F.col(key)).select(F.col(key).alias(name)),
        "near-duplicates",
    )
    small = dropped.count() <= COPIED_IDS
    gone = F.broadcast(dropped) if small else dropped
    kept = rows.join(gone, F.col(key) == F.col(name), "left_anti")
    return kept.select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret and ``n_chars`` counted anew.

    Whole texts are scanned. A null text stays null, repeated rows are masked alike, spans that
    overlap become one mark, and an empty table gives an empty one. ``n_chars`` changes only
    where a secret was found.
    """
    spans = free_name(docs, "_spans")
    found = secret_scan.scan(docs, "text", SECRET_RULES, spans)
    clean = found.withColumn("text", secret_scan.masked(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        counted = F.when(F.size(spans) > 0, F.length("text").cast("long"))
        clean = clean.withColumn("n_chars", F.coalesce(counted, F.col("n_chars")))
    return clean.select(*docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 tokens, with their ids."""
    bound_batches(spark)
    return packing.pack(docs, "doc_id", "text", tokenizer_path(PACKING_VOCABULARY))
