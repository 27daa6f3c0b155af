"""One registered query per operator, over the whole given tables, and the SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ann_forest,
    bpe,
    embedding_dedup,
    extraction,
    filter_audit,
    langid,
    line_dedup,
    ngram_join,
    packing,
    secret_scan,
    url_filter,
    warc,
    whitening,
)
from .batches import bound_batches, materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: vocabulary files, by name in the folder of public tokenizers
PACKING_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    """The place of a vocabulary file; the folder is the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, in a session whose Arrow batches are bounded."""
    bound_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_pack_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into windows of 1024 tokens; one row per piece."""
    pieces = packing.pack(
        table(spark, folder, "documents"), "doc_id", "text", tokenizer_path(PACKING_VOCABULARY)
    )
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@register
def op10_encode_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All documents encoded to ids and decoded again, as digests."""
    return bpe.digests(
        table(spark, folder, "documents"), "doc_id", "text", tokenizer_path(WORD_VOCABULARY)
    )


@register
def op9_identify_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of all documents, learned from the labelled ones outside the held-out fold."""
    docs = table(spark, folder, "documents")
    model = langid.fit(docs, "text", "lang", "doc_id", ~langid.held_out("doc_id"))
    found = langid.predict(docs.select("doc_id", "text"), "text", model, spans=False)
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@register
def op7_extract_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of all pages."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return extraction.extract(pages, "html").withColumn("n_chars", F.length("text").cast("long"))


#: the rules of the URL query
URL_RULES = [
    url_filter.Rule("org/", "allow"),
    url_filter.Rule("example.org/es/", "block"),
    url_filter.Rule("example.org/en/1", "block"),
    url_filter.Rule("com/fr/", "allow"),
    url_filter.Rule("com/de/", "block"),
]


@register
def op2_judge_urls(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on the URL of every page, by rule or by language model."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    judged = url_filter.judge_urls(pages, "url", URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "url_score")


@register
def op3_archive_pages(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written to Zstandard WARC archives and read back."""
    pages = table(spark, folder, "pages")
    archives = warc.archive_folder(pages)
    files = warc.write_archives(pages, archives, "page_id", "url", "html")
    records = warc.read_archives(spark, archives, files, payload=False)
    return records.select(
        warc.key_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.key_of(F.col("refers_to")).alias("refers_to"),
        "error",
    )


#: the rules of the secret scan, base kinds first
SECRET_RULES = (*secret_scan.BASE_RULES, *secret_scan.ADDED_RULES)


@register
def op4_scan_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """The secrets in all documents: counts and digest of the base kinds, and all spans."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, "text", SECRET_RULES)
    base = F.filter("spans", lambda s: s.ord < len(secret_scan.BASE_RULES))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(rule.kind).alias(f"n_{rule.kind}") for rule in secret_scan.BASE_RULES],
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
    )


ORACLES["op4_scan_secrets"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({secret_scan.duckdb_spans(SECRET_RULES)}),
listed AS (
  SELECT rid, kind, ord, s, kind || ':' || s::BIGINT || ':' || e::BIGINT AS shown FROM spans
)
SELECT d.doc_id,
       count(shown) FILTER (WHERE kind = 'assign') AS n_assign,
       count(shown) FILTER (WHERE kind = 'access') AS n_access,
       count(shown) FILTER (WHERE kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(shown, ',' ORDER BY s, ord)
                       FILTER (WHERE ord < {len(secret_scan.BASE_RULES)}), '')) AS base_sha256,
       coalesce(string_agg(shown, ',' ORDER BY s, ord), '') AS spans
FROM d LEFT JOIN listed USING (rid)
GROUP BY rid, d.doc_id
"""


@register
def op5_search_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    vectors = table(spark, folder, "embeddings")
    return ann_forest.search(vectors, "vec_id", "embedding", F.col("vec_id") % 50 == 0)


@register
def op8_dedup_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors of equal label with cosine 0.93 or more."""
    vectors = table(spark, folder, "embeddings")
    return embedding_dedup.near_duplicates(vectors, "vec_id", "embedding", "label")


@register
def op6_join_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose sets of three-word shingles overlap by 90 %."""
    docs = table(spark, folder, "documents")
    return ngram_join.join_groups(docs, "doc_id", "text")


@register
def op11_whiten_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors on their eight strongest components, scaled to deviation one."""
    found = whitening.whiten(table(spark, folder, "embeddings"), "vec_id", "embedding")
    return found.withColumn("deviation", whitening.fits_long(F.col("deviation")))


@register
def op12_drop_lines(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the lines that a document of smaller id holds too."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    bitmaps = materialize(line_dedup.keep_bitmaps(docs, "doc_id", "text"), "keep-bitmaps")
    kept = line_dedup.drop_lines(docs, "doc_id", "text", bitmaps)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return kept.select("doc_id", "n_lines", "n_dropped", digest)


ORACLES["op12_drop_lines"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents
),
l AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (
  SELECT *, translate(
    trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
),
owned AS (
  SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= {line_dedup.LEAST_LENGTH}
  GROUP BY key HAVING count(DISTINCT doc_id) > 1
),
m AS (SELECT k.*, coalesce(doc_id > owner, false) AS gone FROM k LEFT JOIN owned USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), ''))
         AS kept_sha256
FROM m GROUP BY rid, doc_id
"""


@register
def op13_audit_filters(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters remove from all documents in each of their 120 orders."""
    return filter_audit.audit(
        table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id", "text", "lang"
    )


ORACLES["op13_audit_filters"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents
),
w AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         min(doc_id) OVER (PARTITION BY t) AS first_id
  FROM d
),
f AS (
  SELECT doc_id, part, [
    len(words) < 200,
    100 * len(list_distinct(words)) < 50 * len(words),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
    regexp_matches(t, '[#$%&*|]'),
    coalesce(first_id < doc_id, false)] AS fails
  FROM w
),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
         max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
),
combos AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN marks USING (doc_id) GROUP BY ALL
),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, e.i, g.i] AS o
  FROM letters a, letters b, letters c, letters e, letters g
  WHERE len(list_distinct([a.i, b.i, c.i, e.i, g.i])) = 5
),
steps AS (
  SELECT array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') AS filter_order, s.i AS step,
         o[s.i] AS filter, o[1:s.i - 1] AS before
  FROM orders, letters s
),
outcome AS (
  SELECT part, filter_order, step, filter, n, good, toxic, fails[filter] AS hit,
         len(list_filter(before, lambda x: fails[x])) > 0 AS gone,
         len(list_filter(fails, lambda x: x)) = 1 AS alone
  FROM combos, steps
),
counted AS (
  SELECT part, filter_order, step, filter,
         coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (NOT gone AND hit), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone AND hit), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (hit AND alone), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (NOT gone AND hit), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (NOT gone AND hit), 0)::BIGINT AS toxic_lost
  FROM outcome GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM counted
"""
