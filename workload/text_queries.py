"""Text: tokens, paragraphs, sequences, rerank inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from shortlist import defaults as D
from shortlist.functions import text as T
from shortlist.operators import candidates as C
from shortlist.operators import encode, lexical, rerank

from . import sql
from .registry import digest, joined, register
from .views import STOPWORDS, Tables


def _digest(expr: str, name: str) -> str:
    return f"md5({expr}) AS {name}_md5, length({expr}) AS {name}_chars"


def _token_digest(expr: str) -> str:
    return f"md5(array_to_string({expr}, ' ')) AS tokens_md5, len({expr}) AS n_tokens"


def _token_columns(tokens):
    return [F.md5(F.array_join(tokens, " ")).alias("tokens_md5"), F.size(tokens).alias("n_tokens")]


@register(
    "normalize_text",
    f"SELECT doc_id, {_digest('lower(text)', 'text')} FROM documents",
)
def normalize_text(t: Tables):
    return t.base("documents").select("doc_id", *digest(T.normalize_text(F.col("text")), "text"))


@register("tokenize", f"SELECT doc_id, {_token_digest(sql.tokens('text'))} FROM documents")
def tokenize(t: Tables):
    return t.base("documents").select("doc_id", *_token_columns(T.tokenize(F.col("text"))))


@register(
    "tokenize_stopwords",
    f"SELECT doc_id, {_token_digest(sql.tokens('text', STOPWORDS))} FROM documents",
)
def tokenize_stopwords(t: Tables):
    return t.base("documents").select(
        "doc_id", *_token_columns(T.tokenize(F.col("text"), STOPWORDS))
    )


@register(
    "tokenize_extra_stopwords",
    sql.query(
        "SELECT context_id, "
        + _token_digest(
            sql.tokens(
                "replace(masked_text, 'TARGETCIT', '<cit>')", STOPWORDS + ["<num>", "<cit>"]
            )
        )
        + " FROM contexts"
    ),
)
def tokenize_extra_stopwords(t: Tables):
    text = T.mask_citation(F.col("masked_text"))
    return t.contexts.select(
        "context_id", *_token_columns(T.tokenize(text, STOPWORDS, D.JACCARD_STOPWORDS))
    )


@register(
    "tokenize_paragraphs",
    sql.query(
        "SELECT paper_id, ptype, n_tokens, tokens_md5 FROM ("
        f"SELECT paper_id, 0 AS ptype, {_token_digest(sql.tokens('title'))} FROM papers UNION ALL "
        f"SELECT paper_id, 1, {_token_digest(sql.tokens('abstract'))} FROM papers)"
    ),
)
def tokenize_paragraphs(t: Tables):
    paragraphs = t.papers.select(
        "paper_id", F.explode(T.paper_paragraphs(F.col("title"), F.col("abstract"))).alias("p")
    )
    return paragraphs.select("paper_id", "p.ptype", *_token_columns(T.tokenize(F.col("p.text"))))


@register(
    "build_lemmas",
    sql.query(
        "SELECT token, lemma FROM lemmas"
    ),
)
def build_lemmas(t: Tables):
    return lexical.build_lemmas(t.postings.select(F.col("term").alias("token")))


@register(
    "lemmatized_postings",
    sql.query(
        "SELECT coalesce(lemma, term) AS term, paper_id, CAST(sum(tf) AS BIGINT) AS tf "
        "FROM postings LEFT JOIN lemmas ON token = term GROUP BY ALL",
    ),
)
def lemmatized_postings(t: Tables):
    lemmas = lexical.build_lemmas(t.postings.select(F.col("term").alias("token")))
    postings = lexical.build_postings(t.papers, lemmas=lemmas)
    return postings.select("term", "paper_id", F.col("tf").cast("bigint").alias("tf"))


_SEQUENCE = f"""
    SELECT doc_id, array_to_string((list(idx ORDER BY pos) || [0 for _ in range(512)])[1:512], ',')
               AS seq
    FROM (SELECT doc_id, unnest({sql.words("lower(text)")}) AS word,
                 generate_subscripts({sql.words("lower(text)")}, 1) AS pos FROM documents)
    JOIN vocabulary USING (word) GROUP BY doc_id"""


@register(
    "encode_sequences",
    sql.query(
        "SELECT doc_id, md5(coalesce(seq, array_to_string([0 for _ in range(512)], ','))) "
        "AS seq_md5 FROM documents LEFT JOIN sequences USING (doc_id)",
        sequences=_SEQUENCE,
    ),
)
def encode_sequences(t: Tables):
    encoded = encode.encode_sequences(
        t.base("documents"), "doc_id", F.col("text"), t.vocabulary, D.MAX_SEQ_LEN
    )
    return encoded.select("doc_id", F.md5(joined(F.col("seq"))).alias("seq_md5"))


@register(
    "encode_paragraphs",
    sql.query(
        f"""
        SELECT q.id AS query_id, q.ptype, md5(coalesce(seq, array_to_string(
                   [0 for _ in range(512)], ','))) AS seq_md5,
               CAST(NOT regexp_matches(q.text, {sql.NON_SPACE}) AS INTEGER) AS is_empty
        FROM paragraphs q LEFT JOIN (
            SELECT id, ptype, array_to_string((list(idx ORDER BY pos)
                       || [0 for _ in range(512)])[1:512], ',') AS seq
            FROM (SELECT id, ptype, unnest({sql.words("lower(text)")}) AS word,
                         generate_subscripts({sql.words("lower(text)")}, 1) AS pos
                  FROM paragraphs WHERE kind = 'q')
            JOIN vocabulary USING (word) GROUP BY id, ptype) USING (id, ptype)
        WHERE kind = 'q'"""
    ),
)
def encode_paragraphs(t: Tables):
    document = C.query_document(t.queries)
    encoded = encode.encode_paragraphs(t.queries, "query_id", document, t.vocabulary)
    return encoded.select("query_id", F.explode("paragraphs").alias("p")).select(
        "query_id",
        "p.ptype",
        F.md5(joined(F.col("p.seq"))).alias("seq_md5"),
        F.col("p.is_empty").cast("int").alias("is_empty"),
    )


@register(
    "decode_sequences",
    sql.query(
        f"""
        SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents LEFT JOIN (
            SELECT doc_id, array_to_string(list(word ORDER BY pos)[1:512], ' ') AS text
            FROM (SELECT doc_id, unnest({sql.words("lower(text)")}) AS word,
                         generate_subscripts({sql.words("lower(text)")}, 1) AS pos FROM documents)
            JOIN vocabulary USING (word) GROUP BY doc_id) d USING (doc_id)"""
        .replace("md5(coalesce(text, ''))", "md5(coalesce(d.text, ''))")
    ),
)
def decode_sequences(t: Tables):
    encoded = encode.encode_sequences(
        t.base("documents"), "doc_id", F.col("text"), t.vocabulary, D.MAX_SEQ_LEN
    )
    decoded = encode.decode_sequences(encoded, "doc_id", F.col("seq"), t.vocabulary)
    return decoded.select("doc_id", F.md5("text").alias("text_md5"))


@register(
    "paper_paragraphs",
    sql.query(
        "SELECT id AS paper_id, ptype, " + _digest("text", "text")
        + " FROM paragraphs WHERE kind = 'p'"
    ),
)
def paper_paragraphs(t: Tables):
    document = T.paper_paragraphs(F.col("title"), F.col("abstract"))
    return t.papers.select("paper_id", F.explode(document).alias("p")).select(
        "paper_id", "p.ptype", *digest(F.col("p.text"), "text")
    )


@register(
    "context_paragraphs",
    sql.query(
        "SELECT id AS context_id, ptype, " + _digest("text", "text")
        + " FROM paragraphs WHERE kind = 'q'"
    ),
)
def context_paragraphs(t: Tables):
    resolved = C.resolve_papers(t.contexts, t.papers, "citing_id")
    document = T.query_paragraphs(F.col("title"), F.col("abstract"), F.col("masked_text"))
    return resolved.select("context_id", F.explode(document).alias("p")).select(
        "context_id", "p.ptype", *digest(F.col("p.text"), "text")
    )


@register(
    "pad_paragraphs",
    sql.query(
        f"""
        SELECT paper_id, ptype, {_digest("text", "text")},
               CAST(NOT regexp_matches(text, {sql.NON_SPACE}) AS INTEGER) AS is_empty
        FROM (SELECT id AS paper_id, ptype, text FROM paragraphs WHERE kind = 'p'
              UNION ALL SELECT paper_id, 10, '' FROM papers)"""
    ),
)
def pad_paragraphs(t: Tables):
    document = T.pad_paragraphs(T.paper_paragraphs(F.col("title"), F.col("abstract")))
    return t.papers.select("paper_id", F.explode(document).alias("p")).select(
        "paper_id",
        "p.ptype",
        *digest(F.col("p.text"), "text"),
        F.col("p.is_empty").cast("int").alias("is_empty"),
    )


@register(
    "document_text",
    sql.query("SELECT paper_id, " + _digest("(title || ' ' || abstract)", "text") + " FROM papers"),
)
def document_text(t: Tables):
    document = T.paper_paragraphs(F.col("title"), F.col("abstract"))
    return t.papers.select("paper_id", *digest(T.document_text(document), "text"))


@register(
    "rerank_query_text",
    sql.query(
        "SELECT query_id, "
        + _digest(
            "(array_to_string("
            + sql.words("citing_title || ' ' || citing_abstract")
            + "[1:179], ' ') || '<sep>' || replace(local_context, 'TARGETCIT', '<cit>'))",
            "text",
        )
        + " FROM queries"
    ),
)
def rerank_query_text(t: Tables):
    text = T.rerank_query_text(
        F.col("citing_title"), F.col("citing_abstract"), F.col("local_context")
    )
    return t.queries.select("query_id", *digest(text, "text"))


@register(
    "candidate_texts",
    sql.query(
        "SELECT query_id, paper_id, rank, "
        + _digest("(title || ' ' || abstract)", "candidate")
        + " FROM candidates JOIN papers USING (paper_id)"
    ),
)
def candidate_texts(t: Tables):
    texts = rerank.pair_texts(t.candidates, t.queries, t.papers)
    return texts.select(
        "query_id", "paper_id", "rank", *digest(F.col("candidate_text"), "candidate")
    )


@register(
    "query_paragraphs",
    sql.query(
        "SELECT query_id, "
        + _digest("(citing_title || '#' || citing_abstract || '#' || local_context)", "text")
        + ", '0,1,3' AS labels FROM queries"
    ),
)
def query_paragraphs(t: Tables):
    document = C.query_document(t.queries)
    text = F.array_join(F.transform(document, lambda p: p["text"]), "#")
    labels = F.transform(document, lambda p: p["ptype"])
    return t.queries.select("query_id", *digest(text, "text"), joined(labels).alias("labels"))


@register("query_terms", sql.query("SELECT query_id, term, qtf FROM qterms"))
def query_terms(t: Tables):
    return lexical.query_terms(t.queries, F.col("local_context"))


@register(
    "conversation_terms",
    f"""
    SELECT query_id, term, count(*) AS qtf
    FROM (SELECT conv_id || '-' || turn AS query_id, unnest({sql.tokens("text")}) AS term
          FROM conversations) GROUP BY ALL""",
)
def conversation_terms(t: Tables):
    turns = t.base("conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text"
    )
    return lexical.query_terms(turns, F.col("text"))


@register(
    "query_terms_pretokenized",
    sql.query(
        "SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest("
        + sql.words("local_context")
        + ") AS term FROM queries) GROUP BY ALL"
    ),
)
def query_terms_pretokenized(t: Tables):
    return lexical.query_terms(t.queries, F.col("local_context"), pretokenized=True)


@register(
    "resolve_contexts",
    sql.query(
        "SELECT context_id, md5(masked_text) AS text_md5, citing_id, len(positive_ids) "
        "AS n_positive FROM corpus JOIN contexts USING (context_id)"
    ),
)
def resolve_contexts(t: Tables):
    resolved = C.resolve_contexts(t.corpus, t.contexts, strict=True)
    return resolved.select(
        "context_id",
        F.md5("masked_text").alias("text_md5"),
        "citing_id",
        F.size("positive_ids").alias("n_positive"),
    )


@register(
    "resolve_papers",
    sql.query(
        "SELECT context_id, citing_id, " + _digest("coalesce(title, '')", "title") + ", "
        + _digest("coalesce(abstract, '')", "abstract")
        + " FROM contexts LEFT JOIN papers ON paper_id = citing_id"
    ),
)
def resolve_papers(t: Tables):
    resolved = C.resolve_papers(t.contexts, t.papers, "citing_id")
    return resolved.select(
        "context_id",
        "citing_id",
        *digest(F.col("title"), "title"),
        *digest(F.col("abstract"), "abstract"),
    )


