"""SQL fragments shared by the twins of the registered queries.

``query(body, *ctes)`` puts the named fragments, and what they build on, before
``body``. The fragments state the semantics directly over the given tables and share
nothing with the Spark code but a table of fixed values.
"""

from __future__ import annotations

import re

from shortlist.operators.lexical import IRREGULAR_NOUNS

WORD = r"'[\p{L}\p{N}_]+'"
NON_SPACE = r"'[^\s\x0B\x1C-\x1F\x{85}\p{Z}]+'"
STOPWORDS = ["the", "and", "of", "in", "is", "to", "le", "la", "de", "der", "die", "el"]


def words(text: str) -> str:
    return f"regexp_extract_all({text}, {NON_SPACE})"


def tokens(text: str, stopwords: list[str] | None = None) -> str:
    lowered = f"lower({text})"
    if stopwords:
        listed = ", ".join(f"'{w}'" for w in stopwords)
        lowered = (
            f"array_to_string([w for w in {words(lowered)} if w NOT IN ({listed})], ' ')"
        )
    return f"regexp_extract_all({lowered}, {WORD})"


def hash_int(digest: str) -> str:
    return f"('0x' || substr({digest}, 1, 15))::BIGINT"


def joined(expr: str) -> str:
    """A list as one string."""
    return f"array_to_string({expr}, ',')"


def ranked(source: str, n: int | None = None) -> str:
    cut = "" if n is None else f" QUALIFY rank <= {n}"
    return (
        "SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id "
        f"ORDER BY round(score, 9) DESC, paper_id) AS rank, score FROM {source}{cut}"
    )


def without_citing(n: int, unless_positive: bool = False) -> str:
    """``over_fetched`` lists without the citing paper, cut to ``n``."""
    keep = " OR list_contains(positive_ids, citing_id)" if unless_positive else ""
    return f"""
        SELECT * FROM (
            SELECT r.query_id, paper_id, score,
                   row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank) AS rank
            FROM over_fetched r JOIN queries q USING (query_id)
            WHERE paper_id <> citing_id{keep}) WHERE rank <= {n}"""


def norm(vec: str) -> str:
    return f"(sqrt(list_inner_product({vec}, {vec})) + 1e-12)"


#: noun endings and their replacements, as the lemmas use them
_LEMMA_RULES = " UNION ALL ".join(
    f"SELECT token, left(token, length(token) - {len(old)}) || '{new}' AS lemma, {i} AS place "
    f"FROM all_tokens WHERE ends_with(token, '{old}') AND token NOT IN (SELECT token FROM odd_nouns)"
    for i, (old, new) in enumerate([
        ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
        ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
    ], start=1)
)
_ODD_NOUNS = ", ".join(f"('{token}', '{lemma}')" for token, lemma in IRREGULAR_NOUNS)

CTES = {
    "all_tokens": "SELECT DISTINCT term AS token FROM raw_postings",
    "raw_postings": "SELECT DISTINCT term FROM paper_terms",
    "odd_nouns": f"SELECT * FROM (VALUES {_ODD_NOUNS}) AS odd(token, lemma)",
    "lemmas": f"""
        SELECT token, lemma FROM (
            SELECT token, lemma FROM (SELECT token, token AS lemma, 0 AS place FROM all_tokens
                                      UNION ALL SELECT token, lemma, 1 FROM odd_nouns
                                      UNION ALL {_LEMMA_RULES})
            WHERE lemma IN (SELECT token FROM all_tokens) AND token IN (SELECT token FROM all_tokens)
            QUALIFY row_number() OVER (PARTITION BY token ORDER BY length(lemma), place, lemma) = 1)
        WHERE lemma <> token""",
    "papers": """
        SELECT CAST(doc_id AS VARCHAR) AS paper_id, split_part(text, chr(10), 1) AS title,
               substr(text, length(split_part(text, chr(10), 1)) + 2) AS abstract
        FROM documents""",
    "positives": """
        SELECT 'b' || item_id AS context_id, CAST(doc_id AS VARCHAR) AS paper_id
        FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)""",
    "contexts": """
        SELECT 'b' || item_id AS context_id, text || ' TARGETCIT' AS masked_text,
               CAST(item_id AS VARCHAR) AS citing_id, refid
        FROM benchmark LEFT JOIN
             (SELECT context_id, min(paper_id) AS refid FROM positives GROUP BY ALL) f
             ON f.context_id = 'b' || item_id""",
    "corpus": """
        SELECT 'b' || item_id AS context_id, coalesce(ids, []) AS positive_ids
        FROM benchmark LEFT JOIN
             (SELECT context_id, list(paper_id ORDER BY paper_id) AS ids FROM positives
              GROUP BY ALL) p ON p.context_id = 'b' || item_id""",
    "queries": """
        SELECT context_id AS query_id, citing_id, positive_ids, masked_text AS local_context,
               coalesce(title, '') AS citing_title, coalesce(abstract, '') AS citing_abstract
        FROM corpus JOIN contexts USING (context_id)
        LEFT JOIN papers ON papers.paper_id = citing_id""",
    "answerable": "SELECT * FROM queries WHERE len(positive_ids) > 0",
    "truth": "SELECT context_id AS query_id, refid FROM contexts WHERE refid IS NOT NULL",
    "paper_terms": f"""
        SELECT paper_id, unnest({tokens("title || ' ' || abstract")}) AS term FROM papers""",
    "postings": "SELECT term, paper_id, count(*) AS tf FROM paper_terms GROUP BY ALL",
    "doc_stats": f"""
        SELECT paper_id, len({tokens("title || ' ' || abstract")}) AS doc_len FROM papers""",
    "stats": "SELECT count(*) AS n_docs, avg(doc_len) AS avg_len FROM doc_stats",
    "freq": "SELECT term, count(*) AS df FROM postings GROUP BY term",
    "qterms": f"""
        SELECT query_id, term, count(*) AS qtf
        FROM (SELECT query_id, unnest({tokens("local_context")}) AS term FROM queries)
        GROUP BY ALL""",
    "bm25": """
        SELECT query_id, paper_id,
               sum(qtf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))
                   * ln(1 + (n_docs - df + 0.5) / (df + 0.5))) AS score
        FROM qterms JOIN postings USING (term) JOIN freq USING (term)
        JOIN doc_stats USING (paper_id), stats GROUP BY ALL""",
    "over_fetched": ranked("bm25", 51),
    "candidates": without_citing(50),
    "vocab_words": "SELECT DISTINCT term AS word FROM postings",
    "vocabulary": """
        SELECT '<pad>' AS word, 0 AS idx UNION ALL SELECT '<eos>', 1 UNION ALL
        SELECT word, row_number() OVER (ORDER BY md5('0|' || word), word) + 1 FROM vocab_words""",
    "word_values": """
        SELECT word, i,
               CAST(CAST((('0x' || substr(md5(word), CAST(i * 2 + 1 AS INTEGER), 2))::BIGINT
                          - 128) / 127.0 AS FLOAT) AS DOUBLE) AS v
        FROM vocab_words, range(16) t(i)""",
    "paragraphs": """
        SELECT 'p' AS kind, paper_id AS id, 0 AS ptype, 2.0 AS w, title AS text FROM papers
        UNION ALL SELECT 'p', paper_id, 1, 1.0, abstract FROM papers
        UNION ALL SELECT 'q', query_id, 0, 2.0, citing_title FROM queries
        UNION ALL SELECT 'q', query_id, 1, 1.0, citing_abstract FROM queries
        UNION ALL SELECT 'q', query_id, 3, 3.0, local_context FROM queries""",
    "weighted": f"""
        SELECT kind, id, ptype, text,
               CASE WHEN regexp_matches(text, {NON_SPACE}) THEN w ELSE 0 END AS w
        FROM paragraphs""",
    "paragraph_terms": f"""
        SELECT kind, id, ptype, word, count(*) AS n
        FROM (SELECT kind, id, ptype, unnest({tokens("text")}) AS word FROM paragraphs)
        GROUP BY ALL""",
    "paragraph_means": """
        SELECT kind, id, ptype, i, sum(n * v) / sum(n) AS m
        FROM paragraph_terms JOIN word_values USING (word) GROUP BY ALL""",
    "document_values": """
        SELECT kind, id, t.i, CASE WHEN sum(w) > 0 THEN sum(w * coalesce(m, 0)) / sum(w)
                              ELSE 0 END AS x
        FROM weighted CROSS JOIN range(16) t(i)
        LEFT JOIN paragraph_means pm USING (kind, id, ptype, i) GROUP BY ALL""",
    "document_vectors": """
        SELECT kind, id, list(CAST(x AS DOUBLE) ORDER BY i) AS raw FROM document_values
        GROUP BY ALL""",
    "unit_vectors": f"""
        SELECT kind, id, [x / {norm("raw")} for x in raw] AS vec FROM document_vectors""",
    "cosines": """
        SELECT q.id AS query_id, p.id AS paper_id, list_inner_product(q.vec, p.vec) AS score
        FROM unit_vectors q, unit_vectors p WHERE q.kind = 'q' AND p.kind = 'p'""",
    "query_sets": f"""
        SELECT query_id, list_distinct({tokens(
            "citing_title || ' ' || citing_abstract || ' ' || local_context",
            STOPWORDS + ["<num>", "<cit>"])}) AS a FROM queries""",
    "paper_sets": f"""
        SELECT paper_id, list_distinct({tokens(
            "title || ' ' || abstract", STOPWORDS + ["<num>", "<cit>"])}) AS b FROM papers""",
    "exclusions": """
        SELECT DISTINCT query_id, unnest(list_append(positive_ids, citing_id)) AS paper_id
        FROM answerable""",
    "pool": """
        SELECT DISTINCT query_id, paper_id FROM candidates
        WHERE query_id IN (SELECT query_id FROM answerable)
          AND (query_id, paper_id) NOT IN (SELECT (query_id, paper_id) FROM exclusions)""",
    "positive_rows": """
        SELECT query_id, unnest(positive_ids) AS paper_id,
               generate_subscripts(positive_ids, 1) - 1 AS i FROM answerable""",
    "thresholds": """
        SELECT query_id, avg(jaccard) AS threshold FROM (
            SELECT query_id, len(list_intersect(a, b)) / (len(a) + len(b)
                   - len(list_intersect(a, b)) + 1e-12) AS jaccard
            FROM positive_rows JOIN query_sets USING (query_id) JOIN paper_sets USING (paper_id))
        GROUP BY ALL""",
    "picked": """
        SELECT query_id, paper_id FROM positive_rows
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY
            md5('7|' || query_id || '|' || paper_id || '|' || i), paper_id) <= 1""",
    "hard": """
        SELECT query_id, paper_id, jaccard,
               CASE WHEN jaccard >= threshold THEN 2 ELSE 3 END AS level
        FROM (SELECT query_id, paper_id, len(list_intersect(a, b)) / (len(a) + len(b)
                     - len(list_intersect(a, b)) + 1e-12) AS jaccard
              FROM (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY query_id
                    ORDER BY md5('7|' || query_id || '|' || paper_id), paper_id) <= 3)
              JOIN query_sets USING (query_id) JOIN paper_sets USING (paper_id))
        LEFT JOIN thresholds USING (query_id)""",
    "numbered_papers": """
        SELECT paper_id, row_number() OVER (ORDER BY md5('7|' || paper_id), paper_id) - 1
               AS row_idx FROM papers""",
    "easy": f"""
        SELECT query_id, draw, paper_id
        FROM (SELECT query_id, draw,
                     {hash_int("md5('7|' || query_id || '|' || draw)")}
                     % (SELECT count(*) FROM papers) AS row_idx
              FROM answerable, range(1, 3) t(draw)) JOIN numbered_papers USING (row_idx)""",
    "samples": """
        SELECT query_id, CAST(NULL AS VARCHAR) AS paper_id, 0 AS level, 'query' AS role, 0 AS draw
        FROM answerable
        UNION ALL SELECT query_id, paper_id, 1, 'positive', 0 FROM picked
        UNION ALL SELECT query_id, paper_id, level, 'hard', 0 FROM hard
        UNION ALL SELECT query_id, paper_id, 3, 'easy', draw FROM easy""",
    "sizes": f"""
        SELECT query_id, count(*) AS size, md5('7|' || query_id) AS h,
               {hash_int("md5('7|' || query_id)")} % (SELECT CAST(ceil(count(*) / 8.0) AS BIGINT)
                                                      FROM answerable) AS bucket
        FROM samples GROUP BY ALL""",
    "batches": """
        SELECT query_id, bucket || '-' || CAST(floor(coalesce(sum(size) OVER (
                   PARTITION BY bucket ORDER BY h, query_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 20.0) AS BIGINT)
               AS batch_id FROM sizes""",
    "batched": """
        SELECT *, query_id || '|' || role || '|' || coalesce(paper_id, '') || '|' || draw AS row_id
        FROM samples JOIN batches USING (query_id)""",
    "triplets": """
        SELECT a.batch_id, a.row_id AS anchor, p.row_id AS positive, n.row_id AS negative,
               p.level AS positive_level,
               CASE WHEN n.query_id = p.query_id THEN n.level ELSE 4 END AS negative_level
        FROM batched a JOIN batched p ON p.batch_id = a.batch_id AND p.query_id = a.query_id
             AND p.row_id <> a.row_id AND p.level IN (1, 2)
        JOIN batched n ON n.batch_id = a.batch_id AND n.row_id <> a.row_id
             AND n.row_id <> p.row_id AND n.level <> 0
             AND (n.query_id <> p.query_id OR n.level > p.level)
        WHERE a.level = 0""",
    "sample_vectors": """
        SELECT batch_id, row_id, vec FROM batched JOIN unit_vectors
        ON kind = CASE WHEN role = 'query' THEN 'q' ELSE 'p' END
           AND id = CASE WHEN role = 'query' THEN query_id ELSE paper_id END""",
    "lists": f"""
        SELECT query_id, position, level, CASE WHEN level = 0 THEN picked_id
               ELSE pool_ids[{hash_int("md5('7|' || query_id || '|' || position)")}
                             % len(pool_ids) + 1] END AS paper_id
        FROM (SELECT query_id, position, CASE WHEN position = 1 THEN 0 ELSE 1 END AS level,
                     picked.paper_id AS picked_id, pool_ids
              FROM picked JOIN (SELECT query_id, list(paper_id ORDER BY
                    md5('7|' || query_id || '|' || paper_id), paper_id) AS pool_ids
                    FROM pool GROUP BY ALL) USING (query_id), range(1, 11) t(position))""",
    "features": """
        SELECT c.query_id, c.paper_id, c.rank, coalesce(s.score, 0) AS bm25,
               coalesce(v.score, 0) AS cosine, 1.0 / c.rank AS inverse_rank,
               len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)) + 1e-12)
                   AS jaccard
        FROM candidates c LEFT JOIN bm25 s USING (query_id, paper_id)
        LEFT JOIN cosines v USING (query_id, paper_id)
        JOIN query_sets USING (query_id) JOIN paper_sets USING (paper_id)""",
    "scored": """
        SELECT *, 1 / (1 + exp(-(-2.0 + 0.02 * bm25 + 1.0 * cosine + 3.0 * jaccard
                                 + 0.5 * inverse_rank))) AS score FROM features""",
    "reranked": """
        SELECT query_id, paper_id, rank AS first_rank, score, row_number() OVER
               (PARTITION BY query_id ORDER BY round(score, 9) DESC, rank) AS rank FROM scored""",
    "labelled": """
        SELECT r.*, list_contains(positive_ids, paper_id) AS is_hit
        FROM reranked r JOIN queries USING (query_id)""",
    "vecs": """
        SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings""",
    "value_scale": """
        SELECT 4 * stddev_pop(abs(x)) AS s FROM (SELECT unnest(vec) AS x FROM vecs)""",
    "row_scales": """
        SELECT id, 4 * stddev_pop(abs(x)) AS s FROM (SELECT id, unnest(vec) AS x FROM vecs)
        GROUP BY ALL""",
}


def _order(text: str, known: dict[str, str], done: dict[str, str]) -> None:
    for name in known:
        if name not in done and re.search(rf"\b{name}\b", text):
            _order(known[name], {k: v for k, v in known.items() if k != name}, done)
            done.setdefault(name, known[name])


def query(body: str, **extra: str) -> str:
    """``body`` with every fragment it mentions; ``extra`` adds or replaces fragments."""
    done: dict[str, str] = {}
    _order(body, {**CTES, **extra}, done)
    if not done:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({t})" for n, t in done.items()) + "\n" + body


def dequantized(mode_scale: str, steps: int) -> str:
    """Integer codes of column ``vec`` for a scale column."""
    return (
        f"[CASE WHEN {mode_scale} < 1e-12 THEN 0 ELSE CAST(greatest(least(round_even("
        f"x / {mode_scale} * {steps}, 0), {steps - 1}), {-steps}) AS BIGINT) END for x in vec]"
    )


def f1(recall: str, precision: str) -> str:
    return f"2 / (1 / ({recall} + 1e-12) + 1 / ({precision} + 1e-12))"


def metrics(source: str, ks: tuple[int, ...], mode: str) -> str:
    """Metric rows from ``source(query_id, paper_id, rank)`` and ``queries``."""
    listed = ", ".join(f"({k})" for k in ks)
    size = "len(list_distinct(positive_ids))" if mode == "prefetch" else "len(positive_ids)"
    width = "k" if mode == "prefetch" else "least(k, (SELECT max(n) FROM longest))"
    return f"""
        SELECT k, round(recall, 6) AS recall, round(precision, 6) AS precision,
               round({f1("recall", "precision")}, 6) AS f1, n_queries,
               (SELECT count(*) FROM queries WHERE len(positive_ids) = 0) AS n_skipped
        FROM (SELECT k, avg(hit / {size}) AS recall, avg(hit) / {width} AS precision,
                     count(*) AS n_queries
              FROM (SELECT q.query_id, k, any_value(positive_ids) AS positive_ids,
                           CAST(count(DISTINCT CASE WHEN rank <= k THEN paper_id END) AS DOUBLE)
                               AS hit
                    FROM queries q CROSS JOIN (VALUES {listed}) t(k)
                    LEFT JOIN {source} c ON c.query_id = q.query_id
                         AND list_contains(q.positive_ids, c.paper_id)
                    WHERE len(q.positive_ids) > 0 GROUP BY q.query_id, k) GROUP BY k)"""
