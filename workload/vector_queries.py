"""Vectors: similarity, quantization, nearest neighbours, encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from shortlist.functions import vectors as V
from shortlist.operators import encode
from shortlist.operators.knn import knn
from shortlist.operators.quantize import quantize, value_scale
from shortlist.plans.jobs import embed_papers
from shortlist.plans.retrievers import embed_queries
from shortlist.functions import text as T

from . import sql
from .registry import joined, register, rounded
from .views import VECTOR_DIM, WORD_DIM, Tables

TOP_N = 20


def _listed(vec):
    """A vector as a string of its elements, rounded."""
    return joined(F.transform(vec, lambda x: F.format_string("%.6f", F.round(x, 6) + F.lit(0.0))))


def _listed_sql(vec: str) -> str:
    return f"array_to_string([printf('%.6f', round(x, 6) + 0.0) for x in {vec}], ',')"


@register(
    "l2_normalize",
    sql.query(
        f"SELECT id AS vec_id, {_listed_sql('[x / ' + sql.norm('vec') + ' for x in vec]')} AS unit "
        "FROM vecs"
    ),
)
def l2_normalize(t: Tables):
    unit = V.l2_normalize(F.col("vec"))
    return t.vectors.select(F.col("paper_id").alias("vec_id"), _listed(unit).alias("unit"))


_NEIGHBOURS = """
    SELECT a.id AS a, b.id AS b, a.vec AS va, b.vec AS vb
    FROM vecs a JOIN vecs b ON CAST(b.id AS BIGINT) = CAST(a.id AS BIGINT) + 1"""


def _pairs(t: Tables):
    """Every vector beside its successor."""
    left = t.vectors.select(F.col("paper_id").alias("a"), F.col("vec").alias("va"))
    right = t.vectors.select(
        (F.col("paper_id").cast("bigint") - 1).cast("string").alias("a"),
        F.col("paper_id").alias("b"),
        F.col("vec").alias("vb"),
    )
    return left.join(right, "a")


@register(
    "inner_product",
    sql.query(
        "SELECT a, b, round(list_inner_product(va, vb), 6) AS score FROM neighbours",
        neighbours=_NEIGHBOURS,
    ),
)
def inner_product(t: Tables):
    scored = _pairs(t).withColumn("score", V.dot(F.col("va"), F.col("vb")))
    return scored.select("a", "b", *rounded("score"))


@register(
    "cosine_similarity",
    sql.query(
        f"SELECT a, b, round(list_inner_product(va, vb) / ({sql.norm('va')} * {sql.norm('vb')}), 6)"
        " AS similarity FROM neighbours",
        neighbours=_NEIGHBOURS,
    ),
)
def cosine_similarity(t: Tables):
    scored = _pairs(t).withColumn("similarity", V.pair_similarity(F.col("va"), F.col("vb")))
    return scored.select("a", "b", *rounded("similarity"))


@register(
    "euclidean_similarity",
    sql.query(
        "SELECT a, b, round(-list_distance(va, vb), 6) AS similarity FROM neighbours",
        neighbours=_NEIGHBOURS,
    ),
)
def euclidean_similarity(t: Tables):
    similarity = V.pair_similarity(F.col("va"), F.col("vb"), "euclidean")
    return _pairs(t).withColumn("similarity", similarity).select("a", "b", *rounded("similarity"))


@register("value_scale", sql.query("SELECT round(s, 6) AS scale FROM value_scale"))
def vector_value_scale(t: Tables):
    return value_scale(t.vectors).select(*rounded("scale"))


_BITS = (
    "[list_sum([CASE WHEN vec[c * 32 + i + 1] > 0 THEN (1::BIGINT) << i ELSE 0 END "
    "for i in range(32)]) for c in range(2)]"
)


@register(
    "quantize_bool",
    sql.query(
        f"SELECT id AS vec_id, array_to_string([CAST(x AS BIGINT) for x in {_BITS}], ',') AS codes "
        "FROM vecs"
    ),
)
def quantize_bool(t: Tables):
    codes = quantize(t.vectors, "bool")
    return codes.select(F.col("paper_id").alias("vec_id"), joined(F.col("vec")).alias("codes"))


def _quantize_sql(steps: int) -> str:
    return sql.query(
        f"SELECT id AS vec_id, {sql.joined(sql.dequantized('s', steps))} AS codes "
        "FROM vecs, value_scale"
    )


@register("quantize_int4", _quantize_sql(8))
def quantize_int4(t: Tables):
    codes = quantize(t.vectors, "int4")
    return codes.select(F.col("paper_id").alias("vec_id"), joined(F.col("vec")).alias("codes"))


@register("quantize_int8", _quantize_sql(128))
def quantize_int8(t: Tables):
    codes = quantize(t.vectors, "int8")
    return codes.select(F.col("paper_id").alias("vec_id"), joined(F.col("vec")).alias("codes"))


@register(
    "quantize_int8_per_row",
    sql.query(
        f"SELECT id AS vec_id, {sql.joined(sql.dequantized('s', 128))} AS codes "
        "FROM vecs JOIN row_scales USING (id)"
    ),
)
def quantize_int8_per_row(t: Tables):
    codes = quantize(t.vectors, "int8", per_row=True)
    return codes.select(F.col("paper_id").alias("vec_id"), joined(F.col("vec")).alias("codes"))


@register(
    "quantize_float32", sql.query(f"SELECT id AS vec_id, {_listed_sql('vec')} AS codes FROM vecs")
)
def quantize_float32(t: Tables):
    kept = quantize(t.vectors, "float32")
    return kept.select(F.col("paper_id").alias("vec_id"), _listed(F.col("vec")).alias("codes"))


# --- nearest neighbours -----------------------------------------------------------------

_UNIT = f"SELECT id, [x / {sql.norm('vec')} for x in vec] AS vec FROM vecs"
_ALL_PAIRS = """
    SELECT q.id AS query_id, d.id AS paper_id, list_inner_product(q.vec, d.vec) AS score
    FROM unit q, unit d"""


def _knn_sql(n: int = TOP_N, where: str = "", **extra: str) -> str:
    return sql.query(
        "SELECT query_id, paper_id, rank, round(score, 6) AS score FROM best",
        **extra,
        best=sql.ranked(f"(SELECT * FROM scored_pairs{where})", n),
    )


def _unit(t: Tables):
    return t.vectors.withColumn("vec", V.l2_normalize(F.col("vec")))


def _search(t: Tables, precision: str = "float32", n: int = TOP_N, **options):
    unit = _unit(t)
    queries = quantize(unit.withColumnRenamed("paper_id", "query_id"), precision, per_row=True)
    found = knn(queries, quantize(unit, precision), n, VECTOR_DIM, precision, **options)
    return found.select("query_id", "paper_id", "rank", *rounded("score"))


@register("knn", _knn_sql(unit=_UNIT, scored_pairs=_ALL_PAIRS))
def knn_float32(t: Tables):
    """All vectors against all vectors, queries copied to the executors."""
    return _search(t)


@register("knn_grid", _knn_sql(unit=_UNIT, scored_pairs=_ALL_PAIRS))
def knn_grid(t: Tables):
    """The same search with both sides cut into blocks and shuffled."""
    return _search(t, broadcast_queries=0)


@register(
    "knn_allowed",
    _knn_sql(
        where=" WHERE paper_id IN (SELECT CAST(v.vec_id AS VARCHAR) FROM embeddings v "
        "JOIN labels l ON l.doc_id = v.vec_id WHERE quality = 1)",
        unit=_UNIT,
        scored_pairs=_ALL_PAIRS,
    ),
)
def knn_allowed(t: Tables):
    """Restricted to the vectors whose document is labelled as good."""
    good = t.base("labels").filter(F.col("quality") == 1)
    return _search(t, allowed=good.select(F.col("doc_id").cast("string").alias("paper_id")))


@register(
    "knn_allowed_per_query",
    _knn_sql(
        n=5,
        unit=_UNIT,
        allowed_pairs="""
            SELECT DISTINCT CAST(doc_id AS VARCHAR) AS query_id,
                   CAST(unnest([doc_id + 1, doc_id + 2, doc_id * 2, quality * 3 + toxic, 0])
                        AS VARCHAR) AS paper_id FROM labels""",
        scored_pairs="""
            SELECT query_id, paper_id, list_inner_product(q.vec, d.vec) AS score
            FROM allowed_pairs JOIN unit q ON q.id = query_id JOIN unit d ON d.id = paper_id""",
    ),
)
def knn_allowed_per_query(t: Tables):
    """Each labelled document may only see a few vectors of its own."""
    doc = F.col("doc_id")
    few = F.array(
        doc + 1, doc + 2, doc * 2, (F.col("quality") * 3 + F.col("toxic")).cast("bigint"),
        F.lit(0).cast("bigint"),
    )
    allowed = t.base("labels").select(
        doc.cast("string").alias("query_id"),
        F.explode(few.cast("array<string>")).alias("paper_id"),
    )
    return _search(t, n=5, allowed=allowed)


def _integer_unit(steps: int) -> dict[str, str]:
    return {
        "unit": _UNIT,
        "whole_scale": "SELECT 4 * stddev_pop(abs(x)) AS s FROM "
        "(SELECT unnest(vec) AS x FROM unit)",
        "each_scale": "SELECT id, 4 * stddev_pop(abs(x)) AS s FROM "
        "(SELECT id, unnest(vec) AS x FROM unit) GROUP BY ALL",
        "q_codes": f"SELECT id, {sql.dequantized('s', steps)} AS codes "
        "FROM unit JOIN each_scale USING (id)",
        "d_codes": f"SELECT id, {sql.dequantized('s', steps)} AS codes FROM unit, whole_scale",
        "scored_pairs": "SELECT q.id AS query_id, d.id AS paper_id, list_inner_product("
        "CAST(q.codes AS DOUBLE[]), CAST(d.codes AS DOUBLE[])) AS score FROM q_codes q, d_codes d",
    }


@register("knn_int8", _knn_sql(**_integer_unit(128)))
def knn_int8(t: Tables):
    return _search(t, "int8")


@register("knn_int4", _knn_sql(**_integer_unit(8)))
def knn_int4(t: Tables):
    return _search(t, "int4")


_SIGNS = _knn_sql(
    unit=_UNIT,
    signs="SELECT id, [CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END for x in vec] "
    "AS s FROM unit",
    scored_pairs="SELECT q.id AS query_id, d.id AS paper_id, "
    "(list_inner_product(q.s, d.s) + len(q.s)) / 2 AS score FROM signs q, signs d",
)


@register("knn_bool", _SIGNS)
def knn_bool(t: Tables):
    return _search(t, "bool")


@register("knn_grid_int8", _knn_sql(**_integer_unit(128)))
def knn_grid_int8(t: Tables):
    return _search(t, "int8", broadcast_queries=0)


@register("knn_grid_int4", _knn_sql(**_integer_unit(8)))
def knn_grid_int4(t: Tables):
    return _search(t, "int4", broadcast_queries=0)


@register("knn_grid_bool", _SIGNS)
def knn_grid_bool(t: Tables):
    return _search(t, "bool", broadcast_queries=0)


@register(
    "hamming_similarity",
    sql.query(
        "SELECT a, b, len([i for i in range(1, 65) if (va[i] > 0) = (vb[i] > 0)]) AS similarity "
        "FROM neighbours",
        neighbours=_NEIGHBOURS,
    ),
)
def hamming_similarity(t: Tables):
    packed = _pairs(t).select(
        "a", "b", V.pack_sign_bits(F.col("va")).alias("pa"), V.pack_sign_bits(F.col("vb")).alias("pb")
    )
    similarity = V.hamming_similarity(F.col("pa"), F.col("pb"), VECTOR_DIM)
    return packed.select("a", "b", similarity.cast("bigint").alias("similarity"))


# --- encoders ---------------------------------------------------------------------------


@register(
    "mean_vector_encoder",
    sql.query(
        f"""
        SELECT paper_id, {_listed_sql("coalesce(vec, [0.0 for _ in range(16)])")} AS vec
        FROM papers LEFT JOIN (
            SELECT paper_id, list(x ORDER BY i) AS vec
            FROM (SELECT paper_id, i, sum(tf * v) / sum(tf) AS x
                  FROM postings JOIN word_values ON word = term GROUP BY ALL)
            GROUP BY ALL) USING (paper_id)"""
    ),
)
def mean_vector_encoder(t: Tables):
    encoder = encode.mean_vector_encoder(t.word_vectors, WORD_DIM)
    return embed_papers(t.papers, encoder).select("paper_id", _listed(F.col("vec")).alias("vec"))


@register(
    "hierarchical_encoder",
    sql.query(
        f"SELECT id AS paper_id, {_listed_sql('raw')} AS vec FROM document_vectors "
        "WHERE kind = 'p'"
    ),
)
def hierarchical_encoder(t: Tables):
    return embed_papers(t.papers, t.encoder).select("paper_id", _listed(F.col("vec")).alias("vec"))


@register(
    "embed_queries",
    sql.query(
        f"SELECT id AS query_id, {_listed_sql('vec')} AS vec FROM unit_vectors WHERE kind = 'q'"
    ),
)
def embedded_queries(t: Tables):
    return embed_queries(t.queries, t.encoder).select("query_id", _listed(F.col("vec")).alias("vec"))


@register(
    "embed_with_model",
    sql.query(
        f"SELECT paper_id, {_listed_sql('freq')} AS vec FROM frequencies",
        document_texts="""
            SELECT paper_id, title || ' ' || abstract AS text FROM papers""",
        frequencies="""
            SELECT paper_id, [CAST((length(text) - length(replace(text, c, '')))
                   / greatest(length(text), 1) AS FLOAT)::DOUBLE
                   for c in string_split('abcdefghijklmnopqrstuvwxyz', '')] AS freq
            FROM document_texts""",
    ),
)
def embed_with_model(t: Tables):
    """An external model in the encoder slot: here, letter frequencies of the text."""

    def make_predict_fn():
        import numpy as np

        letters = "abcdefghijklmnopqrstuvwxyz"

        def predict(texts):
            return np.array(
                [[text.count(c) / max(len(text), 1) for c in letters] for text in texts],
                dtype=np.float32,
            )

        return predict

    documents = t.papers.select(
        F.col("paper_id").alias("doc_id"),
        T.paper_paragraphs(F.col("title"), F.col("abstract")).alias("document"),
    )
    embedded = encode.model_encoder(make_predict_fn)(documents)
    return embedded.select(F.col("doc_id").alias("paper_id"), _listed(F.col("vec")).alias("vec"))
