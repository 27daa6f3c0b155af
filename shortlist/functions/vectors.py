"""Vector columns. A vector is an array; arithmetic is done in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import defaults as D

#: sign bits kept in one array element by :func:`pack_sign_bits`
BITS_PER_CHUNK = 32


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vec: Column) -> Column:
    return F.sqrt(dot(vec, vec))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once even if a lambda repeats it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def l2_normalize(vec: Column) -> Column:
    return let(
        norm(vec) + F.lit(D.EPSILON),
        lambda length: F.transform(as_double(vec), lambda x: x / length),
    )


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + F.lit(D.EPSILON)) * (norm(b) + F.lit(D.EPSILON)))


def negative_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return -F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def pair_similarity(a: Column, b: Column, kind: str = "cosine") -> Column:
    if kind == "cosine":
        return cosine(a, b)
    if kind == "euclidean":
        return negative_distance(a, b)
    raise ValueError(f"unknown similarity {kind!r}: use 'cosine' or 'euclidean'")


def pack_sign_bits(vec: Column) -> Column:
    """Bit i of chunk c is set when element ``32 * c + i`` is positive."""
    positive = F.transform(vec, lambda x, i: F.struct((x > 0).alias("on"), i.alias("i")))

    def one_chunk(c: Column) -> Column:
        part = F.slice(positive, c * BITS_PER_CHUNK + 1, BITS_PER_CHUNK)
        return F.aggregate(
            part,
            F.lit(0).cast("bigint"),
            lambda acc, p: acc
            + F.when(
                p["on"],
                F.call_function(
                    "shiftleft", F.lit(1).cast("bigint"), (p["i"] - c * BITS_PER_CHUNK).cast("int")
                ),
            ).otherwise(F.lit(0).cast("bigint")),
        )

    last = F.ceil(F.size(vec) / BITS_PER_CHUNK).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), one_chunk)


def hamming_similarity(a: Column, b: Column, dim: Column | int) -> Column:
    """Number of equal sign bits among ``dim``."""
    size = dim if isinstance(dim, Column) else F.lit(dim)
    differing = F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0),
        lambda acc, x: acc + x,
    )
    return size - differing


def quantize_with_scale(vec: Column, scale: Column, steps: int) -> Column:
    """``round(x / scale * steps)`` half-even, clamped to ``[-steps, steps - 1]``."""
    flat = scale < D.EPSILON
    return F.transform(
        as_double(vec),
        lambda x: F.when(flat, F.lit(0).cast("tinyint")).otherwise(
            F.least(
                F.greatest(F.rint(x / scale * F.lit(float(steps))), F.lit(float(-steps))),
                F.lit(float(steps - 1)),
            ).cast("tinyint")
        ),
    )
