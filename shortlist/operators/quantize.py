"""Vector precision conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors

#: steps on each side of zero
INTEGER_STEPS = {"int4": 8, "int8": 128}
PRECISIONS = ("float32", "bool", *INTEGER_STEPS)


def value_scale(df: DataFrame, vec: str = "vec") -> DataFrame:
    """One row: four population standard deviations of all absolute values."""
    magnitudes = F.transform(vectors.as_double(F.col(vec)), F.abs)
    # each vector is reduced in its row to the sums that the deviation needs
    rows = df.select(
        F.aggregate(
            magnitudes,
            F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
            lambda a, x: F.struct(
                (a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")
            ),
        ).alias("m")
    )
    n, mean = F.sum("m.n"), F.sum("m.s") / F.sum("m.n")
    variance = F.greatest(F.sum("m.q") / n - mean * mean, F.lit(0.0))
    return rows.agg((F.lit(4.0) * F.sqrt(variance)).alias("scale"))


def row_scale(vec: Column) -> Column:
    """The same scale over the values of one vector."""
    magnitudes = F.transform(vectors.as_double(vec), F.abs)

    def mean(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / F.size(vec)

    def deviation(center: Column) -> Column:
        return F.sqrt(mean(F.transform(magnitudes, lambda x: (x - center) * (x - center))))

    return F.lit(4.0) * vectors.let(mean(magnitudes), deviation)


def quantize(
    df: DataFrame,
    precision: str = "float32",
    vec: str = "vec",
    out: str | None = None,
    per_row: bool = False,
) -> DataFrame:
    """Convert column ``vec`` to ``precision``.

    ``bool`` packs sign bits; ``int4`` and ``int8`` share one scale over the whole table
    (documents), or take one per vector with ``per_row`` (queries); ``float32`` is kept.
    """
    if precision not in PRECISIONS:
        raise ValueError(f"unknown precision {precision!r}")
    target = out or vec
    if precision == "float32":
        return df if target == vec else df.withColumn(target, F.col(vec))
    if precision == "bool":
        return df.withColumn(target, vectors.pack_sign_bits(F.col(vec)))
    scale = row_scale(F.col(vec)) if per_row else value_scale(df, vec).scalar()
    steps = INTEGER_STEPS[precision]
    scaled = df.withColumn("_scale", scale)
    return scaled.withColumn(
        target, vectors.quantize_with_scale(F.col(vec), F.col("_scale"), steps)
    ).drop("_scale")
