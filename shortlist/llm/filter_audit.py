"""How filters interact: what each removes in every order in which they may be applied.

Whether a row fails a filter does not depend on the order, so each row has a set of failed
filters, written as a number with one bit per filter. Rows are counted by that number, and
the counts answer all orders: a filter removes a row if it is the first of its failures.

Filters that look at one text are expressions. The last one, "identical to an earlier text",
is an existential self-join: texts whose hash occurs under two ids meet the texts of smaller ids
by hash, exact text and id in a left-semi join. The copies of a text are one row with the
smallest id on the right side of the join, aggregated where they are read, and the hashes
of large groups are cut into slices, so a third of all rows may be copies of one text.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import SLICE, spread_heavy
from .batches import materialize

#: what words are made of and what parts them
WORD_BREAKS = r"[\x20\x09-\x0D]+"
FEWEST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
SYMBOLS = "[#$%&*|]"
COPY = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of a text by letter; the text is not null.

    A: few words; B: repeated words; C: many capitals; D: symbols.
    """
    words = F.filter(F.split(text, WORD_BREAKS, -1), lambda w: w != "")
    distinct, every = F.size(F.array_distinct(words)), F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    return {
        "A": every < FEWEST_WORDS,
        "B": 100 * distinct < LEAST_DISTINCT * every,
        "C": 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }


def copies(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(_key, _hash)`` of the rows whose text is that of a row with a smaller key, distinct.

    ``rows`` has the key, the text and ``_hash`` of the text. Null keys are no copies and have
    none; rows that repeat a key are not copies of each other.
    """
    known = rows.filter(F.col(key).isNotNull())
    shared = materialize(
        known.groupBy("_hash")
        .agg(F.count("*").alias("df"), F.min(key).alias("_low"), F.max(key).alias("_top"))
        .filter("_low < _top")
        .select("_hash", "df"),
        "copy-hashes",
    )
    again = materialize(
        known.join(shared.select("_hash"), "_hash", "left_semi").select(
            F.col(key).alias("_key"), "_hash", F.col(text).alias("_text")
        ),
        "copy-texts",
    )
    first = again.groupBy("_hash", "_text").agg(F.min("_key").alias("_first"))
    first = first.select(F.col("_hash"), F.col("_text").alias("_same"), "_first")
    left, right = spread_heavy(again, first, "_hash", "_key", shared)
    right = right.withColumnsRenamed({"_hash": "_h", SLICE: "_s"})
    met = left.join(
        right,
        (F.col("_hash") == F.col("_h"))
        & (F.col(SLICE) == F.col("_s"))
        & (F.col("_text") == F.col("_same"))
        & (F.col("_first") < F.col("_key")),
        "left_semi",
    )
    return met.select("_key", "_hash").distinct()


def failures(df: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """``(_key, _hash, _part, mask, rows)``: the filters that rows fail, one bit per letter.

    The failing ids of every filter are put together by a union and an aggregation. ``rows``
    is the number of rows of that key, text and part.
    """
    texts = df.select(
        F.col(key).alias("_key"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("_part"),
    ).withColumn("_hash", F.xxhash64("_text"))
    found = text_filters(F.col("_text"))
    bits = sum(
        (F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(found.values())),
        start=F.lit(0),
    )
    one = texts.select("_key", "_hash", "_part", bits.alias("mask"), F.lit(1).alias("rows"))
    same = copies(texts, "_key", "_text").select(
        F.col("_key").alias("_k"), F.col("_hash").alias("_h")
    )
    # parts of the copies, so that a key repeated under another part keeps them apart
    parts = texts.select("_key", "_hash", "_part").join(
        same, (F.col("_key") == F.col("_k")) & (F.col("_hash") == F.col("_h")), "left_semi"
    )
    marked = parts.select(
        "_key", "_hash", "_part", F.lit(1 << len(found)).alias("mask"), F.lit(0).alias("rows")
    )
    return (
        one.unionByName(marked)
        .groupBy("_key", "_hash", "_part")
        .agg(F.bit_or("mask").alias("mask"), F.sum("rows").alias("rows"))
    )


def combinations(failed: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Rows of each part by the set of filters they fail: ``part``, ``mask``, three counts.

    ``good`` and ``toxic`` count rows whose key has a label ``quality`` or ``toxic`` of 1;
    a key that is labelled several times has the label if one of its rows does.
    """
    marks = labels.groupBy(F.col(key).alias("_l")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("_good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"),
    )
    met = failed.join(marks, F.col("_key") == F.col("_l"), "left")

    def total(*factors: Column | str) -> Column:
        value = F.col("rows")
        for factor in factors:
            value = value * F.coalesce(factor, F.lit(0))
        return F.sum(value).cast("long")

    return met.groupBy(F.col("_part").alias("part"), "mask").agg(
        total().alias("rows"), total("_good").alias("good"), total("_toxic").alias("toxic")
    )


def audit(df: DataFrame, labels: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """One row per part, order of the filters and step.

    Columns: ``part`` (null: empty string), ``filter_order``, ``step`` (from 1) and, of the
    part's rows: ``kept`` after the step, ``removed`` in it, ``redundant`` (fail its filter but
    were removed earlier), ``unique_fails`` (fail only its filter), ``good_lost`` and
    ``toxic_lost`` (removed in it and labelled so), ``shapley`` (removed by its filter, summed
    over all orders). Null texts are empty. Rows that repeat a key are counted each. Rows with
    a null key are no copies and have no label. A part without rows does not exist, so an
    empty table gives no rows. Other columns of either table are dropped.
    """
    keyed = labels.select(F.col(key), "quality", "toxic")
    counts = combinations(failures(df, key, text, part), keyed, key)
    letters = [*text_filters(F.lit("")), COPY]
    width = 1 << len(letters)

    def listed(name: str) -> Column:
        """The counts of a part by mask, zeros included."""
        held = F.map_from_entries(F.collect_list(F.struct("mask", name)))
        return held.alias(name)

    parts = counts.groupBy("part").agg(listed("rows"), listed("good"), listed("toxic"))
    # a map per part has 2**5 entries at most; a list of that length from here on
    dense = {
        n: F.array(*[F.coalesce(F.try_element_at(n, F.lit(m)), F.lit(0)) for m in range(width)])
        for n in ("rows", "good", "toxic")
    }
    parts = materialize(parts.withColumns(dense), "filter-combinations")
    steps = _steps(letters)
    each = parts.withColumn("_s", F.explode(F.array(*steps))).select(
        "part", "rows", "good", "toxic", "_s.*"
    )

    def summed(name: str, masks: Sequence[int], keep) -> Column:
        chosen = [F.when(keep(m), F.get(name, F.lit(m))).otherwise(F.lit(0)) for m in masks]
        return sum(chosen[1:], start=chosen[0]).cast("long")

    every = range(width)

    def meets(m: int, bits: str) -> Column:
        return F.col(bits).bitwiseAND(F.lit(m)) != 0

    def removed(name: str) -> Column:
        return summed(name, every, lambda m: meets(m, "bit") & ~meets(m, "before"))

    orders = math.factorial(len(letters))
    shares = F.array(*[F.lit(orders // max(m.bit_count(), 1)).cast("long") for m in every])
    weighted = F.zip_with("rows", shares, lambda a, b: a * b)
    return each.withColumn("_weighted", weighted).select(
        "part",
        "filter_order",
        "step",
        summed("rows", every, lambda m: ~meets(m, "bit") & ~meets(m, "before")).alias("kept"),
        removed("rows").alias("removed"),
        summed("rows", every, lambda m: meets(m, "bit") & meets(m, "before")).alias("redundant"),
        F.get("rows", F.col("bit")).cast("long").alias("unique_fails"),
        removed("good").alias("good_lost"),
        removed("toxic").alias("toxic_lost"),
        summed("_weighted", every, lambda m: meets(m, "bit")).alias("shapley"),
    )


def _steps(letters: Sequence[str]) -> list[Column]:
    """Every step of every order: its letter's bit and the bits of the letters before."""
    bit = {letter: 1 << i for i, letter in enumerate(letters)}
    out = []
    for order in itertools.permutations(sorted(letters)):
        before = 0
        for step, letter in enumerate(order, start=1):
            out.append(
                F.struct(
                    F.lit("".join(order)).alias("filter_order"),
                    F.lit(step).alias("step"),
                    F.lit(bit[letter]).alias("bit"),
                    F.lit(before).alias("before"),
                )
            )
            before |= bit[letter]
    return out
