"""Similarity self-join of texts by the Jaccard index of their word n-grams.

The global order of n-grams puts those that many sets hold last (a bounded list, the rarest of
them first) and is that of their hashes otherwise. Vertical partitioning cuts it, and the work
on a pair is shared out over the pieces:

* Candidates. Sets of size n whose index is at least t share at least ``t n`` n-grams, so two
  linked sets meet in one of their first ``n - ceil(t n) + 1``, whatever the order. These
  prefixes are all that is shuffled; as common n-grams come last, a passage that many documents
  share is in the prefix of only those that hardly hold anything else.
* Bound. Each set has about a bit per n-gram that tells if an odd number of n-grams falls on
  it. Two sets differ in at least as many n-grams as these bits; pairs that differ too much go.
* Overlap. What is left is counted exactly: the hash range is cut into fragments, whose
  overlaps are counted apart and summed per pair.

Which n-grams are common is counted over the prefixes of all sets, as no others make candidates:
first in hash order, then those that change once the common ones found so far are last. No order
loses a pair. Equal sets are one entry from the
start. In a bucket of equal prefix n-grams every entry is first compared with one pivot, so a
group of near copies costs a few comparisons each and not all pairs; only entries that this
leaves in different components are compared further.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import in_arrow, lists, materialize, sized
from .components import connected_components

WORDS, PERCENT = 3, 90
#: fragments in which the overlap of a pair is counted
COUNT_FRAGMENTS = 8
#: words of 64 bits in the parities that pairs are formed with, and in the longest ones
PARITY_WORDS, MOST_WORDS = 4, 1024
#: an n-gram in the prefixes of at least so many sets is common; the list goes to every task, so
#: the longest is bounded; prefixes are counted again once common ones are last, so often at most
COMMON, MOST_COMMON, ROUNDS = 64, 500_000, 3
#: ids or hashes copied to the executors instead of shuffling what they choose from, at most
#: (16 bytes each)
COPIED_IDS = 2_000_000
TEXT_BYTES = 400_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: an odd factor of the polynomial word hash, and its inverse modulo 2**64
_FACTOR = 0x5851F42D4C957F2D
_INVERSE = pow(_FACTOR, -1, 1 << 64)


PARITY = tuple(f"_p{i}" for i in range(PARITY_WORDS))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_FACTOR, _INVERSE):
        powers = np.full(size, base, dtype=np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def shingle_hashes(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; empty for one without words.

    Works on the bytes of the whole column: A-Z are lower-cased, a word is a run of bytes
    other than ASCII white space, its hash a polynomial in its bytes.
    """
    text = column.cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)
    offsets = offsets[text.offset : text.offset + len(text) + 1]
    if len(text) == 0:
        return
    buffer = text.buffers()[2]
    data = (
        np.frombuffer(buffer, dtype=np.uint8)[offsets[0] : offsets[-1]]
        if buffer is not None
        else np.zeros(0, dtype=np.uint8)
    )
    offsets = offsets - offsets[0]
    inside = ~_SPACE[data]
    edges = np.zeros(len(data) + 1, dtype=bool)
    edges[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edges[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edges[1:-1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    size = 1 << max(12, int(len(data) + 1).bit_length())
    powers, inverses = _powers(size)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[data] + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    word = _mix((sums[end] - sums[begin]) * inverses[begin] + (end - begin).astype(np.uint64))
    # n-grams that start at each word; those that reach into the next text are not used
    gram = np.zeros(len(word), dtype=np.uint64)
    for k in range(min(words, len(word))):
        gram[: len(word) - k] = gram[: len(word) - k] * _GOLDEN + word[k:]
    gram = _mix(gram)
    first = np.searchsorted(begin, offsets)
    for b, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if e - b >= words:
            yield np.unique(gram[b : e - words + 1])
        elif e > b:  # a short text is one n-gram as a whole
            whole = np.uint64(e - b)
            for w in word[b:e]:
                whole = np.uint64((int(whole) * int(_GOLDEN) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            yield _mix(np.array([whole], dtype=np.uint64))
        else:
            yield gram[:0]


class Order:
    """The global order: n-grams of a list last, by how common they are; others by hash."""

    def __init__(self, common: np.ndarray, counts: np.ndarray) -> None:
        place = np.argsort(common, kind="stable")
        self.common, self.counts = common[place], counts[place]
        self.rank = np.empty(len(common), dtype=np.int64)
        self.rank[np.argsort(counts[place], kind="stable")] = np.arange(1, len(common) + 1)

    def ranks(self, grams: np.ndarray) -> np.ndarray:
        """0 for n-grams that are not common, from 1 for those that are."""
        if not len(self.common):
            return np.zeros(len(grams), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.common, grams), len(self.common) - 1)
        return np.where(self.common[at] == grams, self.rank[at], 0)

    def prefix(self, grams: np.ndarray, percent: int) -> np.ndarray:
        """The first n-grams of a sorted set, as many as a linked set must meet one of."""
        need = len(grams) + 1 - -(-len(grams) * percent // 100) if len(grams) else 0
        ranks = self.ranks(grams)
        rare = grams[ranks == 0]
        if len(rare) >= need:
            return rare[:need]
        rest = np.flatnonzero(ranks)
        rest = rest[np.argsort(ranks[rest], kind="stable")]
        return np.concatenate([rare, grams[rest[: need - len(rare)]]])


def prefix_grams(df: DataFrame, words: int, percent: int, order: Order,
                 before: Order | None) -> DataFrame:
    """One row per n-gram in the prefix of every row whose prefix is not that of ``before``: ``_gram``."""

    def new(grams: np.ndarray) -> np.ndarray:
        found = order.prefix(grams, percent)
        same = before is not None and np.array_equal(found, before.prefix(grams, percent))
        return found[:0] if same else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, "_text", TEXT_BYTES):
            sets = shingle_hashes(batch.column("_text"), words)
            found = np.concatenate([new(grams) for grams in sets])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["_gram"])

    return in_arrow(df.select("_text"), "_gram long", run)


def common_order(df: DataFrame, words: int, percent: int = 0) -> Order:
    """The order of the n-grams of ``df``, whose rows are different sets (``_text``).

    All sets are counted: what is in their prefixes at ``percent``, or with 0 all of them. Once
    common n-grams are last, others take their places; the prefixes that this changes are counted
    in the next round.
    """
    before, order = None, Order(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    for _ in range(ROUNDS):
        counts = materialize(
            prefix_grams(df, words, percent, order, before)
            .groupBy("_gram")
            .agg(F.count("*").alias("_n"))
            .filter(F.col("_n") >= COMMON),
            "join-common",
        )
        # the least count of which so many n-grams remain that the list keeps its bound
        least, total = COMMON, len(order.common)
        for row in counts.groupBy("_n").agg(F.count("*").alias("c")).orderBy(F.desc("_n")).collect():
            total += row["c"]
            if total > MOST_COMMON:
                least = row["_n"] + 1
                break
        found = counts.filter(F.col("_n") >= least).orderBy("_gram").toArrow()
        grams = np.asarray(found.column("_gram").combine_chunks()).astype(np.int64).view(np.uint64)
        times = np.asarray(found.column("_n").combine_chunks()).astype(np.int64)
        new = ~np.isin(grams, order.common)
        if not new.any():
            break
        before, order = order, Order(
            np.concatenate([order.common, grams[new]]), np.concatenate([order.counts, times[new]])
        )
        if percent == 0:
            break
    return order


def profiles(df: DataFrame, words: int) -> DataFrame:
    """Per row: ``_key``, set size ``_n``, and content hashes ``_h1`` and ``_h2``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, "_text", TEXT_BYTES):
            sizes, digests = [], []
            for grams in shingle_hashes(batch.column("_text"), words):
                sizes.append(len(grams))
                digests.append(_digest(grams))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key"),
                    pa.array(np.array(sizes, dtype=np.int64)),
                    _halves(digests, 64),
                    _halves(digests, 0),
                ],
                ["_key", "_n", "_h1", "_h2"],
            )

    return in_arrow(df.select("_key", "_text"), "_key long, _n long, _h1 long, _h2 long", run)


def _digest(grams: np.ndarray) -> int:
    return xxhash.xxh3_128_intdigest(grams.tobytes())


def _halves(digests: list[int], shift: int) -> pa.Array:
    mask = 0xFFFFFFFFFFFFFFFF
    return pa.array(np.array([(d >> shift) & mask for d in digests], dtype=np.uint64).view(np.int64))


def _parity(grams: np.ndarray) -> np.ndarray:
    """Words of bits that tell if an odd number of n-grams falls on them, a bit per n-gram or so.

    Two sets differ in at least as many n-grams as their bits do. There are a power of two of
    words, so a longer list can be folded to half its length.
    """
    words = min(max(PARITY_WORDS, 1 << int(len(grams) // 64).bit_length()), MOST_WORDS)
    place = (grams & np.uint64(64 * words - 1)).astype(np.int64)
    odd = (np.bincount(place, minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _folded(parity: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(parity.reshape(-1, words), axis=0)


def prefixes(df: DataFrame, words: int, percent: int, order: Order) -> DataFrame:
    """Per row: ``_rep``, ``_h1``, size, parities (short, half and whole) and the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, "_text", TEXT_BYTES):
            digests, firsts, whole = [], [], []
            for grams in shingle_hashes(batch.column("_text"), words):
                digests.append((len(grams), _digest(grams)))
                firsts.append(order.prefix(grams, percent))
                whole.append(_parity(grams))
            short = np.array([_folded(p, PARITY_WORDS) for p in whole])
            half = [_folded(p, len(p) // 2) for p in whole]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key"),
                    _halves([d for _, d in digests], 64),
                    pa.array(np.array([n for n, _ in digests], dtype=np.int64)),
                    *[pa.array(short[:, i]) for i in range(PARITY_WORDS)],
                    _long_lists(half),
                    _long_lists(whole),
                    _long_lists(firsts),
                ],
                ["_rep", "_h1", "_n", *PARITY, "_half", "_whole", "_prefix"],
            )

    return in_arrow(
        df.select("_key", "_text"),
        f"_rep long, _h1 long, _n long, {', '.join(f'{p} long' for p in PARITY)}, "
        "_half array<long>, _whole array<long>, _prefix array<long>",
        run,
    )


def _long_lists(parts: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(parts).view(np.int64)
    return lists(flat, np.array([len(p) for p in parts]), pa.int64())


def _unlike(a: Column, b: Column) -> Column:
    """Bits in which two lists of words of one length differ."""
    each = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _coarse(grams: np.ndarray, fragments: int) -> np.ndarray:
    """Where the fragments of an even cut of the hash range begin and end in a sorted set."""
    bounds = np.arange(1, fragments, dtype=np.uint64) * np.uint64((1 << 64) // fragments)
    return np.concatenate([[0], np.searchsorted(grams, bounds), [len(grams)]])


def _segments(df: DataFrame, words: int) -> DataFrame:
    """The sets cut into coarse fragments: ``_key``, ``_h1``, ``_f``, ``_grams``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, "_text", TEXT_BYTES):
            keys, first, sizes, parts = [], [], [], []
            for k, grams in zip(batch.column("_key").to_pylist(),
                                shingle_hashes(batch.column("_text"), words), strict=True):
                keys.append(k)
                first.append(_digest(grams) >> 64)
                sizes.append(np.diff(_coarse(grams, COUNT_FRAGMENTS)))
                parts.append(grams)
            repeat = COUNT_FRAGMENTS
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array(keys, dtype=np.int64), repeat)),
                    pa.array(np.repeat(np.array(first, dtype=np.uint64).view(np.int64), repeat)),
                    pa.array(np.tile(np.arange(repeat, dtype=np.int32), len(keys))),
                    lists(
                        np.concatenate(parts).view(np.int64), np.concatenate(sizes), pa.int64()
                    ),
                ],
                ["_key", "_h1", "_f", "_grams"],
            )

    return in_arrow(
        df.select("_key", "_text"), "_key long, _h1 long, _f int, _grams array<long>", run
    )


def _reaches(overlap: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * overlap >= percent * (a + b - overlap)


def _near(a: Column, b: Column, percent: int) -> Column:
    """Sets of these sizes can reach the threshold."""
    return (100 * a >= percent * b) & (100 * b >= percent * a)


def _may_differ(least: Column, a: Column, b: Column, percent: int) -> Column:
    """Sets that differ in ``least`` n-grams or more can reach the threshold."""
    return least * (100 + percent) <= (100 - percent) * (a + b)


def _once(df: DataFrame, repeated: DataFrame, make: Callable[[DataFrame], DataFrame],
          names: list[str]) -> DataFrame:
    """``make(df)`` without duplicates in ``names``, which only rows of ``repeated`` keys have."""
    if repeated.isEmpty():
        return make(df)
    keys, same = _copied(repeated), F.col("_key") == F.col("_again")
    single, several = df.join(keys, same, "left_anti"), df.join(keys, same, "left_semi")
    return make(single).unionByName(make(several).dropDuplicates(names))


def _linked(pairs: DataFrame, entries: DataFrame, df: DataFrame, repeated: DataFrame, words: int,
            percent: int) -> DataFrame:
    """Of pairs of keys (``a``, ``b``), those whose sets reach the threshold."""
    facts = entries.select("_rep", "_h1", "_n", "_half", "_whole")
    left = facts.toDF("a", "_ha", "_na", "_a2", "_a1")
    right = facts.toDF("b", "_hb", "_nb", "_b2", "_b1")
    both = pairs.join(left, "a").join(right, "b").filter(
        _near(F.col("_na"), F.col("_nb"), percent)
    )
    # lists of one length; sets so different in size that there are none link only below 50 %
    wider, same = F.size("_a1") - F.size("_b1"), F.size("_a1") == F.size("_b1")
    unlike = (
        F.when(same, _unlike(F.col("_a1"), F.col("_b1")))
        .when((wider > 0) & (F.size("_a2") == F.size("_b1")), _unlike(F.col("_a2"), F.col("_b1")))
        .when((wider < 0) & (F.size("_a1") == F.size("_b2")), _unlike(F.col("_a1"), F.col("_b2")))
        .otherwise(F.lit(0))
    )
    possible = materialize(
        both.filter(_may_differ(unlike, F.col("_na"), F.col("_nb"), percent)).select(
            "a", "_ha", "_na", "b", "_hb", "_nb"
        ),
        "join-pairs",
    )
    wanted = materialize(
        possible.select(F.col("a").alias("_w")).union(possible.select("b")).distinct(),
        "join-wanted",
    )
    picked = df.join(_copied(wanted), F.col("_key") == F.col("_w"), "left_semi")
    segments = materialize(
        _once(picked, repeated, lambda rows: _segments(rows, words), ["_key", "_h1", "_f"]),
        "join-segments",
    )
    met = possible.join(segments.toDF("a", "_ha", "_f", "_ga"), ["a", "_ha"]).join(
        segments.toDF("b", "_hb", "_f", "_gb"), ["b", "_hb", "_f"]
    )
    shared = F.size(F.array_intersect("_ga", "_gb")).cast("long")
    overlaps = (
        met.select("a", "_ha", "b", "_hb", "_na", "_nb", shared.alias("_o"))
        .groupBy("a", "_ha", "b", "_hb", "_na", "_nb")
        .agg(F.sum("_o").alias("_overlap"))
    )
    return materialize(
        overlaps.filter(_reaches(F.col("_overlap"), F.col("_na"), F.col("_nb"), percent))
        .select("a", "b")
        .distinct(),
        "join-links",
    )


def join_groups(df: DataFrame, key: str, text: str, words: int = WORDS,
                percent: int = PERCENT) -> DataFrame:
    """One row per row of ``df``: the key, ``n_shingles`` and ``component_id``.

    Two texts link if 100 times the intersection of their n-gram sets is at least ``percent``
    times the union. ``component_id`` is the smallest key reachable by links, the row's own
    included. A text with fewer words than ``words`` has its whole sequence as one n-gram;
    null, empty and blank texts have an empty set and link with nothing. Whole texts are
    read. Rows with a null key link with nothing and have a null component; rows that
    repeat a key count as one vertex. Other columns are dropped.
    """
    df = df.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    found = materialize(profiles(df, words), "join-profiles")
    able = (F.col("_n") > 0) & F.col("_key").isNotNull()
    classes = materialize(
        found.filter(able).groupBy("_h1", "_h2").agg(F.min("_key").alias("_rep")), "join-classes"
    )
    # of equal sets one text is taken apart; the others, and texts without words, are not
    placed = found.join(classes, ["_h1", "_h2"], "left").filter(F.col("_key").isNotNull())
    keys = materialize(
        placed.groupBy("_key").agg(
            F.max(F.coalesce(F.col("_key") == F.col("_rep"), F.lit(False))).alias("_first"),
            F.coalesce(F.min("_rep") != F.max("_rep"), F.lit(False)).alias("_several"),
            F.count("*").alias("_rows"),
        ),
        "join-keys",
    )
    repeated = keys.filter("_rows > 1").select(F.col("_key").alias("_again"))
    idle = keys.filter("not _first").select(F.col("_key").alias("_idle"))
    # a key with several texts ties their sets together
    ties = placed.join(keys.filter("_several").select("_key"), "_key").select(
        F.col("_key").alias("a"), F.col("_rep").alias("b")
    )
    firsts = df.filter(F.col("_key").isNotNull())
    firsts = firsts.join(_copied(idle), F.col("_key") == F.col("_idle"), "left_anti")
    order = common_order(firsts, words, percent)
    entries = materialize(
        _once(
            firsts, repeated, lambda rows: prefixes(rows, words, percent, order), ["_rep", "_h1"]
        ).filter("_n > 0"),
        "join-entries",
    )
    members = _members(entries)
    first = members.filter("_rep != _pivot").select(
        F.col("_pivot").alias("a"), F.col("_rep").alias("b")
    )
    links = _linked(first.distinct(), entries, df, repeated, words, percent).union(
        ties.filter("b is not null")
    )
    settled = connected_components(links, "a", "b")
    apart = _apart(members, settled, entries, percent)
    links = links.union(_linked(apart, entries, df, repeated, words, percent))
    settled = materialize(connected_components(links, "a", "b"), "join-components")
    classes = classes.join(settled, F.col("_rep") == F.col("vertex"), "left").select(
        F.col("_h1").alias("_c1"), F.col("_h2").alias("_c2"),
        F.coalesce("component", "_rep").alias("_component"),
    )
    rows = found.select("_key", "_n", "_h1", "_h2")
    joined = rows.join(
        classes, able & (F.col("_h1") == F.col("_c1")) & (F.col("_h2") == F.col("_c2")), "left"
    )
    return joined.select(
        F.col("_key").alias(key),
        F.col("_n").alias("n_shingles"),
        F.coalesce("_component", "_key").alias("component_id"),
    )


def _copied(rows: DataFrame) -> DataFrame:
    """A stored table of ids, to be copied to the executors if it is short enough."""
    return F.broadcast(rows) if rows.count() <= COPIED_IDS else rows


def _members(entries: DataFrame) -> DataFrame:
    """``(_hash, _rep, _pivot)``: the entries whose prefixes meet in an n-gram, with the smallest.

    Most n-grams are in no other prefix; the smallest and largest entry of each are found
    where the prefixes are read before anything is shuffled.
    """
    hashes = entries.select("_rep", F.explode("_prefix").alias("_hash"))
    pivots = materialize(
        hashes.groupBy("_hash")
        .agg(F.min("_rep").alias("_pivot"), F.max("_rep").alias("_top"))
        .filter("_pivot != _top")
        .select("_hash", "_pivot"),
        "join-pivots",
    )
    # most of the prefixes' n-grams are dropped here; the list of those that stay grows with them
    return materialize(hashes.join(pivots.hint("merge"), "_hash"), "join-members")


def _apart(members: DataFrame, settled: DataFrame, entries: DataFrame,
           percent: int) -> DataFrame:
    """Pairs of a bucket that are in different components and were not compared yet.

    Every entry was compared with the pivot, so only buckets whose other entries are in
    different components are open. Entries look for partners in bands of sizes that can reach
    the threshold, and a pair whose parity bits differ too often is not formed.
    """
    group = settled.select(F.col("vertex").alias("_rep"), F.col("component").alias("_group"))
    pivot = settled.select(F.col("vertex").alias("_pivot"), F.col("component").alias("_pivots"))
    placed = (
        members.filter("_rep != _pivot")
        .join(group, "_rep", "left")
        .withColumn("_group", F.coalesce("_group", "_rep"))
    )
    open_buckets = materialize(
        placed.groupBy("_hash")
        .agg(F.min("_group").alias("_low"), F.max("_group").alias("_top"))
        .filter("_low != _top")
        .select("_hash"),
        "join-open-buckets",
    )
    band = F.floor(F.log(F.col("_n")) / (math.log(100 / percent) * 1.0001)).cast("int")
    facts = entries.select("_rep", "_n", band.alias("_band"), *PARITY)
    placed = materialize(
        placed.join(_copied(open_buckets), "_hash", "left_semi")
        .join(pivot, "_pivot", "left")
        .withColumn("_outside", F.col("_group") != F.coalesce("_pivots", "_pivot"))
        .select("_hash", "_rep", "_group", "_outside")
        .join(facts, "_rep"),
        "join-open",
    )
    nearby = F.explode(F.sequence(F.col("_band") - 1, F.col("_band") + 1))
    # of a pair in different components one at least is not in that of the pivot
    outside = placed.filter("_outside").select(
        "_hash", nearby.alias("_band"), F.col("_rep").alias("_x"), F.col("_group").alias("_gx"),
        F.col("_n").alias("_nx"), *[F.col(p).alias(f"{p}x") for p in PARITY],
    )
    near = _near(F.col("_n"), F.col("_nx"), percent)
    unlike = reduce(add, [F.bit_count(F.col(p).bitwiseXOR(F.col(f"{p}x"))) for p in PARITY])
    possible = _may_differ(unlike, F.col("_n"), F.col("_nx"), percent)
    return (
        outside.join(placed, ["_hash", "_band"])
        .filter((F.col("_gx") != F.col("_group")) & near & possible)
        .select(F.least("_x", "_rep").alias("a"), F.greatest("_x", "_rep").alias("b"))
        .distinct()
    )
