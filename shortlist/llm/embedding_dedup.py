"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes is learned on a bounded sample so that the signs of the
rotated components are balanced and close to the vectors. Several such codes of one vector
are cut into short substrings; each substring is the key of a table. Vectors of one group
that agree in a whole substring, and differ in few bits in all, are compared by the exact
cosine of the original vectors. Every pair that differs in fewer bits than there are tables
is found for sure, and of others the share that chance leaves apart in all tables is lost.

Codes are taken from the mean of the sample, as that parts vectors best, but vectors with a
large common part stand at wider angles from there than their cosine says. So what the
tables would lose is measured: held-out vectors are paired with vectors at exactly the least
cosine, and rotations are added until ``FOUND`` of these pairs meet in every tenth of the
vectors by distance from the mean. If ``MOST_CODES`` do not reach that, the codes are random
axes through the origin, where any pair at cosine 0.93 is expected to meet with 99.2 %,
whatever the data; they part vectors with a large common part less well and so compare more.
Substrings are longer where a group is larger, and then there are more of them.

Equal vectors of a group are one entry with a count, so copies are never paired. Near copies
are not paired either: entries within half the angle of the least cosine of a common centre
link with each other for sure and form a class, whose links are counts. Tables then match
classes; by the angle between two centres and the radii, all members link, or none do, or the
members of the smaller class are compared with the other centre, and only those that lie on
its border with single members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ann_forest import content_key, usable
from .batches import lists, materialize
from .components import connected_components

#: bits of a code (one rotation each), and codes of a vector at least
BITS, CODES = 60, 4
#: bits of a substring by the most vectors of a group, so that few strangers meet in a table
PART_BITS = ((1 << 14, 12), (1 << 17, 15), (None, 20))
#: codes of a vector at most if substrings have 12 bits, and the share of pairs at the least
#: cosine that must meet
MOST_CODES, FOUND = 24, 0.98
#: share of pairs at cosine 0.93 that differ in a bit of a random axis, and share of pairs
#: that random axes must find
DIFFER, FOUND_BY_CHANCE = 0.12, 0.992
#: entries that a class takes its centre from, at most; any centre gives right results
CENTRE_OF = 32
#: angles nearer to a bound than this are settled by the cosine itself
MARGIN = 1e-6
#: pairs that this is measured on, about
PAIRS = 8000
#: vectors that the rotations are learned on, at most, and the rounds of learning
SAMPLE, ROUNDS = 8192, 30
#: a pair is compared if at most this share of all bits differ (mean 0.12 at cosine 0.93), or
#: as many as differ in any of the measured pairs
MOST_DIFFERENT = 0.27
SEED = 20240917


class Rotations:
    """Projections whose signs are the codes of vectors of one length."""

    def __init__(
        self, sample: np.ndarray, dim: int, least: float = 0.93, part_bits: int = 12
    ) -> None:
        self.part_bits, self.in_code = part_bits, BITS // part_bits
        meet = (1 - DIFFER) ** part_bits
        self.most_codes = math.ceil(MOST_CODES * (1 - DIFFER) ** 12 / meet * 5 / self.in_code)
        self.rng = np.random.default_rng([SEED, dim])
        self.mean = np.zeros(dim)
        self.planes: list[np.ndarray] = []
        self.most_different = MOST_DIFFERENT
        if len(sample) < 2 * dim or not self._learn(sample, least):
            self.mean, self.most_different = np.zeros(dim), MOST_DIFFERENT
            tables = math.log(1 - FOUND_BY_CHANCE) / math.log(1 - meet)
            codes = max(CODES, math.ceil(tables / self.in_code))
            self.planes = [self.rng.standard_normal((dim, BITS)) for _ in range(codes)]

    @property
    def tables(self) -> int:
        return len(self.planes) * self.in_code

    @property
    def most(self) -> int:
        """Bits that the codes of a compared pair differ in, at most."""
        return int(self.most_different * len(self.planes) * BITS)

    def _learn(self, sample: np.ndarray, least: float) -> bool:
        """Learn rotations until pairs at cosine ``least`` are found; False if they are not."""
        held = np.arange(len(sample)) % 4 == 0
        taught = sample[~held]
        self.mean = taught.mean(axis=0)
        centred = taught - self.mean
        axes = np.linalg.svd(centred, full_matrices=False)[2][: min(BITS, sample.shape[1])].T
        reduced = centred @ axes
        one, two = self._pairs(sample[held], least)
        far = np.argsort(((one - self.mean) ** 2).sum(axis=1), kind="stable")
        met, differ = np.zeros(len(one), dtype=bool), np.zeros(len(one), dtype=np.int64)
        for n in range(1, self.most_codes + 1):
            plane = axes @ self._rotation(reduced, BITS)
            self.planes.append(plane)
            unlike = ((one - self.mean) @ plane > 0) != ((two - self.mean) @ plane > 0)
            cut = (~unlike).reshape(len(one), self.in_code, self.part_bits)
            met |= cut.all(axis=2).any(axis=1)
            differ += unlike.sum(axis=1)
            if n >= CODES and min(m.mean() for m in np.array_split(met[far], 10)) >= FOUND:
                self.most_different = max(MOST_DIFFERENT, differ.max() / (n * BITS))
                return True
        return False

    def _rotation(self, reduced: np.ndarray, bits: int) -> np.ndarray:
        wide = self.rng.standard_normal((reduced.shape[1], bits))
        if reduced.shape[1] != bits:
            return wide  # more bits than components
        rotation = np.linalg.qr(wide)[0]
        for _ in range(ROUNDS):  # nearest codes, then the rotation nearest to them
            codes = np.where(reduced @ rotation > 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(codes.T @ reduced)
            rotation = (left @ right).T
        return rotation

    def _pairs(self, held: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Held-out vectors and vectors at cosine ``least`` from them.

        Half lie in any direction from the first, half in that from one vector to another.
        """
        one = held[np.arange(max(PAIRS, len(held))) % len(held)]
        there = self.rng.standard_normal(one.shape)
        other = self.rng.integers(0, len(held), size=(2, len(one)))
        apart = held[other[0]] - held[other[1]]
        like = (self.rng.random(len(one)) < 0.5) & (apart != 0).any(axis=1)
        there[like] = apart[like]
        there -= (there * one).sum(axis=1, keepdims=True) * one
        norms = np.sqrt((there * there).sum(axis=1, keepdims=True))
        there = np.divide(there, norms, out=np.zeros_like(there), where=norms > 0)
        return one, least * one + np.sqrt(max(0.0, 1 - least * least)) * there

    def parts(self, vectors: np.ndarray) -> np.ndarray:
        """The substrings of the codes of each vector: vectors x tables."""
        weights = 1 << np.arange(self.part_bits - 1, -1, -1)
        centred = vectors - self.mean
        signs = np.concatenate([centred @ p > 0 for p in self.planes], axis=1)
        return (signs.reshape(len(vectors), self.tables, self.part_bits) * weights).sum(axis=2)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def part_bits(largest: int) -> int:
    """Bits of a substring where the largest group has ``largest`` vectors."""
    return next(bits for most, bits in PART_BITS if most is None or largest <= most)


def with_parts(
    entries: DataFrame, vector: str, least: float, bits: int = 12
) -> tuple[DataFrame, dict[int, int], int]:
    """Add ``_parts``, the substrings of ``bits`` bits of the codes, and drop the vector.

    Also returns the most bits that codes of a pair may differ in, by the length of the
    vectors, and for the lengths that are not listed, whose codes are random. Learns
    from the ``SAMPLE`` entries with the lowest hash; vectors of another length than the
    sample's get codes from random axes.
    """
    order = entries.select(vector, F.col("_h2")).orderBy("_h2", "_h1").limit(SAMPLE)
    picked = [np.array(r[0], dtype=np.float64) for r in order.collect()]
    dims = [len(v) for v in picked]
    dim = max(set(dims), key=lambda d: (dims.count(d), d)) if dims else 0
    sample = [v for v in picked if len(v) == dim]
    learned = Rotations(_unit(np.stack(sample)), dim, least, bits) if sample else None
    kept = [f for f in entries.schema.fields if f.name != vector]
    names = [*[f.name for f in kept], "_parts"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept],
                        "_parts array<int>"])

    known = {dim: learned} if learned is not None else {}

    def rotations(length: int) -> Rotations:
        if length not in known:
            known[length] = Rotations(np.zeros((0, length)), length, least, bits)
        return known[length]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column(vector).value_lengths()).astype(np.int64)
            flat = np.asarray(batch.column(vector).flatten()).astype(np.float64)
            ends = np.cumsum(lengths)
            present = np.unique(lengths).tolist()
            tables = np.zeros(batch.num_rows, dtype=np.int64)
            for length in present:
                tables[lengths == length] = rotations(length).tables
            starts = np.cumsum(tables) - tables
            parts = np.zeros(int(tables.sum()), dtype=np.int32)
            for length in present:
                rows = np.flatnonzero(lengths == length)
                at = (ends[rows] - length)[:, None] + np.arange(length)
                to = starts[rows][:, None] + np.arange(rotations(length).tables)
                parts[to] = rotations(length).parts(_unit(flat[at]))
            column = lists(parts, tables, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in kept], column], names
            )

    most = {length: r.most for length, r in known.items()}
    by_chance = Rotations(np.zeros((0, 1)), 1, least, bits).most
    return entries.mapInArrow(run, schema), most, by_chance


def _bits(a: Column, b: Column) -> Column:
    differences = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(differences, F.lit(0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, exactly the ratio of the sums."""
    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def angle(a: Column, b: Column) -> Column:
    """The angle between two vectors."""
    return F.acos(F.least(F.greatest(cosine(a, b), F.lit(-1.0)), F.lit(1.0)))


def _mean(vectors: Column) -> Column:
    """The sum of the vectors at length one, which points to their middle."""
    def unit(v: Column) -> Column:
        squares = F.transform(v, lambda x: x.cast("double") * x.cast("double"))
        length = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda t, x: t + x))
        scaled = F.transform(F.array(length), lambda n: F.transform(v, lambda x: x / n))
        return F.get(scaled, F.lit(0))

    units = F.transform(vectors, unit)
    rest = F.slice(units, F.lit(2), F.size(units))
    return F.aggregate(
        rest, F.get(units, F.lit(0)), lambda t, v: F.zip_with(t, v, lambda x, y: x + y)
    )


def near_classes(entries: DataFrame, coded: DataFrame, least: float) -> DataFrame:
    """``(_entry, _class)``: entries that link with all others of their class for sure.

    Entries that agree in two successive substrings meet the least entry of that bucket, one row
    each, and follow the least of these that is near. The centre of those that follow one entry
    is the mean of ``CENTRE_OF`` of them; who is within half the angle of ``least`` of it is
    in the class, which is named by its least member. Entries alone are not listed. Also gives
    the ``_angle`` to the centre, and the centre.
    """
    half = math.acos(least) / 2 - MARGIN
    at = F.sequence(F.lit(0), (F.size("_parts") / 2).cast("int") - 1)
    two = F.transform(at, lambda i: F.struct(
        i.alias("i"), F.get("_parts", 2 * i).alias("p"), F.get("_parts", 2 * i + 1).alias("q")
    ))
    keys = coded.select("_entry", "_group", "_dim", F.explode(two).alias("_key"))
    bucket = ["_group", "_dim", "_key"]
    firsts = keys.groupBy(*bucket).agg(F.min("_entry").alias("_first"), F.count("*").alias("_n"))
    met = (
        keys.join(firsts.filter("_n > 1").drop("_n"), bucket)
        .filter("_first < _entry")
        .select("_entry", "_first")
        .distinct()
    )
    vectors = entries.select("_entry", "_vec")
    near = (
        met.join(vectors, "_entry")
        .join(vectors.toDF("_first", "_there"), "_first")
        .filter(cosine(F.col("_vec"), F.col("_there")) >= math.cos(1.5 * half))
        .select("_entry", "_first")
    )
    near = materialize(near, "dedup-near")
    followed = near.union(near.select("_first", "_first")).groupBy("_entry")
    follows = followed.agg(F.min("_first").alias("_first")).join(vectors, "_entry")
    follows = materialize(follows, "dedup-followed")
    # one member by each remainder, so that a large class is no group of one task
    dealt = F.pmod(F.xxhash64("_entry"), F.lit(CENTRE_OF)).alias("_deal")
    centres = (
        follows.groupBy("_first", dealt)
        .agg(F.min(F.struct("_entry", "_vec")).alias("_one"))
        .groupBy("_first")
        .agg(_mean(F.transform(F.array_sort(F.collect_list("_one")), lambda m: m["_vec"])).alias(
            "_centre"
        ))
    )
    inside = (
        follows.join(centres, "_first")
        .withColumn("_angle", angle(F.col("_vec"), F.col("_centre")))
        .filter(F.col("_angle") <= half)
        .select("_entry", "_first", "_angle")
    )
    inside = materialize(inside, "dedup-inside")
    named = inside.groupBy("_first").agg(
        F.min("_entry").alias("_class"), F.count("*").alias("_members")
    )
    named = named.filter("_members > 1").join(centres, "_first")
    return inside.join(named, "_first").select("_entry", "_class", "_angle", "_centre")


def candidate_pairs(
    coded: DataFrame, group: str, most: dict[int, int], by_chance: int
) -> DataFrame:
    """Pairs of classes (``a`` < ``b``) of one group that have members meeting in a table.

    ``coded`` holds ``_class`` and ``_many`` (the class has several members). A class is in a
    bucket once, however many members are. Each pair comes once; two classes of one member each
    are taken in the first table they meet in, if few enough bits differ. The join on group,
    length and substring is a plain one that adaptive execution splits where a key is hot;
    nothing is gathered.
    """
    rows = coded.select("_class", "_many", group, "_dim", "_parts", F.posexplode("_parts"))
    ones = rows.filter("not _many")
    parts = F.lit(None).cast("array<int>")
    many = rows.filter("_many").withColumn("_parts", parts)
    rows = ones.union(many.distinct())
    left = rows.toDF("a", "_ma", "_g", "_d", "_pa", "_t", "_s")
    right = rows.toDF("b", "_mb", "_g", "_d", "_pb", "_t", "_s")
    equal = F.array_position(F.zip_with("_pa", "_pb", lambda x, y: (x == y)), True) - 1
    bound = F.lit(by_chance)
    for length, bits in most.items():
        bound = F.when(F.col("_d") == length, bits).otherwise(bound)
    several = F.col("_ma") | F.col("_mb")
    few = (equal == F.col("_t")) & (_bits(F.col("_pa"), F.col("_pb")) <= bound)
    met = (
        left.join(right, ["_g", "_d", "_t", "_s"])
        .filter(F.col("a") < F.col("b"))
        .filter(several | few)
        .select("a", "b", several.alias("_several"))
    )
    met = materialize(met, "dedup-met")
    repeated = met.filter("_several").distinct()
    return met.filter("not _several").union(repeated).select("a", "b")


def _by_radius(apart: Column, radius: Column, least: float) -> Column:
    """Whether all within ``radius`` of a point at angle ``apart`` link; null if some may."""
    bound = math.acos(least)
    return (
        F.when(apart + radius <= bound - MARGIN, F.lit(True))
        .when(apart - radius > bound + MARGIN, F.lit(False))
        .otherwise(F.lit(None).cast("boolean"))
    )


def links_of(entries: DataFrame, classes: DataFrame, pairs: DataFrame,
             least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What links the classes that ``pairs`` lists: links by class, by entry, and edges.

    ``(_class, _n)`` and ``(_entry, _n)`` are numbers of links for every member of a class, or
    of an entry, and ``(a, b)`` edges that connect what links.
    ``entries`` holds ``_entry``, ``_class``, ``_vec`` and ``_copies``.
    """
    sides = classes.select("_class", "_centre", "_radius", "_size", "_members")
    both = pairs.join(sides.toDF("a", "_ca", "_ra", "_na", "_ka"), "a").join(
        sides.toDF("b", "_cb", "_rb", "_nb", "_kb"), "b"
    )
    alone = (F.col("_ka") == 1) & (F.col("_kb") == 1)
    near = cosine(F.col("_ca"), F.col("_cb"))
    ruled = _by_radius(angle(F.col("_ca"), F.col("_cb")), F.col("_ra") + F.col("_rb"), least)
    verdict = F.when(alone, near >= least).otherwise(ruled)
    swap = F.col("_ka") > F.col("_kb")  # the members of the smaller class go to the other one
    judged = both.withColumn("_links", verdict).filter(F.coalesce("_links", F.lit(True)))
    judged = materialize(
        judged.select(
            "_links",
            F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"),
            F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"),
            F.when(swap, F.col("_nb")).otherwise(F.col("_na")).alias("_na"),
            F.when(swap, F.col("_na")).otherwise(F.col("_nb")).alias("_nb"),
        ),
        "dedup-judged",
    )
    whole = judged.filter("_links")
    own = entries.select("_entry", "_class", "_vec", "_copies")
    border = (
        judged.filter("_links is null")
        .select("a", "b")
        .join(own.toDF("x", "a", "_vx", "_nx"), "a")
        .join(sides.toDF("b", "_cb", "_rb", "_nb", "_kb"), "b")
        .withColumn("_links", _by_radius(angle(F.col("_vx"), F.col("_cb")), F.col("_rb"), least))
        .filter(F.coalesce("_links", F.lit(True)))
        .select("x", "_nx", "b", "_nb", "_links")
    )
    border = materialize(border, "dedup-border")
    reached = border.filter("_links")
    single = (
        border.filter("_links is null")
        .select("x", "_nx", "b")
        .join(own.select("_entry", "_vec").toDF("x", "_vx"), "x")
        .join(own.toDF("y", "b", "_vy", "_ny"), "b")
        .filter(cosine(F.col("_vx"), F.col("_vy")) >= least)
        .select("x", "_nx", "y", "_ny")
    )
    single = materialize(single, "dedup-single")
    by_class = (
        whole.select("a", "_nb").union(whole.select("b", "_na")).union(reached.select("b", "_nx"))
    )
    by_entry = (
        reached.select("x", "_nb").union(single.select("x", "_ny")).union(single.select("y", "_nx"))
    )
    edges = whole.select("a", "b").union(reached.select("x", "b")).union(single.select("x", "y"))
    return by_class.toDF("_class", "_n"), by_entry.toDF("_entry", "_n"), edges.toDF("a", "b")


def near_duplicates(df: DataFrame, key: str, vector: str, group: str,
                    least: float = 0.93) -> DataFrame:
    """One row per row of ``df``: key, ``n_links``, ``component_id``, ``kept``.

    Two rows link if their groups are equal and not null and the cosine of their vectors is at
    least ``least``. Vectors that are null, empty, zero, of unlike lengths, or hold a null or a
    component that is not finite link with nothing; neither do rows with a null key, whose
    component is null and which are not kept. Rows that repeat a key count as vectors of
    their own. Other columns are dropped.
    """
    rows = df.select(
        F.col(key).cast("long").alias("_id"), F.col(group).alias("_group"),
        F.col(vector).alias("_vec"),
    )
    able = F.col("_id").isNotNull() & F.col("_group").isNotNull() & usable(F.col("_vec"))
    rows = rows.withColumn("_able", able).select("*", *content_key("_group", "_vec"))
    entries = (
        rows.filter("_able")
        .groupBy("_h1", "_h2")
        .agg(
            F.min("_id").alias("_least"), F.count("*").alias("_copies"),
            F.first("_group").alias("_group"), F.first("_vec").alias("_vec"),
        )
        .withColumn("_dim", F.size("_vec"))
        .withColumn("_entry", F.struct("_least", "_h1"))
    )
    entries = materialize(entries, "dedup-entries")
    wanted = entries.select("_h1", "_h2", "_entry", "_group", "_dim", "_vec")
    sizes = wanted.groupBy("_group", "_dim").agg(F.count("*").alias("_n"))
    largest = sizes.agg(F.coalesce(F.max("_n"), F.lit(0)).alias("n")).collect()[0]["n"]
    coded, most, by_chance = with_parts(wanted, "_vec", least, part_bits(largest))
    coded = materialize(coded, "dedup-codes")
    near = materialize(near_classes(entries, coded, least), "dedup-members")
    members = near.select("_entry", "_class", "_angle")
    entries = materialize(
        entries.join(members, "_entry", "left")
        .withColumn("_many", F.col("_class").isNotNull())
        .withColumn("_class", F.coalesce("_class", "_entry")),
        "dedup-classed",
    )
    measured = entries.filter("_many").groupBy("_class").agg(
        F.max("_angle").alias("_radius"), F.sum("_copies").alias("_size"),
        F.count("*").alias("_members"),
    )
    centres = near.filter("_entry = _class").select("_class", "_centre")
    ones = entries.filter("not _many").select(
        "_class", F.lit(0.0).alias("_radius"), F.col("_copies").alias("_size"),
        F.lit(1).cast("long").alias("_members"),
        F.transform("_vec", lambda x: x.cast("double")).alias("_centre"),
    )
    classes = materialize(
        measured.join(centres, "_class").unionByName(ones), "dedup-classes"
    )
    coded = coded.join(entries.select("_entry", "_class", "_many"), "_entry")
    pairs = candidate_pairs(coded, "_group", most, by_chance)
    by_class, by_entry, edges = links_of(entries, classes, pairs, least)
    edges = edges.union(entries.filter("_many").select("_entry", "_class"))
    components = connected_components(
        edges.select(F.col("a._least").alias("a"), F.col("b._least").alias("b")), "a", "b"
    )
    of_class = by_class.groupBy("_class").agg(F.sum("_n").alias("_others"))
    of_entry = by_entry.groupBy("_entry").agg(F.sum("_n").alias("_more"))
    none = F.lit(0)
    found = (
        entries.select("_h1", "_h2", "_entry", "_least", "_class")
        .join(classes.select("_class", "_size"), "_class")
        .join(of_class, "_class", "left")
        .join(of_entry, "_entry", "left")
        .join(components, F.col("_least") == F.col("vertex"), "left")
        .select(
            "_h1", "_h2",
            (F.col("_size") - 1 + F.coalesce("_others", none) + F.coalesce("_more", none)).alias(
                "n_links"
            ),
            F.coalesce("component", "_least").alias("component_id"),
            F.lit(True).alias("_found"),
        )
    )
    joined = rows.select("_id", "_h1", "_h2", "_able").join(
        found, ["_h1", "_h2"], "left"
    )
    linked = F.col("_able") & F.col("_found").isNotNull()
    component = F.when(linked, F.col("component_id")).otherwise(F.col("_id"))
    return joined.select(
        F.col("_id").alias(key),
        F.when(linked, F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"),
    )
