"""Whitening of vectors on their principal components, by Golub-Kahan-Lanczos bidiagonalisation.

Entries are first made integers (``floor(SCALE * c) + SHIFT``), so counts, sums and deviations
are exact. Centred rows ``X`` are never formed as a whole: each step is one pass over the
stored rows in which every task multiplies its rows with a vector from the right (``p = X q``) and
the result with its rows from the left (``X' p``), and sums of one row of the small side travel.
Right vectors (as long as a row) stay on the driver. A left vector has an entry per row; as it is
``X c`` for a short ``c`` that the recurrence gives along, its entries are made again where the
rows are instead of being stored. Both sides are reorthogonalised in full against all earlier
vectors. The singular value decomposition of the small bidiagonal matrix yields components; a
further run, orthogonal to the ones found, shows whether any was missed (equal eigenvalues),
and a last projection on the span of all of them gives eigenvalues to double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import bound_batches, materialize

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: entries at least this large have no exact integer in a double; their rows are left out
LARGEST = float(1 << 42)
#: a component is found when its residual is this small against the largest deviation
CONVERGED = 1e-13
#: residual at which the run that looks for missed components may judge its largest one
SETTLED = 1e-5
#: a component whose eigenvalue is below this share of the largest one is rounding error
RANK = 1e-12
SEED = 20240917


@dataclass
class Whitening:
    """What the fit found: components are columns, eigenvalues fall."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    #: distributed passes over the rows that the bidiagonalisation took
    passes: int = 0


def integer_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """The usable rows as ``(_key, _x array<long>)``, stored in the shared folder.

    Null vectors, vectors with null, non-finite or huge (2**42) entries, and vectors of
    another length than the commonest (the shorter one of equally common ones) are left out.
    """
    value = F.transform(F.col(vector), lambda c: c.cast("double"))
    rows = df.select(F.col(key).alias("_key"), value.alias("_v"))
    fine = F.forall("_v", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))
    entry = F.transform("_v", lambda c: F.floor(c * SCALE) + SHIFT)
    whole = materialize(rows.filter(fine).select("_key", entry.alias("_x")), "whitening")
    sizes = whole.groupBy(F.size("_x").alias("d")).count()
    common = sizes.orderBy(F.desc("count"), "d").first()
    return whole.filter(F.size("_x") == (common["d"] if common else 0))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("_x"))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _total(rows: DataFrame, dim: int, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all batches of ``work(integers)``, a short vector of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = work(_matrix(batch, dim))
                total = part if total is None else total + part
        if total is not None:
            place = pa.array(np.arange(len(total), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([place, pa.array(total)], ["place", "value"])

    parts = rows.select("_x").mapInArrow(run, "place int, value double")
    found = parts.groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(found))
    for row in found:
        out[row["place"]] = row["value"]
    return out


def exact_sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of rows and the sum of each entry, as integers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, dim)
            # two halves, as sums of whole numbers of 53 bits would not fit
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            place = np.arange(dim + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(place),
                    pa.array(np.append(high, 0)),
                    pa.array(np.append(low, len(x))),
                ],
                ["place", "high", "low"],
            )

    wide = "decimal(38,0)"
    parts = rows.select("_x").mapInArrow(run, "place int, high long, low long")
    found = (
        parts.groupBy("place")
        .agg(F.sum(F.col("high").cast(wide)).alias("h"), F.sum(F.col("low").cast(wide)).alias("l"))
        .collect()
    )
    total = {r["place"]: (int(r["h"]) << 32) + int(r["l"]) for r in found}
    return total.get(dim, 0), [total.get(i, 0) for i in range(dim)]


class _Products:
    """Distributed products with the centred rows."""

    def __init__(self, rows: DataFrame, dim: int, n: int, sums: list[int]) -> None:
        self.rows, self.dim, self.n = rows, dim, n
        self.mean = np.array([s / n for s in sums])
        self.passes = 0

    def step(self, q: np.ndarray, lefts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """``p'p``, ``U'p`` and ``X'p`` for ``p = X q`` and ``U = X lefts``."""
        mean = self.mean

        def work(integers: np.ndarray) -> np.ndarray:
            x = integers - mean
            p = x @ q
            return np.concatenate([[p @ p], (x @ lefts).T @ p, x.T @ p])

        self.passes += 1
        out = _total(self.rows, self.dim, work)
        k = lefts.shape[1]
        return float(out[0]), out[1 : 1 + k], out[1 + k :]

    def gram(self, directions: np.ndarray) -> np.ndarray:
        """Covariance of the rows projected on ``directions``, centred, divisor n."""
        mean, k = self.mean, directions.shape[1]

        def work(integers: np.ndarray) -> np.ndarray:
            y = (integers - mean) @ directions
            return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])

        self.passes += 1
        out = _total(self.rows, self.dim, work)
        middle = out[:k] / self.n
        return out[k:].reshape(k, k) / self.n - np.outer(middle, middle)

    def trace(self) -> float:
        mean = self.mean
        return float(_total(self.rows, self.dim, lambda x: ((x - mean) ** 2).sum(axis=0)).sum())


def _orthogonal(vector: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        vector = vector - basis @ (basis.T @ vector)
    return vector


def _bidiagonalise(products: _Products, locked: np.ndarray, want: int, tolerance: float,
                   rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, bool]:
    """Directions and singular values of ``X`` orthogonal to ``locked``, the largest ``want``.

    Fewer if the space that one start vector reaches is smaller. Also returns whether the
    right vectors span everything, so that no direction can be missing.
    """
    dim = products.dim
    start = _orthogonal(rng.standard_normal(dim), locked)
    rights = [start / np.linalg.norm(start)]
    lefts = np.zeros((dim, 0))  # u_j = X lefts[:, j]
    back = np.zeros((dim, 0))  # X' u_j
    alphas: list[float] = []
    betas: list[float] = []
    while True:
        q = rights[-1] - (betas[-1] * lefts[:, -1] if betas else 0.0)
        for _ in range(2):  # full reorthogonalisation of the left vector, again if it mattered
            square, along, product = products.step(q, lefts)
            q = q - lefts @ along
            product = product - back @ along
            rest = square - along @ along
            if along @ along <= 1e-20 * square:
                break
        alpha = float(np.sqrt(max(rest, 0.0)))
        largest = max([alpha, *alphas])
        if alpha <= 1e-14 * largest or largest == 0.0:
            break  # the rows have no part in this direction
        lefts = np.column_stack([lefts, q / alpha])
        back = np.column_stack([back, product / alpha])
        alphas.append(alpha)
        basis = np.column_stack([locked, *rights])
        after = _orthogonal(back[:, -1], basis)
        beta = float(np.linalg.norm(after))
        band = np.diag(alphas) + np.diag(betas, 1) if betas else np.diag(alphas)
        left, sigma, right = np.linalg.svd(band)
        residuals = beta * np.abs(left[-1, :])
        done = len(sigma) >= want and (residuals[:want] <= tolerance * sigma[0]).all()
        whole = basis.shape[1] >= dim
        if done or whole or beta <= 1e-14 * largest:
            return np.column_stack(rights) @ right.T[:, :want], sigma[:want], whole
        betas.append(beta)
        rights.append(after / beta)
    if not alphas:
        return np.zeros((dim, 0)), np.zeros(0), True
    # the last right vector has no left one: a bidiagonal with one column more
    band = np.zeros((len(alphas), len(rights)))
    band[: len(alphas), : len(alphas)] = np.diag(alphas)
    band[np.arange(len(betas)), np.arange(1, len(betas) + 1)] = betas
    _, sigma, right = np.linalg.svd(band, full_matrices=False)
    whole = locked.shape[1] + len(rights) >= dim
    return np.column_stack(rights) @ right.T[:, :want], sigma[:want], whole


def fit_rows(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Fit on the rows of :func:`integer_rows`."""
    first = rows.first()
    dim = len(first["_x"]) if first else 0
    if not dim:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    n, sums = exact_sums(rows, dim)
    products = _Products(rows, dim, n, sums)
    trace = products.trace() / n
    rng = np.random.default_rng([SEED, dim])
    found, values = np.zeros((dim, 0)), np.zeros(0)
    # the first run finds the components; a later one finds what one start vector cannot reach
    whole = False
    while trace > 0 and not whole and found.shape[1] < dim:
        short = components - found.shape[1]
        tolerance = CONVERGED if short > 0 else SETTLED
        more, sigma, whole = _bidiagonalise(products, found, max(short, 1), tolerance, rng)
        if not len(sigma):
            break
        if short <= 0 and sigma[0] ** 2 / n <= values[-1] * (1 + 1e-9):
            break
        if short <= 0:  # a missed one: find it as precisely as the others
            more, _, whole = _bidiagonalise(products, found, 1, CONVERGED, rng)
        both = np.linalg.qr(np.column_stack([found, more]))[0]
        values, turn = np.linalg.eigh(products.gram(both))
        order = np.argsort(-values, kind="stable")[:components]
        values, found = values[order], both @ turn[:, order]
    able = values > RANK * values[0] if len(values) else np.zeros(0, dtype=bool)
    return Whitening(n, sums, found[:, able], values[able], trace, products.passes)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum of ``(n x - S)**2`` over the entries of each row, exactly."""
    largest = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if 2 * largest < 1 << 31 and (2 * largest) ** 2 * x.shape[1] < 1 << 62:
        apart = x * n - np.array(sums, dtype=np.int64)
        return (apart * apart).sum(axis=1).tolist()
    if 2 * largest < 1 << 62:
        apart = x * n - np.array(sums, dtype=np.int64)
        if float(np.abs(apart).max(initial=0)) ** 2 * x.shape[1] < float(1 << 62):
            return (apart * apart).sum(axis=1).tolist()
        apart = apart.astype(object)
    else:
        apart = x.astype(object) * n - np.array(sums, dtype=object)
    return (apart * apart).sum(axis=1).tolist()


def whiten(df: DataFrame, key: str, vector: str, components: int = COMPONENTS) -> DataFrame:
    """One row per usable row of ``df`` and component.

    Columns: the key, ``component`` (from 1, by falling eigenvalue), ``n`` (rows of the fit
    list), ``deviation`` (sum over entries of ``(n x - S)**2``, exact, decimal; null beyond 38
    digits), ``whitened`` (the centred integers on the component over its deviation),
    ``explained`` (share of the trace), ``identity_error`` (largest absolute entry of the
    whitened covariance minus the identity, measured over all rows).

    All usable rows are the fit list; see :func:`integer_rows` for which are. Repeated rows and
    keys and null keys are rows like others. There are as many components as asked for, as
    entries, or as the rank of the centred rows, whichever is least, so an empty table, a single
    row or all equal rows give none. Components of equal eigenvalues are any orthogonal ones
    of their span. Signs are arbitrary but the same in all rows. Other columns are dropped.
    """
    bound_batches(df.sparkSession)
    rows = integer_rows(df, key, vector)
    model = fit_rows(rows, components)
    n, sums, count = model.n, model.sums, len(model.eigenvalues)
    kind = rows.schema["_key"].dataType.simpleString()
    schema = (
        f"_key {kind}, component int, deviation decimal(38,0), whitened double, explained double"
    )
    dim = len(sums)
    scaled = model.components / np.sqrt(model.eigenvalues) if count else model.components
    explained = model.eigenvalues / model.trace if count else np.zeros(0)
    products = _Products(rows, dim, n, sums) if count else None
    error = float(np.abs(products.gram(scaled) - np.eye(count)).max()) if count else 0.0
    mean = products.mean if count else np.zeros(0)
    most = 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not count or not batch.num_rows:
                continue
            x = _matrix(batch, dim)
            exact = [d if d < most else None for d in _deviations(x, n, sums)]
            deviation = pa.array(exact, type=pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(len(x)), count))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    deviation.take(each),
                    pa.array(((x - mean) @ scaled).ravel()),
                    pa.array(np.tile(explained, len(x))),
                ],
                ["_key", "component", "deviation", "whitened", "explained"],
            )

    return rows.mapInArrow(run, schema).select(
        F.col("_key").alias(key),
        "component",
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        "explained",
        F.lit(error).alias("identity_error"),
    )


def fits_long(value: Column) -> Column:
    """A decimal as a long, null where it has no room."""
    return value.try_cast("long")
