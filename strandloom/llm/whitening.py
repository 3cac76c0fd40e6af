"""Whitening of embeddings by the covariance of their quantised values, recovered by polarisation.

A component c counts as the integer floor(256 c). Covariances are those of the distinct integer vectors.
Aggregated are only squares, each exact: of every centred component, and of every sum of two. Then
cov(i, j) = (var(i + j) - var(i) - var(j)) / 2. Components are centred by the integer below their mean, which
keeps the squares small; the rest of the mean is taken off in exact arithmetic: with n vectors, sum q and sum of
squares s about the integer, n times the sum about the mean is n s - q². Sums leave a task as
five limbs of 40 bits, so that they are exact whatever the values and their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandloom.llm.common import bounded_batches, per_batch, store

SCALE = 256
COMPONENTS = 4
LIMB_BITS, LIMBS = 40, 5
#: Rows squared at once.
ROWS = 4096
#: An eigenvalue below this share of the trace is rounding: nothing varies along its component.
LEAST_SHARE = 1e-12

_LIMBS = [f"s{k}" for k in range(LIMBS)]


def quantised(vector: Column) -> Column:
    """floor(256 c) of every component; values outside of 64 bits become the nearest end."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(SCALE * c).cast("long"))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, x) of the rows whose vector is not null, not empty and has finite components only."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(
        F.coalesce((F.size("v") > 0) & fine, F.lit(False))).select("vec_id", quantised(F.col("v")).alias("x"))


def _split(value: int) -> list[int]:
    return [value >> LIMB_BITS * k & (1 << LIMB_BITS) - 1 for k in range(LIMBS)]


def _joined(limbs) -> int:
    return sum(int(v) << LIMB_BITS * k for k, v in enumerate(limbs))


def _vectors(batch: pa.RecordBatch, column: str = "x") -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each length."""
    lists = batch.column(column)
    sizes = np.diff(np.array(lists.offsets))
    found = {}
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        found[int(size)] = rows, np.array(lists.take(pa.array(rows)).flatten()).reshape(-1, size)
    return found


class _Sums:
    """Exact sums of n, every component, or every square of a component or of a sum of two."""

    def __init__(self, dims: int):
        self.dims, self.n = dims, 0
        self.sums = [0] * dims
        self.pairs = np.triu_indices(dims, 1)
        self.squares: list[int] = [0] * (dims + len(self.pairs[0]))

    def add(self, x: np.ndarray) -> None:
        self.n += len(x)
        small = np.abs(x).max(initial=0) < 1 << 40 and x.min(initial=0) > np.iinfo(np.int64).min
        totals = x.sum(0) if small else x.astype(object).sum(0)
        self.sums = [a + int(b) for a, b in zip(self.sums, totals)]

    def add_squares(self, x: np.ndarray, mean: list[int]) -> None:
        """``mean``: the integer that each component is centred by."""
        self.n += len(x)
        reach = max((abs(int(v) - m) for col, m in zip(x.T, mean) for v in (col.min(), col.max())), default=0)
        if 4 * reach * reach * len(x) < 1 << 62:
            u = x - np.array(mean, np.int64)
        else:  # Python's integers have no bounds
            u = x.astype(object) - np.array(mean, object)
        found = list((u * u).sum(0))
        for i in range(self.dims - 1):
            both = u[:, i : i + 1] + u[:, i + 1 :]
            found += list((both * both).sum(0))
        self.squares = [a + int(b) for a, b in zip(self.squares, found)]


class Model:
    """Mean, covariance and components of the distinct vectors of one length."""

    def __init__(self, n: int, sums: list[int], squares: list[int] | None = None, components: int = COMPONENTS):
        self.n, self.sums = n, sums
        self.mean = [s // n for s in sums]
        self.rest = np.array([s - n * m for s, m in zip(sums, self.mean)], float) / n
        if squares is not None:
            self._fit(squares, components)

    def _fit(self, squares: list[int], components: int) -> None:
        n, dims = self.n, len(self.sums)
        rest = [s - n * m for s, m in zip(self.sums, self.mean)]
        own = [n * s - q * q for s, q in zip(squares, rest)]  # n² times each variance
        exact = [[0] * dims for _ in range(dims)]
        for (i, j), s in zip(zip(*np.triu_indices(dims, 1)), squares[dims:]):
            both = n * s - (rest[i] + rest[j]) ** 2
            exact[i][j] = exact[j][i] = both - own[i] - own[j]
        for i in range(dims):
            exact[i][i] = 2 * own[i]
        # Quotients of integers are rounded once, however large they are.
        values, vectors = np.linalg.eigh(np.array([[v / (2 * n * n) for v in row] for row in exact]))
        order = np.argsort(-values, kind="stable")[:components]
        self.values, self.vectors = values[order], vectors[:, order]
        trace = sum(own) / (n * n)
        self.flat = self.values <= LEAST_SHARE * trace
        self.explained = np.maximum(self.values, 0.0) / trace if trace else None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the large part is taken off in integers."""
        small = np.abs(x).max(initial=0) < 1 << 60 and max(map(abs, self.mean)) < 1 << 60
        if small and x.min(initial=0) > np.iinfo(np.int64).min:
            return (x - np.array(self.mean, np.int64)).astype(float) - self.rest
        return (x.astype(object) - np.array(self.mean, object)).astype(float) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        scale = np.sqrt(np.where(self.flat, 1.0, self.values))
        return (self.centred(x) @ self.vectors) / scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)², null beyond 64 bits."""
        n, limit = self.n, 1 << 63
        reach = n * int(max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))) + max(map(abs, self.sums))
        if reach * reach * len(self.sums) < limit:
            away = n * x - np.array(self.sums, np.int64)
            return (away * away).sum(1).tolist()
        away = n * x.astype(object) - np.array(self.sums, object)
        return [int(d) if d < limit else None for d in (away * away).sum(1)]


def _summed(fit: DataFrame, means: dict[int, list[int]] | None) -> dict[int, dict[int, int]]:
    """Exact totals over the fit list, by length of the vectors and place: 0 is n, then come the sums, or with
    ``means`` the squares. Their number depends on the lengths only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, _Sums] = {}
        for batch in batches:
            for dims, (_, x) in _vectors(batch).items():
                own = made.setdefault(dims, _Sums(dims))
                for at in range(0, len(x), ROWS):
                    if means is None:
                        own.add(x[at : at + ROWS])
                    else:
                        own.add_squares(x[at : at + ROWS], means[dims])
        for dims, own in made.items():
            found = [own.n, *(own.squares if means else own.sums)]
            # Sums may be negative: the top limb keeps the sign.
            limbs = [[*_split(v)[:-1], v >> LIMB_BITS * (LIMBS - 1)] for v in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([dims] * len(found), pa.int64()), pa.array(range(len(found)), pa.int64()),
                 *(pa.array(c, pa.int64()) for c in zip(*limbs))], names=["dims", "place", *_LIMBS])

    schema = ", ".join(f"{c} bigint" for c in ("dims", "place", *_LIMBS))
    parts = fit.mapInArrow(run, schema)
    totals = parts.groupBy("dims", "place").agg(*(F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in _LIMBS))
    found: dict[int, dict[int, int]] = {}
    for dims, place, *limbs in totals.collect():
        found.setdefault(dims, {})[place] = _joined(limbs)
    return found


def fitted(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length of the distinct vectors ``fit`` (x: array of long)."""
    sums = _summed(fit, None)
    means = {d: [s[i] // s[0] for i in range(1, d + 1)] for d, s in sums.items()}
    squares = _summed(fit, means) if sums else {}
    return {
        d: Model(s[0], [s[i] for i in range(1, d + 1)], [squares[d][i] for i in range(1, len(squares[d]))], components)
        for d, s in sums.items()
    }


def _identity_errors(fit: DataFrame, models: dict[int, Model], components: int) -> dict[int, float | None]:
    """Largest entry of the covariance of the whitened fit list minus the identity, measured; over the components
    along which something varies."""
    names = [f"w{k}" for k in range(components)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims, rows = [], []
        for d, (_, x) in _vectors(batch).items():
            w = models[d].whitened(x)
            w[:, models[d].flat] = np.nan
            rows.append(np.pad(w, [(0, 0), (0, components - w.shape[1])], constant_values=np.nan))
            dims.append(np.full(len(x), d))
        w = np.concatenate(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(dims)), *(pa.array(c, from_pandas=True) for c in w.T)], names=["dims", *names])

    white = fit.mapInArrow(per_batch(run), ", ".join(["dims bigint", *(f"{c} double" for c in names)]))
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    errors: dict[int, float | None] = {}
    for dims, *found in white.groupBy("dims").agg(*(F.covar_pop(names[i], names[j]) for i, j in pairs)).collect():
        off = [abs(v - (i == j)) for (i, j), v in zip(pairs, found) if v is not None]
        errors[dims] = max(off, default=None)
    return errors


def whitened(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
) -> DataFrame:
    """For every usable row and each of the first components: vec_id, component (from 1, by falling
    eigenvalue), n, deviation, whitened, explained, identity_error.

    Rows without a vector, with an empty one, or with null or non-finite components take no part. Rows
    with equal or no keys are answered each on its own, equal vectors are fitted once. Vectors of differing
    lengths have models of their own; those of d components give at most d rows. Along a component without
    variance ``whitened`` is null, as is ``explained`` if nothing varies at all and ``identity_error`` if nothing
    could be measured; a deviation beyond 64 bits is null. Other columns play no part; an empty table gives no rows.

    The driver sees sums only: one per pair of dimensions. Every pass is over a table of the distinct vectors.
    """
    bounded_batches(vectors.sparkSession)
    rows = usable(vectors, key, vector)
    fit = store(rows.select("x").distinct(), "fit-list")
    models = fitted(fit, components)
    errors = _identity_errors(fit, models, components) if models else {}

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for dims, (at, x) in _vectors(batch).items():
            model = models[dims]
            k = len(model.values)
            white = model.whitened(x)
            white[:, model.flat] = np.nan
            names = batch.column("vec_id").take(pa.array(np.repeat(at, k)))
            explained = [None] * k if model.explained is None else model.explained.tolist()
            yield pa.RecordBatch.from_arrays([
                names, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                pa.array([model.n] * (k * len(at)), pa.int64()),
                pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                pa.array(white.ravel(), from_pandas=True), pa.array(explained * len(at), pa.float64()),
                pa.array([errors[dims]] * (k * len(at)), pa.float64()),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from run(batch)

    return rows.mapInArrow(
        each, "vec_id long, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double")
