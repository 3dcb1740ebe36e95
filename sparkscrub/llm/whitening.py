"""Whitening of embeddings by spectrum slicing.

Spark sums the vectors and, centred on their mean, their outer products; the covariance has one row per dimension,
however many vectors there are. Its leading eigenvalues are found one by one. The inertia of a shifted covariance,
counted in its LDLᵀ factors, says how many eigenvalues lie above the shift, so bisection puts each into an
interval of its own; Rayleigh quotient iteration then converges cubically, and the counts on both sides of the
result certify that it is the eigenvalue of that number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import added_up

#: Greatest size of an entry's whole number: beyond it, doubles have no exact place for it.
_EXACT = 1 << 53
_EPS = float(np.finfo(np.float64).eps)


def negatives(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of symmetric ``a`` lie below ``shift``: negative pivots of LDLᵀ (Bunch and Kaufman)."""
    a = a - shift * np.eye(len(a))
    bound = (1 + 17**0.5) / 8
    below = 0
    while len(a):
        column = np.abs(a[1:, 0])
        r = int(column.argmax()) + 1 if len(column) else 0
        largest = column[r - 1] if len(column) else 0.0
        size = 1
        if largest > 0 and abs(a[0, 0]) < bound * largest:
            row = np.abs(a[r])
            row[r] = 0.0
            other = row.max()
            if abs(a[0, 0]) * other < bound * largest**2:
                if abs(a[r, r]) >= bound * other:
                    order = np.arange(len(a))
                    order[[0, r]] = r, 0
                    a = a[np.ix_(order, order)]
                else:
                    size = 2
                    order = np.arange(len(a))
                    order[[1, r]] = r, 1
                    a = a[np.ix_(order, order)]
        if size == 1:
            pivot = a[0, 0]
            below += pivot < 0
            rest = a[1:, 0]
            # A pivot of exactly 0 has a column of zeros here: an eigenvalue at the shift, counted as not below.
            a = a[1:, 1:] - (np.outer(rest, rest) / pivot if pivot else 0.0)
        else:
            below += 1  # a pivot block with one eigenvalue on each side
            rest = a[2:, :2]
            a = a[2:, 2:] - rest @ np.linalg.solve(a[:2, :2], rest.T)
        a = (a + a.T) / 2
    return int(below)


def leading(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` greatest eigenvalues of ``v``, falling, and their unit eigenvectors in columns.

    Eigenvalues that are 0 to working precision are left out, so a covariance of few or dependent vectors gives
    fewer. Eigenvalues too close to be told apart get orthogonal vectors of their common space.
    """
    d = len(v)
    if d == 0 or not np.abs(v).max() > 0:
        return np.zeros(0), np.zeros((d, 0))
    scale = float(np.abs(v).sum(axis=1).max())  # no eigenvalue is beyond this
    floor = 1e4 * d * _EPS * scale
    close = 4 * d * _EPS * scale
    counts: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = d - negatives(v, shift)
        return counts[shift]

    top = scale * (1 + 4 * _EPS)
    counts[top] = 0
    rng = np.random.default_rng(1)
    values, vectors = [], np.zeros((d, 0))

    def apart(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - vectors @ (vectors.T @ x)
        return x / np.linalg.norm(x)

    def solve(shift: float, x: np.ndarray) -> np.ndarray:
        try:
            found = np.linalg.solve(v - shift * np.eye(d), x)
            if np.isfinite(found).all():
                return found
        except np.linalg.LinAlgError:
            pass
        return np.linalg.solve(v - (shift + close) * np.eye(d), x)

    def iterate(shift: float, low: float, high: float) -> tuple[float, np.ndarray] | None:
        """Rayleigh quotient iteration from two steps with a fixed shift; None if it leaves the interval."""
        x = apart(rng.standard_normal(d))
        for _ in range(2):
            x = apart(solve(shift, x))
        rho = float(x @ v @ x)
        for _ in range(12):
            residual = np.linalg.norm(v @ x - rho * x)
            if residual <= close:
                # One more step costs little and takes the vector to working precision.
                x = apart(solve(rho, x))
                rho = float(x @ v @ x)
                return (rho, x) if low - close <= rho <= high + close else None
            x = apart(solve(rho, x))
            rho = float(x @ v @ x)
            if not low - close <= rho <= high + close:
                return None
        return None

    while len(values) < min(most, d):
        k = len(values) + 1
        low = max([s for s, n in counts.items() if n >= k], default=-close)
        high = min(s for s, n in counts.items() if n < k)
        if high <= floor:
            break
        found = None
        while True:
            tight = high - low <= close
            alone = above(low) - above(high) == 1
            if alone or tight:
                found = iterate((low + high) / 2, low, high)
                if found is not None or tight:
                    break
            middle = (low + high) / 2
            if above(middle) >= k:
                low = middle
            else:
                high = middle
        if found is None:
            x = apart(solve((low + high) / 2, apart(rng.standard_normal(d))))
            x = apart(solve((low + high) / 2, x))
            found = float(x @ v @ x), x
        rho, x = found
        if rho <= floor:
            break
        # The counts certify the number: at least k eigenvalues from just below, fewer than k from just above.
        if not above(rho - 2 * close) >= k > above(rho + 2 * close):
            raise ArithmeticError(f"eigenvalue {k} is not where the counts put it")
        values.append(rho)
        vectors = np.column_stack([vectors, x])
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], vectors[:, order]


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors with sums ``sums``, the leading eigenvalues and eigenvectors of their covariance, its trace,
    and the largest entry by which the covariance of the whitened vectors differs from the identity."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None


def _whole_numbers(vector: Column) -> Column:
    """Entry ``c`` as ``floor(64 c) + 1000000``; null if any entry is null, not finite or beyond exact doubles."""
    scaled = F.transform(vector, lambda c: F.floor(c.cast("double") * 64))
    usable = F.forall(
        vector, lambda c: F.coalesce(F.abs(c.cast("double")) * 64 < _EXACT - 2_000_000, F.lit(False)) & ~F.isnan(c.cast("double"))
    )
    return F.when(F.coalesce(usable, F.lit(False)), F.transform(scaled, lambda x: x.cast("long") + 1_000_000))


def usable_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows ``vec_id``, ``x`` (whole numbers). Without rows whose vector is null, empty, or holds an entry that is
    null, not finite or of 2^47 and more; and, where lengths differ, only rows of the most frequent one (of
    equally frequent ones the longest)."""
    found = df.select(F.col(vec_id).alias("vec_id"), _whole_numbers(F.col(vector)).alias("x")).where("size(x) > 0")
    lengths = found.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).first()
    return found.where(F.size("x") == (lengths["d"] if lengths else 0))


def _matrix(column) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _total(df: DataFrame, partial: Callable[[np.ndarray], np.ndarray], size: int, kind: str) -> np.ndarray:
    """The sum over the rows of ``df`` (``x``) of ``partial(matrix)``, an array of ``size`` entries.

    Each task sends one binary row; these are added up by few tasks, whose results are few enough for the driver.
    """

    def of_rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(size, kind)
        for batch in batches:
            if batch.num_rows:
                total += partial(_matrix(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return added_up(df.select("x").mapInArrow(of_rows, "sums binary"), size, kind)


def _centred(x: np.ndarray, n: int, middle: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """``x - S / n``: the nearest whole number of the mean is taken off exactly, then the fraction left."""
    return (x - middle).astype(np.float64) - shift


def fit(rows: DataFrame, components: int = 32) -> Whitening:
    """The whitening of ``rows`` (of :func:`usable_vectors`): three passes of sums, all vectors counted."""
    first = rows.select(F.size("x")).first()
    d = first[0] if first else 0
    if not d:
        return Whitening(0, (), np.zeros(0), np.zeros((0, 0)), 0.0, None)

    # Sums in two halves, so that they stay exact beyond 64 bits.
    def sums(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])

    total = [int(t) for t in _total(rows, sums, 2 * d + 1, "int64")]
    n, exact = total[0], tuple((high << 32) + low for high, low in zip(total[1 : d + 1], total[d + 1 :], strict=True))
    middle, shift = _middle(n, exact)

    def outer(x: np.ndarray) -> np.ndarray:
        y = _centred(x, n, middle, shift)
        return (y.T @ y).ravel()

    v = _total(rows, outer, d * d, "float64").reshape(d, d) / n
    v = (v + v.T) / 2
    values, vectors = leading(v, components)
    k = len(values)
    if k == 0:
        return Whitening(n, exact, values, vectors, float(np.trace(v)), None)
    project = vectors / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = _centred(x, n, middle, shift) @ project
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    found = _total(rows, moments, k + k * k, "float64") / n
    covariance = found[k:].reshape(k, k) - np.outer(found[:k], found[:k])
    return Whitening(n, exact, values, vectors, float(np.trace(v)), float(np.abs(covariance - np.eye(k)).max()))


def _middle(n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    middle = [(2 * s + n) // (2 * n) for s in sums]
    shift = [(s - n * m) / n for s, m in zip(sums, middle, strict=True)]
    return np.array(middle, np.int64), np.array(shift, np.float64)


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """Per row of ``rows`` (of :func:`usable_vectors`): ``vec_id``, ``deviation`` (sum over dimensions of the squares of
    ``n x - S``; null where it does not fit 64 bits) and ``whitened`` (an array, one entry per component)."""
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation long, whitened array<double>"
    if len(model.values) == 0:
        return rows.sparkSession.createDataFrame([], schema)
    n, project = model.n, model.vectors / np.sqrt(model.values)
    middle, shift = _middle(n, model.sums)
    parts = [n * int(m) - s for m, s in zip(middle, model.sums, strict=True)]  # n x - S = n (x - middle) + part

    def deviations(x: np.ndarray) -> list[int | None]:
        rough = (np.abs(x - middle).astype(np.float64) + 1.0) * n
        if (rough**2).sum(axis=1).max() < 2.0**62:
            return ((n * (x - middle) + np.array(parts, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((n * (a - m) + p) ** 2 for a, m, p in zip(row, middle.tolist(), parts, strict=True)) for row in x.tolist()]
        return [e if e < 1 << 63 else None for e in exact]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _matrix(part.column("x"))
                w = _centred(x, n, middle, shift) @ project
                ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id"),
                        pa.array(deviations(x), pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(w.ravel())),
                    ],
                    names=["vec_id", "deviation", "whitened"],
                )

    return rows.select("vec_id", "x").mapInArrow(run, schema)


def whiten(df: DataFrame, components: int = 32, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable vector and component (numbered from 1 by falling eigenvalue): ``vec_id``, ``component``,
    ``n``, ``deviation``, ``whitened``, ``explained`` (share of the trace) and ``identity_error``.

    Which vectors are usable says :func:`usable_vectors`. Repeated rows count and come out as often as they are there;
    a null id stays null. Equal eigenvalues have some orthogonal basis, the same for all rows. Components without
    variance (constant or dependent dimensions, fewer vectors than dimensions, an empty table) do not come out.
    Only the two named columns are read, so others may have any name.
    """
    rows = usable_vectors(df, vec_id, vector)
    model = fit(rows, components)
    shares = [float(e) / model.trace for e in model.values]
    found = whitened(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("__at", "whitened"))
    return found.select(
        "vec_id",
        (F.col("__at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(F.array(*map(F.lit, shares or [0.0])), F.col("__at")).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
