"""Embedding whitening: leading components by Jacobi-Davidson with distributed centred products."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustra.functions.columns import ref
from lustra.session import stage

SCALE = 256
COMPONENTS = 4
BLOCK = 2048  # vectors in a row of the fit list
TASKS = 1024  # partial products that reach the driver at most
SPACE = 40  # vectors of the search space before a restart
INNER = 12  # MINRES steps per correction equation
ROUNDS = 300
EPSILON = float(np.finfo(float).eps)


class Fit(NamedTuple):
    """Fitted whitening: n vectors with sums per dimension, unit components (rows), eigenvalues, trace, residuals."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    identity_error: float


def whole_vectors(embeddings: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, x): ``floor(scale * c)`` of every entry c, as longs; rows with a null or non-finite entry, or a null vector, go.

    The dimension is the greatest length; a shorter vector lacks entries, so it goes too.
    """
    plain = embeddings.select(F.col(ref(id_column)).alias("id"), F.expr(f"CAST({ref(vector)} AS ARRAY<DOUBLE>)").alias("c"))
    sound = plain.filter("c IS NOT NULL AND size(c) > 0 AND forall(c, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('Infinity'))")
    x = sound.select("id", F.expr(f"transform(c, e -> CAST(floor({scale}D * e) AS BIGINT))").alias("x"))
    x = stage(x, "vectors")
    d = x.agg(F.expr("max(size(x))")).first()[0] or 0
    return x.filter(F.expr(f"size(x) = {d}"))


def fit_list(x: DataFrame) -> DataFrame:
    """Every distinct vector once, as blocks of up to BLOCK vectors: (rows, dims, data), data little-endian 64-bit."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            for at in range(0, len(column), BLOCK):
                part = column.slice(at, BLOCK)
                data = part.flatten().to_numpy(zero_copy_only=False).astype("<i8")
                yield pa.RecordBatch.from_pydict({"rows": [len(part)], "dims": [len(data) // len(part)], "data": [data.tobytes()]})

    return stage(x.select("x").distinct().mapInArrow(blocks, "rows long, dims long, data binary"), "fit")


def reduced(blocks: DataFrame, part: Callable[[np.ndarray], list[np.ndarray]], tasks: int = TASKS) -> list[np.ndarray]:
    """Sums over all blocks of the arrays that ``part`` makes of one; each task sends its own sums, ``tasks`` at most.

    Sums of a task are added in the order of tasks, so a repeated run gives the same bits.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for rows, dims, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                x = np.frombuffer(data.as_py(), "<i8").reshape(rows, dims)
                found = part(x)
                total = found if total is None else [a + b for a, b in zip(total, found)]
        if total is not None:
            flat = [[float(v) for v in np.ravel(a)] if a.dtype != object else None for a in total]
            exact = [[str(v) for v in np.ravel(a)] if a.dtype == object else None for a in total]
            yield pa.RecordBatch.from_pydict({"flat": [flat], "exact": [exact], "shapes": [[list(a.shape) for a in total]]},
                schema=pa.schema([("flat", pa.list_(pa.list_(pa.float64()))), ("exact", pa.list_(pa.list_(pa.string()))), ("shapes", pa.list_(pa.list_(pa.int32())))]))

    rows = blocks.coalesce(tasks).mapInArrow(partial, "flat array<array<double>>, exact array<array<string>>, shapes array<array<int>>").collect()
    out: list[np.ndarray] = []
    for i in range(len(rows[0]["shapes"]) if rows else 0):
        shape = rows[0]["shapes"][i]
        if rows[0]["exact"][i] is None:
            out.append(np.sum([np.reshape(r["flat"][i], shape) for r in rows], axis=0))
        else:
            out.append(np.array([sum(int(r["exact"][i][k]) for r in rows) for k in range(len(rows[0]["exact"][i]))], object).reshape(shape))
    return out


def minres(product: Callable[[np.ndarray], np.ndarray], project: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Approximate solutions of the projected symmetric systems with right sides ``b``, one per column, in lockstep.

    ``product`` applies the shifted operator of each column.  Lanczos vectors are rotated as they come; a column
    that has reached ``tolerance`` of its right side, or has no further direction, stands still.
    """
    x = np.zeros_like(b)
    beta1 = np.linalg.norm(b, axis=0)
    live = beta1 > 0
    safe = np.where(live, beta1, 1)
    v_old, v, w_old, w = np.zeros_like(b), b / safe, np.zeros_like(b), np.zeros_like(b)
    beta, eta = np.zeros(b.shape[1]), beta1.copy()
    c_old = c = np.ones(b.shape[1])
    s_old = s = np.zeros(b.shape[1])
    for _ in range(steps):
        if not live.any():
            break
        p = project(product(v))
        alpha = np.sum(v * p, axis=0)
        p = p - alpha * v - beta * v_old
        beta_new = np.linalg.norm(p, axis=0)
        # Two rotations of before act on the new column of the tridiagonal matrix, then one of its own.
        rho3, rho2 = s_old * beta, c * c_old * beta + s * alpha
        delta = c * alpha - c_old * s * beta
        rho1 = np.hypot(delta, beta_new)
        ok = live & (rho1 > 0)
        r = np.where(ok, rho1, 1)
        c_new, s_new = np.where(ok, delta / r, 1), np.where(ok, beta_new / r, 0)
        w_new = (v - rho3 * w_old - rho2 * w) / r
        x = x + np.where(ok, c_new * eta, 0) * w_new
        eta = np.where(ok, -s_new * eta, eta)
        live = ok & (np.abs(eta) > tolerance * beta1) & (beta_new > EPSILON * np.abs(alpha))
        v_old, v = v, np.where(live, p / np.where(beta_new > 0, beta_new, 1), 0)
        w_old, w, beta = w, w_new, np.where(live, beta_new, 0)
        c_old, c, s_old, s = c, c_new, s, s_new
    return x


def _orthonormal(new: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """Unit columns spanning ``new`` beyond the columns of ``others``; columns within rounding of them go."""
    kept: list[np.ndarray] = []
    for t in new.T:
        size = np.linalg.norm(t)
        if not size > 0:
            continue
        t = t / size
        for _ in range(3):
            for o in others:
                t = t - o @ (o.T @ t)
            for k in kept:
                t = t - k * (k @ t)
            size = np.linalg.norm(t)
            if size < 1e-8:
                break
            t = t / size
        else:
            kept.append(t)
    return np.array(kept).T.reshape(len(new), len(kept))


def jacobi_davidson(
    product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, tolerance: float | None = None,
    space: int = SPACE, inner: int = INNER, rounds: int = ROUNDS,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenpairs of a symmetric operator: (values, unit vectors as columns, residual norms).

    ``product`` multiplies a block of columns; all columns that a step needs go through it at once.  Ritz pairs of
    the search space are locked from the top as their residual falls to ``tolerance`` times the largest value
    (64 roundings unless given).  For the others, the correction equations, projected away from all locked and
    wanted Ritz vectors, are solved by a few MINRES steps and extend the space, which restarts from its best half.
    Locked vectors stay in the Rayleigh-Ritz step, so that rounding never mixes them up.  Not reaching the tolerance is an error.
    """
    wanted = min(wanted, dims)
    space = max(space, 3 * wanted)
    tolerance = 64 * EPSILON if tolerance is None else tolerance
    start = np.random.default_rng(7).standard_normal((dims, min(dims, 2 * wanted)))
    v = _orthonormal(start)
    av = product(v)
    done = np.zeros((dims, 0))
    for _ in range(rounds):
        h = v.T @ av
        values, s = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-values, kind="stable")
        values, s = values[order], s[:, order]
        u, au = v @ s[:, :wanted], av @ s[:, :wanted]
        theta = values[:wanted]
        r = au - u * theta
        size = np.linalg.norm(r, axis=0)
        scale = max(abs(values[0]), np.finfo(float).tiny)
        open_ = np.flatnonzero(size > tolerance * scale)
        locked = int(open_[0]) if len(open_) else wanted
        done = u[:, :locked]
        if locked == wanted:
            # Vectors built up over many steps are judged by a product of their own.
            u = np.linalg.qr(u)[0]
            au = product(u)
            h = u.T @ au
            theta, s = np.linalg.eigh((h + h.T) / 2)
            theta, s = theta[::-1], s[:, ::-1]
            u, au = u @ s, au @ s
            size = np.linalg.norm(au - u * theta, axis=0)
            if (size <= tolerance * scale).all():
                return theta, u, size
            v, av = u, au
            continue
        active = np.arange(locked, wanted)
        away = np.hstack([done, u[:, active]])
        project = lambda t: t - away @ (away.T @ t)  # noqa: B023, E731
        shift = theta[active]
        shifted = lambda t: product(t) - t * shift  # noqa: B023, E731
        t = minres(shifted, project, -project(r[:, active]), inner, 1e-3)
        if v.shape[1] + len(active) > space:
            keep = max(space // 2, wanted)
            v, av = v @ s[:, :keep], av @ s[:, :keep]
        if v.shape[1] < dims:
            # A direction that rounding has used up is replaced by a fresh one.
            new = _orthonormal(np.hstack([t, r[:, active]]), v)[:, : len(active)]
            if not new.shape[1]:
                new = _orthonormal(np.random.default_rng(v.shape[1]).standard_normal((dims, 1)), v)
            new = new[:, : dims - v.shape[1]]
            v, av = np.hstack([v, new]), np.hstack([av, product(new)])
        else:
            v = np.linalg.qr(v)[0]
            av = product(v)
    raise ArithmeticError(f"residuals {size} above {tolerance} after {rounds} rounds")


def fit_whitening(blocks: DataFrame, components: int = COMPONENTS) -> Fit:
    """Fit on the blocks of :func:`fit_list`; passes over them are all that touches the vectors.

    Components whose variance is only rounding (at most dims roundings of the trace) cannot be whitened and are left out.
    """
    first = reduced(blocks, lambda x: [np.array([len(x)], object), np.array([int(v) for v in _column_sums(x)], object)])
    if not first:
        return Fit(0, np.array([], object), np.zeros((0, 0)), np.zeros(0), 0.0, np.zeros(0), 0.0)
    n, sums = int(first[0][0]), first[1]
    dims = len(sums)
    mean = np.array([s / n for s in sums])

    def product(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> list[np.ndarray]:
            centred = x - mean
            return [centred.T @ (centred @ q)]

        return reduced(blocks, part)[0] / n

    trace = float(reduced(blocks, lambda x: [np.array([np.square(x - mean).sum()])])[0][0]) / n
    if not trace > 0:
        return Fit(n, sums, np.zeros((0, dims)), np.zeros(0), 0.0, np.zeros(0), 0.0)
    values, vectors, residuals = jacobi_davidson(product, dims, components)
    real = values > dims * EPSILON * trace
    values, vectors, residuals = values[real], vectors[:, real], residuals[real]
    to = vectors / np.sqrt(values)
    middle = reduced(blocks, lambda x: [((x - mean) @ to).sum(axis=0)])[0] / n

    def spread(x: np.ndarray) -> list[np.ndarray]:
        y = (x - mean) @ to - middle
        return [y.T @ y]

    error = np.abs(reduced(blocks, spread)[0] / n - np.eye(len(values))).max()
    return Fit(n, sums, vectors.T, values, trace, residuals, float(error))


def _column_sums(x: np.ndarray) -> list[int]:
    """Exact sums of columns: halves of 32 bits cannot overflow."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return [(int(a) << 32) + int(b) for a, b in zip(high.sum(axis=0), low.sum(axis=0))]


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``n * x - S`` as doubles, and the exact sum of its squares per row."""
    most = max((abs(int(x.max())), abs(int(x.min()))), default=0) * n + max(abs(int(s)) for s in sums)
    wide = x.astype(object) if most * most * x.shape[1] >= 1 << 62 else x
    centred = wide * n - (sums if wide is not x else sums.astype(np.int64))
    return centred.astype(float), (centred * centred).sum(axis=1)


def whiten(x: DataFrame, fit: Fit) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row of ``x`` and component."""
    k = len(fit.values)
    to = fit.components.T / np.sqrt(fit.values) if k else None
    share = fit.values / fit.trace if k else None
    kind = x.schema["id"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows or not k:
                continue
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
            centred, deviation = deviations(vectors, fit.n, fit.sums)
            whitened = (centred / fit.n) @ to
            times = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(times)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                 pa.array(np.full(rows * k, fit.n)), pa.array([int(v) for v in deviation], pa.decimal128(38, 0)).take(pa.array(times)),
                 pa.array(whitened.ravel()), pa.array(np.tile(share, rows)), pa.array(np.full(rows * k, fit.identity_error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    out = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    return x.select("id", "x").mapInArrow(project, out)


def whiten_embeddings(embeddings: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows of :func:`whiten` for all sound vectors of a table, fitted on its distinct vectors.

    Vectors that are null, empty, hold a null or non-finite entry, or lack entries against the longest are left
    out, as are other columns; a null id stays null, repeated rows are rows each and count once in the fit.  Equal
    eigenvalues get some orthonormal basis, the same for all rows.  An empty table, and one of a single distinct
    vector (which has no variance), give no rows; fewer components come out where the rest have no variance.
    ``deviation`` is exact up to 38 digits.
    """
    x = whole_vectors(embeddings, id_column, vector)
    return whiten(x, fit_whitening(fit_list(x), components))
