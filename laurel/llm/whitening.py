"""Whitening of vectors: leading covariance eigenvectors by Jacobi-Davidson, whose products run over the distributed rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.session import stored

INNER_STEPS = 4  # MINRES steps, one distributed product each, for a correction
SPACES = 6  # the search space holds so many times the wanted vectors before it restarts
GUARDS = 4  # further vectors of a block, which speed up the last wanted ones
MAX_ROUNDS = 200
EPS = float(np.finfo(np.float64).eps)
LONG_MAX = 2**63 - 1
Product = Callable[[np.ndarray], np.ndarray]


@dataclass
class Whitening:
    """What is learned of the fit list: its size, exact sums, and the leading eigenpairs of its covariance."""

    n: int
    sums: list[int]
    vectors: np.ndarray  # dimensions x components, unit columns
    values: np.ndarray  # falling
    trace: float
    largest: int  # largest absolute entry
    identity_error: float = 0.0
    rounds: int = 0
    residual: float = 0.0  # the largest residual norm, in units of the largest eigenvalue


def quantised(vector: str | Column, scale: int = 64, offset: int = 1_000_000) -> Column:
    """floor(scale * entry) + offset per entry, as longs; scaled entries beyond 2^62 are held there."""
    entries = F.col(vector) if isinstance(vector, str) else vector
    bounded = lambda c: F.least(F.greatest(c, F.lit(-(2.0**62))), F.lit(2.0**62))
    return F.transform(entries, lambda c: F.floor(bounded(c.cast("double") * scale)) + F.lit(offset))


def usable(docs: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, x) of the rows whose vector is not null, has finite entries only, and has the commonest length."""
    entries = docs[vector].cast("array<double>")
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = docs.where(entries.isNotNull() & finite).select(docs[vec_id].alias("vec_id"), quantised(entries).alias("x"))
    size = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (size["d"] if size else 0)).where(F.size("x") > 0)


def _matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _deviations(x: np.ndarray, n: int, sums: list[int], largest: int) -> np.ndarray:
    """n * x - sums, exact: in 64 bits where they hold it, else in Python's integers."""
    if 2 * n * max(largest, 1) < 2**62:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _centred(x: np.ndarray, n: int, sums: list[int], largest: int) -> np.ndarray:
    return _deviations(x, n, sums, largest).astype(np.float64) / n


# ---- distributed sums ---------------------------------------------------------------------------------------------------

def _moments(fit: DataFrame, d: int) -> tuple[int, list[int], int]:
    """Rows, exact sums per dimension and the largest absolute entry of the fit list."""
    def part(batches):
        n, sums, largest = 0, [0] * d, 0
        for x in _matrices(batches, d):
            n += len(x)
            largest = max(largest, int(x.max()), -int(x.min()))
            exact = x if largest * len(x) < 2**62 else x.astype(object)
            sums = [a + int(b) for a, b in zip(sums, exact.sum(axis=0), strict=True)]
        if n:
            yield pa.RecordBatch.from_pydict({"dim": list(range(d)), "n": [n] * d, "total": [Decimal(s) for s in sums],
                                              "largest": [largest] * d}, schema=pa.schema(
                [("dim", pa.int32()), ("n", pa.int64()), ("total", pa.decimal128(38, 0)), ("largest", pa.int64())]))

    parts = fit.mapInArrow(part, "dim int, n long, total decimal(38,0), largest long")
    rows = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("largest").alias("largest")).collect()
    rows.sort(key=lambda r: r["dim"])
    return rows[0]["n"], [int(r["total"]) for r in rows], rows[0]["largest"]


def _summed(fit: DataFrame, d: int, height: int, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of `of` (matrix to height x width): per task first, then per line of the result."""
    names = [f"c{j}" for j in range(width)]

    def part(batches):
        total = np.zeros((height, width))
        for x in _matrices(batches, d):
            total += of(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int32()), *(pa.array(total[:, j]) for j in range(width))],
                                         names=["line", *names])

    parts = fit.mapInArrow(part, "line int, " + ", ".join(f"{c} double" for c in names))
    out = np.zeros((height, width))
    for r in parts.groupBy("line").agg(*(F.sum(c).alias(c) for c in names)).collect():
        out[r[0]] = r[1:]
    return out


# ---- Jacobi-Davidson ----------------------------------------------------------------------------------------------------

def _orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """What the columns of `new` add to the orthonormal `basis`; columns that add nothing are left out."""
    out = np.zeros((len(new), 0))
    for column in new.T:
        size = np.linalg.norm(column)
        if not size > 0:
            continue
        v = column / size
        for _ in range(3):
            v = v - basis @ (basis.T @ v) - out @ (out.T @ v)
            size = np.linalg.norm(v)
            if size < 1e-8:
                break
            v = v / size
        else:
            out = np.column_stack([out, v])
    return out


def minres(apply: Product, right: np.ndarray, steps: int, aim: float = 1e-2) -> np.ndarray:
    """Approximate solutions of apply(t) = right, one symmetric system per column; one product serves all columns."""
    beta = np.linalg.norm(right, axis=0)
    first, live = np.where(beta > 0, beta, 1.0), beta > 0
    v_old, v = np.zeros_like(right), right / first
    t, w_old, w = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    cos_old, cos, sin_old, sin = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    rest, beta = beta.copy(), np.zeros_like(beta)
    for _ in range(steps):
        if not live.any():
            break
        image = apply(v)
        alpha = (v * image).sum(axis=0)
        image = image - alpha * v - beta * v_old
        beta_new = np.linalg.norm(image, axis=0)
        # the new column of the tridiagonal matrix, turned by the two rotations before, and by one of its own
        far, near = sin_old * beta, sin * alpha + cos_old * cos * beta
        diagonal = cos * alpha - cos_old * sin * beta
        length = np.hypot(diagonal, beta_new)
        safe = np.where(length > 0, length, 1.0)
        cos_new, sin_new = diagonal / safe, beta_new / safe
        w_new = (v - near * w - far * w_old) / safe
        step = np.where(live & (length > 0), cos_new * rest, 0.0)
        t = t + step * w_new
        rest = -sin_new * rest
        live = live & (length > 0) & (np.abs(rest) > aim * first) & (beta_new > 0)
        v_old, v = v, image / np.where(beta_new > 0, beta_new, 1.0)
        w_old, w, cos_old, cos, sin_old, sin, beta = w, w_new, cos, cos_new, sin, sin_new, beta_new
    return t


def eigenpairs(product: Product, d: int, k: int) -> tuple[np.ndarray, np.ndarray, int, float]:
    """The k largest eigenvalues of a symmetric operator, their vectors, rounds taken, largest residual left.

    Jacobi-Davidson in blocks: Rayleigh-Ritz on the search space, pairs whose residual is at rounding level are locked
    from the largest on, and the others' corrections solve the projected equation (I-UU')(A-value)(I-UU') t = -residual
    by a few MINRES steps. The operator is known by its products alone; one product of a block is one Spark job.
    """
    rng = np.random.default_rng(13)
    basis = _orthonormal(rng.standard_normal((d, min(d, k + GUARDS))), np.zeros((d, 0)))
    images = product(basis)
    best, idle = np.inf, 0
    for turn in range(1, MAX_ROUNDS + 1):
        small = basis.T @ images
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        vectors, products = basis @ turns[:, :k], images @ turns[:, :k]
        rests = products - vectors * values[:k]
        norms = np.linalg.norm(rests, axis=0)
        size = max(values[0], 0.0)
        good = norms <= 16 * EPS * np.sqrt(d) * size
        worst = norms.max()
        idle = 0 if worst < best / 2 else idle + 1
        best = min(best, worst)
        if good.all() or (idle >= 4 and best <= 1e-12 * size):
            return values[:k], vectors, turn, worst / size if size else 0.0
        locked = int(np.argmin(good)) if not good.all() else k  # a prefix: falling values stay in order
        open_ = [j for j in range(locked, k) if not good[j]]
        shift = values[open_]

        def projected(t: np.ndarray, u=vectors, shift=shift) -> np.ndarray:
            t = t - u @ (u.T @ t)
            image = product(t) - t * shift
            return image - u @ (u.T @ image)

        fixes = minres(projected, -rests[:, open_], INNER_STEPS)
        if basis.shape[1] + len(open_) > max(SPACES * k, k + 2 * GUARDS) and basis.shape[1] < d:
            keep = turns[:, :min(basis.shape[1], 2 * k + GUARDS)]
            basis, images = basis @ keep, images @ keep
        new = _orthonormal(fixes, basis)
        if basis.shape[1] + new.shape[1] < d and new.shape[1] < len(open_):
            new = np.column_stack([new, _orthonormal(rests[:, open_], np.column_stack([basis, new]))])
        if new.shape[1]:
            basis, images = np.column_stack([basis, new]), np.column_stack([images, product(new)])
        else:  # nothing to add: the space is whole or the rest is rounding, so products are taken afresh
            basis = _orthonormal(basis, np.zeros((d, 0)))
            images = product(basis)
    raise RuntimeError(f"residuals stay at {best:.3g} after {MAX_ROUNDS} rounds")


def fit_whitening(rows: DataFrame, k: int = 16) -> Whitening | None:
    """The whitening of `rows` (x: integer vectors of one length), learned from each distinct vector once; None if empty.

    Nothing but sums moves: the vectors of the search space (dimensions x a few dozen) go out with a product, and per
    task one partial image comes back, added up by line. Rows are centred in exact integers before they are multiplied.
    Components whose eigenvalue is zero to rounding are left out, so there may be fewer than `k`.
    """
    fit = stored(rows.select("x").distinct(), "fit_vectors")
    some = fit.first()
    if some is None:
        return None
    d = len(some["x"])
    n, sums, largest = _moments(fit, d)

    def product(block: np.ndarray) -> np.ndarray:
        def image(x, block=block):
            z = _centred(x, n, sums, largest)
            return z.T @ (z @ block)

        return _summed(fit, d, d, block.shape[1], image) / n

    trace = float(_summed(fit, d, 1, 1, lambda x: np.array([[(_centred(x, n, sums, largest) ** 2).sum()]]))[0, 0]) / n
    model = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), trace, largest)
    if trace == 0:
        return model
    values, vectors, model.rounds, model.residual = eigenpairs(product, d, min(k, d))
    real = values > 16 * d * EPS * values[0]
    values, vectors = values[real], vectors[:, real]
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])])
    model.vectors, model.values = vectors, values

    def gram(x):
        y = np.column_stack([_whitened(x, model), np.ones(len(x))])
        return y.T @ y

    k = len(values)
    moments = _summed(fit, d, k + 1, k + 1, gram) / n
    covariance = moments[:k, :k] - np.outer(moments[k, :k], moments[k, :k])
    model.identity_error = float(np.abs(covariance - np.eye(k)).max())
    return model


def _whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    return _centred(x, model.n, model.sums, model.largest) @ model.vectors / np.sqrt(model.values)


def whitened(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """Per row (vec_id, x) and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    `deviation` is the exact sum over dimensions of (n * x - sum)^2, null where a long cannot hold it. Null and repeated
    ids are kept: every row has its lines. No model, or one without components, gives no rows.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    d, k = len(model.sums), len(model.values)

    def part(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for at in range(0, batch.num_rows, 1_000):
                own = batch.slice(at, 1_000)
                x = next(_matrices(iter([own]), d))
                away = _deviations(x, model.n, model.sums, model.largest)
                if away.dtype != object and ((away.astype(np.float64) ** 2).sum(axis=1) > 2.0**62).any():
                    away = away.astype(object)
                squares = [int(s) if s <= LONG_MAX else None for s in (away * away).sum(axis=1).tolist()]
                lines = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays([
                    own.column("vec_id").cast(pa.int64()).take(pa.array(lines)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array([model.n] * len(lines), pa.int64()), pa.array(squares, pa.int64()).take(pa.array(lines)),
                    pa.array(_whitened(x, model).ravel()), pa.array(np.tile(model.values / model.trace, len(x))),
                    pa.array([model.identity_error] * len(lines), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(part, schema)
