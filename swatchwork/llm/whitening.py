"""Embedding whitening by QDWH spectral divide and conquer.

Two passes over the vectors sum them and, centred, their products; the sums of a task leave it as one
row a dimension. The covariance, whose size does not depend on the number of vectors, is then split:
the polar factor of the covariance minus a shift is the matrix sign, half of sign plus identity is the
projector on the eigenvectors above the shift, and its range and the complement are split on their own,
until each part has one eigenvalue. The components are broadcast and every vector is projected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from swatchwork.runtime import bounded_batches

EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class WhitenParams:
    """Entries become floor(``scale`` * entry) + ``offset``. ``components``: at most so many are returned.
    ``max_dim``: a covariance of more dimensions is refused, since the driver holds it."""

    column: str = "embedding"
    components: int = 32
    scale: int = 64
    offset: int = 1_000_000
    max_dim: int = 4096


@dataclass(frozen=True)
class Whitening:
    """``n`` fitted vectors with sums ``s`` (exact integers), eigenvalues and their vectors as columns, both by
    falling eigenvalue, and the trace of the covariance."""

    n: int
    s: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def matrix_sign(a: np.ndarray) -> np.ndarray:
    """Polar factor of a symmetric matrix by QDWH: dynamically weighted Halley steps by QR."""
    m = len(a)
    x = a / np.linalg.norm(a)
    low = max(1 / np.linalg.norm(np.linalg.inv(x)), EPS) if np.linalg.cond(x) < 1 / EPS else EPS
    for _ in range(60):
        l2 = low * low
        d = (4 * max(0.0, 1 - l2) / (l2 * l2)) ** (1 / 3)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - l2) / (l2 * root))) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(m)]))[0]
        new = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:m] @ q[m:].T)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (wa + wb * l2) / (1 + wc * l2))
        if moved <= 10 * EPS ** (1 / 3) and abs(1 - low) <= 10 * EPS:
            break
    return x


def _halves(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None where ``a`` is a multiple
    of the identity but for rounding."""
    m = len(a)
    mean = np.trace(a) / m
    spread = np.linalg.norm(a - mean * np.eye(m)) / np.sqrt(m)
    if spread <= 4 * EPS * scale:
        return None
    best = None
    for step in (0.0, 0.01, -0.01, 0.037, -0.037, 0.11, -0.11, 0.29, -0.29, 0.003, -0.003):
        sign = matrix_sign(a - (mean + step * spread) * np.eye(m))
        above = round((np.trace(sign) + m) / 2)
        if not 0 < above < m:
            continue
        # An orthonormal basis of the projector's range, then of its complement: the sign maps a random
        # block almost into both, and one more application cleans it.
        up, down = (np.eye(m) + sign) / 2, (np.eye(m) - sign) / 2
        order = np.argsort(-np.diag(up), kind="stable")
        q = np.linalg.qr(up @ np.linalg.qr(up[:, order[:above]])[0])[0]
        p = np.linalg.qr(down @ np.linalg.qr(down[:, order[::-1][: m - above]])[0])[0]
        off = max(np.linalg.norm(q.T @ a @ p), np.linalg.norm(q.T @ p) * scale)
        if best is None or off < best[0]:
            best = (off, q, p)
        if off <= 16 * m * EPS * scale:
            break
    if best is None and spread > 1e-10 * scale:
        raise ArithmeticError("no shift splits the covariance")
    return best and (best[1], best[2])


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and unit eigenvectors as columns, by spectral divide and conquer."""
    scale = max(float(np.linalg.norm(a)), np.finfo(float).tiny)
    parts, open_ = [], [np.eye(len(a))]
    while open_:
        basis = open_.pop()
        own = basis.T @ a @ basis
        own = (own + own.T) / 2
        halves = _halves(own, scale) if basis.shape[1] > 1 else None
        if halves is None:
            parts.append(basis)
        else:
            open_ += [basis @ h for h in halves]
    # Splits leave rounding between branches: two steps correct it, two more make the vectors orthogonal.
    v = np.hstack(parts)
    for _ in range(2):
        v = _corrected(a, v, scale)
    for _ in range(2):
        v = v @ (1.5 * np.eye(len(a)) - 0.5 * (v.T @ v))
    values = np.einsum("ij,ij->j", v, a @ v)
    order = np.argsort(-values, kind="stable")
    return values[order], v[:, order]


def _corrected(a: np.ndarray, v: np.ndarray, scale: float) -> np.ndarray:
    """One step of first-order correction: off-diagonal parts of V'AV over the gaps of eigenvalues, and of
    V'V; vectors whose eigenvalues are too near for that are only made orthogonal."""
    r, s = np.eye(len(a)) - v.T @ v, v.T @ a @ v
    values = np.diag(s) / (1 - np.diag(r))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > 1e3 * EPS * scale
    step = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), 1)
    step = np.where(np.abs(step) < 1e-6, step, r / 2)
    np.fill_diagonal(step, np.diag(r) / 2)
    return v + v @ step


def _matrix(batch: pa.RecordBatch, p: WhitenParams) -> np.ndarray:
    """The entries of a batch as long x."""
    v = batch.column("v")
    flat = v.flatten().to_numpy(zero_copy_only=False)
    return np.floor(p.scale * flat.reshape(len(batch), -1)).astype(np.int64) + p.offset


def _sums(batches: Iterator[pa.RecordBatch], p: WhitenParams) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for batch in batches:
        if len(batch):
            x = _matrix(batch, p)
            # Halves of 31 bits, so that no sum of a batch leaves the range of a long.
            part = [(int(h) << 31) + int(lo) for h, lo in zip((x >> 31).sum(axis=0), (x & ((1 << 31) - 1)).sum(axis=0))]
            n, total = n + len(batch), part if total is None else [a + b for a, b in zip(total, part)]
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array(list(map(str, total)))], ["i", "n", "total"])


def _products(rows: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows and of the products of their columns, one output row a column."""
    first, second = None, None
    for y in rows:
        one, two = y.sum(axis=0), y.T @ y
        first, second = (one, two) if first is None else (first + one, second + two)
    if second is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(first)), pa.int32()), pa.array(first, pa.float64()), pa.array(list(second), pa.list_(pa.float64()))], ["i", "total", "products"])


def _summed(parts: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Totals and products of all tasks: d and d x d numbers, whatever the number of vectors."""
    flat = parts.select("i", F.posexplode(F.concat(F.array("total"), F.col("products"))).alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((d, d + 1))
    out[flat["i"].to_numpy(), flat["j"].to_numpy()] = flat["v"].to_numpy()
    return out[:, 0], out[:, 1:]


def usable(vectors: DataFrame, p: WhitenParams) -> DataFrame:
    """``vec_id, v``: rows with a vector of finite entries that fit a long once scaled, and of the most
    frequent length (of several the largest)."""
    v = F.col(p.column).cast("array<double>")
    most = (1 << 62) / p.scale
    # A comparison is null for null, false for NaN's absolute value here, and false for the infinities.
    fine = F.coalesce(F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < most)), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(fine & (F.size("v") > 0))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("v") == (usual["d"] if usual else 0))


def fit(rows: DataFrame, p: WhitenParams = WhitenParams()) -> Whitening | None:
    """Components of the covariance of ``rows`` (a frame of ``usable``); None without rows."""
    sums = rows.mapInArrow(lambda it: _sums(it, p), "i int, n long, total string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found: list[Row] = sums.orderBy("i").limit(p.max_dim + 1).collect()
    if not found:
        return None
    if len(found) > p.max_dim:
        raise ValueError(f"vectors of more than {p.max_dim} dimensions")
    n, s = found[0]["n"], [int(r["total"]) for r in found]
    # Centred at the whole number below the mean, so that products are whole numbers and their order does not
    # matter; the part of the mean behind it is taken off at the end.
    centre = np.array([t // n for t in s], np.int64)
    rest = np.array([(t % n) / n for t in s])
    parts = rows.mapInArrow(lambda it: _products((_matrix(b, p) - centre).astype(float) for b in it if len(b)), "i int, total double, products array<double>")
    _, products = _summed(parts, len(s))
    v = products / n - np.outer(rest, rest)
    v = (v + v.T) / 2
    values, vectors = eigen(v)
    return Whitening(n, tuple(s), values, vectors, float(np.trace(v)))


def _projection(model: Whitening, p: WhitenParams) -> np.ndarray:
    """Eigenvectors over the roots of their eigenvalues; NaN for components without variance."""
    k = min(p.components, len(model.values))
    values = np.where(model.values[:k] > 64 * EPS * max(model.trace, 0.0), model.values[:k], np.nan)
    return model.vectors[:, :k] / np.sqrt(values)


def _centred(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, list[int | None]]:
    """n * x - S as floats, and the exact sums of its squares; None where they leave the range of a long."""
    wide = max(map(abs, model.s)) + model.n * int(np.abs(x).max()) >= 1 << 62
    y = model.n * x.astype(object) - np.array(model.s, object) if wide else model.n * x - np.array(model.s, np.int64)
    far = int(np.abs(y).max())
    squares = (y.astype(object) ** 2 if far * far * y.shape[1] >= 1 << 63 else y * y).sum(axis=1)
    return y.astype(float), [int(t) if t < 1 << 63 else None for t in squares]


def _whitened(batches: Iterator[pa.RecordBatch], model: Whitening, p: WhitenParams) -> Iterator[pa.RecordBatch]:
    w = _projection(model, p)
    for batch in batches:
        if len(batch):
            y, squares = _centred(_matrix(batch, p), model)
            z = pa.array(list((y / model.n) @ w), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(squares, pa.int64()), z], ["vec_id", "deviation", "z"])


def whiten(vectors: DataFrame, p: WhitenParams = WhitenParams()) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every usable row of
    ``vectors`` (vec_id and the vector column) and every component.

    Rows whose vector is null, empty, holds null or non-finite entries or entries beyond a long, or has not
    the most frequent length, are left out. Repeated rows count and are returned each; a null vec_id stays
    null; other columns are ignored. ``deviation`` is null where it leaves the range of a long, ``whitened``
    for components without variance, ``explained`` where no dimension has any, and ``identity_error``, over the
    components with variance, where there are none. An empty table gives an empty result.
    """
    rows = bounded_batches(usable(vectors, p))
    model = fit(rows, p)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    k = min(p.components, len(model.values))
    shown = rows.mapInArrow(lambda it: _whitened(it, model, p), "vec_id long, deviation long, z array<double>")
    error = whitened_error(shown, model.n, k)
    share = [float(e) / model.trace if model.trace > 0 else None for e in model.values[:k]]
    flat = shown.select("vec_id", "deviation", F.posexplode("z").alias("at", "z"))
    return flat.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.nanvl(F.col("z"), F.lit(None).cast("double")).alias("whitened"),
        F.element_at(F.array(*(F.lit(e).cast("double") for e in share)), F.col("at") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def whitened_error(shown: DataFrame, n: int, k: int) -> float | None:
    """Largest absolute entry of the covariance of the column ``z`` minus the identity, over the components
    that are no NaN."""
    z = lambda b: b.column("z").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
    parts = shown.mapInArrow(lambda it: _products(z(b) for b in it if len(b)), "i int, total double, products array<double>")
    total, products = _summed(parts, k)
    held = np.flatnonzero(~np.isnan(total))
    if not len(held):
        return None
    # The vectors are centred before they are projected; what rounding leaves of the mean is taken off.
    mean = total[held] / n
    return float(np.abs(products[np.ix_(held, held)] / n - np.outer(mean, mean) - np.eye(len(held))).max())
