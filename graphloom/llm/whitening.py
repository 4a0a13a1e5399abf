"""Whitening of embeddings by a bidiagonal qd solver.

The distinct vectors, as whole numbers, are centred exactly and reduced by blockwise QR: each
task folds its rows into one triangle, and triangles are folded together, a few at a time. The
last one, of as many rows as a vector has entries, is all that reaches the driver. There it is
made bidiagonal by Householder reflections; dqds finds the squares of its singular values with
high relative accuracy; and twisted factorisations of the bidiagonal's square give the vectors
that belong to them. Whitened values are projections on these, made in the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, ship
from .vectors import matrix, usable, whole

ship(__name__)

#: Triangles that are folded together in one task.
FOLD = 8
EPS = 2.0**-52
_LONG = (1 << 63) - 1


# the solver


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a, superdiagonal b and orthogonal w with r = u B w.T for an orthogonal u, by Householder reflections."""
    r = r.copy()
    d = len(r)
    w = np.eye(d)

    def reflection(x: np.ndarray) -> np.ndarray:
        v = x.copy()
        v[0] += math.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(v)
        return v / size if size else v

    for k in range(d):
        v = reflection(r[k:, k])
        r[k:, k:] -= 2 * np.outer(v, v @ r[k:, k:])
        if k < d - 2:
            v = reflection(r[k, k + 1 :])
            r[k:, k + 1 :] -= 2 * np.outer(r[k:, k + 1 :] @ v, v)
            w[:, k + 1 :] -= 2 * np.outer(w[:, k + 1 :] @ v, v)
    return np.diag(r).copy(), np.diag(r, 1).copy(), w


def sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One dqds transform and the sum of 1 / d; None if the shift was too large."""
    d, total, nq, ne = q[0] - shift, 0.0, [], []
    for k in range(len(e)):
        if not d > 0:
            return None
        total += 1 / d
        x = d + e[k]
        t = q[k + 1] / x
        nq.append(x)
        ne.append(e[k] * t)
        d = d * t - shift
    if not d > 0:
        return None
    return [*nq, d], ne, total + 1 / d


def guess(q: list[float], e: list[float]) -> float:
    """The least eigenvalue of the last two rows, less the distance within which one of the whole must be."""
    x, y, off = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1], math.sqrt(q[-2] * e[-1])
    half = (x - y) / 2
    root = math.hypot(half, off)
    least = y - off * off / (half + root) if half + root > 0 else y - root + half
    part = off / math.hypot(off, x - least) if off else 0.0
    return least - (math.sqrt(q[-3] * e[-2]) * part if len(e) > 1 else 0.0)


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Eigenvalues, falling, of B.T B, where B has the roots of q, all above nought, on its diagonal and those of e above it."""
    found, todo = [], [(list(q), list(e), 0.0, 0.0)]
    while todo:
        q, e, shifted, rest = todo.pop()
        safe = 0.0
        while len(q) > 1:
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= EPS * EPS * min(shifted + q[k], shifted + q[k + 1])), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], shifted, rest))
                q, e, safe = q[cut + 1 :], e[cut + 1 :], 0.0
                continue
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            # a guess that failed isn't tried again before a safe shift has changed the numbers
            shift = safe or guess(q, e) * (1 - 4 * EPS)
            made = sweep(q, e, shift) if shift > 0 else None
            if made is None:
                # without a shift it always works, and 1 / sum(1 / d) is no more than the least eigenvalue
                shift, made = 0.0, sweep(q, e, 0.0)
            safe = 0.0 if shift else (1 - len(q) * 8 * EPS) / made[2]
            q, e = made[:2]
            # a compensated sum of shifts
            more = shift + rest
            total = shifted + more
            rest, shifted = more - (total - shifted), total
        if q:
            found.append(q[0] + rest + shifted)
    return sorted(found, reverse=True)


class Twisted:
    """Twisted factorisation of B.T B - value, from B's diagonal a and superdiagonal b."""

    def __init__(self, a: np.ndarray, b: np.ndarray, value: float):
        n = len(a)
        d, l = (a * a).tolist(), (b / a[:-1]).tolist()  # noqa: E741
        tiny = EPS * EPS * max(d)
        solid = lambda x: x if abs(x) > tiny else tiny
        self.lower, self.upper, self.top, self.bottom = [0.0] * (n - 1), [0.0] * (n - 1), [0.0] * n, [0.0] * n
        s = [-value] * n
        for k in range(n - 1):
            self.top[k] = solid(s[k] + d[k])
            self.lower[k] = d[k] * l[k] / self.top[k]
            s[k + 1] = self.lower[k] * l[k] * s[k] - value
        p = [d[-1] - value] * n
        for k in range(n - 2, -1, -1):
            self.bottom[k + 1] = solid(d[k] * l[k] * l[k] + p[k + 1])
            t = d[k] / self.bottom[k + 1]
            self.upper[k] = l[k] * t
            p[k] = p[k + 1] * t - value
        self.gamma = [x + y + value for x, y in zip(s, p, strict=True)]
        self.twist = min(range(n), key=lambda k: abs(self.gamma[k]))
        self.pivot = solid(self.gamma[self.twist])

    def vector(self) -> np.ndarray:
        """The vector that the factors annihilate but for the twist."""
        return self._back(np.eye(1, len(self.gamma), self.twist)[0])

    def _back(self, y: np.ndarray) -> np.ndarray:
        z = y.tolist()
        for k in range(self.twist - 1, -1, -1):
            z[k] -= self.lower[k] * z[k + 1]
        for k in range(self.twist, len(z) - 1):
            z[k + 1] -= self.upper[k] * z[k]
        return np.array(z)

    def solve(self, x: np.ndarray) -> np.ndarray:
        """One step of inverse iteration."""
        v, r = x.tolist(), self.twist
        for k in range(r):
            v[k + 1] -= self.lower[k] * v[k]
        for k in range(len(v) - 1, r, -1):
            v[k - 1] -= self.upper[k - 1] * v[k]
        pivot = [*self.top[:r], self.pivot, *self.bottom[r + 1 :]]
        return self._back(np.array(v) / np.array(pivot))


def block_vectors(a: np.ndarray, b: np.ndarray, values: list[float]) -> np.ndarray:
    """Unit vectors, as rows, of B.T B for the given eigenvalues, falling, of a B that doesn't fall into parts."""
    out = np.zeros((len(values), len(a)))
    start = 0
    rng = np.random.default_rng(7)
    for k, value in enumerate(values):
        factors = Twisted(a, b, value)
        if k and values[k - 1] - value > 1e-3 * values[k - 1]:
            start = k
        near = out[start:k]
        z = factors.vector()
        z /= np.linalg.norm(z)
        if len(near):
            # of a cluster: kept orthogonal to the vectors before, by inverse iteration
            y = z - near.T @ (near @ z)
            for _ in range(4):
                if np.linalg.norm(y) < 0.1:
                    y = rng.normal(size=len(a))
                for _ in range(2):
                    y -= near.T @ (near @ y)
                y /= np.linalg.norm(y)
                y = factors.solve(y)
                y /= np.linalg.norm(y)
                y -= near.T @ (near @ y)
            y -= near.T @ (near @ y)
            z = y / np.linalg.norm(y)
        out[k] = z
    return out


def right_vectors(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest singular values of a square matrix, falling, and their right vectors, as rows; at most so many.

    The vectors of values that are nought within rounding aren't orthogonal to each other.
    """
    d = len(r)
    scale = np.abs(r).max(initial=0)
    if not scale:
        return np.zeros(min(most, d)), np.eye(d)[:most]
    a, b, w = bidiagonal(r / scale)
    size = max(np.abs(a).max(), np.abs(b).max(initial=0))
    # entries below the rounding of the largest one are as good as any such
    a = np.where(np.abs(a) < EPS * size / 16, EPS * size / 16, a)
    parts = np.flatnonzero(np.abs(b) <= EPS * np.minimum(np.abs(a[:-1]), np.abs(a[1:])) / 16) + 1
    found = []
    for lo, hi in zip(np.r_[0, parts], np.r_[parts, d], strict=True):
        own, above = a[lo:hi], b[lo : hi - 1]
        values = dqds((own * own).tolist(), (above * above).tolist())[:most]
        for value, z in zip(values, block_vectors(own, above, values), strict=True):
            found.append((value, np.pad(z, (lo, d - hi))))
    found = sorted(found, key=lambda x: -x[0])[:most]
    vectors = np.stack([z for _, z in found]) @ w.T
    vectors *= np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
    return scale * np.sqrt([value for value, _ in found]), vectors


# the work in tasks


def exact(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, as Python's numbers where long doesn't hold them."""
    if (int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)) < _LONG:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def deviations(y: np.ndarray) -> pa.Array:
    """Sums of squares of the rows; null where long doesn't hold one."""
    most = int(np.abs(y).max(initial=0))
    if most * most * y.shape[1] <= _LONG:
        return pa.array((y.astype(np.int64) ** 2).sum(axis=1))
    return pa.array([t if (t := sum(int(v) ** 2 for v in row)) <= _LONG else None for row in y.tolist()], type=pa.int64())


def _sums(fill: int, dim: int):
    """j, n and the sum of entry j, for each batch."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"), fill, dim)
                # in two parts, so that no sum of a batch leaves the range of long
                total = [(int(h) << 26) + int(low) for h, low in zip((x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0), strict=True)]
                yield pa.RecordBatch.from_pydict({"j": pa.array(range(dim), pa.int32()), "n": pa.array([len(x)] * dim, pa.int64()), "s": pa.array(list(map(Decimal, total)), pa.decimal128(38, 0))})

    return sums


def _triangle(fill: int, n: int, sums: list[int]):
    """One triangle for each task: the R of its centred rows."""

    def triangle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, len(sums)))
        for batch in batches:
            y = exact(matrix(batch.column("x"), fill, len(sums)), n, sums).astype(float) / n
            r = np.linalg.qr(np.vstack([r, y]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "r": [r.tobytes()]})

    return triangle


def _fold(dim: int):
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [np.frombuffer(x).reshape(-1, dim) for x in pdf.sort_values("part")["r"]]
        return pd.DataFrame({"part": [int(pdf["to"].iat[0])], "r": [np.linalg.qr(np.vstack(rows), mode="r").tobytes()]})

    return fold


def reduced(fit: DataFrame, fill: int, n: int, sums: list[int]) -> np.ndarray:
    """The R of all centred rows, square."""
    dim = len(sums)
    parts = checkpoint(fit.mapInArrow(_triangle(fill, n, sums), "part long, r binary"))
    while parts.count() > 1:
        parts = checkpoint(parts.withColumn("to", F.expr(f"part div {FOLD}")).groupBy("to").applyInPandas(_fold(dim), "part long, r binary"))
    r = np.frombuffer(parts.first()["r"]).reshape(-1, dim)
    return np.pad(r, ((0, dim - len(r)), (0, 0)))


def _moments(fill: int, n: int, sums: list[int], to: np.ndarray):
    """i, j and the sums of products of whitened values i and j (-1: 1), for each task."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = to.shape[1]
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            y = exact(matrix(batch.column("x"), fill, len(sums)), n, sums).astype(float) / n @ to
            y = np.column_stack([np.ones(len(y)), y])
            total += y.T @ y
        i, j = np.indices(total.shape, dtype=np.int32)
        yield pa.RecordBatch.from_pydict({"i": i.ravel() - 1, "j": j.ravel() - 1, "s": total.ravel()})

    return moments


def identity_error(fit: DataFrame, fill: int, n: int, sums: list[int], to: np.ndarray) -> float:
    """The largest absolute entry of the whitened values' covariance minus the identity."""
    k = to.shape[1]
    found = fit.mapInArrow(_moments(fill, n, sums, to), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    m = np.zeros((k + 1, k + 1))
    m[found["i"] + 1, found["j"] + 1] = found["s"] / n
    return float(np.abs(m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) - np.eye(k)).max(initial=0))


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each row and component.

    An entry c, as double, counts as x = floor(scale * c) + offset, the floor being held within 2 ** 53 either way. Mean,
    covariance (divisor n) and components are those of the n distinct vectors x with sums S per entry. deviation: the sum of
    (n * x - S) ** 2, exact, null where long doesn't hold it. whitened: x - S / n projected on the component, over the
    root of its variance. explained: the variance's share of the whole. The sign of a component is such that its largest entry
    is above nought; components of equal variance are some orthogonal ones. A component without variance (all rows
    alike, fewer rows than entries, entries that follow from others) has explained 0, null if there is no variance at all, and
    whitened null, and doesn't count in identity_error. Rows whose vector is null or holds null or non-finite entries are left
    out; a shorter vector, an empty one too, counts as ending with noughts (c = 0), and if all are empty there are no
    components and no rows. Repeated rows, and rows without an id or with equal ids, come out as often as they are. An empty table gives no rows. Other
    columns, whatever their names, are ignored.
    """
    rows = usable(vectors, vector).select(F.col(id_column).cast("long").alias("vec_id"), whole(vector, scale, offset).alias("x"))
    fit = checkpoint(rows.select("x").distinct())
    dim = fit.agg(F.max(F.size("x"))).first()[0] or 0
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dim:
        return vectors.sparkSession.createDataFrame([], schema)
    totals = fit.mapInArrow(_sums(offset, dim), "j int, n long, s decimal(38,0)").groupBy("j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("j").collect()
    n, sums = totals[0]["n"], [int(r["s"]) for r in totals]
    r = reduced(fit, offset, n, sums)
    sigma, axes = right_vectors(r, components)
    e = sigma * sigma / n
    whole_variance = float((r * r).sum()) / n
    some = sigma > sigma.max(initial=0) * dim * 2.0**-44
    to = (axes[some] / np.sqrt(e[some])[:, None]).T
    error = identity_error(fit, offset, n, sums, to)
    share = np.where(some, e, 0) / whole_variance if whole_variance else np.full(len(e), np.nan)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(sigma)
        for batch in batches:
            m = batch.num_rows
            y = exact(matrix(batch.column("x"), offset, dim), n, sums)
            white = np.zeros((m, k))
            white[:, some] = y.astype(float) / n @ to
            row = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column("vec_id").take(row),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m),
                    "n": np.full(m * k, n, dtype=np.int64),
                    "deviation": deviations(y).take(row),
                    "whitened": pa.array(white.ravel(), mask=np.tile(~some, m)),
                    "explained": pa.array(np.tile(share, m), mask=np.tile(np.isnan(share), m)),
                    "identity_error": np.full(m * k, error),
                }
            )

    return rows.mapInArrow(project, schema)
