"""Whitening of embeddings by spectrum slicing of their covariance.

The covariance is summed by the tasks, centred before it is multiplied.  Its leading
eigenpairs are found on the driver, whose work depends on the vectors' length only:
LDL^T factorisations of the shifted covariance (in its tridiagonal form) count the
eigenvalues above a shift, bisection on these counts isolates each leading one,
Rayleigh quotient iteration converges cubically from there, and two more counts
around the result certify its number.  Rows are then projected where they lie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, shuffle_parts

EPS = float(np.finfo(np.float64).eps)
RANK = 1e-12                 # eigenvalues up to this share of the largest count as zero
SHIFT = 1_000_000
LOW, HIGH = -(1 << 62), 1 << 62
SAFE = 1 << 62
LONG_END = (1 << 63) - 1
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# ------------------------------------------------------------ eigenpairs

def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix (Householder)."""
    a = v.copy()
    n = len(a)
    for j in range(n - 2):
        x = a[j + 1:, j].copy()
        size = np.linalg.norm(x)
        if size == 0 or not np.any(x[1:]):
            continue
        x[0] += size if x[0] >= 0 else -size
        x /= np.linalg.norm(x)
        block = a[j + 1:, j + 1:]
        p = block @ x
        p -= (x @ p) * x
        block -= 2 * (np.outer(x, p) + np.outer(p, x))
        a[j + 1:, j] -= 2 * x * (x @ a[j + 1:, j])
        a[j, j + 1:] = a[j + 1:, j]
    return np.diag(a).copy(), np.diag(a, -1).copy()


class Inertia:
    """Counts of eigenvalues above a shift: the positive pivots of an LDL^T factorisation."""

    def __init__(self, v: np.ndarray):
        diag, off = tridiagonal(v)
        self.diag, self.off2 = diag.tolist(), [0.0, *(off * off).tolist()]
        reach = np.abs(off)
        reach = np.concatenate([reach, [0.0]]) + np.concatenate([[0.0], reach])
        self.scale = float((np.abs(diag) + reach).max(initial=0.0))
        self.seen = {float((diag - reach).min()) - EPS * self.scale - 1e-300: len(diag),
                     float((diag + reach).max()) + EPS * self.scale + 1e-300: 0}

    def above(self, shift: float) -> int:
        if shift not in self.seen:
            tiny = EPS * EPS * self.scale + 1e-300
            pivot, count = 1.0, 0
            for d, o in zip(self.diag, self.off2):
                pivot = d - shift - o / pivot
                if abs(pivot) < tiny:
                    pivot = -tiny
                count += pivot > 0
            self.seen[shift] = count
        return self.seen[shift]

    def bracket(self, j: int) -> tuple[float, float]:
        """The tightest shifts seen with eigenvalue j (from 1, falling) between them."""
        return max(s for s, c in self.seen.items() if c >= j), min(s for s, c in self.seen.items() if c < j)


def leading_pairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` leading eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    Fewer if fewer eigenvalues exceed ``RANK`` times the largest.  Multiple eigenvalues
    get orthonormal vectors.
    """
    dim = len(v)
    if not dim or not np.any(v):
        return np.zeros(0), np.zeros((dim, 0))
    inertia = Inertia(v)
    fine = 4 * EPS * inertia.scale
    values, vectors = [], np.zeros((dim, 0))
    rng = np.random.default_rng(12)
    for j in range(1, min(k, dim) + 1):
        if values and inertia.above(max(RANK * values[0], fine)) < j:
            break

        def narrow(width: float) -> tuple[float, float]:
            lo, hi = inertia.bracket(j)
            while hi - lo > width and (inertia.above(lo) != j or inertia.above(hi) != j - 1 or hi - lo > 1e-2 * abs(hi)):
                mid = (lo + hi) / 2
                if not lo < mid < hi:
                    break
                lo, hi = (mid, hi) if inertia.above(mid) >= j else (lo, mid)
            return lo, hi

        def free(x: np.ndarray) -> np.ndarray:
            for _ in range(2):
                x = x - vectors @ (vectors.T @ x)
            return x / np.linalg.norm(x)

        def solve(shift: float, x: np.ndarray) -> np.ndarray:
            for nudge in (0.0, fine, -fine, 16 * fine):
                try:
                    y = np.linalg.solve(v - (shift + nudge) * np.eye(dim), x)
                except np.linalg.LinAlgError:
                    continue
                if np.isfinite(y).all() and np.any(y):
                    return y
            return x

        def certified(e: float) -> bool:
            near = dim * fine
            return inertia.above(e - near) >= j and inertia.above(e + near) < j

        def iterate(lo: float, hi: float, cubic: bool) -> tuple[float, np.ndarray]:
            x = free(rng.normal(size=dim))
            shift = (lo + hi) / 2
            for _ in range(2):
                x = free(solve(shift, x))
            for _ in range(12):
                e = float(x @ v @ x)
                if np.linalg.norm(v @ x - e * x) <= fine:
                    break
                x = free(solve(e if cubic else shift, x))
            return float(x @ v @ x), x

        lo, hi = narrow(fine)
        e, x = iterate(lo, hi, True)
        if not (lo - fine <= e <= hi + fine and certified(e)):
            # it ran to another eigenvalue: bisect to the last digit, iterate with that fixed shift
            while hi - lo > fine:
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if inertia.above(mid) >= j else (lo, mid)
            e, x = iterate(lo, hi, False)
            if not certified(e):
                raise ArithmeticError(f"eigenvalue {j} could not be certified")
        values.append(e)
        x = x if x[np.abs(x).argmax()] > 0 else -x
        vectors = np.hstack([vectors, x[:, None]])
    return np.array(values), vectors


# ------------------------------------------------------- sums over all rows

def vectors_of(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``__id, __vec`` of the rows whose vector is neither null nor holds a null or non-finite entry."""
    finite = F.forall("__vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    named = rows.select(F.col(id_col).cast("long").alias("__id"), F.transform(F.col(vec_col), lambda c: c.cast("double")).alias("__vec"))
    return named.filter(F.col("__vec").isNotNull() & F.coalesce(finite, F.lit(False)))


def _x(col: pa.Array, dim: int) -> np.ndarray:
    """floor(64 c) + 1000000 as long, cut to +-2^62."""
    c = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim)
    with np.errstate(over="ignore"):
        y = np.floor(64.0 * c)
    exact = np.abs(y) < 2.0 ** 53
    return np.where(exact, np.where(exact, y, 0).astype(np.int64) + SHIFT, np.clip(y, float(LOW), float(HIGH)).astype(np.int64))


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - S, exact: int64 where that holds it, else Python integers."""
    s = [abs(t) for t in total]
    if n * max(1, int(np.abs(x).max(initial=0))) + max(s, default=0) < SAFE:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def deviations(c: np.ndarray) -> np.ndarray:
    """Row sums of squares, exact; beyond a long cut to its end."""
    if c.dtype != object and c.size and int(np.abs(c).max()) ** 2 * c.shape[1] < SAFE:
        return (c * c).sum(1)
    return np.array([min(sum(int(v) * int(v) for v in row), LONG_END) for row in c.tolist()], np.int64)


def _summed(df: DataFrame, run, add, name: str = "sums"):
    """What ``run`` yields per task, added up by ``add`` in two levels of tasks; one blob of fixed size, or None."""
    def total(batches):
        got = None
        for b in batches:
            for blob in b.column(name).to_pylist():
                got = blob if got is None else add(got, blob)
        if got is not None:
            yield pa.RecordBatch.from_arrays([pa.array([got], pa.binary())], names=[name])

    def first(batches):
        blob = run(batches)
        if blob is not None:
            yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=[name])

    schema = f"{name} binary"
    some = df.mapInArrow(first, schema).repartition(min(16, shuffle_parts(df.sparkSession))).mapInArrow(total, schema)
    got = some.repartition(1).mapInArrow(total, schema).first()
    return None if got is None else got[0]


def column_sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """n and the exact sum of x per dimension."""
    def pack(n, sums):
        return b"".join(int(v).to_bytes(16, "little", signed=True) for v in (n, *sums))

    def ints(blob):
        return [int.from_bytes(blob[i:i + 16], "little", signed=True) for i in range(0, len(blob), 16)]

    def run(batches):
        n, sums = 0, [0] * dim
        for b in batches:
            x = _x(b.column("__vec"), dim)
            n += len(x)
            # two halves, so that int64 sums of a batch cannot overflow
            high, low = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
            sums = [s + (h << 32) + l for s, h, l in zip(sums, high, low)]
        return pack(n, sums) if n else None

    got = _summed(rows, run, lambda a, b: pack(*((v := [x + y for x, y in zip(ints(a), ints(b))])[:1]), v[1:]))
    if got is None:
        return 0, [0] * dim
    n, *sums = ints(got)
    return n, sums


def _float_add(a: bytes, b: bytes) -> bytes:
    return (np.frombuffer(a) + np.frombuffer(b)).tobytes()


def covariance(rows: DataFrame, dim: int, n: int, total: list[int]) -> np.ndarray:
    """Covariance (divisor n) of x, centred before it is multiplied."""
    def run(batches):
        got = None
        for b in batches:
            y = centred(_x(b.column("__vec"), dim), n, total).astype(np.float64) / n
            got = y.T @ y if got is None else got + y.T @ y
        return None if got is None else np.ascontiguousarray(got).tobytes()

    v = np.frombuffer(_summed(rows, run, _float_add)).reshape(dim, dim) / n
    return (v + v.T) / 2


def whiten(vectors: DataFrame, most: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per remaining row and component.

    Rows with a null vector or a null or non-finite entry are dropped.  All others,
    null and repeated ids among them, are fitted and returned; their entries c become x =
    floor(64 c) + 1000000 (cut to +-2^62).  Vectors have one length: those of another
    length than the most common one (of two, the longer) have no place in the
    space and are dropped like null ones.  Components whose eigenvalue is not above
    1e-12 of the largest have no direction and get no rows; equal vectors or a
    single row thus give an empty result, and so does an empty table.  A deviation
    beyond a long is cut to its end.  Other columns are not read.
    """
    spark = ready(vectors.sparkSession)
    rows = vectors_of(vectors, id_col, vec_col)
    lengths = rows.groupBy(F.size("__vec").alias("dim")).agg(F.count(F.lit(1)).alias("rows"))
    common = lengths.orderBy(F.desc("rows"), F.desc("dim")).first()
    dim = common["dim"] if common else 0
    rows = rows.filter(F.size("__vec") == dim)
    n, total = column_sums(rows, dim) if dim else (0, [])
    v = covariance(rows, dim, n, total) if n else np.zeros((0, 0))
    values, vecs = leading_pairs(v, most)
    if not len(values):
        return spark.createDataFrame([], OUT)
    k = len(values)
    project = vecs / np.sqrt(values)

    def whitened(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = centred(x, n, total)
        return c, (c.astype(np.float64) / n) @ project

    def run(batches):
        got = None
        for b in batches:
            w = np.hstack([whitened(_x(b.column("__vec"), dim))[1], np.ones((b.num_rows, 1))])
            got = w.T @ w if got is None else got + w.T @ w
        return None if got is None else np.ascontiguousarray(got).tobytes()

    # of the values that are returned: second moments and, in the last row, sums
    moments = np.frombuffer(_summed(rows, run, _float_add)).reshape(k + 1, k + 1) / n
    mean = moments[k, :k]
    error = float(np.abs(moments[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())
    explained = values / np.trace(v)

    def out(batches):
        for b in batches:
            if not b.num_rows:
                continue
            c, w = whitened(_x(b.column("__vec"), dim))
            many = b.num_rows * k
            at = np.repeat(np.arange(b.num_rows), k)
            yield pa.RecordBatch.from_arrays(
                [b.column("__id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)),
                 pa.array(np.full(many, n, np.int64)), pa.array(deviations(c)[at]), pa.array(w.ravel()),
                 pa.array(np.tile(explained, b.num_rows)), pa.array(np.full(many, error))],
                names=[c.split()[0] for c in OUT.split(", ")])

    return rows.mapInArrow(out, OUT)
