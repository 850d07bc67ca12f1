"""Embedding whitening by the exact characteristic polynomial.

Entries become integers x = floor(64 * c) + 1000000. With n vectors, their sums
S and the matrix T of the sums of products, A = n * T - S * S' is an integer
matrix: n * n times the covariance. A does not change when all x are shifted,
so the sums are taken of floor(64 * c). T and S come from one distributed pass
(exact long or integer arithmetic, summed as three limbs of 50 bits).

The polynomial det(x - A) is taken modulo primes of 31 bits, a prime a task:
reduction to Hessenberg form, then its recurrence. The coefficients are bounded
by the trace, which says how many primes Chinese remaindering takes. All roots
are real and none is negative, so by Descartes' rule the sign changes of the
polynomial shifted to a number count exactly the roots above it. The k-th
largest root is found by halving an interval, a root a task, in integers of
``BITS`` bits for the trace; multiple roots come out as often as they count.
The component is a null vector of A minus the root: inverse iteration with
``DIGITS`` decimal digits, several vectors at once for a multiple root.

On the driver there are the sums of one dimension pair each, the polynomial and
the components: all bounded by the dimensions, none by the rows.

Defined cases: a vector that is null, empty, or has a null or non-finite entry
is dropped; so is one whose length is not that of most vectors (of equally
frequent lengths, the greatest). An entry of which floor(64 * c) is beyond
a long counts as the last double within it. Components of eigenvalue 0 can't be whitened and
have no rows, so equal vectors, a single one, or an empty table give no rows. A
deviation that no long holds is null. Ids may repeat or be null; other columns,
of any name, are not looked at.
"""

from __future__ import annotations

import decimal
import math
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rowwise import quoted

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Bits of a limb of a sum.
LIMB = 50
#: Rows whose products are summed at once.
ROWS = 4096
#: Resolution of a root, as a power of two below the trace.
BITS = 160
#: Roots closer than 2 ** TIED units of that resolution count as one.
TIED = 24
DIGITS = 60
#: The greatest double that is a long.
BOUND = 2.0**63 - 1024
LONG = (1 << 63) - 1


# --- exact integers of the vectors


def integers(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that remain, their floor(64 * c) as longs)."""
    column = batch.column("vector")
    right = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(right)).flatten().cast(pa.float64())
    c = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(c).all(1)
    with np.errstate(over="ignore"):
        y = np.clip(np.floor(c[good] * SCALE), -BOUND, BOUND)
    return right[good], y.astype(np.int64)


def products(y: np.ndarray) -> np.ndarray:
    """y' * y, exact: in doubles or longs while they hold every sum, else in integers."""
    most = int(np.abs(y).max(initial=0)) ** 2 * len(y)
    if most < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    y = y if most < 1 << 62 else y.astype(object)
    return y.T.dot(y)


def vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return rows.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(vector_col)).cast("array<double>").alias("vector"))


def dimension(rows: DataFrame, vector_col: str) -> int:
    """Length of most of the vectors that remain; 0 if there is none."""
    v = F.col(quoted(vector_col)).cast("array<double>")
    good = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    sizes = rows.where(good).select(F.size(v).alias("size")).where("size > 0").groupBy("size").count()
    most = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return most["size"] if most else 0


def cells(src: DataFrame, make, kind: str) -> dict[int, list]:
    """Sums by cell of the (cell, values...) rows that make(batches) yields in
    each task; the driver gets one row a cell."""
    names = ["a", "b", "c"] if kind == "bigint" else ["a"]
    schema = "cell int, " + ", ".join(f"{n} {kind}" for n in names)

    def run(batches):
        cell, values = make(batches)
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(cell, np.int32)), *map(pa.array, values)], ["cell", *names])

    wide = "decimal(38,0)" if kind == "bigint" else "double"
    found = src.mapInArrow(run, schema).groupBy("cell").agg(*[F.sum(F.col(n).cast(wide)).alias(n) for n in names])
    return {r["cell"]: [r[n] for n in names] for r in found.collect()}


def scatter(src: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """(n, S, T) of the remaining vectors of that length, as exact integers."""
    upper = np.triu_indices(dim)

    def make(batches):
        n, s, t = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            _, y = integers(batch, dim)
            for at in range(0, len(y), ROWS):
                part = y[at:at + ROWS]
                n += len(part)
                s += part.astype(object).sum(0) if int(np.abs(part).max()) * len(part) >= 1 << 62 else part.sum(0).astype(object)
                t += products(part).astype(object)
        values = [n, *s.tolist(), *t[upper].tolist()] if n else []
        low = (1 << LIMB) - 1
        limbs = [[v & low for v in values], [v >> LIMB & low for v in values], [v >> 2 * LIMB for v in values]]
        return range(len(values)), [np.array(x, np.int64) for x in limbs]

    found = cells(src.select("vector"), make, "bigint")
    if not found:
        return 0, [0] * dim, np.zeros((dim, dim), object)
    total = [sum(int(v) << LIMB * i for i, v in enumerate(found[c])) for c in range(1 + dim + len(upper[0]))]
    t = np.zeros((dim, dim), object)
    t[upper] = total[1 + dim:]
    return total[0], total[1:1 + dim], t + np.triu(t, 1).T


# --- characteristic polynomial


def is_prime(n: int) -> bool:
    """For n below 3.2e9."""
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for b in (2, 3, 5, 7):
        x = pow(b, d, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(r - 1)):
            return False
    return True


def primes(bits: int) -> list[int]:
    """Primes below 2**31, from the greatest, whose product has more than ``bits`` bits."""
    out, n = [], 1 << 31
    while sum(p.bit_length() - 1 for p in out) <= bits:
        n -= 1
        if n % 2 and is_prime(n):
            out.append(n)
    return out


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A similar matrix modulo p that is zero below the first subdiagonal."""
    h = a.copy()
    for m in range(1, len(h) - 1):
        some = np.flatnonzero(h[m:, m - 1])
        if not len(some):
            continue
        i = m + int(some[0])
        if i != m:
            h[[m, i]] = h[[i, m]]
            h[:, [m, i]] = h[:, [i, m]]
        u = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:, m - 1:] = (h[m + 1:, m - 1:] - u[:, None] * h[m, m - 1:]) % p
        h[:, m] = (h[:, m] + (h[:, m + 1:] * u % p).sum(1)) % p
    return h


def polynomial_mod(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - a) modulo p, from x**0."""
    h = hessenberg(a, p)
    d = len(h)
    q = np.zeros((d + 1, d + 1), np.int64)
    q[0, 0] = 1
    for k in range(1, d + 1):
        new = -h[k - 1, k - 1] * q[k - 1] % p
        new[1:] += q[k - 1, :-1]
        weight, t = [], 1
        for i in range(k - 1, 0, -1):
            t = t * int(h[i, i - 1]) % p
            weight.append(t * int(h[i - 1, k - 1]) % p)
        if weight:
            new -= (np.array(weight[::-1])[:, None] * q[:k - 1] % p).sum(0)
        q[k] = new % p
    return q[d]


def remaindered(residues: list[tuple[int, list[int]]]) -> list[int]:
    """The integers of least size with these residues (prime, one for each)."""
    whole = math.prod(p for p, _ in residues)
    unit = [whole // p * pow(whole // p, -1, p) for p, _ in residues]
    out = [sum(u * r[i] for u, (_, r) in zip(unit, residues)) % whole for i in range(len(residues[0][1]))]
    return [x - whole if 2 * x > whole else x for x in out]


def in_tasks(spark: SparkSession, n: int, fn, schema: str) -> list:
    """Rows of fn(0), .., fn(n - 1), each in a task of its own."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                rows = fn(i)
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])
    return spark.range(0, n, 1, max(1, n)).mapInArrow(run, schema).collect() if n else []


def polynomial(spark: SparkSession, a: np.ndarray) -> list[int]:
    """Coefficients of det(x - a), from x**0, of a positive semidefinite integer matrix."""
    d = len(a)
    # the k-th one is at most C(d, k) * (trace / d)**k
    bits = d * (int(np.trace(a)) // d + 2).bit_length() + 2
    p = primes(bits)
    step = 4

    def fn(i):
        return [(x, polynomial_mod((a % x).astype(np.int64), x).tolist()) for x in p[step * i:step * (i + 1)]]
    found = in_tasks(spark, -(-len(p) // step), fn, "p bigint, c array<bigint>")
    return remaindered([(r["p"], r["c"]) for r in found])


# --- roots


def above(q: list[int], a: int) -> int:
    """Roots above a of a polynomial with real roots only: sign changes of q(x + a)."""
    c = list(q)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def value(q: list[int], x: int) -> int:
    out = 0
    for c in reversed(q):
        out = out * x + c
    return out


def root(q: list[int], k: int, most: int) -> int:
    """The a with the k-th largest root of q in (a, a + 1]; no root is over most."""
    low, high, n_low, n_high = -1, most, len(q) - 1, 0
    while high - low > 1:
        mid = (low + high) // 2
        if n_low - n_high == 1 and (v := value(q, mid)):  # one root: the sign tells its side
            n = n_high + ((v > 0) != (n_high % 2 == 0))
        else:
            n = above(q, mid)
        low, high, n_low, n_high = (mid, high, n, n_high) if n >= k else (low, mid, n_low, n)
    return low


def null_vectors(a: np.ndarray, shift: Decimal, count: int) -> np.ndarray:
    """Orthonormal vectors of the ``count`` eigenvalues of a next to shift, by
    inverse iteration: elimination with row exchanges, then solving anew for
    what the last round has found."""
    with decimal.localcontext() as context:
        context.prec, context.Emax, context.Emin = DIGITS, decimal.MAX_EMAX, decimal.MIN_EMIN
        d = len(a)
        u = np.array([[Decimal(int(x)) for x in row] for row in a], object)
        size = max(abs(x) for x in u.ravel()) or Decimal(1)
        for i in range(d):
            u[i, i] -= shift
        order, low = np.arange(d), np.full((d, d), Decimal(0), object)
        for k in range(d):
            i = k + max(range(d - k), key=lambda j: abs(u[k + j, k]))
            if i != k:
                u[[k, i]], low[[k, i]], order[[k, i]] = u[[i, k]], low[[i, k]], order[[i, k]]
            if abs(u[k, k]) < size.scaleb(-DIGITS):
                u[k, k] = size.scaleb(-DIGITS)
            f = u[k + 1:, k] / u[k, k]
            low[k + 1:, k] = f
            u[k + 1:, k:] = u[k + 1:, k:] - f[:, None] * u[k, k:]
        start = np.random.Generator(np.random.PCG64(d)).integers(-10**6, 10**6, (count, d))
        found = [np.array([Decimal(int(x)) for x in row], object) for row in start]
        for _ in range(4):
            solved = []
            for v in found:
                x = v[order]
                for k in range(d):
                    x[k + 1:] = x[k + 1:] - low[k + 1:, k] * x[k]
                for k in range(d - 1, -1, -1):
                    x[k] = x[k] / u[k, k]
                    x[:k] = x[:k] - u[:k, k] * x[k]
                for _ in range(2):
                    for w in solved:
                        x = x - w * (w * x).sum()
                    x = x / max(abs(e) for e in x)
                solved.append(x / (x * x).sum().sqrt())
            found = solved
        out = np.array([[float(e) for e in v] for v in found])
    return out * np.sign(out[np.arange(count), np.abs(out).argmax(1)])[:, None]


# --- model and rows


@dataclass
class Model:
    dim: int
    n: int
    sums: list            # of floor(64 * c)
    values: list          # eigenvalues of n * n times the covariance, as Decimal, falling
    axes: np.ndarray      # unit eigenvectors, a row each
    trace: int

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.values]

    def deviations(self, y: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.sums))
        if most < 1 << 62:
            return self.n * y - np.array(self.sums, np.int64)
        return self.n * y.astype(object) - np.array(self.sums, object)

    def whitened(self, t: np.ndarray) -> np.ndarray:
        scale = np.array([float(1 / v.sqrt()) for v in self.values])
        return t.astype(np.float64) @ (self.axes * scale[:, None]).T


def fit(rows: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> Model | None:
    """Components of the remaining vectors; None if all are equal or there is none."""
    spark, dim = rows.sparkSession, dimension(rows, vector_col)
    n, s, t = scatter(vectors(rows, id_col, vector_col), dim) if dim else (0, [], None)
    if not n:
        return None
    a = n * t - np.outer(np.array(s, object), np.array(s, object))
    trace, unit = int(np.trace(a)), math.gcd(*map(int, a.ravel()))
    if not trace:
        return None
    a = a // unit
    q = polynomial(spark, a)
    rank = dim - next(i for i, c in enumerate(q) if c)
    # roots in units of 2**-s
    scale = max(0, BITS - (trace // unit).bit_length())
    fine = [c << scale * (dim - i) for i, c in enumerate(q)]
    most = (trace // unit) << scale
    wanted = min(components, rank)
    found = sorted(((r["k"], int(r["a"])) for r in in_tasks(
        spark, wanted, lambda i: [(i + 1, str(root(fine, i + 1, most)))], "k bigint, a string")))
    groups: list[list[int]] = []
    for _, x in found:
        if groups and groups[-1][-1] - x < 1 << TIED:
            groups[-1].append(x)
        else:
            groups.append([x])

    def middle(x: int) -> Decimal:
        with decimal.localcontext() as context:
            context.prec = DIGITS + 20
            return Decimal(2 * x + 1) / (1 << scale + 1)

    vectors_of = in_tasks(spark, len(groups), lambda i: [
        (i, v.tolist()) for v in null_vectors(a, middle(groups[i][len(groups[i]) // 2]), len(groups[i]))], "g bigint, v array<double>")
    axes = np.array([r["v"] for r in sorted(vectors_of, key=lambda r: r["g"])])
    return Model(dim, n, s, [middle(x) * unit for _, x in found], axes, trace)


def identity_error(src: DataFrame, model: Model) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity.
    Products are centred at each task's mean; the means' own part is added."""
    k = len(model.values)

    def make(batches):
        n, total, parts = 0, np.zeros(k), []
        for batch in batches:
            _, y = integers(batch, model.dim)
            if len(y):
                w = model.whitened(model.deviations(y))
                parts.append((len(w), w.mean(0), (w - w.mean(0)).T @ (w - w.mean(0))))
                n, total = n + len(w), total + w.sum(0)
                if len(parts) > 50:  # one part for all so far
                    parts = [merged(parts, n, total / n)]
        if not n:
            return [], [np.zeros(0)]
        _, mean, centred = merged(parts, n, total / n)
        values = np.concatenate([[n], n * mean, (centred + n * np.outer(mean, mean)).ravel()])
        return range(len(values)), [values]

    def merged(parts, n, mean):
        return n, mean, sum(c + m * np.outer(v - mean, v - mean) for m, v, c in parts)

    found = cells(src.select("vector"), make, "double")
    total = np.array([found[c][0] for c in range(1 + k + k * k)])
    mean = total[1:1 + k] / total[0]
    return float(np.abs(total[1 + k:].reshape(k, k) / total[0] - np.outer(mean, mean) - np.eye(k)).max())


def project(src: DataFrame, model: Model) -> DataFrame:
    """(id, deviation, whitened array) of the remaining vectors."""
    schema = f"id {src.schema['id'].dataType.simpleString()}, deviation bigint, whitened array<double>"
    k = len(model.values)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                row, y = integers(part, model.dim)
                if not len(row):
                    continue
                t = model.deviations(y)
                if t.dtype == object or int(np.abs(t).max()) ** 2 * model.dim > LONG:
                    squares = [x if x <= LONG else None for x in (t.astype(object) ** 2).sum(1)]
                else:
                    squares = (t * t).sum(1)
                w = model.whitened(t)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k, dtype=np.int32)), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row)), pa.array(squares, pa.int64()), lists],
                                                 ["id", "deviation", "whitened"])
    return src.mapInArrow(run, schema)


def report(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error)
    for every remaining vector and component."""
    model = fit(rows, vector_col, id_col, components)
    src = vectors(rows, id_col, vector_col)
    if model is None:
        empty = src.where(F.lit(False)).select(F.col("id").alias(id_col))
        rest = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        return empty.select(id_col, *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in rest.split(", "))])
    error = identity_error(src, model)
    share = F.array(*[F.lit(x) for x in model.explained])
    out = project(src, model).select("id", "deviation", F.posexplode("whitened").alias("at", "value"))
    return out.select(F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
                      "deviation", F.col("value").alias("whitened"), F.element_at(share, F.col("at") + 1).alias("explained"),
                      F.lit(error).alias("identity_error"))
