"""Whitening of embeddings by principal components from an exact characteristic polynomial.

Method: entries are made integers, so the scatter matrix M = n * sum(y y') - s s' (which is n * n times the
covariance) is an exact integer matrix. Its characteristic polynomial is taken modulo many 31-bit primes, each
by a reduction to Hessenberg form in a task of its own, and put together by the Chinese remainder theorem. All roots are real,
so the sign changes of the polynomial shifted to a count the roots above a exactly (Descartes' rule): bisection
on that count isolates each wanted root, and bisection on the sign narrows it to over 128 bits. A component is the
null space of M less its root, found by inverse iteration in fixed-point arithmetic of 320 bits; equal roots share one
elimination and get an orthonormal basis.

Rows are only summed: tasks emit sums of dimensions and of their products, which Spark adds up. What reaches the driver is
a matrix of the dimensions, whatever the number of rows.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import release, shuffle_partitions

#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Bits of fixed-point numbers in eliminations; bits that a root has at least.
BITS, ROOT_BITS = 320, 160
#: Vector entries that are held as numbers at a time.
ENTRIES = 1 << 19
EXACT = pa.decimal128(38, 0)


def integers(batches, dim: int | None = None):
    """``ids, x``: ids as an Arrow column, and a matrix of integers, of the usable vectors of one length (``dim``, or any)."""
    for batch in batches:
        column = batch.column("vector")
        length = np.diff(column.offsets.to_numpy())
        step = max(1, ENTRIES // max(1, int(length.max(initial=1))))
        for at in range(0, batch.num_rows, step):
            part, ids = column.slice(at, step), batch.column("vec_id").slice(at, step)
            size = np.diff(part.offsets.to_numpy())
            size[part.is_null().to_numpy(zero_copy_only=False)] = 0
            flat = part.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
            starts = np.cumsum(size) - size
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.floor(SCALE * flat)
                bad = np.append(np.cumsum(~(np.abs(x) < 2.0**62)), 0)
            wrong = bad[starts + size - 1] - np.where(starts > 0, bad[starts - 1], 0)
            for d in np.unique(size[size > 0]).tolist() if dim is None else [dim]:
                own = np.flatnonzero((size == d) & (wrong == 0))
                if len(own):
                    yield ids.take(pa.array(own)), x[starts[own][:, None] + np.arange(d)].astype(np.int64) + OFFSET
    release()


def exactly(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], EXACT)


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors of the commonest length (the shorter on ties), and their sums by dimension."""

    def of(batches):
        held: dict[int, list] = {}
        for _, x in integers(batches):
            own = held.setdefault(x.shape[1], [0, 0])
            own[0] += len(x)
            small = largest(x) < 1 << 40
            own[1] = own[1] + (x.sum(axis=0).astype(object) if small else x.astype(object).sum(axis=0))
        for d, (n, total) in held.items():
            yield pa.record_batch([pa.array([d] * (d + 1), pa.int32()), pa.array(range(-1, d), pa.int32()), exactly([n, *total])], ["length", "at", "value"])

    parts = vectors.mapInArrow(of, "length int, at int, value decimal(38,0)").groupBy("length", "at").agg(F.sum("value").alias("value")).persist()
    best = parts.where("at = -1").orderBy(F.desc("value"), "length").first()
    found = {r["at"]: int(r["value"]) for r in parts.where(F.col("length") == best["length"]).collect()} if best else {-1: 0}
    parts.unpersist()
    return found[-1], [found[i] for i in range(len(found) - 1)]


def scatter(vectors: DataFrame, n: int, total: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``M, centre, rest``: M[i][j] = n * sum(y_i y_j) - rest_i rest_j with y = x - centre, exact Python integers; rest sums y."""
    d = len(total)
    centre = np.array([t // n for t in total], np.int64)
    rest = np.array([t - n * int(c) for t, c in zip(total, centre)], object)
    row, column = np.tril_indices(d)

    def of(batches):
        held = np.zeros((d, d), object)
        for _, x in integers(batches, d):
            y = x - centre
            if largest(y) ** 2 * len(y) < 1 << 53:  # exact in doubles
                y = y.astype(np.float64)
                held = held + (y.T @ y).astype(np.int64).astype(object)
            else:
                y = y.astype(object)
                held = held + y.T @ y
        yield pa.record_batch([pa.array(row, pa.int32()), pa.array(column, pa.int32()), exactly(held[row, column])], ["i", "j", "value"])

    out = np.zeros((d, d), object)
    for r in vectors.mapInArrow(of, "i int, j int, value decimal(38,0)").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = int(r["value"])
    return n * out - np.outer(rest, rest), centre, rest


def primes_below(limit: int, count: int) -> list[int]:
    """The largest ``count`` primes below ``limit``, at most 2 ** 32 (Miller-Rabin with bases that decide up to there)."""

    def is_prime(q: int) -> bool:
        odd, twos = q - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 7, 61):
            power = pow(base, odd, q)
            if power not in (1, q - 1) and all((power := power * power % q) != q - 1 for _ in range(twos - 1)):
                return False
        return True

    out, q = [], limit - 1 + limit % 2
    while len(out) < count:
        if is_prime(q):
            out.append(q)
        q -= 2
    return out


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo a prime below 2 ** 31, of the highest power first."""
    h = np.array(matrix % p, np.int64)
    d = len(h)
    for m in range(1, d - 1):
        pivot = np.flatnonzero(h[m:, m - 1])
        if not len(pivot):
            continue
        at = m + int(pivot[0])
        h[[m, at]] = h[[at, m]]
        h[:, [m, at]] = h[:, [at, m]]
        factor = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factor[:, None] * h[m]) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factor % p).sum(axis=1)) % p
    # polys[k] belongs to the leading k x k part, lowest power first
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        polys[k, 1:] = polys[k - 1, :-1]
        weight, below = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            weight[i] = int(h[i, k - 1]) * below % p
            below = below * int(h[i, i - 1]) % p if i else 0
        polys[k] = (polys[k] - (weight[:, None] * polys[:k] % p).sum(axis=0)) % p
    return polys[d][::-1]


def symmetric_sums(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """e_0 ... e_d, the elementary symmetric functions of the roots: det(x - matrix) is the sum of (-1)^j e_j x^(d-j).

    None exceeds comb(d, j) * (trace / d) ** j, as all roots of a scatter matrix are at least 0; primes suffice for that.
    """
    d = len(matrix)
    trace = sum(matrix.diagonal().tolist())
    bound = 1 + max(-(-comb(d, j) * trace**j // d**j) for j in range(d + 1))
    primes = primes_below(1 << 31, bound.bit_length() // 30 + 1)
    rows = [[int(v) for v in r] for r in matrix]

    def of(batches):
        own = np.array(rows, object)
        for batch in batches:
            for at in batch.column("id").to_pylist():
                yield pa.record_batch([pa.array([at], pa.int64()), pa.array([polynomial_modulo(own, primes[at]).tolist()], pa.list_(pa.int64()))], ["at", "poly"])

    # a few numbers for each prime; primes grow with the dimensions only
    found = spark.range(0, len(primes), 1, min(len(primes), 4 * shuffle_partitions(spark))).mapInArrow(of, "at long, poly array<long>").collect()
    whole, out = 1, [0] * (d + 1)
    for r in found:
        p = primes[r["at"]]
        step = pow(whole, -1, p)
        out = [v + whole * ((c * (-1) ** j - v) * step % p) for j, (v, c) in enumerate(zip(out, r["poly"]))]
        whole *= p
    if out[1] != trace:
        raise ArithmeticError("the polynomial's second coefficient is not the trace")
    return out


def roots_above(poly: list[int], at: int) -> int:
    """Roots of a polynomial with real roots only that are greater than ``at``: sign changes once it is shifted there."""
    shifted = list(poly)
    for last in range(len(shifted) - 1, 0, -1):
        for i in range(1, last + 1):
            shifted[i] += at * shifted[i - 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def root(sums_of_roots: list[int], k: int, bits: int = ROOT_BITS) -> Fraction:
    """The k-th largest root, counted with multiplicity, to ``bits`` bits or more."""
    scale = 0
    while True:
        # roots times 2 ** scale
        poly = [(-1) ** j * e << scale * j for j, e in enumerate(sums_of_roots)]
        low, high = 0, sums_of_roots[1] << scale  # above low, not above high, once there are over 0
        alone = False
        while high - low > 1:
            middle = (low + high) // 2
            if alone:
                value = 0
                for c in poly:
                    value = value * middle + c
                above = value != 0 and (value > 0) == rising
            else:
                above = roots_above(poly, middle) >= k
            low, high = (middle, high) if above else (low, middle)
            if not alone and roots_above(poly, low) == k and roots_above(poly, high) == k - 1:
                alone = True
                # the sign below the root: each larger root turns it once
                rising = k % 2 == 0
        if high.bit_length() >= bits:
            return Fraction(high, 1 << scale)
        scale += bits - high.bit_length() + 1


def null_space(matrix: np.ndarray, value: Fraction, count: int, turns: int = 3) -> list[list[float]]:
    """``count`` orthonormal vectors of the null space of matrix - value, by inverse iteration in fixed-point numbers."""
    d = len(matrix)
    one = 1 << BITS
    top = max(1, max(abs(int(v)) for v in matrix.diagonal()))
    fixed = lambda v: int(v * one / top)
    a = np.array([[int(v) * one // top for v in r] for r in matrix], object)
    for i in range(d):
        a[i, i] = fixed(Fraction(int(matrix[i, i])) - value)
    order, lower = np.arange(d), np.zeros((d, d), object)
    for j in range(d):
        at = j + max(range(d - j), key=lambda i: abs(a[j + i, j]))
        a[[j, at]], lower[[j, at]], order[[j, at]] = a[[at, j]], lower[[at, j]], order[[at, j]]
        if a[j, j] == 0:
            a[j, j] = 1  # the least number there is: the matrix is singular, as it should be
        factor = np.array([(v << BITS) // a[j, j] for v in a[j + 1 :, j]], object)
        lower[j + 1 :, j] = factor
        if j + 1 < d:
            a[j + 1 :, j:] = a[j + 1 :, j:] - (factor[:, None] * a[j, j:] >> BITS)

    def solved(b: np.ndarray) -> np.ndarray:
        y = b[order].copy()
        for j in range(d):
            y[j + 1 :] = y[j + 1 :] - (lower[j + 1 :, j] * y[j] >> BITS)
        for j in range(d - 1, -1, -1):
            y[j] = (y[j] << BITS) // a[j, j]
            y[:j] = y[:j] - (a[:j, j] * y[j] >> BITS)
        return y

    def unit(v: np.ndarray, against: list[np.ndarray]) -> np.ndarray:
        for _ in range(2):
            for w in against:
                v = v - (w * (sum((v * w).tolist()) >> BITS) >> BITS)
            norm = isqrt(sum((v * v).tolist()))
            v = np.array([(x << BITS) // max(1, norm) for x in v], object)
        return v

    out: list[np.ndarray] = []
    for c in range(count):
        # any start that is not orthogonal to the space
        v = unit(np.array([((i + 1) * (2 * c + 3) * 40503 % 65521 + 1) << BITS - 16 for i in range(d)], object), out)
        for _ in range(turns):
            v = unit(solved(v), out)
        out.append(v)
    vectors = [[x / one for x in v.tolist()] for v in out]
    # the sign is free: the largest entry is positive
    return [[-x for x in v] if v[max(range(d), key=lambda i: abs(v[i]))] < 0 else v for v in vectors]


def principal(spark: SparkSession, matrix: np.ndarray, count: int) -> tuple[list[Fraction], np.ndarray]:
    """The ``count`` largest roots, or as many as are over 0, and their unit vectors, each in a task of its own."""
    e = symmetric_sums(spark, matrix) if len(matrix) else [1]
    count = min(count, max(j for j, v in enumerate(e) if v))  # the rank: as many roots are 0 as last sums
    if not count:
        return [], np.zeros((0, len(matrix)))
    # numbers of any size travel as text
    texts = [hex(v) for v in e]

    def of_roots(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                x = root([int(v, 16) for v in texts], k + 1)
                yield pa.record_batch([pa.array([k]), pa.array([hex(x.numerator)]), pa.array([hex(x.denominator)])], ["k", "up", "down"])

    found = sorted(spark.range(0, count, 1, count).mapInArrow(of_roots, "k long, up string, down string").collect())
    values = [Fraction(int(r["up"], 16), int(r["down"], 16)) for r in found]
    # roots that agree to the last bit but few are equal
    firsts = [k for k in range(count) if k == 0 or (values[k - 1] - values[k]) * (1 << ROOT_BITS - 8) > values[k - 1]]
    runs = list(zip(firsts, [*firsts[1:], count]))
    rows = [[int(v) for v in r] for r in matrix]

    def of_vectors(batches):
        own = np.array(rows, object)
        for batch in batches:
            for at in batch.column("id").to_pylist():
                a, b = runs[at]
                got = null_space(own, values[a], b - a)
                yield pa.record_batch([pa.array(range(a, b), pa.int64()), pa.array(got, pa.list_(pa.float64()))], ["k", "vector"])

    vectors = sorted(spark.range(0, len(runs), 1, len(runs)).mapInArrow(of_vectors, "k long, vector array<double>").collect())
    return values, np.array([r["vector"] for r in vectors])


def whiten(rows: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error``: a row for each usable vector and component.

    An entry c is taken as floor(1024 c) + 100000. Unusable, and left out, are vectors that are null or empty, hold a null
    or an entry that is not finite or does not fit in a long, or have another length than most (on ties the shorter
    counts). Components have unit vectors of the covariance (divisor n), numbered by falling eigenvalue; the largest entry of each is positive.
    There are as many as asked for, or as the rank allows: directions without variance give none, so equal or single vectors
    give no rows. Equal eigenvalues get any orthonormal basis of their space. ``whitened`` is the centred projection over the root of the eigenvalue,
    ``explained`` the eigenvalue's share of the trace, ``identity_error`` the largest entry of the covariance of ``whitened`` less the identity,
    ``deviation`` sum((n x - S)^2). Ids are carried, null and repeated ones too; other columns are ignored. Sums over 38 digits raise an error. An
    empty table gives an empty result.
    """
    spark = rows.sparkSession
    vectors = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    n, total = sums(vectors)
    if not n:
        return spark.createDataFrame([], schema)
    matrix, centre, rest = scatter(vectors, n, total)
    values, axes = principal(spark, matrix, components)
    d, k = len(total), len(values)
    if not k:
        return spark.createDataFrame([], schema)
    trace = sum(matrix.diagonal().tolist())
    explained = np.array([float(v / trace) for v in values])
    # deviations are values / n^2; the centre is left out of the projections before multiplying
    scaled = axes / np.sqrt([float(v / n**2) for v in values])[:, None]
    shift = np.array([float(Fraction(int(r), n)) for r in rest])
    low, high = np.tril_indices(k)
    left = [int(r) for r in rest]
    most = max(map(abs, left))

    def products(batches):
        first, both = np.zeros(k), np.zeros((k, k))
        for _, x in integers(batches, d):
            w = ((x - centre) - shift) @ scaled.T
            first += w.sum(axis=0)
            both += w.T @ w
        yield pa.record_batch([pa.array(np.append(np.full(k, -1), low), pa.int32()), pa.array(np.append(np.arange(k), high), pa.int32()), pa.array(np.append(first, both[low, high]))], ["i", "j", "value"])

    got = {(r["i"], r["j"]): r["value"] / n for r in vectors.mapInArrow(products, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()}
    error = max(abs(got[i, j] - got[-1, i] * got[-1, j] - (i == j)) for i, j in zip(low.tolist(), high.tolist()))

    def of(batches):
        for ids, x in integers(batches, d):
            y = x - centre
            w = (y - shift) @ scaled.T
            if (n * largest(y) + most) ** 2 * d < 1 << 63:
                deviation = pa.array(((n * y - np.array(left, np.int64)) ** 2).sum(axis=1)).cast(EXACT)
            else:
                deviation = exactly(((n * y.astype(object) - np.array(left, object)) ** 2).sum(axis=1))
            at = pa.array(np.repeat(np.arange(len(y)), k))
            count = len(at)
            columns = [ids.take(at), pa.array(np.tile(np.arange(1, k + 1), len(y)), pa.int32()), pa.array(np.full(count, n)), deviation.take(at), pa.array(w.ravel()), pa.array(np.tile(explained, len(y))), pa.array(np.full(count, error))]
            yield pa.record_batch(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(of, schema)
