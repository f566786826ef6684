"""Whitening of vectors by the exact characteristic polynomial of their scatter.

Entries are whole numbers, so the scatter n * sum(x x') - S S' of the distinct vectors is an exact integer matrix. Its
characteristic polynomial is found modulo many primes (reduction to Hessenberg form, then the recurrence of its leading
minors) and put together by Chinese remaindering; the primes follow from a bound of the coefficients and are dealt over
tasks. The scatter is symmetric, so all roots are real, and the number of roots above t is exactly the number of sign
changes of the polynomial's coefficients about t: bisection with that count isolates the roots, and the sign at single
points narrows isolated ones, in whole numbers to about 110 bits. Components span the null space of scatter - root,
found by inverse iteration with an elimination in fixed-point whole numbers, one task per root.

Only what the dimension bounds reaches the driver: sums of products, coefficients and components.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from driftwell.llm.rows import arrow_map, drop_kept, give_back, stored

COMPONENTS = 16
# Entries become floor(SCALE * c) + SHIFT.
SCALE = 64
SHIFT = 1_000_000
# Larger entries (beyond any of use) stop here, so that whole numbers of 64 bits hold them.
MOST = 1 << 61
# Exact products: digits of so many bits, so many rows at once, stay under the 53 bits of a double.
DIGIT = 18
ROWS = 1 << 16
# Sums travel as whole numbers in parts of so many bits.
LIMB = 40
# Primes under 2**31 whose remainders multiply within 64 bits; those of one task.
PRIME_TOP = (1 << 31) - 1
PRIMES_AT_ONCE = 8
# Roots are found to the trace over 2**ROOT_BITS; eliminations hold FIXED bits behind the point.
ROOT_BITS = 110
FIXED = 320
# Roots nearer than so many steps count as one of several dimensions.
NEAR = 16
TURNS = 40


# ---- whole-number rows ----


def whole_entries(df: DataFrame, vector: str, key: str) -> DataFrame:
    """``key`` as vec_id, dim and the entries floor(SCALE * c) as bytes; NULL bytes for vectors that are not usable.

    Entries take 2, 4 or 8 bytes, the fewest that hold the vector, so equal vectors have equal bytes.
    """
    slim = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(ArrayType(DoubleType())).alias("v"))

    def run(rows: pa.Table) -> dict:
        vectors = rows["v"].combine_chunks()
        lengths = vectors.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        flat = vectors.flatten().fill_null(math.nan).to_numpy()
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
        usable = (lengths > 0) & (bad[bounds[1:]] == bad[bounds[:-1]])
        with np.errstate(all="ignore"):
            whole = np.clip(np.floor(np.where(np.isfinite(flat), flat, 0) * float(SCALE)), -float(MOST), float(MOST)).astype(np.int64)
        out = []
        for i, ok in enumerate(usable.tolist()):
            x = whole[bounds[i] : bounds[i + 1]]
            if ok:
                most = max(abs(int(x.min())), abs(int(x.max())))
                out.append(x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes())
            else:
                out.append(None)
        return {"vec_id": rows["vec_id"], "dim": lengths, "x": out}

    return arrow_map(slim, run, "vec_id long, dim int, x binary")


def matrix(raw: Sequence[bytes], dim: int) -> np.ndarray:
    """Rows of entries from their bytes."""
    sizes = {len(r) for r in raw}
    if len(sizes) == 1:
        return np.frombuffer(b"".join(raw), f"<i{sizes.pop() // dim}").reshape(-1, dim).astype(np.int64)
    return np.array([np.frombuffer(r, f"<i{len(r) // dim}") for r in raw], np.int64).reshape(-1, dim)


def exact_sums(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of products of the columns, as whole numbers of any size."""
    d = y.shape[1]
    total, products = np.zeros(d, object), np.zeros((d, d), object)
    for at in range(0, len(y), ROWS):
        part = y[at : at + ROWS]
        digits, rest = [], part
        while True:
            if int(np.abs(rest).max(initial=0)) < 1 << DIGIT:
                digits.append(rest.astype(float))
                break
            digits.append((rest & (1 << DIGIT) - 1).astype(float))
            rest = rest >> DIGIT
        for i, a in enumerate(digits):
            total += a.sum(axis=0).astype(np.int64).astype(object) << DIGIT * i
            for j, b in enumerate(digits):
                products += (a.T @ b).astype(np.int64).astype(object) << DIGIT * (i + j)
    return total, products


def scatter_sums(fit: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums and the products of all vectors: one set per task, added up by Spark in limbs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        n, total, products = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y = matrix(batch.column(0).slice(at, ROWS).to_pylist(), dim)
                s, p = exact_sums(y)
                n, total, products = n + len(y), total + s, products + p
        if n:
            found = [(-1, -1, n), *((-1, j, int(v)) for j, v in enumerate(total))]
            found += [(i, j, int(products[i, j])) for i in range(dim) for j in range(i, dim)]
            rows = [(i, j, k, part) for i, j, v in found for k, part in enumerate(limbs(v))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["i", "j", "k", "part"])
        give_back()

    parts = fit.select("x").mapInArrow(run, "i int, j int, k int, part long").groupBy("i", "j", "k").agg(F.sum("part").alias("part"))
    n, total, products = 0, [0] * dim, np.zeros((dim, dim), object)
    for r in parts.collect():
        value = r.part << LIMB * r.k
        if r.j < 0:
            n += value
        elif r.i < 0:
            total[r.j] += value
        else:
            products[r.i, r.j] += value
            if r.i != r.j:
                products[r.j, r.i] += value
    return n, total, products


def limbs(value: int) -> list[int]:
    """``value`` in parts of LIMB bits with its sign, lowest first."""
    sign, value = (-1 if value < 0 else 1), abs(value)
    out = []
    while value or not out:
        out.append(sign * (value & (1 << LIMB) - 1))
        value >>= LIMB
    return out


# ---- characteristic polynomial ----


def primes_below(top: int, product_bits: float) -> list[int]:
    """The largest primes up to ``top`` whose product has more than ``product_bits`` bits."""
    found, bits, at = [], 0.0, top | 1
    while bits <= product_bits:
        if _is_prime(at):
            found.append(at)
            bits += math.log2(at)
        at -= 2
    return found


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every number under 3.4e14."""
    if n < 2 or n % 2 == 0:
        return n == 2
    if n in (3, 5, 7, 11, 13, 17):
        return True
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7, 11, 13, 17):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def coefficient_bits(scatter: np.ndarray) -> float:
    """Bits that hold every coefficient of the characteristic polynomial: roots are not negative and sum to the trace."""
    d = len(scatter)
    mean = max(1.0, math.log2(max(1, int(np.trace(scatter)))) - math.log2(d) + 1e-9)
    return max(math.lgamma(d + 1) / math.log(2) - (math.lgamma(k + 1) + math.lgamma(d - k + 1)) / math.log(2) + k * mean for k in range(d + 1)) + 8


def polynomials_modulo(scatter: np.ndarray, primes: Sequence[int]) -> np.ndarray:
    """(primes, d + 1): coefficients of det(t - scatter) modulo each prime, lowest first."""
    d, q = len(scatter), np.array(primes, np.int64)
    h = np.stack([(scatter % int(p)).astype(np.int64) for p in primes])
    mod, every = q[:, None, None], np.arange(len(q))
    for m in range(1, d - 1):
        below = h[:, m:, m - 1]
        pivot = m + np.argmax(below != 0, axis=1)
        # Swap rows and columns m and pivot, which leaves the polynomial as it is.
        for axis in (1, 2):
            at = (every, pivot) if axis == 1 else (every, slice(None), pivot)
            here = (every, m) if axis == 1 else (every, slice(None), m)
            held = h[at].copy()
            h[at] = h[here]
            h[here] = held
        lead = h[:, m, m - 1]
        inverse = np.array([pow(int(v), -1, int(p)) if v else 0 for v, p in zip(lead, q)], np.int64)
        u = h[:, m + 1 :, m - 1] * inverse[:, None] % q[:, None]
        h[:, m + 1 :, :] = (h[:, m + 1 :, :] - u[:, :, None] * h[:, m : m + 1, :] % mod) % mod
        h[:, :, m] = (h[:, :, m] + (h[:, :, m + 1 :] * u[:, None, :] % mod).sum(axis=2)) % q[:, None]
    found = np.zeros((d + 1, len(q), d + 1), np.int64)
    found[0, :, 0] = 1
    mod = q[:, None]
    for k in range(1, d + 1):
        made = -h[:, k - 1, k - 1][:, None] * found[k - 1] % mod
        made[:, 1:] += found[k - 1][:, :-1]
        chain = np.ones(len(q), np.int64)
        for i in range(1, k):
            chain = chain * h[:, k - i, k - i - 1] % q
            made -= (h[:, k - i - 1, k - 1] * chain % q)[:, None] * found[k - i - 1] % mod
        found[k] = made % mod
    return found[d]


def remaindered(residues: np.ndarray, primes: Sequence[int]) -> list[int]:
    """The whole numbers of least absolute value with these remainders (primes, numbers)."""
    product = math.prod(primes)
    weights = [(product // p) * pow(product // p % p, -1, p) for p in primes]
    out = []
    for column in residues.T.tolist():
        value = sum(r * w for r, w in zip(column, weights)) % product
        out.append(value - product if 2 * value > product else value)
    return out


def characteristic(spark: SparkSession, scatter: np.ndarray) -> list[int]:
    """Coefficients of det(t - scatter), lowest first; batches of primes are dealt over tasks."""
    primes = primes_below(PRIME_TOP, coefficient_bits(scatter))
    batches = [primes[i : i + PRIMES_AT_ONCE] for i in range(0, len(primes), PRIMES_AT_ONCE)]

    def run(rows: pa.Table) -> dict:
        found = [(p, c) for batch in rows["primes"].to_pylist() for p, c in zip(batch, polynomials_modulo(scatter, batch).tolist())]
        return {"p": [f[0] for f in found], "c": [f[1] for f in found]}

    dealt = spark.createDataFrame([(b,) for b in batches], "primes array<long>").repartition(len(batches))
    rows = sorted(arrow_map(dealt, run, "p long, c array<long>").collect(), reverse=True)
    return remaindered(np.array([r.c for r in rows], np.int64), [r.p for r in rows])


# ---- roots ----


def roots_above(polynomial: Sequence[int], t: int) -> int:
    """How many roots (all real, counted as often as they occur) are above ``t``: sign changes of the shifted coefficients."""
    c = list(polynomial)
    if t:
        d = len(c) - 1
        for i in range(d):
            for j in range(d - 1, i - 1, -1):
                c[j] += t * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _value(polynomial: Sequence[int], t: int) -> int:
    total = 0
    for c in reversed(polynomial):
        total = total * t + c
    return total


class Root(NamedTuple):
    """A root of a polynomial lies in (place, place + 1] times 2**power."""

    place: int
    power: int

    def value(self) -> Fraction:
        return Fraction(2 * self.place + 1, 2) * Fraction(2) ** self.power


def largest_roots(polynomial: Sequence[int], wanted: int) -> list[Root]:
    """The ``wanted`` largest positive roots (as many as there are), falling, each as often as it occurs."""
    d = len(polynomial) - 1
    trace = -polynomial[d - 1] if d else 0
    if trace <= 0:
        return []
    power = min(0, trace.bit_length() - ROOT_BITS)
    # The polynomial in units of 2**power, cleared of fractions.
    scaled = [c << -power * (d - j) for j, c in enumerate(polynomial)]
    low, high = 0, trace << -power
    found: dict[int, int] = {}
    open_ = [(low, high, roots_above(scaled, low), 0)]
    while open_:
        low, high, at_low, at_high = open_.pop()
        # Roots number at_high + 1 to at_low, counted from the largest, lie in (low, high].
        if at_low == at_high or at_high >= wanted:
            continue
        if high - low == 1:
            found |= dict.fromkeys(range(at_high, at_low), low)
        elif at_low - at_high == 1:
            # One simple root: the sign tells the side.
            above = _value(scaled, high)
            if not above:
                found[at_high] = high - 1
                continue
            while high - low > 1:
                middle = (low + high) // 2
                value = _value(scaled, middle)
                if value and (value > 0) == (above > 0):
                    high = middle
                else:
                    low, high = (middle - 1, middle) if not value else (middle, high)
            found[at_high] = low
        else:
            middle = (low + high) // 2
            count = roots_above(scaled, middle)
            open_ += [(low, middle, at_low, count), (middle, high, count, at_high)]
    return [Root(found[i], power) for i in range(min(wanted, len(found)))]


# ---- components ----


def _eliminated(a: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Solver of a x = b in fixed point, by elimination with the largest pivots."""
    a, d = a.copy(), len(a)
    steps = []
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
        # A pivot of zero is the null space itself: the least number stands for it.
        if a[k, k] == 0:
            a[k, k] = 1
        factors = (a[k + 1 :, k] << FIXED) // a[k, k]
        a[k + 1 :, k:] -= (factors[:, None] * a[k, k:][None, :]) >> FIXED
        steps.append((pivot, factors))

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.copy()
        for k, (pivot, factors) in enumerate(steps):
            if pivot != k:
                x[[k, pivot]] = x[[pivot, k]]
            x[k + 1 :] -= (factors * x[k]) >> FIXED
        for k in range(d - 1, -1, -1):
            rest = x[k] - (sum(a[k, j] * x[j] for j in range(k + 1, d)) >> FIXED)
            x[k] = (rest << FIXED) // a[k, k]
        return x

    return solve


def _unit(x: np.ndarray) -> np.ndarray:
    """``x`` with length one, in fixed point."""
    length = math.isqrt(sum(v * v for v in x)) or 1
    return np.array([(v << FIXED) // length for v in x], object)


def null_vectors(scatter: np.ndarray, shift: Fraction, count: int) -> np.ndarray:
    """(count, d): unit vectors that span the null space of scatter - shift, by inverse iteration."""
    d = len(scatter)
    size = max(1, int(np.trace(scatter)))
    a = np.array([[int((Fraction(int(v)) - (shift if i == j else 0)) * (1 << FIXED) / size) for j, v in enumerate(row)] for i, row in enumerate(scatter)], object)
    solve = _eliminated(a)
    start = np.random.default_rng(7).integers(-(1 << 40), 1 << 40, (count, d)).astype(object)
    vectors = [_unit(v) for v in start]
    for _ in range(TURNS):
        made: list[np.ndarray] = []
        for v in vectors:
            x = _unit(solve(v))
            for _ in range(2):
                for other in made:
                    part = sum(p * q for p, q in zip(x, other)) >> FIXED
                    x = x - ((part * other) >> FIXED)
                x = _unit(x)
            made.append(x)
        # Either sign is the same direction.
        moved = max(min(max(abs(p - q) for p, q in zip(x, v)), max(abs(p + q) for p, q in zip(x, v))) for x, v in zip(made, vectors))
        vectors = made
        if count == 1 and moved < 1 << FIXED - 90:
            break
    out = np.array([[float(Fraction(int(v), 1 << FIXED)) for v in x] for x in vectors])
    # The entry of largest size is positive.
    return out * np.sign(out[np.arange(count), np.argmax(np.abs(out), axis=1)])[:, None]


class Whitening(NamedTuple):
    n: int
    sums: list[int]  # of floor(SCALE * c)
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # one component in a row
    explained: np.ndarray

    def deviations(self, y: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64 bits where these hold it."""
        most = max([int(np.abs(y).max(initial=0)), 1]) * self.n + max(map(abs, self.sums), default=0)
        if most < 1 << 62:
            return self.n * y - np.array(self.sums, np.int64)
        return self.n * y.astype(object) - np.array(self.sums, object)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return deviations.astype(float) / self.n @ (self.vectors / np.sqrt(self.values)[:, None]).T


def fit_whitening(spark: SparkSession, fit: DataFrame, dim: int, components: int) -> Whitening | None:
    """Components of the vectors ``fit`` (their bytes, each once). None without any vector."""
    n, sums, products = scatter_sums(fit, dim)
    if not n:
        return None
    s = np.array(sums, object)
    scatter = n * products - np.outer(s, s)
    common = math.gcd(*map(int, scatter.reshape(-1))) or 1
    small = scatter // common
    trace = int(np.trace(small))
    roots = largest_roots(characteristic(spark, small), components) if trace else []
    if not roots:
        return Whitening(n, sums, np.zeros(0), np.zeros((0, dim)), np.zeros(0))
    groups: list[list[Root]] = []
    for root in roots:
        if groups and groups[-1][-1].place - root.place < NEAR:
            groups[-1].append(root)
        else:
            groups.append([root])
    step = Fraction(2) ** roots[0].power
    # Several roots in one place are shifted past, so that none of their directions outgrows the others.
    shifts = [(g[0].value() + (4 * NEAR * step if len(g) > 1 else 0), len(g)) for g in groups]
    tasks = [(k, str(shift.numerator), str(shift.denominator), count) for k, (shift, count) in enumerate(shifts)]

    def run(rows: pa.Table) -> dict:
        made = [
            null_vectors(small, Fraction(int(a), int(b)), c).tolist()
            for a, b, c in zip(rows["over"].to_pylist(), rows["under"].to_pylist(), rows["size"].to_pylist())
        ]
        return {"k": rows["k"], "vectors": made}

    dealt = spark.createDataFrame(tasks, "k int, over string, under string, size int").repartition(len(tasks))
    rows = sorted(arrow_map(dealt, run, "k int, vectors array<array<double>>").collect())
    vectors = np.array([v for r in rows for v in r.vectors])
    values = [r.value() for r in roots]
    # scatter = n * n * covariance.
    return Whitening(
        n, sums, np.array([float(v * common / (n * n)) for v in values]), vectors, np.array([float(v / trace) for v in values])
    )


def identity_error(fit: DataFrame, dim: int, w: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit vectors minus the identity, from the vectors themselves."""
    size = len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        total = np.zeros((size, size))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                z = w.whitened(w.deviations(matrix(batch.column(0).slice(at, ROWS).to_pylist(), dim)))
                total += z.T @ z
        i, j = np.indices((size, size)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.reshape(-1))], names=["i", "j", "part"])
        give_back()

    parts = fit.select("x").mapInArrow(run, "i int, j int, part double").groupBy("i", "j").agg(F.sum("part").alias("part"))
    return max(abs(r.part / w.n - (r.i == r.j)) for r in parts.collect())


def whiten(df: DataFrame, vector: str, key: str, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    Vectors that are NULL, empty or hold NULL or non-finite entries are left out, and so are those of another length than
    most have (the greater length on ties). Repeated rows stay in the result and count once in the fit. Components with
    eigenvalue 0 cannot be whitened and have no rows; without spread or vectors there are none at all. A deviation beyond
    64 bits is NULL. Ids are integers; columns of other names are not read.
    """
    spark = df.sparkSession
    usable = stored(whole_entries(df, vector, key).where("x is not null"), "whole-vectors")
    common = usable.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim = common[0].dim if common else 1
    usable = usable.where(F.col("dim") == dim)
    fit = stored(usable.select("x").distinct(), "fit-vectors")
    w = fit_whitening(spark, fit, dim, components)
    if w is None or not len(w.values):
        w, error = Whitening(0, [], np.zeros(0), np.zeros((0, dim)), np.zeros(0)), 0.0
    else:
        error = identity_error(fit, dim, w)

    def run(rows: pa.Table) -> dict:
        k, n = len(w.values), rows.num_rows
        if not k:
            return {c: [] for c in ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")}
        z = w.deviations(matrix(rows["x"].to_pylist(), dim))
        most = int(np.abs(z).max(initial=0))
        if most * most * dim < 1 << 63:
            square = (z * z).sum(axis=1).tolist()
        else:
            square = [sum(int(v) * int(v) for v in row) for row in z]
        square = [v if v < 1 << 63 else None for v in square]
        return {
            "vec_id": rows["vec_id"].take(pa.array(np.repeat(np.arange(n), k))),
            "component": np.tile(np.arange(1, k + 1), n),
            "n": np.full(n * k, w.n),
            "deviation": [v for v in square for _ in range(k)],
            "whitened": w.whitened(z).reshape(-1),
            "explained": np.tile(w.explained, n),
            "identity_error": np.full(n * k, error),
        }

    return arrow_map(
        usable.select("vec_id", "x"), run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double", piece=1 << 20
    )
