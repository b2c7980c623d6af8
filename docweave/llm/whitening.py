"""Whitened embeddings from the exact characteristic polynomial of their scatter.

Entries become integers, so the scatter of the distinct vectors is an integer matrix, summed exactly in tasks. Its
characteristic polynomial is found modulo many primes, each by a reduction to Hessenberg form, and put together by
Chinese remainders. All roots of it are real, so the sign changes of the polynomial moved to t count the roots above
t exactly: bisection isolates each root wanted, to hundreds of bits. Inverse iteration in the null space of the matrix
less the root, in long decimals, gives the components. What passes through the driver is square in the number of
dimensions, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal, localcontext

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import table, written

COMPONENTS = 4
SCALE = 256
# Bits behind the point of a root, beyond those that tell the smallest root wanted from zero.
ROOT_BITS = 256
# Digits of the components' arithmetic beyond those of the root.
SPARE_DIGITS = 60
LIMB = 32
_LONG = 1 << 63


# ---------------------------------------------------------------- exact sums


def scaled_rows(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, x) of the rows that take part: ``x`` is the floor of 256 times each entry."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    usable = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < float(_LONG)))
    rows = rows.filter(F.col("v").isNotNull() & F.coalesce(usable, F.lit(False)) & (F.size("v") > 0))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def exact_products(x: np.ndarray) -> np.ndarray:
    """The integer matrix of the products of columns, as Python numbers; by doubles where those are exact."""
    d = x.shape[1]
    total = np.zeros((d, d), dtype=object)
    largest = max((abs(int(x.max())), abs(int(x.min())))) if x.size else 0
    if largest < 1 << 24:
        rows = max(1, (1 << 53) // max(1, largest * largest))
        for start in range(0, len(x), rows):
            part = x[start : start + rows].astype(np.float64)
            total += (part.T @ part).astype(np.int64).astype(object)
    else:
        wide = x.astype(object)
        total += wide.T @ wide
    return total


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """The signed digits of ``value`` in base 2**32 that are not 0, with their places."""
    sign, rest, place = (-1 if value < 0 else 1), abs(value), 0
    while rest:
        if digit := rest & ((1 << LIMB) - 1):
            yield place, sign * digit
        rest, place = rest >> LIMB, place + 1


@dataclass
class Moments:
    """Count, sums per dimension, and ``n`` times the sums of products less the products of sums."""

    n: int
    sums: list[int]
    scatter: list[list[int]]


def moments(fit: DataFrame, dimensions: int) -> Moments:
    """Exact sums over the rows ``x`` of ``fit``; every task sends the digits of its own, of bounded number."""
    d = dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                n += len(x)
                sums += x.sum(axis=0, dtype=object) if np.abs(x).max() >= 1 << 40 else x.sum(axis=0).astype(object)
                products += exact_products(x)
        upper = products[np.triu_indices(d)]
        rows = [(i, k, digit) for i, value in enumerate([n, *sums.tolist(), *upper.tolist()]) for k, digit in _limbs(value)]
        columns = [pa.array(list(c), pa.int64()) for c in (zip(*rows) if rows else [[]] * 3)]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "k", "digit"])

    digits = fit.select("x").mapInArrow(run, "i long, k long, digit long").groupBy("i", "k").agg(F.sum("digit").alias("digit"))
    values = [0] * (1 + d + d * (d + 1) // 2)
    for i, k, digit in digits.collect():
        values[i] += digit << (LIMB * k)
    n, sums = values[0], values[1 : d + 1]
    scatter = [[0] * d for _ in range(d)]
    for (i, j), value in zip(zip(*map(np.ndarray.tolist, np.triu_indices(d))), values[d + 1 :]):
        scatter[i][j] = scatter[j][i] = n * value - sums[i] * sums[j]
    return Moments(n, sums, scatter)


# ------------------------------------------------- characteristic polynomial


def is_prime(n: int) -> bool:
    """Certain for n below 2**32 with these three bases' test."""
    if n < 2 or any(n % p == 0 and n != p for p in (2, 3, 5, 7, 61)):
        return False
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 7, 61):
        x = pow(base, odd, n)
        if base % n == 0 or x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_below(limit: int, bits: int) -> list[int]:
    """The largest primes under ``limit`` whose product has more than ``bits`` bits."""
    found, held, n = [], 0.0, limit - 1
    while held <= bits + 1:
        if is_prime(n):
            found.append(n)
            held += n.bit_length() - 1
        n -= 1
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(t - matrix) modulo ``p``, constant first, by way of Hessenberg form."""
    h = np.array(matrix, dtype=np.int64) % p
    d = len(h)
    for column in range(d - 2):
        below = np.flatnonzero(h[column + 1 :, column])
        if not len(below):
            continue
        pivot = column + 1 + int(below[0])
        if pivot != column + 1:
            h[[column + 1, pivot]] = h[[pivot, column + 1]]
            h[:, [column + 1, pivot]] = h[:, [pivot, column + 1]]
        factor = h[column + 2 :, column] * pow(int(h[column + 1, column]), -1, p) % p
        h[column + 2 :] = (h[column + 2 :] - factor[:, None] * h[column + 1] % p) % p
        # Each product is below 2**62; they are reduced before they are summed.
        h[:, column + 1] = (h[:, column + 1] + (h[:, column + 2 :] * factor % p).sum(axis=1)) % p
    below = np.concatenate((np.diagonal(h, -1), [0]))
    polynomials = np.zeros((d + 1, d + 1), dtype=np.int64)
    polynomials[0, 0] = 1
    for k in range(d):
        current = -h[k, k] * polynomials[k] % p
        current[1:] += polynomials[k, :-1]
        path = 1
        weights = np.zeros(k, dtype=np.int64)
        for i in range(k - 1, -1, -1):
            path = path * int(below[i]) % p
            weights[i] = path * int(h[i, k]) % p
        current = current - (weights[:, None] * polynomials[:k] % p).sum(axis=0)
        polynomials[k + 1] = current % p
    return polynomials[d].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """The integer coefficients of det(t - matrix) of a matrix without negative roots, constant first."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    # The absolute coefficients sum to the product of 1 + root, which is at most that of d equal roots.
    bits = d * (1 + -(-trace // d)).bit_length() + 2
    primes = primes_below(1 << 31, bits)
    shared = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(shared.value, dtype=object)
        for batch in batches:
            for p in batch.column(0).to_pylist():
                rest = polynomial_modulo((exact % p).astype(np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([rest], pa.list_(pa.int64()))], names=["p", "rest"])

    parts = max(1, min(len(primes), spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(parts).mapInArrow(run, "p long, rest array<long>").collect()
    product, coefficients = 1, [0] * (d + 1)
    for p, rest in sorted(map(tuple, rows)):
        inverse = pow(product, -1, p)
        coefficients = [c + product * ((r - c) * inverse % p) for c, r in zip(coefficients, rest)]
        product *= p
    return [c - product if 2 * c > product else c for c in coefficients]


# ---------------------------------------------------------------- real roots


def roots_above(polynomial: list[int], t: int, bits: int) -> int:
    """How many roots, counted with their multiplicity, are greater than t / 2**bits; all roots must be real."""
    d = len(polynomial) - 1
    moved = [c << (bits * (d - k)) for k, c in enumerate(polynomial)]
    for start in range(d):
        for k in range(d - 1, start - 1, -1):
            moved[k] += t * moved[k + 1]
    signs = [c > 0 for c in moved if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(polynomial: list[int], count: int, bits: int = ROOT_BITS) -> list[tuple[int, int, int]]:
    """(numerator, bits, multiplicity) of the ``count`` largest roots above 0, by falling value.

    Every root is within 2**-bits of its fraction; roots that lie closer than that count as one.
    """
    zeros = next(k for k, c in enumerate(polynomial) if c)
    positive = polynomial[zeros:]
    d = len(positive) - 1
    if not d:
        return []
    top = 1
    while roots_above(positive, top, 0):
        top *= 2
    # A polynomial of whole coefficients has no root between 0 and this power of two.
    least = max((abs(c) for c in positive[1:])).bit_length()
    bits = bits + max(0, least - abs(positive[0]).bit_length())
    found: list[tuple[int, int, int]] = []
    above, high, scale = 0, top, 0
    while above < min(count, d):
        # (low, high] holds the next root, and all roots above ``high`` are found.
        low, at_least = 0, d
        while at_least - above > 1 and (high - low > 1 or scale < bits):
            if high - low <= 1:
                low, high, scale = low * 2, high * 2, scale + 1
            middle = (low + high) // 2
            over = roots_above(positive, middle, scale)
            if over > above:
                low, at_least = middle, over
            else:
                high = middle
        if at_least - above == 1:
            found.append((*_narrowed(positive, low, high, scale, bits), 1))
        else:
            found.append((high, scale, at_least - above))
        above, high = at_least, low
    return found


def _narrowed(polynomial: list[int], low: int, high: int, scale: int, bits: int) -> tuple[int, int]:
    """(numerator, bits) of the one simple root in (low, high], by the sign of the polynomial."""

    def value(t: int, scale: int) -> int:
        total, power = 0, 1
        for c in reversed(polynomial):
            total = total * t + c * power
            power <<= scale
        return total

    more = max(0, bits - scale)
    low, high, scale = low << more, high << more, scale + more
    above = value(high, scale)
    while above and high - low > 1:
        middle = (low + high) // 2
        sign = value(middle, scale)
        if not sign:
            return middle, scale
        if (sign > 0) == (above > 0):
            high = middle
        else:
            low = middle
    return high, scale


# ---------------------------------------------------------------- components


def _digits(numerator: int) -> int:
    return int(numerator.bit_length() * 0.302) + SPARE_DIGITS


def null_vectors(matrix: list[list[int]], numerator: int, bits: int, count: int) -> np.ndarray:
    """``count`` orthogonal unit vectors that the matrix stretches by numerator / 2**bits, by inverse iteration."""
    d = len(matrix)
    digits = _digits(numerator)
    with localcontext(Context(prec=digits)):
        root = Decimal(numerator) / (Decimal(2) ** bits)
        a = np.array([[Decimal(v) for v in row] for row in matrix], dtype=object)
        a[np.arange(d), np.arange(d)] -= root
        scale = max(abs(v) for v in a.ravel()) or Decimal(1)
        least = scale * Decimal(10) ** (10 - digits)
        order = np.arange(d)
        for k in range(d):
            best = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
            a[[k, best]], order[[k, best]] = a[[best, k]], order[[best, k]]
            if abs(a[k, k]) < least:
                a[k, k] = least
            a[k + 1 :, k] /= a[k, k]
            a[k + 1 :, k + 1 :] -= a[k + 1 :, k : k + 1] * a[k : k + 1, k + 1 :]
        draw = np.random.default_rng(12)
        starts = [np.array([Decimal(int(v)) for v in draw.integers(-1000, 1001, d)], dtype=object) for _ in range(count)]
        for _ in range(3):
            solved = []
            for start in starts:
                b = start[order]
                for k in range(d):
                    b[k + 1 :] -= a[k + 1 :, k] * b[k]
                for k in range(d - 1, -1, -1):
                    b[k] = (b[k] - a[k, k + 1 :] @ b[k + 1 :]) / a[k, k] if k < d - 1 else b[k] / a[k, k]
                b /= max(abs(v) for v in b) or Decimal(1)
                for other in solved:
                    b = b - other * (other @ b)
                solved.append(b / (b @ b).sqrt())
            starts = solved
    return np.array([[float(v) for v in vector] for vector in starts])


@dataclass
class Whitening:
    """Mean, components and their eigenvalues of the covariance; ``moments`` are exact."""

    moments: Moments
    components: np.ndarray
    roots: np.ndarray
    explained: list[float]

    @classmethod
    def fit(cls, spark: SparkSession, found: Moments, count: int = COMPONENTS) -> "Whitening":
        """Up to ``count`` components; directions without any variance are none."""
        d = len(found.sums)
        scatter, n = found.scatter, found.n
        trace = sum(scatter[i][i] for i in range(d))
        if not trace:
            return cls(found, np.zeros((0, d)), np.zeros(0), [])
        polynomial = characteristic_polynomial(spark, scatter)
        components, roots, explained = [], [], []
        for numerator, bits, multiplicity in largest_roots(polynomial, count):
            wanted = min(multiplicity, count - len(roots))
            components.append(null_vectors(scatter, numerator, bits, wanted))
            with localcontext(Context(prec=_digits(numerator))):
                root = Decimal(numerator) / Decimal(2) ** bits
                roots += [float(root / (Decimal(n) * Decimal(n)))] * wanted
                explained += [float(root / Decimal(trace))] * wanted
        return cls(found, np.concatenate(components), np.array(roots), explained)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: in longs where these hold it."""
        n, sums = self.moments.n, self.moments.sums
        reach = n * max(1, int(np.abs(x.astype(object)).max())) + max(abs(s) for s in sums)
        kind = np.int64 if reach < 1 << 62 else object
        return x.astype(kind) * n - np.array(sums, dtype=kind)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Squared lengths of n * x - S; None where a long cannot hold one."""
        centred = self.centred(x)
        if centred.dtype == object or int(np.abs(centred).max()) ** 2 * centred.shape[1] >= _LONG:
            exact = (centred.astype(object) ** 2).sum(axis=1).tolist()
            return [v if v < _LONG else None for v in exact]
        return (centred * centred).sum(axis=1).tolist()

    def whitened(self, x: np.ndarray) -> np.ndarray:
        centred = self.centred(x).astype(float) / self.moments.n
        # A sum per row, so that a row's value does not depend on its batch.
        return np.stack([(centred * v).sum(axis=1) / np.sqrt(e) for v, e in zip(self.components, self.roots)], axis=1)


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every row and component.

    Rows whose vector is null or empty, holds a null or non-finite entry or one that 256 times over leaves a long, or
    has a length other than the commonest (the shorter of two as common), take no part. Repeated rows are returned
    as often as they come; equal vectors count once in the fit. Directions without variance are no components, so
    a table whose vectors are all equal, or an empty one, gives no rows. ``deviation`` is null where a long cannot hold
    it. Null ids stay. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = written(scaled_rows(vectors, id_column, vector_column), "scaled")
    lengths = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), "length").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("x") == lengths["length"])
    fit = written(rows.select("x").distinct(), "fit")
    model = Whitening.fit(spark, moments(fit, lengths["length"]), components)
    k = len(model.roots)
    if not k:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<deviation: long, z: array<double>>")
    def projected(x: pd.Series) -> pd.DataFrame:
        values = np.stack(x.to_numpy()) if len(x) else np.zeros((0, lengths["length"]), dtype=np.int64)
        if not len(values):
            return pd.DataFrame({"deviation": pd.array([], dtype="Int64"), "z": []})
        z = shared.value.whitened(values)
        return pd.DataFrame({"deviation": pd.array(shared.value.deviations(values), dtype="Int64"), "z": list(z)})

    z = fit.select(projected("x").alias("p")).select(*[F.get("p.z", F.lit(i)).alias(f"z{i}") for i in range(k)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    covariances = z.agg(*[F.covar_pop(f"z{i}", f"z{j}") for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for (i, j), c in zip(pairs, covariances))
    placed = rows.select("vec_id", projected("x").alias("p")).select("vec_id", "p.deviation", F.posexplode("p.z").alias("place", "whitened"))
    explained = F.array(*map(F.lit, model.explained))
    return placed.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.moments.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("place")).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the four components that explain most."""
    return whiten(table(spark, sf_dir, "embeddings"))
