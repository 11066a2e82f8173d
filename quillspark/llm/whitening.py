"""Whitening of embeddings with an exact scatter matrix by residue numbers.

1. Each entry c becomes the whole number ``floor(scale * c) + shift``. A first pass counts the vectors and finds the largest entry, which
   bounds every sum of products; so many primes are taken that their product is above twice that bound.
2. Per partition and prime, the products of ``(1, x)`` with itself are matrix products of residues in doubles: a block of rows has so
   few that every partial sum stays below 2**53, and is exact. The residues of a partition are summed by Spark, an entry of the matrix at a time.
3. Chinese remaindering gives the exact sums: the count, the sums by dimension and the scatter. ``n * scatter - sums x sums`` is exact too; only
   then is it divided by n**2 and rounded, once, to doubles, for the eigenvectors of the covariance (``numpy.linalg.eigh``).
4. A second pass over the rows projects ``x - sums / n`` and measures the covariance of what is whitened; a third writes the rows.

What reaches the driver is the matrix, whose size the dimensions bound, and not the rows.

Cases: vectors that are null or hold nulls, NaN or infinities are left out, as are those whose number of entries is not the most common one
(of equally common ones the largest; an empty vector has no components either), as no covariance is between them. Entries of any finite size are
exact. Null ids and repeated rows are rows like any other. Components without variance (by the eigenvalues' precision) are not returned; so
constant vectors give no rows. An empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Primes are below this; residues around zero are below half of it, and a block of rows has at most ``2 ** 53 / (PRIME_LIMIT / 2) ** 2``.
PRIME_LIMIT = 1 << 22
BLOCK = (1 << 53) // (PRIME_LIMIT // 2) ** 2
#: Entries are cut in limbs of so many bits for exact sums of squares.
LIMB = 24
_SAFE = 1 << 62


def primes(least_product: int) -> list[int]:
    """The largest primes below ``PRIME_LIMIT``, so many that their product reaches ``least_product``."""
    found, product, x = [], 1, PRIME_LIMIT
    while product < least_product:
        x -= 1
        if x % 2 and all(x % d for d in range(3, math.isqrt(x) + 1, 2)):
            found.append(x)
            product *= x
    return found


def remainders(rests: list[int], moduli: list[int]) -> int:
    """The number nearest to zero with these residues."""
    value, product = 0, 1
    for rest, p in zip(rests, moduli):
        value += product * ((rest - value) * pow(product, -1, p) % p)
        product *= p
    return value - product if 2 * value > product else value


def whole(values: np.ndarray, scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    """``floor(scale * c) + shift``: int64, or Python's whole numbers where those are too small."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * float(scale))
    if not scaled.size or np.abs(scaled).max() < 2.0**61:
        return scaled.astype(np.int64) + shift
    exact = [math.floor(Fraction(c) * scale) + shift for c in values.ravel().tolist()]
    return np.array(exact, object).reshape(values.shape)


def residue_products(x: np.ndarray, moduli: list[int]) -> list[np.ndarray]:
    """``(1, x)`` times itself, summed over the rows of x, modulo each prime."""
    out = []
    for p in moduli:
        rest = np.mod(x, p).astype(np.int64)
        rest = np.where(rest > p // 2, rest - p, rest)
        own = np.concatenate([np.ones((len(x), 1)), rest.astype(np.float64)], 1)
        total = np.zeros((own.shape[1], own.shape[1]), np.int64)
        for k in range(0, len(x), BLOCK):
            part = own[k : k + BLOCK]
            total = (total + (part.T @ part).astype(np.int64)) % p
        out.append(total)
    return out


def squared_lengths(z: np.ndarray) -> list[int]:
    """The exact sum of squares of each row of whole numbers."""
    if not z.size:
        return [0] * len(z)
    size = max(int(np.abs(z).max()), 1).bit_length()
    if z.dtype == object:
        return [int(v) for v in (z * z).sum(1)]
    if 2 * size + int(z.shape[1]).bit_length() < 63:
        return (z * z).sum(1).tolist()
    magnitude = np.abs(z)
    limbs = [(magnitude >> LIMB * k) & ((1 << LIMB) - 1) for k in range(-(-size // LIMB))]
    total = np.zeros(len(z), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            total = total + (a * b).sum(1).astype(object) * (1 << LIMB * (i + j))
    return [int(v) for v in total]


class Whitener(NamedTuple):
    """What the rows are whitened with: count, sums by dimension, projections (a column a component, divided by its deviation), and the
    components' shares of the variance."""

    n: int
    sums: list[int]
    projection: np.ndarray
    explained: list[float]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact."""
        largest = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if x.dtype == object or largest >= _SAFE:
            return x.astype(object) * self.n - np.array(self.sums, object)
        return x * self.n - np.array(self.sums, np.int64)

    def whitened(self, z: np.ndarray) -> np.ndarray:
        """Of centred numbers (``n * x - sums``)."""
        return (z.astype(np.float64) / self.n) @ self.projection


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    """The batch's vectors, all of the same number of entries, as doubles."""
    column = batch.column("_vector")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _valid(rows: DataFrame) -> tuple[DataFrame, int, int, float]:
    """Rows with a whole vector of the most common size (_vector), their number, that size and the largest entry."""
    fine = F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = rows.where(F.col("_vector").isNotNull() & (F.size("_vector") > 0)).where(F.coalesce(fine, F.lit(False)))
    sizes = valid.groupBy(F.size("_vector").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(F.array_max("_vector"), -F.array_min("_vector"))).alias("most"))
    best = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    if best is None:
        return valid, 0, 0, 0.0
    return valid.where(F.size("_vector") == best["size"]), best["n"], best["size"], best["most"]


def fit(rows: DataFrame, n: int, size: int, most: float, scale: int = SCALE, shift: int = SHIFT, count: int = COMPONENTS) -> Whitener:
    """The whitener of ``rows`` (_vector: ``n`` vectors of ``size`` entries, none of which is further from zero than ``most``)."""
    largest = max(math.floor(Fraction(most) * scale) + 1 + abs(shift), 1)
    moduli = primes(2 * n * largest * largest + 2)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray] | None = None
        for batch in batches:
            if batch.num_rows:
                own = residue_products(whole(_vectors(batch), scale, shift), moduli)
                total = own if total is None else [(a + b) % p for a, b, p in zip(total, own, moduli)]
        if total is not None:
            i, j = np.triu_indices(size + 1)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *(pa.array(t[i, j]) for t in total)], names)

    names = ["i", "j", *(f"r{k}" for k in range(len(moduli)))]
    partial = rows.select("_vector").mapInArrow(products, ", ".join(f"{x} {'int' if x in 'ij' else 'long'}" for x in names))
    summed = partial.groupBy("i", "j").agg(*(F.sum(x).alias(x) for x in names[2:])).collect()
    exact = np.zeros((size + 1, size + 1), object)
    for r in summed:
        exact[r["i"], r["j"]] = exact[r["j"], r["i"]] = remainders([r[x] % p for x, p in zip(names[2:], moduli)], moduli)
    sums = [int(x) for x in exact[0, 1:]]
    covariance = exact[1:, 1:] * n - np.outer(np.array(sums, object), np.array(sums, object))
    covariance = np.array([[float(Fraction(int(x), n * n)) for x in line] for line in covariance], np.float64)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:count]
    trace = float(sum(Fraction(int(exact[k, k]) * n - sums[k - 1] ** 2, n * n) for k in range(1, size + 1)))
    order = order[values[order] > size * np.finfo(np.float64).eps * max(values.max(), 0.0)]
    return Whitener(n, sums, vectors[:, order] / np.sqrt(values[order]), [float(v) / trace for v in values[order]])


def whiten(embeddings: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT, count: int = COMPONENTS) -> DataFrame:
    """id, component (from 1), n, deviation (decimal: the exact sum of squares of ``n * x - sums``; null if it has over 38 digits), whitened,
    explained and identity_error for each vector and component."""
    kind = dict(embeddings.dtypes)[id_column]
    rows, n, size, most = _valid(embeddings.select(F.col(id_column).alias("_id"), F.col(vector).cast("array<double>").alias("_vector")))
    schema = f"`{id_column}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    own = fit(rows, n, size, most, scale, shift, count) if n else None
    if own is None or not own.explained:
        return embeddings.sparkSession.createDataFrame([], schema)
    width = len(own.explained)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            y = own.whitened(own.centred(whole(_vectors(batch), scale, shift)))
            total += y.T @ y
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "v"])

    spread = rows.select("_vector").mapInArrow(measure, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    error = max(abs(r["v"] / n - (r["i"] == r["j"])) for r in spread)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z = own.centred(whole(_vectors(batch), scale, shift))
            many = len(z) * width
            place = np.repeat(np.arange(len(z)), width)
            deviation = pa.array([str(d) if d < 10**38 else None for d in squared_lengths(z)], pa.string())
            columns = [
                batch.column("_id").take(pa.array(place)),
                pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(z))),
                pa.array(np.full(many, n, np.int64)),
                deviation.take(pa.array(place)),
                pa.array(own.whitened(z).ravel()),
                pa.array(np.tile(np.array(own.explained), len(z))),
                pa.array(np.full(many, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    found = rows.mapInArrow(project, f"id {kind}, component int, n long, deviation string, whitened double, explained double, identity_error double")
    return found.withColumn("deviation", F.col("deviation").cast("decimal(38,0)")).withColumnRenamed("id", id_column)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deviation is a long here; one beyond that (from some 10^7 rows on) is null, and ``whiten`` has it."""
    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))
