"""Whitening of embeddings from an exact integer scatter.

Entries are quantised to integers x. A shift (the first vector met) is subtracted, and every task accumulates sums and
cross-products of its rows: a block's product is a float matrix product over so few rows, and so few bits, that every
partial sum stays under 2^53 and is exact; blocks are added up as integers of any length. Tasks hand these on in limbs of
30 bits, which Spark adds up by (row, column, limb). From them n X'X - SS' is formed exactly; only then is it divided and
decomposed by eigh. What reaches the driver is bounded by the square of the dimension, whatever the number of rows.

Cases: rows whose vector is null, empty, or holds null or non-finite entries are neither fitted nor returned. Vectors of
several lengths, and entries that do not fit 64 bits when quantised, are errors. Repeated rows count each. Without rows
the result is empty. Fewer dimensions than asked for give fewer components. A component without variance has a null
`whitened` and is left out of identity_error. Null keys stay; columns that are not keys are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import persisted, read_table

#: Bits of a limb in which tasks hand on their sums, and of a part of an entry in which products are made.
LIMB = 30
PART = 24
#: Rows of a block.
BLOCK = 4096


def usable(vec: str) -> Column:
    """Whether a vector has entries, all of them finite."""
    fine = F.forall(F.col(vec).cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.col(vec).isNotNull() & (F.size(vec) > 0) & fine


def quantised(column: pa.ListArray, dim: int, scale: float, offset: int) -> np.ndarray:
    """floor(scale * c) + offset of a column of vectors, as rows of 64-bit integers."""
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != dim).any():
        raise ValueError(f"vectors of {dim} and of {int(lengths[lengths != dim][0])} entries")
    x = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(float))
    if len(x) and np.abs(x).max() >= 2.0**62:
        raise ValueError("an entry does not fit 64 bits")
    return x.astype(np.int64).reshape(-1, dim) + offset


def parts_of(x: np.ndarray) -> list[np.ndarray]:
    """x as signed parts of PART bits, the lowest first, as floats."""
    out = []
    while np.abs(x).max(initial=0) >= 1 << PART:
        out.append((x & ((1 << PART) - 1)).astype(float))
        x = x >> PART
    return [*out, x.astype(float)]


class Scatter:
    """Exact sums and cross-products of integer rows."""

    def __init__(self, dim: int):
        self.n = 0
        self.sums = np.zeros(dim, object)
        self.products = np.zeros((dim, dim), object)

    def add(self, x: np.ndarray) -> None:
        """x: shifted rows, 64-bit."""
        # The widest part has PART bits, so that 2^(53 - 2 PART) rows are exact, more where entries are smaller.
        widest = float(max(1, min(int(np.abs(x).max(initial=0)), 1 << PART)))
        rows = max(1, min(BLOCK, int(2.0**53 / widest**2)))
        for i in range(0, len(x), rows):
            parts = parts_of(x[i : i + rows])
            for p, a in enumerate(parts):
                self.sums += a.sum(0).astype(np.int64).astype(object) << (PART * p)
                for q, b in enumerate(parts):
                    self.products += (a.T @ b).astype(np.int64).astype(object) << (PART * (p + q))
        self.n += len(x)

    def limbs(self) -> Iterator[pa.RecordBatch]:
        """(i, j, limb, v): i = -1 counts rows, j = -1 are sums, else products with i <= j."""
        dim = len(self.sums)
        i, j = np.triu_indices(dim)
        i = np.concatenate([[-1], np.arange(dim), i]).astype(np.int32)
        j = np.concatenate([[-1], np.full(dim, -1), j]).astype(np.int32)
        v = np.concatenate([np.array([self.n], object), self.sums, self.products[np.triu_indices(dim)]])
        count = max(int(abs(x)).bit_length() for x in v) // LIMB + 1
        for k in range(count):
            low = v >> (LIMB * k)
            out = low if k == count - 1 else low & ((1 << LIMB) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.full(len(v), k, np.int32)), pa.array(out.astype(np.int64))], ["i", "j", "limb", "v"])


def fit(vectors: DataFrame, scale: float, offset: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray] | None:
    """(n, shift, sums of shifted rows, n X'X - SS') of the vectors (column v), in exact integers; None without rows."""
    first = vectors.select("v").take(1)
    if not first:
        return None
    dim = len(first[0].v)
    shift = quantised(pa.array([first[0].v], pa.list_(pa.float64())), dim, scale, offset)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Scatter(dim)
        for b in batches:
            held.add(quantised(b.column(0), dim, scale, offset) - shift)
        if held.n:
            yield from held.limbs()

    parts = vectors.select("v").mapInArrow(run, "i int, j int, limb int, v long").groupBy("i", "j", "limb").agg(F.sum("v").alias("v"))
    n, sums, products = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
    for i, j, limb, v in parts.collect():  # as many rows as a triangle of the matrix has limbs
        if i < 0:
            n += v << (LIMB * limb)
        elif j < 0:
            sums[i] += v << (LIMB * limb)
        else:
            products[i, j] += v << (LIMB * limb)
    upper = np.triu(np.ones((dim, dim), bool))
    products = np.where(upper, products, products.T)
    return n, shift, sums, n * products - np.outer(sums, sums)


def decompose(n: int, scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues from the largest on, unit eigenvectors as columns (the largest entry positive), and the trace of the covariance."""
    square = n * n
    cov = np.array([[x / square for x in row] for row in scatter], float)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    return e, u * np.sign(u[np.abs(u).argmax(0), np.arange(len(e))]), sum(scatter.diagonal()) / square


def deviations(d: np.ndarray) -> list[int]:
    """Exact sums of squares of rows of integers."""
    if d.dtype != object and d.shape[1] * float(np.abs(d).max(initial=0)) ** 2 < 2.0**62:
        return (d * d).sum(1).tolist()
    return [sum(x * x for x in row) for row in d.tolist()]


def whiten(df: DataFrame, keys: list[str], vec: str = "embedding", components: int = 8, scale: float = 1024.0, offset: int = 100_000) -> DataFrame:
    """keys, component (from 1), n, deviation (decimal), whitened, explained, identity_error for every usable row and component.

    deviation is the exact sum of (n x - S)^2 over the dimensions; identity_error is measured on the whitened rows.
    """
    spark = df.sparkSession
    vectors = df.where(usable(vec)).select(*keys, F.col(vec).cast("array<double>").alias("v"))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    found = fit(vectors, scale, offset)
    if found is None:
        return spark.createDataFrame([], f"{kinds}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    n, shift, sums, scatter = found
    dim = len(shift)
    e, u, trace = decompose(n, scatter)
    e, u = e[:components], u[:, :components]
    alive = e > max(trace, 0.0) * dim * np.finfo(float).eps
    onto = np.where(alive, u / np.sqrt(np.where(alive, e, 1.0)), 0.0)
    small = max(map(abs, [*sums, 0])) < 1 << 61

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                some = b.slice(i, BLOCK)
                x = quantised(some.column(some.num_columns - 1), dim, scale, offset) - shift
                fits = small and n * int(np.abs(x).max(initial=0)) < 1 << 61
                d = n * x - sums.astype(np.int64) if fits else n * x.astype(object) - sums
                w = (d / n).astype(float) @ onto
                dev = pa.array([str(y) for y in deviations(d)]).cast(pa.decimal128(38, 0))
                flat = pa.array(w.ravel())
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], dev, rows], [*some.schema.names[:-1], "deviation", "w"])

    rows = persisted(vectors.mapInArrow(run, f"{kinds}, deviation decimal(38,0), w array<double>"), "whitened")
    live = np.flatnonzero(alive).tolist()
    error = 0.0
    if live:
        means = rows.agg(*[F.avg(F.col("w")[i]) for i in live]).first()
        centred = {i: F.col("w")[i] - F.lit(m) for i, m in zip(live, means, strict=True)}
        pairs = [(i, j) for i in live for j in live if i <= j]
        cov = rows.agg(*[F.avg(centred[i] * centred[j]) for i, j in pairs]).first()
        error = max(abs(c - (i == j)) for (i, j), c in zip(pairs, cov, strict=True))
    share = F.array(*[F.lit(float(x / trace) if trace > 0 else None).cast("double") for x in e])
    kept = F.array(*[F.lit(bool(x)) for x in alive])
    out = rows.select(*keys, "deviation", F.posexplode("w").alias("at", "y"))
    return out.select(*keys, (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.when(kept[F.col("at")], F.col("y")).alias("whitened"), share[F.col("at")].alias("explained"), F.lit(float(error)).alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(read_table(spark, sf_dir, "embeddings"), ["vec_id"])
    return out.withColumn("deviation", F.col("deviation").cast("long"))
