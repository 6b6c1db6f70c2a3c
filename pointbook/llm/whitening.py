"""Embedding whitening: components of the covariance by spectrum slicing, and the vectors projected on them.

The covariance is taken over the fit list, each distinct integer vector once.
Its entries are sums of products of whole numbers that were centred (by the
rounded mean) before they were multiplied; Spark adds them up without loss,
and only their quotient by n² is rounded. The matrix is as large as the vectors
are long, whatever the number of rows; its leading eigenpairs are found on the
driver (``spectrum``) and sent to all rows.

Defined results: rows whose vector is null or holds a null or non-finite entry
are dropped; every other row is whitened, repeated ones each. Vectors count as
padded with zeros to the longest. A component without variance (fewer
distinct vectors or dimensions than components) cannot be whitened and gives no
rows; so an empty table, or one of a single distinct vector, gives none.
``deviation`` is null where it does not fit into a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spectrum
from .common import written
from .vectors import EXACT, integer_vectors, matrix, width_of

COMPONENTS = 4

# Vectors multiplied at a time.
ROWS = 4096

DECIMAL = pa.decimal128(38, 0)


def _whole(values: list[int]) -> pa.Array:
    from decimal import Decimal

    return pa.array([Decimal(v) for v in values], DECIMAL)


def fit_list(vectors: DataFrame, width: int, x: str = "x") -> DataFrame:
    """Each distinct vector once, padded to ``width``. Equal vectors meet in their task before they are shuffled."""
    padded = F.concat(F.col(x), F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size(x)))
    return vectors.select(padded.alias("x")).distinct()


def _parts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for s in range(0, batch.num_rows, ROWS):
            yield matrix(batch.column(0).slice(s, ROWS), width)


def totals(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """(rows, sum of each dimension), exact: one row a task and dimension is summed by Spark."""

    def run(batches):
        n, total = 0, [0] * width
        for x in _parts(batches, width):
            n += len(x)
            high, low = x >> 32, x & 0xFFFFFFFF  # halves cannot overflow
            total = [t + (int(h) << 32) + int(l) for t, h, l in zip(total, high.sum(0), low.sum(0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), _whole([n, *total])], ["i", "v"])

    got = dict(map(tuple, fit.select("x").mapInArrow(run, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").cast("decimal(38,0)")).collect()))
    return int(got.get(-1, 0)), [int(got.get(i, 0)) for i in range(width)]


def covariance(fit: DataFrame, width: int, n: int, sums: list[int]) -> np.ndarray:
    """The covariance (divisor n): products of entries less the rounded mean, summed exactly, corrected by the rest of the mean."""
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre)]
    upper = np.triu_indices(width)

    def run(batches):
        total = np.zeros(len(upper[0]), object)
        for x in _parts(batches, width):
            y = x - np.array(centre)
            if float(np.abs(y.astype(float)).max(initial=0)) ** 2 * ROWS < EXACT / 4:
                y = y.astype(np.float64)
                part = (y.T @ y)[upper].astype(np.int64).astype(object)
            else:
                y = x.astype(object) - np.array(centre, object)
                part = (y.T @ y)[upper]
            total = total + part
        yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), _whole([int(v) for v in total])], ["i", "j", "v"])

    # width * (width + 1) / 2 rows, whatever the table's size
    rows = fit.select("x").mapInArrow(run, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()
    v = np.zeros((width, width))
    for i, j, g in rows:
        v[i, j] = v[j, i] = (n * int(g) - rest[i] * rest[j]) / (n * n)
    return v


@dataclass
class Whitening:
    """Rows of the fit list, sums, eigenvalues (falling), unit eigenvectors (rows), the covariance's trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float

    @property
    def width(self) -> int:
        return len(self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections of x - S/n over the roots of the eigenvalues."""
        y = self._apart(x).astype(np.float64) / self.n
        return (y @ self.axes.T) / np.sqrt(self.values)

    def _apart(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        sums = np.array(self.sums, object)
        most = self.n * int(np.abs(x.astype(object)).max(initial=0)) + max((abs(s) for s in self.sums), default=0)
        return self.n * x - sums.astype(np.int64) if most < 1 << 62 else self.n * x.astype(object) - sums

    def deviation(self, x: np.ndarray) -> pa.Array:
        y = self._apart(x)
        if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * max(self.width, 1) < 1 << 63:
            return pa.array((y * y).sum(1))
        total = [int((row * row).sum()) for row in y.astype(object)]
        return pa.array([t if t < 1 << 63 else None for t in total], pa.int64())


def fit(vectors: DataFrame, components: int = COMPONENTS, x: str = "x") -> tuple[Whitening, DataFrame]:
    """The whitening of integer vectors, and the (written) fit list."""
    width = width_of(vectors, x)
    distinct = written(fit_list(vectors, width, x), "whitening")
    n, sums = totals(distinct, width)
    v = covariance(distinct, width, n, sums) if n else np.zeros((width, width))
    values, axes = spectrum.leading(v, components)
    return Whitening(n, sums, values, axes, float(np.trace(v))), distinct


def project(df: DataFrame, model: Whitening, x: str = "x", out: str = "w") -> DataFrame:
    """Add ``out``: a struct of the projections (array<double>) and the deviation; a column of that name is replaced."""
    keep = [c for c in df.columns if c != out]
    src = df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{x}`").alias("x"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # components times the vector's length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                part = batch.slice(s, ROWS)
                v = matrix(part.column(1), m.width)
                w = m.whitened(v)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.StructArray.from_arrays([lists, m.deviation(v)], ["whitened", "deviation"])], ["row", "w"])

    kind = T.StructType.fromDDL("w struct<whitened: array<double>, deviation: bigint>")
    done = src.mapInArrow(run, T.StructType([src.schema["row"], *kind.fields]))
    return done.select(*(F.col("row").getField(c).alias(c) for c in keep), F.col("w").alias(out))


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance less the identity."""
    k = len(model.values)
    if not k:
        return 0.0
    flat = project(distinct, model).select(*(F.col("w.whitened")[i].alias(f"y{i}") for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = flat.agg(*(F.covar_pop(f"y{i}", f"y{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(df: DataFrame, key: Column, components: int = COMPONENTS, source: str = "embedding") -> DataFrame:
    """A row for each row that stays and each component: vec_id (``key``), component, n, deviation, whitened, explained, identity_error."""
    vectors = integer_vectors(df.select(key.alias("vec_id"), F.col(source).alias("embedding")))
    model, distinct = fit(vectors, components)
    error = identity_error(distinct, model)
    shares = F.array(*(F.lit(float(e) / model.trace) for e in model.values)) if len(model.values) else F.array().cast("array<double>")
    rows = project(vectors, model).select("vec_id", F.col("w.deviation").alias("deviation"), F.posexplode("w.whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
                       F.get(shares, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"))


def report(embeddings: DataFrame) -> DataFrame:
    """Per row and component up to 4: vec_id, component, n, deviation, whitened, explained, identity_error."""
    return whiten(embeddings.select("vec_id", "embedding"), F.col("vec_id"))
