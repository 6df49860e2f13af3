"""Whitening of embeddings: exact sums of squares of every dimension and of every pair's sum give, by polarisation, every
covariance; the matrix is assembled and decomposed, and each vector is projected on its leading components."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from . import common

#: An entry c counts as floor(SCALE * c) + SHIFT; products beyond LARGEST saturate.
SCALE, SHIFT, LARGEST = 64, 1_000_000, float(1 << 48)
N_COMPONENTS = 16
#: Directions with less of the variance than this are rounding errors of the decomposition, not components.
LEAST_SHARE = 1e-12
#: Rows that a task holds as a matrix at a time.
BLOCK = 1024
_EXACT = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums per dimension; centre (whole numbers near the means) and rest = sums - n * centre; weights
    (dimension by component); explained: each component's share of the variance; identity_error over the fit list."""

    n: int
    sums: list[int]
    centre: np.ndarray
    rest: list[int]
    weights: np.ndarray
    explained: list[float]
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre).astype(np.float64) - np.array([r / self.n for r in self.rest])) @ self.weights

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - sums)^2, as whole numbers of any size."""
        y = x - self.centre
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.rest), default=0)
        exact = most * most * max(x.shape[1], 1) < _EXACT
        z = y.astype(np.int64 if exact else object) * self.n - np.array(self.rest, np.int64 if exact else object)
        return (z * z).sum(axis=1).tolist()


def integral(vector: Column) -> Column:
    """The whole numbers that a vector's entries count as."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))).cast("long") + SHIFT)


def matrix(column: pa.Array, width: int, kind=np.int64) -> np.ndarray:
    """Arrays of one length, without nulls, as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _totals(fit: DataFrame, width: int, size: int, of) -> list[int]:
    """Sums over all rows of what of(block of rows) gives, whole numbers: first within tasks, then over tasks."""

    def partial(batches):
        total = np.zeros(size, object)
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                total += of(matrix(batch.column(0).slice(first, BLOCK), width))
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int64()), pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))], ["k", "v"])

    rows = fit.select("x").mapInArrow(partial, "k long, v decimal(38,0)").groupBy("k").agg(F.sum("v").cast(DecimalType(38, 0)).alias("v")).collect()
    out = [0] * size
    for k, v in rows:
        out[k] = int(v)
    return out


def _squares(centre: np.ndarray):
    """Of a block: the sum of each dimension's centred squares, then of the squares of each pair's sum."""

    def of(x: np.ndarray) -> np.ndarray:
        y = x - centre
        if 4 * int(np.abs(y).max(initial=0)) ** 2 * BLOCK >= _EXACT:
            y = y.astype(object)
        parts = [(y * y).sum(axis=0)]
        for i in range(y.shape[1] - 1):
            both = y[:, i : i + 1] + y[:, i + 1 :]
            parts.append((both * both).sum(axis=0))
        return np.concatenate(parts).astype(object)

    return of


def covariance(n: int, rest: list[int], squares: list[int]) -> np.ndarray:
    """2 cov(a, b) = var(a + b) - var(a) - var(b), in whole numbers and divided once. squares are about the centre; what
    it is off the mean, rest / n, is taken out exactly."""
    width = len(rest)
    own = [n * q - r * r for q, r in zip(squares, rest)]
    out, k = np.zeros((width, width)), width
    for i in range(width):
        out[i, i] = own[i] / n**2
        for j in range(i + 1, width):
            out[i, j] = out[j, i] = (n * squares[k] - (rest[i] + rest[j]) ** 2 - own[i] - own[j]) / (2 * n**2)
            k += 1
    return out


def components(cov: np.ndarray, most: int) -> tuple[np.ndarray, list[float]]:
    """Weights that project on the unit eigenvectors and divide by the root of the eigenvalue, largest first, and each one's
    share of the trace. The largest entry of an eigenvector is positive."""
    trace = float(np.trace(cov))
    if not trace > 0:
        return np.zeros((len(cov), 0)), []
    value, vector = np.linalg.eigh(cov)
    keep = [i for i in np.argsort(-value, kind="stable")[:most] if value[i] > LEAST_SHARE * trace]
    vector = vector[:, keep]
    vector = vector * np.sign(vector[np.abs(vector).argmax(axis=0), range(len(keep))])
    return vector / np.sqrt(value[keep]), [float(value[i] / trace) for i in keep]


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    width, k = model.weights.shape

    def partial(batches):
        total, product = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                w = model.project(matrix(batch.column(0).slice(first, BLOCK), width))
                total, product = total + w.sum(axis=0), product + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k + k * k), pa.int64()), pa.array(np.concatenate([total, product.ravel()]))], ["k", "v"])

    sums = np.zeros(k + k * k)
    for i, v in fit.select("x").mapInArrow(partial, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        sums[i] = v
    mean = sums[:k] / model.n  # rounding only, as what is projected is centred
    return float(np.abs(sums[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def sound(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there, has entries, and has no null or non-finite ones."""
    fine = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False)))


def width_of(df: DataFrame, vector: str) -> int:
    """The length that most vectors have (of equally many the larger), 0 without rows."""
    top = df.groupBy(F.size(vector).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return top["width"] if top else 0


def fitted(df: DataFrame, vector: str = "embedding", n_components: int = N_COMPONENTS) -> Whitening | None:
    """Whitening of the distinct vectors of df; None without any.

    Copies are taken out with partial aggregation and the distinct vectors stored; three passes over them sum up
    dimensions, squares and the check. Each task sends d(d+1)/2 sums, and the driver holds a d by d matrix: both depend on
    the dimensions alone.
    """
    good = sound(df, vector)
    width = width_of(good, vector)
    if not width:
        return None
    fit = common.stored(good.where(F.size(vector) == width).select(integral(F.col(vector)).alias("x")).distinct(), "vectors")
    n = fit.count()
    sums = _totals(fit, width, width, lambda x: x.sum(axis=0).astype(object))
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = [s - n * int(c) for s, c in zip(sums, centre)]
    squares = _totals(fit, width, width * (width + 1) // 2, _squares(centre))
    weights, explained = components(covariance(n, rest, squares), n_components)
    model = Whitening(n, sums, centre, rest, weights, explained)
    return Whitening(n, sums, centre, rest, weights, explained, _identity_error(fit, model) if explained else 0.0)


def whitened(df: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """df's rows with a usable vector, with whitened (array of double, one a component) and deviation (sum over dimensions
    of (n * x - sums)^2; null from 10^38 on).

    Vectors that are null or empty, hold null or non-finite entries, or have another length than most have no row.
    Repeated rows and equal vectors each keep their row and get equal values. Entries beyond 2^42 saturate. Without
    variance (one distinct vector) there are no components and whitened is empty. Other columns are kept; ones named
    whitened or deviation are replaced.
    """
    width, k = model.weights.shape

    @F.arrow_udf("struct<whitened array<double>, deviation decimal(38,0)>")
    def of(x: pa.Array) -> pa.Array:
        values, sizes = [], []
        for first in range(0, len(x), BLOCK):
            block = matrix(x.slice(first, BLOCK), width)
            values.append(model.project(block).ravel())
            sizes += model.deviation(block)
        flat = np.concatenate(values) if values else np.zeros(0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(flat))
        return pa.StructArray.from_arrays([lists, pa.array([Decimal(s) if s < 10**38 else None for s in sizes], pa.decimal128(38, 0))], ["whitened", "deviation"])

    names = [F.col(f"`{c}`") for c in df.columns if c not in ("whitened", "deviation")]
    good = sound(df, vector).where(F.size(vector) == width)
    return good.select(*names, of(integral(F.col(vector))).alias("__w")).select(*names, "__w.whitened", "__w.deviation")


def op11_polarisation_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each usable vector's components: vec_id, component (from 1), n, deviation (null beyond a long), whitened, explained,
    identity_error. No rows for an empty table, or where all vectors are equal."""
    table = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fitted(table)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    explained = F.array(*(F.lit(e) for e in model.explained)) if model.explained else F.array().cast("array<double>")
    rows = whitened(table, model).select("vec_id", F.expr("try_cast(deviation AS long)").alias("deviation"), F.posexplode("whitened").alias("i", "whitened"))
    return rows.select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("i")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )


QUERIES = {"op11_polarisation_whitening": op11_polarisation_whitening}
ORACLES: dict[str, str] = {}
