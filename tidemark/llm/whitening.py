"""Embedding whitening: a randomised range finder over all centred rows, Rayleigh-Ritz for the components.

Entries become whole numbers x = floor(scale * c) + shift. The model is fitted on every distinct x vector, once each: a
random basis of components + oversampling columns is multiplied by the covariance in repeated passes over all rows, made
orthonormal after each, until Rayleigh-Ritz in its span leaves residuals that are small against the gaps between the
eigenvalues. If they are still too large after `passes`, the basis becomes that of the full dimension and one more pass
gives the covariance itself, whose eigenvectors are then exact to double precision.

A pass is a Spark job: each task folds its rows into one matrix of dimension x columns, the rows of these matrices are
summed by their number, and the driver gets one matrix, whose size depends on the dimension alone. The distinct vectors
lie in the shared folder as Parquet, so a lost executor costs a rerun of its tasks.

Defined cases: dropped are null vectors, those with null or non-finite entries or with entries of 2^40 and more, and those
whose length isn't the most frequent one (the longer of equally frequent). A component without variance (an eigenvalue of
at most 1e-12 of the trace, as with a single distinct vector) has whitened 0 and takes no part in identity_error; where
the trace is 0 explained is null. deviation is null where it doesn't fit in a long. Repeated rows and ids each get their
rows; a null vec_id is kept; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_batches, table

COMPONENTS = 16
OVERSAMPLING = 10
PASSES = 4
SCALE, SHIFT = 64, 1_000_000
PRECISION = 1e-12  # of residuals against gaps
FLAT = 1e-12  # of an eigenvalue against the trace
LARGEST = float(1 << 40)
ROWS = 4096


@dataclass
class Model:
    """n distinct vectors with sums S; components [dimension, k] by falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    columns: int  # of the basis that gave the components
    passes: int

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt(eigenvalue), 0 for components without variance."""
        sound = self.eigenvalues > FLAT * self.trace
        return np.divide(1.0, np.sqrt(np.where(sound, self.eigenvalues, 1.0)), out=np.zeros(len(sound)), where=sound)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x - np.array([s // self.n for s in self.sums]) - np.array([s % self.n for s in self.sums]) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components * self.scales

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, in whole numbers."""
        far = max(self.n * abs(int(v)) + abs(s) for lo, hi, s in zip(x.min(axis=0), x.max(axis=0), self.sums, strict=True) for v in (lo, hi)) if len(x) else 0
        if far < 1 << 63:
            d = self.n * x - np.array(self.sums, np.int64)
            if int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 1 << 63:
                return (d * d).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def whole(df: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id and x of the vectors that count, whose lengths are looked up when this is called."""
    c = F.col("embedding")
    sound = F.forall(c, lambda v: F.coalesce(F.abs(v.cast("double")) < LARGEST, F.lit(False)))  # false for NaN, which is larger than all
    kept = df.where(c.isNotNull() & sound & (F.size(c) > 0))
    usual = kept.groupBy(F.size(c).alias("length")).count().agg(F.max(F.struct("count", "length"))["length"]).first()[0]
    x = F.transform(c, lambda v: F.floor(v.cast("double") * scale).cast("long") + shift)
    return kept.where(F.size(c) == (usual or 0)).select("vec_id", x.alias("x"))


def _vectors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The column x as matrices of at most ROWS rows."""
    column = batch.column(batch.schema.get_field_index("x"))
    for lo in range(0, len(column), ROWS):
        part = column.slice(lo, ROWS)
        yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def summed(fit: DataFrame, fold: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of fold(x), a matrix of `shape`, over all rows of `fit`: folded in each task, then summed entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(shape), False
        for batch in batches:
            for x in _vectors(batch):
                total, some = total + fold(x), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), pa.array(list(total))], ["i", "row"])

    parts = small_batches(fit.select("x")).mapInArrow(run, "i int, row array<double>")
    sums = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    found, out = sums.toArrow(), np.zeros(shape)
    out[found["i"].to_numpy(), found["j"].to_numpy()] = found["v"].to_numpy()
    return out


def _ritz(basis: np.ndarray, product: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The k leading Ritz values and vectors in the span of an orthonormal basis, from the covariance times it, and whether they are precise."""
    inner = basis.T @ product
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = basis @ turn[:, :k]
    if basis.shape[1] == basis.shape[0]:
        return np.maximum(values[:k], 0), vectors, True
    if len(values) == k:  # nothing is known of the gap below the last
        return np.maximum(values, 0), vectors, False
    residual = np.linalg.norm(product @ turn[:, :k] - vectors * values[:k], axis=0)
    gaps = np.abs(np.diff(values[: k + 1]))
    near = np.minimum(gaps, np.append(np.inf, gaps[:-1]))
    return np.maximum(values[:k], 0), vectors, bool((residual <= PRECISION * near).all())


def fit(vectors: DataFrame, k: int = COMPONENTS, oversampling: int = OVERSAMPLING, passes: int = PASSES, seed: int = 11) -> Model | None:
    """The model of the distinct x of `vectors`; None without any. Runs its passes when called."""
    scratch = Scratch(vectors.sparkSession)
    distinct = scratch.write(vectors.select("x").distinct(), "distinct")
    sums = distinct.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).orderBy("j").collect()
    if not sums:
        return None
    model = Model(sums[0].n, [int(r.s) for r in sums], np.zeros((len(sums), 0)), np.zeros(0), 0.0, 0.0, 0, 0)
    d, n = len(sums), model.n
    k = min(k, d)

    def times(basis: np.ndarray) -> np.ndarray:
        """The covariance times a basis, and its trace as a last column's first entry."""

        def fold(x: np.ndarray) -> np.ndarray:
            c = model.centred(x)
            side = np.zeros((d, 1))
            side[0, 0] = (c * c).sum()
            return np.hstack((c.T @ (c @ basis), side))

        return summed(distinct, fold, (d, basis.shape[1] + 1)) / n

    rng = np.random.default_rng(seed)
    columns = min(d, k + oversampling)
    basis, done, precise = np.linalg.qr(rng.normal(size=(d, columns)))[0], 0, False
    while not precise:
        if done == passes and columns < d:
            columns = d
            basis = np.eye(d)
        elif columns == d:
            basis = np.eye(d)
        product = times(basis)
        model.trace = float(product[0, -1])
        model.eigenvalues, model.components, precise = _ritz(basis, product[:, :-1], k)
        basis, done = np.linalg.qr(product[:, :-1])[0], done + 1
    model.columns, model.passes = columns, done
    white = summed(distinct, lambda x: (w := model.whitened(x)).T @ w, (k, k)) / n
    sound = model.scales > 0
    model.identity_error = float(np.abs(white - np.eye(k))[np.ix_(sound, sound)].max(initial=0.0))
    return model


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def transform(vectors: DataFrame, model: Model | None) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error for each row of `vectors` and component."""
    if model is None:
        return vectors.sparkSession.createDataFrame([], OUT)
    k = len(model.eigenvalues)
    explained = [e / model.trace if model.trace > 0 else None for e in model.eigenvalues.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lo = batch.column(batch.schema.get_field_index("vec_id")), 0
            for x in _vectors(batch):
                m = len(x)
                of = pa.array(np.repeat(np.arange(lo, lo + m), k))
                columns = [
                    ids.take(of),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    pa.array(model.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(model.whitened(x).ravel()),
                    pa.array(explained * m, pa.float64()),
                    pa.array(np.full(m * k, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
                lo += m

    return small_batches(vectors).mapInArrow(run, OUT)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return transform(vectors, fit(vectors))
