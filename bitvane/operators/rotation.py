"""A learned orthogonal rotation that makes sign codes more informative (ITQ, Gong and Lazebnik, CVPR 2011).

Training alternates: the signs B = sign(XW) and the cross moment X'B come from one distributed pass
over a sample, W is the polar factor of the moment, by a singular value decomposition on the driver. The
sample is of at most some 100,000 rows by default, drawn by a hash of the vector. A pass sends one
dim x dim matrix for each partition, of 4,096 rows on average; the partitions are fixed by a hash of the
row, and their sums are added in order, so training is repeatable. The matrix G = W' maps x to Gx, as
float32. A model that was never trained, or failed to, is the identity.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes as C
from ..plans.planner import EngineError, RotationStatus


def random_orthogonal(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same for the same seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def polar_factor(m: np.ndarray) -> np.ndarray:
    """The orthogonal matrix nearest m; raises not_converged where m is (nearly) rank-deficient."""
    if not np.isfinite(m).all():
        raise EngineError(RotationStatus.NOT_CONVERGED, "the moment isn't finite")
    u, s, vt = np.linalg.svd(m)
    if s[0] == 0 or s[-1] <= s[0] * len(m) * np.finfo(np.float64).eps:
        raise EngineError(RotationStatus.NOT_CONVERGED, "the moment is rank-deficient")
    return u @ vt


def residual(g: np.ndarray) -> float:
    """max |G'G - I|; 1e30 where G holds NaN."""
    with np.errstate(invalid="ignore", over="ignore"):
        r = np.abs(g.T.astype(np.float64) @ g.astype(np.float64) - np.eye(len(g))).max(initial=0.0)
    return float(r) if np.isfinite(r) else 1e30


def spectral_norm(m: np.ndarray) -> float:
    return float(np.linalg.norm(m, 2))


@dataclass
class RotationModel:
    matrix: np.ndarray  # dim x dim float32, y = Gx
    error_before: float = 0.0
    error_after: float = 0.0
    orthogonality: float = 0.0
    objective: tuple[float, ...] = ()

    @classmethod
    def identity(cls, dim: int) -> RotationModel:
        return cls(np.eye(dim, dtype=np.float32))

    @property
    def dim(self) -> int:
        return len(self.matrix)

    # -- applying ----------------------------------------------------------------------------

    def rotate_numpy(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.float64) @ self.matrix.T.astype(np.float64)).astype(np.float32)

    def rotate(self, df: DataFrame, vector: str = "embedding", out: str = "rotated") -> DataFrame:
        """df with Gx of each vector."""
        held = df.sparkSession.sparkContext.broadcast(self.matrix)  # dim x dim
        dim = self.dim

        @F.pandas_udf("array<float>")
        def turned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            g = held.value.astype(np.float64)
            for column in batches:
                yield pd.Series(list((C.stacked(column, dim).astype(np.float64) @ g.T).astype(np.float32)), dtype=object)

        return df.withColumn(out, turned(F.col(vector)))

    def rotate_quantize(self, df: DataFrame, vector: str = "embedding", prefix: str = "w") -> DataFrame:
        """df with the code's words of the rotated vector: one trip to Python, the same bits as rotating first."""
        held, dim, names = df.sparkSession.sparkContext.broadcast(self.matrix), self.dim, C.word_names(self.dim, prefix)

        @F.pandas_udf("array<bigint>")
        def coded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            g = held.value.astype(np.float64)
            for column in batches:
                turned = (C.stacked(column, dim).astype(np.float64) @ g.T).astype(np.float32)
                yield pd.Series(list(C.pack_numpy(turned).view(np.int64)), dtype=object)

        return df.withColumn("_code", coded(F.col(vector))).withColumns({n: F.col("_code")[i] for i, n in enumerate(names)}).drop("_code")

    # -- keeping -----------------------------------------------------------------------------

    def save(self, spark: SparkSession, path: str) -> None:
        """As Parquet: (row, coeffs), and the diagnostics as a row -1's note."""
        notes = json.dumps({"error_before": self.error_before, "error_after": self.error_after, "orthogonality": self.orthogonality})
        rows = [(i, [float(x) for x in r], None) for i, r in enumerate(self.matrix)] + [(-1, None, notes)]
        spark.createDataFrame(rows, "row int, coeffs array<float>, note string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, dim: int | None = None) -> RotationModel:
        rows = {r["row"]: r for r in spark.read.parquet(path).collect()}  # dim rows and a note
        notes = json.loads(rows.pop(-1)["note"])
        g = np.array([rows[i]["coeffs"] for i in range(len(rows))], np.float32)
        check_matrix(g, dim)
        return cls(g, **notes)


def check_matrix(g: np.ndarray, dim: int | None = None) -> None:
    if dim is not None and len(g) != dim:
        raise EngineError(RotationStatus.INCOMPATIBLE, f"{len(g)} dimensions, not {dim}")
    if g.ndim != 2 or g.shape[0] != g.shape[1] or not np.isfinite(g).all() or residual(g) >= 1e-2:
        raise EngineError(RotationStatus.CORRUPT, "the matrix isn't orthogonal")


def quantization_error(rotated: Column) -> Column:
    """Aggregate: the mean over rows and components of (sign(y) - y)**2, where the sign of 0 is -1."""
    part = F.aggregate(rotated, F.lit(0.0), lambda s, y: s + F.pow(F.when(y > 0, 1.0).otherwise(-1.0) - y.cast("double"), F.lit(2.0)))
    return F.avg(part / F.size(rotated))


def _passes(data: DataFrame, dim: int, partitions: int):
    """A function of W that gives (X'B, sum of (B - XW)**2), added up in partition order."""
    # a hash of the values deals equal rows alike in every run
    dealt = data.select("embedding").repartition(partitions, F.xxhash64("embedding")).sortWithinPartitions("embedding").persist()
    spark = data.sparkSession

    def moment(w: np.ndarray) -> tuple[np.ndarray, float]:
        held = spark.sparkContext.broadcast(w)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, error = np.zeros((dim, dim)), 0.0
            for batch in batches:
                x = C.stacked(batch["embedding"], dim, np.float64)
                y = x @ held.value
                b = np.where(y > 0, 1.0, -1.0)
                total += x.T @ b
                error += float(((b - y) ** 2).sum())
            from pyspark import TaskContext

            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "moment": [total.ravel()], "error": [error]})

        rows = dealt.mapInPandas(run, "part int, moment array<double>, error double").collect()  # partitions rows of dim**2
        rows.sort(key=lambda r: r["part"])
        return sum((np.array(r["moment"]).reshape(dim, dim) for r in rows), np.zeros((dim, dim))), sum(r["error"] for r in rows)

    return moment, dealt


class RotationEstimator:
    """Fits a RotationModel; fit() raises EngineError bad_input or not_converged."""

    def __init__(self, iterations: int = 20, seed: int = 42, partitions: int | None = None, sample_rows: int = 100_000):
        self.iterations, self.seed, self.partitions, self.sample_rows = iterations, seed, partitions, sample_rows

    def fit(self, df: DataFrame, dim: int, vector: str = "embedding") -> RotationModel:
        data = df.select(F.col(vector).alias("embedding")).where(F.col(vector).isNotNull())
        facts = data.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
        if self.iterations < 1 or facts["n"] < dim or facts["low"] != dim or facts["high"] != dim:
            raise EngineError(RotationStatus.BAD_INPUT, "too few rows, no iterations, or rows of another length")
        n = facts["n"]
        if n > self.sample_rows:
            place = F.pmod(F.xxhash64("embedding", F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
            data = data.where(place < self.sample_rows / n)
            n = data.count()
            if n < dim:
                raise EngineError(RotationStatus.BAD_INPUT, "too few rows in the sample")
        partitions = self.partitions or n // 4096 + 1
        moment, dealt = _passes(data, dim, partitions)
        try:
            _, before = moment(np.eye(dim))
            w, objective = random_orthogonal(dim, self.seed), []
            for _ in range(self.iterations):
                m, error = moment(w)
                objective.append(error / (n * dim))
                w = polar_factor(m)
            g = w.T.astype(np.float32)
            _, after = moment(g.T.astype(np.float64))
        finally:
            dealt.unpersist()
        off = residual(g)
        if off >= 1e-3:
            raise EngineError(RotationStatus.NOT_CONVERGED, f"residual {off}")
        scale = n * dim
        return RotationModel(g, before / scale, after / scale, off, tuple(objective))

    def fit_or_identity(self, df: DataFrame, dim: int, vector: str = "embedding") -> tuple[RotationModel, RotationStatus]:
        try:
            return self.fit(df, dim, vector), RotationStatus.OK
        except EngineError as e:
            return RotationModel.identity(dim), e.status
