"""Training and use of scalar quantisers: rotation, primary and residual codes, and the distances they give."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfold.functions import vector as V
from nearfold.functions.codebook import normal_levels
from nearfold.operators.knn import matrix


def random_rotation(d: int, seed: int = 42) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def gaussian_projection(d: int, d_out: int, seed: int = 42) -> np.ndarray:
    """Entries N(0, 1/d_out): squared norms are kept in expectation."""
    return np.random.default_rng(seed).normal(scale=d_out**-0.5, size=(d_out, d))


def reflection(d: int) -> list[list[float]]:
    """A fixed orthogonal matrix: the reflection along (1, 1/2, ..., 1/d)."""
    v = [1.0 / (i + 1) for i in range(d)]
    n = sum(x * x for x in v)
    return [[float(i == j) - 2 * v[i] * v[j] / n for j in range(d)] for i in range(d)]


def estimate_sigma(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """sigma: root of the mean square over all components."""
    v = V.doubles(column)
    return vectors.select(V.sqnorm(v).alias("s"), F.size(v).alias("d")).agg(F.sqrt(F.sum("s") / F.sum("d")).alias("sigma"))


def kmeans_1d(values: DataFrame, k: int, rounds: int = 25) -> list[float]:
    """k ascending levels of the values (x), by Lloyd's iterations from their quantiles; an empty level returns to its quantile."""
    values = values.select(F.col("x").cast("double").alias("x"))
    starts = values.agg(F.percentile("x", F.array(*(F.lit((i + 0.5) / k) for i in range(k))))).first()[0]
    if starts is None:
        return []
    levels = list(starts)
    for _ in range(rounds):
        means = {r["c"]: r["m"] for r in values.groupBy(V.nearest_level(F.col("x"), levels).alias("c")).agg(F.avg("x").alias("m")).collect()}
        new = sorted(means.get(i, starts[i]) for i in range(k))
        if max(abs(a - b) for a, b in zip(new, levels)) < 1e-9:
            return new
        levels = new
    return levels


def second_moment(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """i, j, m: the uncentred second-moment matrix, upper triangle. Each partition adds up its own by matrix products."""
    sums = vectors.select(F.col(column).alias("v")).mapInArrow(_products, "i int, j int, s double, n long")
    return sums.groupBy("i", "j").agg((F.sum("s") / F.sum("n")).alias("m"))


def _products(batches):
    total, n = None, 0
    for batch in batches:
        if batch.num_rows:
            x = matrix(batch.column("v"))
            total, n = x.T @ x + (0 if total is None else total), n + len(x)
    if n:
        i, j = np.triu_indices(len(total))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j]), pa.array(np.full(len(i), n))], names=["i", "j", "s", "n"])


def principal_axes(vectors: DataFrame, k: int, column: str = "embedding") -> np.ndarray:
    """The k leading eigenvectors of the second-moment matrix, as rows."""
    got = second_moment(vectors, column).toPandas()
    d = int(got["j"].max()) + 1
    m = np.zeros((d, d))
    m[got["i"], got["j"]] = got["m"]
    m[got["j"], got["i"]] = got["m"]
    values, axes = np.linalg.eigh(m)
    return axes[:, np.argsort(-values)[:k]].T


def class_scatter_axes(vectors: DataFrame, label: str, k: int, column: str = "embedding") -> np.ndarray:
    """The k leading axes between classes: of the rows sqrt(n_c / n) (mean_c - mean)."""
    means = group_means(vectors.select(F.col(label).alias("c"), F.col(column).alias("v")), "c", "v").toPandas()
    w = means["n"].to_numpy(float) / means["n"].sum()
    m = np.array(means["mean"].tolist())
    scaled = np.sqrt(w)[:, None] * (m - (w[:, None] * m).sum(axis=0))
    return np.linalg.svd(scaled, full_matrices=False)[2][:k]


def group_means(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """key, n, mean of each group (integer keys): each batch is summed by key and component first, so a group of any size is summed everywhere."""
    kind = vectors.schema[key].dataType.simpleString()
    sums = vectors.select(key, F.col(column).alias("v")).mapInArrow(_sums(key), f"{key} {kind}, pos int, s double, n long")
    parts = sums.groupBy(key, "pos").agg((F.sum("s") / F.sum("n")).alias("m"), F.sum("n").alias("n"))
    return parts.groupBy(key).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("s")).select(key, "n", F.transform("s", lambda x: x["m"]).alias("mean"))


def _sums(key: str):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"))
            keys, at, n = np.unique(batch.column(key).to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
            d = x.shape[1]
            total = np.bincount((at[:, None] * d + np.arange(d)).ravel(), x.ravel(), len(keys) * d)
            columns = [pa.array(np.repeat(keys, d)).cast(batch.schema.field(key).type), pa.array(np.tile(np.arange(d, dtype=np.int32), len(keys))), pa.array(total), pa.array(np.repeat(n, d))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "pos", "s", "n"])

    return run


@dataclass(frozen=True)
class Quantiser:
    """Primary levels for each component, and levels for what they leave over."""

    primary: list[float]
    residual: list[float]

    @classmethod
    def analytic(cls, sigma: float, bits: int, residual_bits: int) -> "Quantiser":
        """Levels of a normal distribution; the residual's deviation is that within the inner primary cells."""
        primary = normal_levels(sigma, 1 << bits)
        gap = max((b - a for a, b in zip(primary, primary[1:])), default=2 * sigma)
        return cls(primary, normal_levels(gap / 12**0.5, 1 << residual_bits))

    def encode(self, vectors: DataFrame, column: str = "embedding") -> DataFrame:
        """Adds code, residual_code, and correction = 2 <primary part, residual part>."""
        v = V.doubles(column)
        coded = vectors.withColumn("code", V.quantize(v, self.primary))
        left = V.subtract(v, V.reconstruct(F.col("code"), self.primary))
        coded = coded.withColumn("residual_code", V.quantize(left, self.residual))
        parts = V.reconstruct(F.col("code"), self.primary), V.reconstruct(F.col("residual_code"), self.residual)
        return coded.withColumn("correction", 2 * V.dot(*parts))

    def decode(self, code: str = "code", residual_code: str = "residual_code") -> Column:
        return V.add(V.reconstruct(F.col(code), self.primary), V.reconstruct(F.col(residual_code), self.residual))

    def code_distance(self, q: Column, code: str = "code") -> Column:
        """Squared distance of a query to the primary part."""
        return V.l2sq(q, V.reconstruct(F.col(code), self.primary))

    def composite_distance(self, q: Column) -> Column:
        """Squared distance to the full decoded vector: primary and residual distances and the correction, less |q|^2, which they hold twice."""
        residual = V.l2sq(q, V.reconstruct(F.col("residual_code"), self.residual))
        return self.code_distance(q) + residual + F.col("correction") - V.sqnorm(q)


def packed_code(codes: Column, bits: int, per_byte: int) -> Column:
    """Sub-codes packed into numbers, the first lowest."""
    groups = F.sequence(F.lit(0), F.floor((F.size(codes) - 1) / per_byte).cast("int"))
    return F.transform(groups, lambda g: F.aggregate(F.sequence(F.lit(0), F.lit(per_byte - 1)), F.lit(0), lambda s, i: s + F.coalesce(F.try_element_at(codes, (g * per_byte + i + 1).cast("int")), F.lit(0)) * F.pow(F.lit(2), i * bits).cast("int")))

