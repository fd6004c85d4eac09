"""k-means over vector tables, and assignment to centroids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfold.functions import vector as V
from nearfold.operators.knn import matrix, of_dimension, top_k
from nearfold.operators.quantize import group_means
from nearfold.scratch import written


def nearest(vectors: DataFrame, centroids: DataFrame, column: str = "embedding", by: list[str] | None = None) -> DataFrame:
    """vectors with c and dist of the nearest centroid (c, cent); ties to the smallest c.

    by: centroids of the row's own parent only. The centroids of a level are a bounded model table; all of a parent's
    are put beside each row as one array, so rows are neither multiplied nor shuffled.
    """
    by = by or []
    table = centroids.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("c", "cent"))).alias("_cents"))
    joined = vectors.join(F.broadcast(table), by) if by else vectors.crossJoin(F.broadcast(table))
    scored = F.transform("_cents", lambda t: F.struct(V.l2sq(V.doubles(column), t["cent"]).alias("dist"), t["c"].alias("c")))
    return joined.withColumn("_best", F.array_min(scored)).select(*vectors.columns, F.col("_best.c").alias("c"), F.col("_best.dist").alias("dist"))


def _assign(cents: np.ndarray, ids: np.ndarray, column: str):
    def run(batches):
        norms = (cents**2).sum(axis=1)
        for batch in batches:
            batch = of_dimension(batch, column, cents.shape[1])
            if not batch.num_rows:
                continue
            x = matrix(batch.column(column))
            d = norms[None, :] - 2 * x @ cents.T
            at = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids[at]), pa.array(d[np.arange(len(at)), at] + (x**2).sum(axis=1))], names=[*batch.schema.names, "c", "dist"])

    return run


def assign_fast(vectors: DataFrame, cents: np.ndarray, column: str = "embedding") -> DataFrame:
    """As nearest, for many centroids: one matrix product for each Arrow batch. Adds c and dist. Null and empty vectors, and those of another dimension, are left out."""
    import pyspark.sql.types as T

    schema = T.StructType([*vectors.schema.fields, T.StructField("c", T.LongType()), T.StructField("dist", T.DoubleType())])
    return vectors.mapInArrow(_assign(np.asarray(cents, np.float64), np.arange(len(cents)), column), schema)


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows with a vector to learn from: neither null nor empty, all components finite."""
    return vectors.where((F.size(column) > 0) & V.is_finite(V.doubles(column)))


def strided_init(vectors: DataFrame, k: int, column: str = "embedding") -> np.ndarray:
    """Vectors at even strides of the order of vec_id, whatever the ids are; fewer than k if there are fewer rows. vectors: a training set of bounded size.

    Ids alone are ranked, by ranges: the ranges' counts say which rank each stride has within its range.
    """
    vectors = usable(vectors, column)
    n = vectors.count()
    if not n:
        return np.zeros((0, 0))
    places = sorted({i * n // k for i in range(k)})
    low, high = vectors.agg(F.min("vec_id"), F.max("vec_id")).first()
    if high - low + 1 == n:  # no gaps: ranks are ids
        ids = [low + p for p in places]
    else:
        ranked = vectors.select("vec_id").repartitionByRange("vec_id").sortWithinPartitions("vec_id")
        ids = _at_places(ranked, places)
    got = {r["vec_id"]: r["v"] for r in vectors.where(F.col("vec_id").isin(ids)).select("vec_id", V.doubles(column).alias("v")).collect()}
    return np.array([got[i] for i in ids])


def _at_places(ordered: DataFrame, places: list[int]) -> list[int]:
    """The ids at these places of a range-sorted column of ids."""
    ordered = written(ordered.withColumn("range", F.spark_partition_id()), "ranks")
    counts = {r["range"]: r["n"] for r in ordered.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted, before = [], 0
    for part in sorted(counts):
        wanted += [(part, p - before + 1) for p in places if before <= p < before + counts[part]]
        before += counts[part]
    rank = F.row_number().over(Window.partitionBy("range").orderBy("vec_id")).cast("long")
    table = ordered.sparkSession.createDataFrame(wanted, "range int, rank long")
    return sorted(r["vec_id"] for r in ordered.withColumn("rank", rank).join(F.broadcast(table), ["range", "rank"]).collect())


def reseeded(means: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Centroids in which each empty cluster takes a copy of a large one's, the two moved apart a little along it: what that one had is then split."""
    out, sizes = means.copy(), sizes.astype(np.float64)
    for c in np.flatnonzero(sizes == 0):
        big = int(sizes.argmax())
        step = np.where(np.arange(out.shape[1]) % 2 == 0, 1.0, -1.0) / 1024
        out[c], out[big] = out[big] * (1 + step), out[big] * (1 - step)
        sizes[c] = sizes[big] = sizes[big] / 2
    return out


def kmeans(vectors: DataFrame, k: int, rounds: int = 8, column: str = "embedding", init: np.ndarray | None = None, tolerance: float = 1e-12) -> np.ndarray:
    """Centroids by Lloyd's iterations, until none moves by more than the tolerance. Each round is one scan and one aggregation by (cluster, component); the driver holds the k centroids only. An empty cluster is seeded anew from the largest. No usable rows: no centroids."""
    cents = strided_init(vectors, k, column) if init is None else np.array(init, np.float64)
    if not len(cents):
        return cents
    rows = usable(vectors.select(column), column)
    for _ in range(rounds):
        new, sizes = cents.copy(), np.zeros(len(cents))
        for r in group_means(assign_fast(rows, cents, column), "c", column).collect():
            new[r["c"]], sizes[r["c"]] = r["mean"], r["n"]
        new = reseeded(new, sizes)
        if np.abs(new - cents).max() <= tolerance:
            break
        cents = new
    return cents


def projected_kmeans(vectors: DataFrame, projection: np.ndarray, k: int, rounds: int = 8, column: str = "embedding") -> DataFrame:
    """c, n, cent: clusters found in a projected space, with means in the full one. A cluster without rows has no row in the table."""
    rows = vectors.select("vec_id", column, V.matvec(np.asarray(projection).tolist(), V.doubles(column)).alias("_p"))
    cents = kmeans(rows, k, rounds, "_p")
    if not len(cents):
        return vectors.sparkSession.createDataFrame([], "c long, n long, cent array<double>")
    return group_means(assign_fast(rows, cents, "_p"), "c", column).withColumnRenamed("mean", "cent")


def occupied(centroids: DataFrame, assigned: DataFrame) -> DataFrame:
    """Centroids (c, cent) that some row of assigned (c) has: an empty one must attract no query."""
    return centroids.join(F.broadcast(assigned.select("c").distinct()), "c", "left_semi")


def local_kmeans(x: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and assignment of one group in memory, from evenly strided rows; empty clusters are seeded anew, and it ends when no row moves."""
    k = min(k, len(x))
    cents = x[[i * len(x) // k for i in range(k)]].astype(np.float64)
    before = None
    for step in range(rounds + 1):
        at = ((cents**2).sum(axis=1)[None, :] - 2 * x @ cents.T).argmin(axis=1)
        if step == rounds or (before is not None and (at == before).all()):
            break
        before = at
        sizes = np.bincount(at, minlength=k)
        means = np.zeros_like(cents)
        for d in range(x.shape[1]):
            means[:, d] = np.bincount(at, x[:, d], k)
        cents = reseeded(np.where(sizes[:, None] > 0, means / np.maximum(sizes, 1)[:, None], cents), sizes)
    return cents, at


def centroid_table(spark, cents: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(cents)], "c long, cent array<double>")


def probes(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """qid, c, dist, rank: the nprobe nearest centroids of each query."""
    pairs = queries.crossJoin(F.broadcast(centroids)).select("qid", "c", V.l2sq(F.col("q"), F.col("cent")).alias("dist"))
    return top_k(pairs, nprobe, ["qid"], ["dist", "c"])
