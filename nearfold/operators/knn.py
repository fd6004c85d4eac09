"""Exact nearest neighbours, top-k selection, and recall."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfold.scratch import written

#: Queries broadcast at a time, the bytes that they may take, and the distances that are held at once.
QUERY_BLOCK = 8192
BLOCK_BYTES = 64 << 20
HELD = 1 << 22


def top_k(df: DataFrame, k: int, by: list[str], order: list[Column | str], rank: str = "rank") -> DataFrame:
    """The k first rows of each key, with their rank. Partial limits run before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as a dense matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def of_dimension(batch: pa.RecordBatch, column: str, dim: int) -> pa.RecordBatch:
    """The rows whose vector has this dimension and no null: others, null and empty ones among them, are no neighbour of any."""
    import pyarrow.compute as pc

    lists = batch.column(column)
    fits = pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False)
    batch = batch if pc.all(fits).as_py() is not False else batch.filter(fits)
    lists = batch.column(column)
    if lists.flatten().null_count:
        whole = [all(x is not None for x in v) for v in lists.to_pylist()]
        batch = batch.filter(pa.array(whole, pa.bool_()))
    return batch


def nearest_rows(d: np.ndarray, measure, v: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact distances of each row's `take` nearest by approximate d, and of those tied with the last."""
    take = min(take, d.shape[1])
    at = np.argpartition(d, take - 1, axis=1)[:, :take]
    bound = np.take_along_axis(d, at, axis=1).max(axis=1, keepdims=True) + 1e-9
    most = int((d <= bound).sum(axis=1).max())
    if most > take:  # ties beyond the margin
        at = np.argsort(d, axis=1, kind="stable")[:, :most]
    return v[at], measure(at)


class Nearest:
    """The k nearest to each of a block of queries among the rows (vec_id, embedding) that were added."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.norms = (queries**2).sum(axis=1)
        self.dist, self.vec = np.full((len(ids), 0), np.inf), np.zeros((len(ids), 0), np.int64)

    def add(self, batch: pa.RecordBatch) -> None:
        queries, step = self.queries, max(64, HELD // len(self.ids))
        batch = of_dimension(batch, "embedding", queries.shape[1])
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            v, x = part.column("vec_id").to_numpy(zero_copy_only=False), matrix(part.column("embedding"))
            d = self.norms[:, None] + (x**2).sum(axis=1)[None, :] - 2 * queries @ x.T
            # A margin for the error of the expanded form: candidates are measured exactly.
            near, exact = nearest_rows(d, lambda at: np.array([((x[a] - q) ** 2).sum(axis=1) for a, q in zip(at, queries)]), v, self.k + 8)
            dist, vec = np.hstack([self.dist, exact]), np.hstack([self.vec, near])
            order = np.lexsort((vec, np.round(dist, 6)), axis=1)[:, : self.k]
            self.dist, self.vec = np.take_along_axis(dist, order, axis=1), np.take_along_axis(vec, order, axis=1)

    def found(self) -> pa.RecordBatch:
        n = self.dist.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, n)), pa.array(self.vec.ravel()), pa.array(self.dist.ravel())], names=["qid", "vec_id", "dist"])


def _scan(shared, k: int):
    def run(batches):
        near = Nearest(*shared.value, k)
        for batch in batches:
            near.add(batch)
        yield near.found()

    return run


def query_blocks(queries: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Queries (qid, q) in blocks of bounded size, as NumPy arrays. Queries without a vector of the usual dimension are left out."""
    dim = queries.select(F.max(F.size("q"))).first()[0]
    if not dim or dim < 1:
        return
    block = max(1, min(QUERY_BLOCK, block_bytes // (8 * dim)))
    queries = queries.where((F.size("q") == dim) & ~F.exists("q", lambda x: x.isNull()))
    parts = max(1, -(-queries.count() // block))
    dealt = queries.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)))
    for i in range(parts):
        got = dealt.where(F.col("part") == i).select("qid", "q").toArrow().combine_chunks()
        if got.num_rows:
            q = got.column("q").combine_chunks()
            yield got.column("qid").to_numpy(), matrix(q)


def by_blocks(queries: DataFrame, scan, label: str) -> DataFrame | None:
    """What scan(block) gives for all blocks of queries: one block's as a plan, several blocks' each written before the next is broadcast, so only one is held."""
    held = None
    before = None
    for block in query_blocks(queries):
        if before is not None:
            found, shared = before
            found = written(found, label)
            shared.destroy()
            held = found if held is None else held.unionByName(found)
        shared = queries.sparkSession.sparkContext.broadcast(block)
        before = scan(shared), shared
    if before is None:
        return None
    return before[0] if held is None else held.unionByName(before[0])


def exact_knn(base: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """qid, rank, vec_id, dist: the k nearest of base (vec_id, embedding) to each of queries (qid, q), by squared L2 and then vec_id.

    A stated set of queries against all rows: queries are broadcast in blocks of
    bounded size, each base partition keeps k candidates for each query, and the
    candidates alone are shuffled. Null and empty vectors, and those of another
    dimension, are no neighbours.
    """
    rows = base.select("vec_id", "embedding")
    found = by_blocks(queries, lambda shared: rows.mapInArrow(_scan(shared, k), "qid long, vec_id long, dist double"), "knn")
    if found is None:
        found = base.sparkSession.createDataFrame([], "qid long, vec_id long, dist double")
    found = found.withColumn("dist", F.round("dist", 6))
    return top_k(found, k, ["qid"], ["dist", "vec_id"]).select("qid", "rank", "vec_id", "dist")


def squared(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances, by differences."""
    return np.array([((x - a) ** 2).sum(axis=1) for a in q]).reshape(len(q), len(x))


def _values(shared, columns: dict, column: str, extra: list[str]):
    def run(batches):
        ids, queries = shared.value
        step = max(64, HELD // (len(ids) * max(1, len(columns))))
        for batch in batches:
            batch = of_dimension(batch, column, queries.shape[1]) if not extra else batch
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                x = matrix(part.column(column))
                more = [part.column(e).to_numpy(zero_copy_only=False) for e in extra]
                found = [np.asarray(f(queries, x, *more), np.float64).ravel() for f in columns.values()]
                v = part.column("vec_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, len(v))), pa.array(np.tile(v, len(ids))), *map(pa.array, found)], names=["qid", "vec_id", *columns])

    return run


def against(base: DataFrame, queries: DataFrame, column: str = "embedding", extra: tuple[str, ...] = (), **columns) -> DataFrame:
    """qid, vec_id and a value by each function of (queries, rows, extra columns) for each row of base with each of a stated set of queries (qid, q).

    Functions take matrices and give one, so a batch is a matrix product or the like. Queries come in blocks of bounded size.
    """
    schema = "qid long, vec_id long, " + ", ".join(f"{c} double" for c in columns)
    rows = base.select("vec_id", column, *extra)
    found = by_blocks(queries, lambda shared: rows.mapInArrow(_values(shared, columns, column, list(extra)), schema), "values")
    return base.sparkSession.createDataFrame([], schema) if found is None else found


def recall(result: DataFrame, truth: DataFrame, k: int, m: int | None = None) -> DataFrame:
    """recall: the share of the first k results that are among the first m true neighbours (m = k unless given). Both: qid, rank, vec_id."""
    m = m or k
    hits = result.where(F.col("rank") <= k).join(truth.where(F.col("rank") <= m).select("qid", "vec_id"), ["qid", "vec_id"])
    n = truth.select("qid").distinct().agg((F.count(F.lit(1)) * k).alias("n"))
    return hits.agg(F.count(F.lit(1)).alias("hits")).join(n).select((F.col("hits") / F.col("n")).alias("recall"))  # one row by one row


def restrict_truth(truth: DataFrame, id_map: DataFrame, k: int) -> DataFrame:
    """Ground truth over a subset: neighbours that the id map (local_id, global_id) lacks are dropped, order kept, first k, with the number of survivors."""
    kept = truth.join(id_map, truth["vec_id"] == id_map["global_id"]).select("qid", F.col("rank").alias("old"), "local_id")
    w = Window.partitionBy("qid")
    ranked = kept.withColumn("rank", F.row_number().over(w.orderBy("old"))).withColumn("survivors", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("rank") <= k).select("qid", "rank", "local_id", "survivors")


def pad_top_k(result: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exactly k rows for each query; missing ones have id -1 and infinite distance."""
    slots = queries.select("qid", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return slots.join(result, ["qid", "rank"], "left").select("qid", "rank", F.coalesce("vec_id", F.lit(-1)).cast("long").alias("vec_id"), F.coalesce("dist", F.lit(float("inf"))).alias("dist"))
