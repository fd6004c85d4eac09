"""A three-level routing tree. Children are trained on residuals and numbered within their parent."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.functions import vector as V
from nearfold.operators.kmeans import centroid_table, kmeans, local_kmeans, nearest
from nearfold.operators.knn import top_k


@dataclass
class Tree:
    """Model tables: l1 (c1, cent), l2 (c1, c2, cent), l3 (c1, c2, c3, cent). Empty cells have no row."""

    l1: DataFrame
    l2: DataFrame
    l3: DataFrame
    k2: int
    k3: int

    def held(self) -> "Tree":
        """The same tables, held by the driver: at most k1 * k2 * k3 rows, which plans then need not make again."""
        tables = [t.sparkSession.createDataFrame(t.collect(), t.schema) for t in (self.l1, self.l2, self.l3)]
        return Tree(*tables, self.k2, self.k3)

    def assign(self, vectors: DataFrame) -> DataFrame:
        """vec_id, embedding, c1, c2, c3, cell_id and r3, the residual of the cell's absolute centroid."""
        first = level_down(vectors.select("vec_id", "embedding", V.doubles("embedding").alias("r")), self.l1, [], "c1")
        second = level_down(first, self.l2, ["c1"], "c2")
        third = level_down(second, self.l3, ["c1", "c2"], "c3")
        return third.withColumn("cell_id", V.cell_id(F.col("c1"), F.col("c2"), F.col("c3"), self.k2, self.k3)).withColumnRenamed("r", "r3")

    def absolute(self) -> DataFrame:
        """cell_id, c1, c2, c3, cent: sums of the centroids of the three levels."""
        a = self.l1.select("c1", F.col("cent").alias("a"))
        b = self.l2.select("c1", "c2", F.col("cent").alias("b"))
        c = self.l3.select("c1", "c2", "c3", F.col("cent").alias("c"))
        joined = c.join(b, ["c1", "c2"]).join(a, "c1")
        return joined.select(V.cell_id(F.col("c1"), F.col("c2"), F.col("c3"), self.k2, self.k3).alias("cell_id"), "c1", "c2", "c3", V.add(V.add(F.col("a"), F.col("b")), F.col("c")).alias("cent"))

    def route(self, queries: DataFrame, ck1: int, ck2: int, ck3: int) -> DataFrame:
        """qid, q, c1, c2, c3, cell_id, dist: cells reached by the ck1 nearest first-level cells, the ck2 nearest children of each, and the ck3 nearest of those, each by its own residual."""
        start = queries.select("qid", "q", F.col("q").alias("r"))
        one = spread(start, self.l1, [], "c1", ck1)
        two = spread(one, self.l2, ["c1"], "c2", ck2)
        three = spread(two, self.l3, ["c1", "c2"], "c3", ck3)
        return three.withColumn("cell_id", V.cell_id(F.col("c1"), F.col("c2"), F.col("c3"), self.k2, self.k3))


def level_down(rows: DataFrame, level: DataFrame, by: list[str], name: str) -> DataFrame:
    """The nearest child of each row's cell, with the residual to it in r."""
    table = level.withColumnRenamed(name, "c")
    found = nearest(rows, table, "r", by).withColumnRenamed("c", name).drop("dist")
    joined = found.join(F.broadcast(level), [*by, name])
    return joined.withColumn("r", V.subtract(F.col("r"), F.col("cent"))).drop("cent")


def spread(rows: DataFrame, level: DataFrame, by: list[str], name: str, keep: int) -> DataFrame:
    """The keep nearest children of each (query, cell), with residuals."""
    table = F.broadcast(level)
    pairs = rows.join(table, by) if by else rows.crossJoin(table)
    scored = pairs.withColumn("dist", V.l2sq(F.col("r"), F.col("cent")))
    kept = top_k(scored, keep, ["qid", *by], ["dist", name], "_rank")
    return kept.withColumn("r", V.subtract(F.col("r"), F.col("cent"))).drop("cent", "_rank")


def _children(k: int, rounds: int, by: list[str], name: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        cents, _ = local_kmeans(np.array(group["r"].tolist()), k, rounds)
        head = {c: [group[c].iloc[0]] * len(cents) for c in by}
        return pd.DataFrame({**head, name: np.arange(len(cents), dtype=np.int64), "cent": list(cents)})

    return run


def train_tree(sample: DataFrame, k1: int, k2: int, k3: int, rounds: int = 10) -> Tree:
    """Levels by k-means, the lower ones within each parent. sample (vec_id, embedding) is a bounded training set: each parent's part of it is clustered in one task."""
    rows = sample.select("vec_id", "embedding", V.doubles("embedding").alias("r"))
    l1 = centroid_table(sample.sparkSession, kmeans(sample, k1, rounds)).withColumnRenamed("c", "c1")
    one = level_down(rows, l1, [], "c1")
    l2 = one.select("vec_id", "c1", "r").groupBy("c1").applyInPandas(_children(k2, rounds, ["c1"], "c2"), "c1 long, c2 long, cent array<double>")
    two = level_down(one, l2, ["c1"], "c2")
    l3 = two.select("vec_id", "c1", "c2", "r").groupBy("c1", "c2").applyInPandas(_children(k3, rounds, ["c1", "c2"], "c3"), "c1 long, c2 long, c3 long, cent array<double>")
    return Tree(l1, l2, l3, k2, k3)


def seeded_tree(vectors: DataFrame, roots, k2: int, k3: int) -> Tree:
    """A tree without iterations: roots (a Column) marks the first level's vectors, by vec_id; each parent's children are its first k residuals by vec_id."""
    from pyspark.sql import Window

    rows = vectors.select("vec_id", "embedding", V.doubles("embedding").alias("r"))
    l1 = rows.where(roots).select((F.row_number().over(Window.orderBy("vec_id")) - 1).cast("long").alias("c1"), F.col("r").alias("cent"))
    one = level_down(rows, l1, [], "c1")
    l2 = top_k(one, k2, ["c1"], ["vec_id"], "n").select("c1", (F.col("n") - 1).cast("long").alias("c2"), F.col("r").alias("cent"))
    two = level_down(one, l2, ["c1"], "c2")
    l3 = top_k(two, k3, ["c1", "c2"], ["vec_id"], "n").select("c1", "c2", (F.col("n") - 1).cast("long").alias("c3"), F.col("r").alias("cent"))
    return Tree(l1, l2, l3, k2, k3)


def sign_route(vectors: DataFrame, dims: list[int], column: str = "embedding") -> DataFrame:
    """vec_id, code: one of 2^len(dims) analytic cells by the signs of some components."""
    return vectors.select("vec_id", V.sign_code(V.doubles(column), dims).alias("code"))
