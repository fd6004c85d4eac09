"""Leaf blocks: bounded groups of one cell's vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfold.functions import vector as V
from nearfold.operators.kmeans import local_kmeans
from nearfold.operators.quantize import group_means

LEAF = 128
#: A cell of more members is cut along one axis: balanced assignment measures every member against every block.
BALANCED_MOST = 4096


def pack(cells: DataFrame, leaf: int = LEAF, order: list | None = None) -> DataFrame:
    """cells (vec_id, cell_id, ...) with block_id and pos: runs of leaf vectors of a cell, numbered over all cells in order."""
    ranked = cells.withColumn("_r", F.row_number().over(Window.partitionBy("cell_id").orderBy(*(order or ["vec_id"]))) - 1)
    local = ranked.withColumn("_b", F.floor(F.col("_r") / leaf)).withColumn("pos", (F.col("_r") % leaf).cast("int"))
    starts = cell_offsets(cells, leaf).select("cell_id", "first_block")
    return local.join(starts, "cell_id").withColumn("block_id", (F.col("first_block") + F.col("_b")).cast("long")).drop("_r", "_b", "first_block")


def cell_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))


def cell_offsets(cells: DataFrame, leaf: int = LEAF) -> DataFrame:
    """cell_id, n, first_row, first_block: exclusive prefix sums over the cells, of which there are a bounded number."""
    before = Window.orderBy("cell_id").rowsBetween(Window.unboundedPreceding, -1)
    counts = cell_counts(cells)
    return counts.select("cell_id", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_row"), F.coalesce(F.sum(F.ceil(F.col("n") / leaf)).over(before), F.lit(0)).alias("first_block"))


def _bisect(leaf: int):
    def halves(ids: np.ndarray, x: np.ndarray):
        todo = [np.arange(len(ids))]
        while todo:
            at = todo.pop()
            if len(at) <= leaf:
                yield at
                continue
            part = x[at]
            far = ((part - part.mean(axis=0)) ** 2).sum(axis=1).argmax()
            other = ((part - part[far]) ** 2).sum(axis=1).argmax()
            along = part @ (part[other] - part[far])
            order = np.lexsort((ids[at], along))
            half = len(at) // 2
            todo += [at[order[half:]], at[order[:half]]]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        ids, x = group["vec_id"].to_numpy(), np.array(group["v"].tolist())
        parts = [(b, p, ids[i]) for b, at in enumerate(halves(ids, x)) for p, i in enumerate(at)]
        b, p, v = (np.array(c, np.int64) for c in zip(*parts))
        return pd.DataFrame({"cell_id": group["cell_id"].iloc[0], "block": b, "pos": p, "vec_id": v})

    return run


def bisect_blocks(cells: DataFrame, leaf: int = LEAF) -> DataFrame:
    """cell_id, block, pos, vec_id: each cell halved along the axis of a farthest pair, at the median, until a part has at most leaf members. A cell is worked on in one task; cells are bounded by the tree."""
    rows = cells.select("vec_id", "cell_id", V.doubles("embedding").alias("v"))
    return rows.groupBy("cell_id").applyInPandas(_bisect(leaf), "cell_id long, block long, pos long, vec_id long")


def _one_axis(leaf: int):
    """Blocks of consecutive members along the leading axis of the cell."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        ids, x = group["vec_id"].to_numpy(), np.array(group["v"].tolist())
        centred = x - x.mean(axis=0)
        axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = np.lexsort((ids, np.round(x @ axis, 9)))
        at = np.arange(len(ids))
        return pd.DataFrame({"cell_id": group["cell_id"].iloc[0], "block": at // leaf, "pos": at % leaf, "vec_id": ids[order]})

    return run


def _balanced(leaf: int, rounds: int, most: int):
    large = _one_axis(leaf)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        n = len(group)
        if n > most:
            return large(group)
        group = group.sort_values("vec_id")
        ids, x = group["vec_id"].to_numpy(), np.array(group["v"].tolist())
        cents, _ = local_kmeans(x, -(-n // leaf), rounds)
        d = (x**2).sum(axis=1)[:, None] + (cents**2).sum(axis=1)[None, :] - 2 * x @ cents.T
        block, room = np.full(n, -1), np.full(len(cents), leaf)
        for flat in np.argsort(d, axis=None, kind="stable"):
            i, c = divmod(int(flat), len(cents))
            if block[i] < 0 and room[c]:
                block[i] = c
                room[c] -= 1
        pos = pd.Series(block).groupby(block).cumcount().to_numpy()
        return pd.DataFrame({"cell_id": group["cell_id"].iloc[0], "block": block.astype(np.int64), "pos": pos.astype(np.int64), "vec_id": ids})

    return run


def balanced_blocks(cells: DataFrame, leaf: int = LEAF, rounds: int = 5, most: int = BALANCED_MOST) -> DataFrame:
    """As bisect_blocks, by k-means within the cell and then the nearest pairs first, at most leaf to a cluster. A cell of more than `most` members is ordered along its leading axis and cut."""
    rows = cells.select("vec_id", "cell_id", V.doubles("embedding").alias("v"))
    return rows.groupBy("cell_id").applyInPandas(_balanced(leaf, rounds, most), "cell_id long, block long, pos long, vec_id long")


def block_centroids(blocks: DataFrame, column: str = "embedding") -> DataFrame:
    """block_id, n, cent, norm."""
    means = group_means(blocks, "block_id", column)
    return means.select("block_id", "n", F.col("mean").alias("cent"), V.sqnorm(F.col("mean")).alias("norm"))


def write_regions(blocks: DataFrame, path: str, blocks_per_region: int = 16, order: str = "block_id") -> DataFrame:
    """Blocks in files of their own region: region_id follows the given order (block_id, or a breadth-first rank), and queries that name regions read those files only."""
    regions = blocks.withColumn("region_id", F.floor(F.col(order) / blocks_per_region).cast("long"))
    regions.repartition("region_id").sortWithinPartitions("region_id", "block_id", "pos").write.mode("overwrite").partitionBy("region_id").parquet(path)
    return blocks.sparkSession.read.parquet(path)
