"""Reranking of block candidates: by codes, then exactly; and pruning by intervals around code distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfold.functions import vector as V
from nearfold.operators.knn import top_k


def code_scan(pairs: DataFrame, blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, block_id, vec_id, adc, eps for each vector of each visited block. Blocks: block_id, vec_id, decoded, eps; no raw vectors are read."""
    joined = pairs.select("qid", "block_id").join(blocks.select("block_id", "vec_id", "decoded", "eps"), "block_id").join(queries, "qid")
    return joined.select("qid", "block_id", "vec_id", V.l2sq(F.col("q"), F.col("decoded")).alias("adc"), "eps")


def exact(candidates: DataFrame, base: DataFrame, queries: DataFrame) -> DataFrame:
    """candidates with dist. Raw vectors are fetched by this join alone, for the candidates that are left."""
    raw = base.select("vec_id", V.doubles("embedding").alias("v"))
    joined = candidates.join(raw, "vec_id").join(queries, "qid")
    return joined.withColumn("dist", F.round(V.l2sq(F.col("q"), F.col("v")), 6)).drop("v", "q")


def rerank_global(scanned: DataFrame, base: DataFrame, queries: DataFrame, r: int, k: int) -> DataFrame:
    kept = top_k(scanned, r, ["qid"], ["adc", "vec_id"], "_r").drop("_r")
    return top_k(exact(kept, base, queries), k, ["qid"], ["dist", "vec_id"])


def rerank_blocks(scanned: DataFrame, base: DataFrame, queries: DataFrame, r: int = 16, k_local: int = 10, k: int = 10) -> DataFrame:
    """Of each visited block the r nearest by code, exactly measured, the k_local nearest; over all blocks the k nearest."""
    kept = top_k(scanned, r, ["qid", "block_id"], ["adc", "vec_id"], "_r").drop("_r")
    local = top_k(exact(kept, base, queries), k_local, ["qid", "block_id"], ["dist", "vec_id"], "_r").drop("_r")
    return top_k(local, k, ["qid"], ["dist", "vec_id"])


def bounds(scanned: DataFrame) -> DataFrame:
    """Adds low2 and high2: squares of the least and largest distance that adc and the decoding error eps allow."""
    root = F.sqrt("adc")
    low = F.greatest(F.lit(0.0), root - F.col("eps"))
    return scanned.withColumn("low2", low * low).withColumn("high2", (root + F.col("eps")) * (root + F.col("eps")))


def threshold(bounded: DataFrame, k: int, column: str = "high2") -> DataFrame:
    """qid, tau2: the k-th smallest upper bound, or the largest if there are fewer."""
    return top_k(bounded, k, ["qid"], [column, "vec_id"], "_r").groupBy("qid").agg(F.max(column).alias("tau2"))


def prune(bounded: DataFrame, tau: DataFrame) -> DataFrame:
    """Candidates whose lower bound does not exceed the threshold: no true neighbour among the candidates is lost."""
    return bounded.join(tau, "qid").where("low2 <= tau2 + 1e-9")


def seeds(bounded: DataFrame, base: DataFrame, queries: DataFrame, per_block: int, k: int) -> DataFrame:
    """qid, tau2 from exact distances of the per_block most promising candidates of each block."""
    first = top_k(bounded, per_block, ["qid", "block_id"], ["high2", "vec_id"], "_r").drop("_r")
    return threshold(exact(first, base, queries), k, "dist")


def prune_and_rerank(bounded: DataFrame, tau: DataFrame, base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return top_k(exact(prune(bounded, tau), base, queries), k, ["qid"], ["dist", "vec_id"])


def survivor_counts(bounded: DataFrame, tau: DataFrame, r: int) -> DataFrame:
    """qid, survivors, blocks, blocks_over: blocks with more than r survivors."""
    per = prune(bounded, tau).groupBy("qid", "block_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("qid").agg(F.sum("n").alias("survivors"), F.count(F.lit(1)).alias("blocks"), F.sum(F.when(F.col("n") > r, 1).otherwise(0)).alias("blocks_over"))


def agreement(a: DataFrame, b: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """qid, agree: whether two results have the same neighbours, but for those whose distances differ from the last one's by a relative tolerance at most."""
    w = Window.partitionBy("qid")
    both = a.select("qid", "vec_id", "dist", F.lit(1).alias("s")).unionByName(b.select("qid", "vec_id", "dist", F.lit(2).alias("s")))
    marked = both.withColumn("last", F.max("dist").over(w)).groupBy("qid", "vec_id").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("dist"), F.max("last").alias("last"))
    odd = (F.col("n") == 1) & (F.col("last") - F.col("dist") > tolerance * F.col("last"))
    return marked.groupBy("qid").agg((F.sum(F.when(odd, 1).otherwise(0)) == 0).alias("agree"))
