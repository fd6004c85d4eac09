"""Streams of vectors into an index, and of queries against one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from nearfold.operators.knn import Nearest, query_blocks


def ingest(stream: DataFrame, index, path: str, checkpoint: str):
    """Encodes each micro-batch with the trained index and appends it to the lists at path; returns the started query. A batch that is run again replaces its own files."""

    def append(batch: DataFrame, number: int) -> None:
        coded = index.encode(batch).withColumn("batch", F.lit(number))
        coded.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "list_id").parquet(path)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def serve(queries: DataFrame, index, path: str, checkpoint: str, k: int = 10, **knobs):
    """Answers each micro-batch of queries (qid, q) from the index, with the knobs of its search, and appends the neighbours to path. A batch that is run again replaces its own files."""

    def answer(batch: DataFrame, number: int) -> None:
        index.search(batch, k, **knobs).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _nearest(shared, k: int):
    """Of each task's vectors the k nearest to each query of all blocks."""

    def run(batches):
        blocks = [Nearest(*block, k) for block in shared.value]
        for batch in batches:
            for block in blocks:
                block.add(batch)
        yield from (block.found() for block in blocks)

    return run


def standing_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """qid, rank, vec_id, dist, updated as vectors stream past standing queries (a bounded table): the state of a query is its k nearest so far. Each task sends only its k nearest to a query there."""
    shared = vectors.sparkSession.sparkContext.broadcast(list(query_blocks(queries)))
    near = vectors.select("vec_id", "embedding").mapInArrow(_nearest(shared, k), "qid long, vec_id long, dist double")
    scored = near.select("qid", "vec_id", F.round("dist", 6).alias("dist"))

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        dists, ids = (np.array(x) for x in state.get) if state.exists else (np.zeros(0), np.zeros(0, np.int64))
        for f in frames:
            dists, ids = np.concatenate([dists, f["dist"]]), np.concatenate([ids, f["vec_id"]])
            order = np.lexsort((ids, dists))[:k]
            dists, ids = dists[order], ids[order]
        state.update((dists.tolist(), [int(x) for x in ids]))
        yield pd.DataFrame({"qid": key[0], "rank": np.arange(1, len(ids) + 1, dtype=np.int32), "vec_id": ids.astype(np.int64), "dist": dists})

    return scored.groupBy("qid").applyInPandasWithState(update, "qid long, rank int, vec_id long, dist double", "dists array<double>, ids array<long>", "update", GroupStateTimeout.NoTimeout)
