"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths written since each open scope began.
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder that the context was given. Only a local session may do without: it gets one of its own."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/nearfold-scratch"
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/nearfold/{label}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: lineage ends here and lost executors cost no rework."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables of written that nothing reads any more."""
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if "/nearfold/" in path:
                drop_path(table.sparkSession, path)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Deletes at its end what was written within, but for the paths that are put into the list that it gives."""
    mine, kept = [], []
    _scopes.append(mine)
    try:
        yield kept
    finally:
        _scopes.remove(mine)
        for path in mine:
            if path not in kept:
                drop_path(spark, path)
