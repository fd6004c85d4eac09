"""What the operators of this subpackage share: input, shared scratch tables, Arrow helpers."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.scratch import drop, drop_path, scratch_path, scratch_scope, shared_dir, written  # noqa: F401

#: A word is a maximal run of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"
#: Bytes of an Arrow batch of texts.
BATCH_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each string; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def segments(batches, key: str):
    """Contiguous runs of equal key from batches sorted by key, each as one table. Only one run is held at a time."""
    import pyarrow.compute as pc

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        if batch.num_rows > 1:
            differ = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            cuts = [0, *(differ.nonzero()[0] + 1).tolist(), batch.num_rows]
        else:
            cuts = [0, 1]
        for lo, hi in zip(cuts, cuts[1:]):
            value = keys[lo].as_py()
            if held and value != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = value
    if held:
        yield pa.Table.from_batches(held)


def rank_column(docs: DataFrame):
    """Bytes that order documents by doc_id (null last), then by the hash of their text. Rows equal in both have the same.

    Whole numbers are ordered as such and make 17 bytes; ids of other types are ordered as text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        number = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    else:
        number = F.concat(F.hex(F.col("doc_id").cast("string").cast("binary")), F.lit("00"))
    known = F.when(F.col("doc_id").isNull(), F.lit("01" + "F" * 16)).otherwise(F.concat(F.lit("00"), number))
    return F.unhex(F.concat(known, F.lpad(F.hex(F.xxhash64(text_or_empty())), 16, "0")))


def to_python(df: DataFrame) -> DataFrame:
    """df, whose Arrow batches are bounded in bytes by a setting of its session, for texts can be long."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]?)[a-z]*", str(conf.get(key, None) or 0).lower()).groups()
    if not 0 < int(number) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(unit, 0) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def afresh(digest: str = "digest"):
    """A digest of 32 bytes under an expression of its own. Where rows dealt out by the digest meet a join or a
    grouping by this, they are dealt anew, so a large partition of the join can be split."""
    return F.substring(digest, 1, 32)


def boxed(docs: DataFrame) -> DataFrame:
    """doc, a struct of all columns, and rank. No name that an operator adds can clash with one of docs; unboxed by select("doc.*")."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), rank_column(docs).alias("rank"))


def with_text(docs: DataFrame, text, changed):
    """doc with a new text where changed; n_chars, if there, follows."""
    fields = docs.schema
    new = F.col("doc").withField("text", text)
    if "n_chars" in fields.names:
        new = new.withField("n_chars", F.length(text).cast(fields["n_chars"].dataType))
    return F.when(changed, new).otherwise(F.col("doc")).alias("doc")
