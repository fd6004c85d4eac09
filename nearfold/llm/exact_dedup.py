"""Exact dedup of incoming batches against immutable snapshots.

A snapshot is a folder that is written once and screened by any number of later
batches. It holds the normalised texts of its rows with their digests, one
bucket for each distinct digest, and over the buckets a static binary-fuse filter
for each shard of digests; shards have a bounded number of keys, so filters grow
in number, never in size. The digests of an incoming batch are first grouped
(copies within the batch meet here, with partial aggregation, so a group of any
size is one row), then screened shard by shard. A filter has no false negatives;
positives join the snapshot's buckets by exact digest, which drops the false
ones. Whatever is to be called a copy, within the batch or against the snapshot,
is then compared byte by byte with what its bucket holds: texts of digests with
more than one row are grouped by the bytes themselves, again with partial
aggregation.

Texts are equal when identical without the six ASCII blanks. Of equal texts,
the row with the most code points, then the smallest doc_id (null last) stays.

Null text: empty, equal to all texts of blanks. Repeated rows: copies; of rows
equal in doc_id and length too, one stays, whichever. Empty table or snapshot:
no filters, nothing screened positive. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm.common import BLANK, afresh, scratch_path, segments, table, text_or_empty, written

#: Keys of one filter, on average.
SHARD_KEYS = 50_000


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over key + seed."""
    x = keys + np.uint64(seed)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class BinaryFuse:
    """A static 3-wise binary fuse filter with 8-bit fingerprints over distinct 64-bit keys."""

    def __init__(self, seed: int, segment: int, count: int, slots: np.ndarray):
        self.seed, self.segment, self.count, self.slots = seed, segment, count, slots

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, count: int):
        """Three slots in consecutive segments, and the fingerprint."""
        h = _mix(keys, seed)
        start = ((h >> np.uint64(32)) * np.uint64(count * segment)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        second = (start + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (start + np.uint64(2 * segment)) ^ (h & mask)
        return np.stack([start, second, third]).astype(np.int64), (_mix(h, 1) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> "BinaryFuse":
        keys = np.unique(np.asarray(keys, np.uint64))
        n = max(len(keys), 2)
        segment = 1 << int(np.floor(np.log(n) / np.log(3.33) + 2.25))
        slots = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n)))
        count = max(1, -(-slots // segment) - 2)
        size = (count + 2) * segment
        for seed in range(1, 1000):
            places, prints = cls._places(keys, seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1, segment, count)
            degree = np.bincount(places.ravel(), minlength=size)
            # The keys still in a slot, as sum of their positions: where the degree is 1, the sum is the key.
            total = np.bincount(places.ravel(), np.tile(np.arange(len(keys), dtype=np.float64), 3), minlength=size)
            rounds, single = [], np.flatnonzero(degree == 1)
            peeled = 0
            while len(single):
                key, at = np.unique(total[single].astype(np.int64), return_index=True)
                rounds.append((key, single[at]))
                peeled += len(key)
                touched = places[:, key].ravel()
                np.subtract.at(degree, touched, 1)
                np.subtract.at(total, touched, np.tile(key, 3))
                single = np.unique(touched)
                single = single[degree[single] == 1]
            if peeled == len(keys):
                table_ = np.zeros(size, np.uint8)
                for key, slot in reversed(rounds):  # no two keys of a round share a slot that either owns
                    a, b, c = places[:, key]
                    table_[slot] = 0
                    table_[slot] = prints[key] ^ table_[a] ^ table_[b] ^ table_[c]
                return cls(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1, segment, count, table_)
        raise RuntimeError("no binary fuse filter found")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        (a, b, c), prints = self._places(np.asarray(keys, np.uint64), self.seed, self.segment, self.count)
        return prints == self.slots[a] ^ self.slots[b] ^ self.slots[c]

    def dump(self) -> bytes:
        return np.array([self.seed, self.segment, self.count], np.uint64).tobytes() + self.slots.tobytes()

    @classmethod
    def load(cls, blob: bytes) -> "BinaryFuse":
        seed, segment, count = np.frombuffer(blob, np.uint64, 3).tolist()
        return cls(seed, segment, count, np.frombuffer(blob, np.uint8, offset=24))


def _keys(digests: pa.ChunkedArray) -> np.ndarray:
    """The first 64 bits of each 256-bit digest."""
    return np.frombuffer(b"".join(x[:8] for x in digests.to_pylist()), np.uint64)


def _build(batches):
    for run in segments(batches, "shard"):
        yield pa.RecordBatch.from_pydict({"shard": run.column("shard")[:1].combine_chunks(), "filter": pa.array([BinaryFuse.build(_keys(run.column("digest"))).dump()], pa.binary())})


def _screen(batches):
    for run in segments(batches, "shard"):
        blob = next((x for x in run.column("filter").to_pylist() if x is not None), None)
        digests = run.column("digest").drop_null()
        hits = BinaryFuse.load(blob).contains(_keys(digests)) if blob is not None else np.zeros(len(digests), bool)
        yield from pa.table({"digest": digests.filter(pa.array(hits))}).to_batches()


def with_shard(digests: DataFrame, shards: int) -> DataFrame:
    """The shard is taken from other bits than the filter's key."""
    return digests.withColumn("shard", F.pmod(F.conv(F.hex(F.substring("digest", 9, 4)), 16, 10).cast("long"), F.lit(shards)))


def build_filters(buckets: DataFrame, shards: int) -> DataFrame:
    """shard, filter, shards: one binary fuse filter for each shard of the snapshot's digests, and the number of shards."""
    rows = with_shard(buckets.select("digest"), shards).repartition("shard").sortWithinPartitions("shard")
    return rows.mapInArrow(_build, "shard long, filter binary").withColumn("shards", F.lit(shards).cast("long"))


def screen(digests: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """Those of the batch's distinct digests that the filters of the snapshot can't rule out."""
    rows = with_shard(digests.select("digest"), shards).withColumn("filter", F.lit(None).cast("binary"))
    both = rows.unionByName(filters.select("shard", "filter", F.lit(None).cast("binary").alias("digest")))
    return both.repartition("shard").sortWithinPartitions("shard").mapInArrow(_screen, "digest binary")


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, points, bare, digest, check, and tag, which is the row's own once this is written."""
    text = text_or_empty()
    rows = docs.select("doc_id", F.length(text).cast("long").alias("points"), F.regexp_replace(text, f"{BLANK}+", "").alias("bare"))
    keys = {"digest": F.unhex(F.sha2("bare", 256)), "check": F.crc32(F.col("bare").cast("binary")), "tag": F.monotonically_increasing_id()}
    return rows.withColumns(keys)


class Snapshot:
    """Rows, buckets and filters in a folder that all executors see."""

    def __init__(self, spark, path: str):
        self.rows, self.buckets, self.filters = (spark.read.parquet(f"{path}/{part}") for part in ("rows", "buckets", "filters"))
        self.shards = self.filters.agg(F.max("shards")).first()[0] or 1

    @classmethod
    def write(cls, docs: DataFrame, path: str) -> "Snapshot":
        """A new snapshot of docs; an error if the folder has one."""
        spark = docs.sparkSession
        keyed_texts(docs).write.parquet(f"{path}/rows")
        spark.read.parquet(f"{path}/rows").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/buckets")
        buckets = spark.read.parquet(f"{path}/buckets")
        build_filters(buckets, max(1, -(-buckets.count() // SHARD_KEYS))).write.parquet(f"{path}/filters")
        return cls(spark, path)

    def holds(self, digests: DataFrame) -> DataFrame:
        """Those of the distinct digests that have a bucket here."""
        return screen(digests, self.filters, self.shards).join(self.buckets.select("digest"), "digest", "left_semi")


def equal_texts(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """digest, check, group_size, keep_id, keep_points: the groups of equal bytes among the rows of these digests."""
    suspects = rows.join(digests.hint("shuffle_hash"), "digest", "left_semi").withColumn("digest", afresh())
    # Texts of one length are one row here, of the smallest id; then the longest.
    longest = suspects.groupBy("digest", "bare", "points").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"))
    groups = longest.groupBy("digest", "bare").agg(F.sum("n").alias("group_size"), F.max(F.struct("points", "least")).alias("best"))
    return groups.select("digest", F.crc32(F.col("bare").cast("binary")).alias("check"), "group_size", F.col("best.least").alias("keep_id"), F.col("best.points").alias("keep_points"))


def placed(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest, check for each row. digests: those that occur more than once."""
    narrow = rows.select("doc_id", "points", "digest", "check", "tag")
    groups = written(equal_texts(rows, digests), "groups")
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))
    # Only where rows repeat an id and a length is there a choice between several.
    first = narrow.join(groups, ["digest", "check"]).where(best).groupBy(afresh().alias("digest"), "check").agg(F.min("tag").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    groups = written(groups.join(first, ["digest", "check"], "left"), "groups")
    alone = F.col("group_size").isNull()
    return narrow.join(groups, ["digest", "check"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (best & F.coalesce(F.col("tag") == F.col("first"), F.lit(True)))).alias("kept"),
        "digest",
        "check",
    )


def _counted(rows: DataFrame) -> DataFrame:
    return written(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "batch")


def screen_batch(batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """doc_id, in_snapshot, keep_id, group_size, kept, text_sha256 for each row of a later batch. Groups are those within the batch; kept is true for one row of each text that the snapshot lacks."""
    rows = written(keyed_texts(batch), "batch-rows")
    counts = _counted(rows)
    held = written(snapshot.holds(counts), "held")
    theirs, ours = (x.join(held.hint("shuffle_hash"), "digest", "left_semi").groupBy(afresh().alias("digest"), "bare", "check").agg(F.count(F.lit(1)).alias("n")) for x in (snapshot.rows, rows))
    same = written(ours.join(theirs, ["digest", "bare", "check"], "left_semi").select("digest", "check", F.lit(True).alias("held")), "same")
    found = placed(rows, counts.where("n > 1").select("digest")).withColumn("digest", afresh()).join(same.hint("shuffle_hash"), ["digest", "check"], "left")
    known = F.coalesce("held", F.lit(False))
    return found.select("doc_id", known.alias("in_snapshot"), "keep_id", "group_size", (F.col("kept") & ~known).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, is_history) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs. is_history: a Column, true for the rows of the snapshot."""
    spark = docs.sparkSession
    snapshot = Snapshot.write(docs.where(is_history), scratch_path(spark, "snapshot"))
    batch = written(keyed_texts(docs.where(~F.coalesce(is_history, F.lit(False)))), "batch-rows")
    counts = _counted(batch)
    within = snapshot.buckets.where("n > 1").select("digest").unionByName(counts.where("n > 1").select("digest"))
    repeated = written(snapshot.holds(counts).unionByName(within).distinct(), "repeated")
    rows = snapshot.rows.withColumn("tag", F.col("tag") * 2).unionByName(batch.withColumn("tag", F.col("tag") * 2 + 1))
    return placed(rows, repeated).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The even half of documents, by hash, is the snapshot; the rest is the incoming batch. Nulls, ties and repeated rows as the module states; no rows for an empty table."""
    return exact_dedup(table(spark, sf_dir, "documents"), F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0)


OP3_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY bare) AS group_size
      FROM t WINDOW w AS (PARTITION BY bare ORDER BY points DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, sha256(bare) AS text_sha256 FROM g
"""
