"""SimHash near-dedup by anchor-point covering.

The 64 bits of a fingerprint are cut into three blocks of 23, 23 and 18 bits. Two
fingerprints that differ in at most 4 bits differ in at most 1 bit of some
block, for otherwise they would differ in at least 2 + 2 + 2 bits.

- Anchors of the blocks of 23 bits are the 4,096 words of the perfect binary
  Golay code, of covering radius 3. A fingerprint goes to every anchor within
  3 + 1 bits of its block, 5.3 of them on average.
- Anchors of the block of 18 bits are the 2^14 words of the Hamming code of 15
  bits with three free bits beside it, of covering radius 1. A fingerprint goes
  to every anchor within 1 + 1 bits, 10.8 on average.

So two fingerprints that differ in 1 bit of a block meet at the anchor nearest to
either, and each is copied to 21.4 anchors on average.

Only distinct fingerprints are replicated, whatever their number of documents.
At each anchor all fingerprints are compared; the anchor returns not the pairs
but a star for each set that is connected there, so a group of near copies
costs as many rows as it has fingerprints. A full anchor is searched outward
from one fingerprint at a time, each of which is compared with the unassigned
rest only, so dense groups are absorbed at once. Stars of all anchors are then
joined into components.

With more than REFINE_AT fingerprints, each anchor is divided by a pigeonhole:
five parts of the bits outside the block, one of which must agree. The links
found are the same.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; shingles of 4
words, or the whole sequence if shorter. Null and blank texts: fingerprint zero,
linked like any other. Null doc_id: counted last; a component of null ids only
has a null id. Repeated rows: each returned. Empty table: no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm.common import as_bytes, boxed, rank_column, segments, table, to_python, written
from nearfold.llm.components import components

SHINGLE = 4
THRESHOLD = 4
#: First bit, bits and covering radius of each block. Two fingerprints within THRESHOLD are within 1 bit in one of three.
BLOCKS = ((0, 23, 3), (23, 23, 3), (46, 18, 1))
IN_BLOCK = THRESHOLD // len(BLOCKS)
REFINE_AT = 1 << 22
REFINE_PARTS = 5

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
TO_LOWER = bytes.maketrans(UPPER, LOWER)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64 bits, unsigned."""
    import xxhash

    words = text.translate(TO_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-shingle]]).tolist()
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    n = len(hashes)
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        prints = np.array([fingerprint(t) for t in as_bytes(batch.column("text"))], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def checks(size: int) -> list[int]:
    """The syndrome of each single bit: of the Golay code of 23 bits, or of the Hamming code of 15 bits with free bits, of syndrome 0, after it."""
    if size != 23:
        return [*range(1, 16), *[0] * (size - 15)]
    generator = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
    single = []
    for i in range(size):
        x = 1 << i
        for bit in range(size - 1, 10, -1):
            if x >> bit & 1:
                x ^= generator << (bit - 11)
        single.append(x)
    return single


@functools.cache
def patterns(size: int, reach: int) -> list[np.ndarray]:
    """All error patterns of at most `reach` bits of a block, by syndrome."""
    single = checks(size)
    by: list[list[int]] = [[] for _ in range(1 << max(single).bit_length())]

    def grow(pattern: int, syndrome: int, start: int, left: int) -> None:
        by[syndrome].append(pattern)
        for i in range(start, size) if left else ():
            grow(pattern | 1 << i, syndrome ^ single[i], i + 1, left - 1)

    grow(0, 0, 0, reach)
    return [np.array(p, np.int64) for p in by]


def anchors(block: np.ndarray, size: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and anchors: each value of a block with every code word within covering radius + IN_BLOCK bits of it."""
    errors = patterns(size, radius + IN_BLOCK)
    syndrome = np.zeros(len(block), np.int64)
    for i, x in enumerate(checks(size)):
        syndrome ^= np.where(block >> i & 1, x, 0)
    counts = np.array([len(p) for p in errors])[syndrome]
    rows = np.repeat(np.arange(len(block)), counts)
    return rows, block[rows] ^ (np.concatenate([errors[s] for s in syndrome]) if len(block) else rows)


def _replicate(refine: bool):
    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            bits = fp.view(np.uint64)
            for b, (first, size, radius) in enumerate(BLOCKS):
                block = (bits >> np.uint64(first) & np.uint64((1 << size) - 1)).astype(np.int64)
                rows, anchor = anchors(block, size, radius)
                key = anchor << 2 | b
                if refine:
                    rest = np.concatenate([np.arange(first), np.arange(first + size, 64)])
                    for j, part in enumerate(np.array_split(rest, REFINE_PARTS)):
                        value = np.zeros(len(fp), np.int64)
                        for k, bit in enumerate(part):
                            value |= (bits >> np.uint64(bit) & np.uint64(1)).astype(np.int64) << k
                        yield _visits(key << 14 | value[rows] << 3 | j, fp[rows])  # a part has at most 11 bits
                else:
                    yield _visits(key, fp[rows])

    return run


def _visits(anchor: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp)], names=["anchor", "fp"])


def stars(fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints with the first of the set that they are connected to among fps; sets of one are left out."""
    bits = fps.view(np.uint64)
    n = len(bits)
    if n < 2:
        return fps[:0], fps[:0]
    root = np.full(n, -1, np.int64)
    if n <= 1024:
        near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= threshold
        linked = np.flatnonzero(near.sum(axis=1) > 1)
        if not len(linked):
            return fps[:0], fps[:0]
    else:
        linked = np.arange(n)
    rest = linked
    while len(rest):
        first, rest = rest[0], rest[1:]
        root[first] = first
        frontier = np.array([first])
        while len(frontier) and len(rest):
            met = np.zeros(len(rest), bool)
            for i in range(0, len(frontier), max(1, (1 << 20) // len(rest))):
                part = frontier[i : i + max(1, (1 << 20) // len(rest))]
                met |= (np.bitwise_count(bits[part][:, None] ^ bits[rest][None, :]) <= threshold).any(axis=0)
            frontier, rest = rest[met], rest[~met]
            root[frontier] = first
    child = np.flatnonzero((root >= 0) & (root != np.arange(n)))
    return fps[child], fps[root[child]]


def _compare(batches):
    for run in segments(batches, "anchor"):
        fps = np.unique(run.column("fp").to_numpy())
        u, v = stars(fps)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def links(prints: DataFrame, refine: bool) -> DataFrame:
    """u, v: edges that connect all distinct fingerprints (fp) within the threshold of one another."""
    visits = prints.select("fp").mapInArrow(_replicate(refine), "anchor long, fp long")
    return visits.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare, "u long, v long")


def near_dedup(docs: DataFrame, refine: bool | None = None) -> DataFrame:
    """doc_id, fp, component_id for each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = written(to_python(docs.select("doc_id", "text")).mapInArrow(_fingerprints, f"doc_id {kind}, fp long"), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    refine = prints.count() > REFINE_AT if refine is None else refine
    roots = components(links(prints, refine))
    placed = prints.join(roots, prints["fp"] == roots["u"], "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id")).select(F.bitwise_not("root").alias("k"), "component_id")
    known = written(placed.join(smallest, F.bitwise_not("root") == F.col("k")).select("fp", "component_id"), "components")
    return rows.join(known, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component the document of the smallest doc_id (null last), then text hash; of equal rows one."""
    ranked = near_dedup(docs.select(rank_column(docs).alias("doc_id"), "text"))
    kept = written(ranked.where("doc_id = component_id").select(F.col("doc_id").alias("rank")).distinct(), "kept")
    return boxed(docs).dropDuplicates(["rank"]).join(kept.hint("shuffle_hash"), "rank", "left_semi").select("doc.*")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """near_dedup of all documents: null and blank texts have fingerprint zero, repeated rows are each returned; no rows for an empty table."""
    found = near_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
