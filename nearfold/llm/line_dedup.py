"""Line dedup by pairwise alignment.

Documents are paired by shared lines: each document with the earliest holder of
each of its lines, however common, so a line of any number of holders makes one
pair for each, never all pairs. A line of under KEY_WORDS words pairs documents
by the lines from it on that have KEY_WORDS words together.

Each pair is aligned by patience diff over all its lines: by those that occur
once on either side, and in a gap without such lines by the occurrences of each
line, the first on one side with the first on the other and so on. Blocks of
consecutive aligned lines with KEY_WORDS words or more are deleted from the later
document.
The first occurrence of a line is never deleted, as no earlier document has it.

Lines are compared without blanks at their ends, by hashes of 128 bits. Null text: one empty line.
Null doc_id: the latest, by text. Rows equal in doc_id and text are one document,
and each is returned alike; rows equal in doc_id only are ordered by text. Empty
table: no rows. Extra columns are ignored here and kept by without_blocks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm.common import as_bytes, boxed, rank_column, table, text_or_empty, to_python, with_text, written

KEY_WORDS = 5


def pairing_keys(hashes: list[bytes], words: list[int]) -> set[bytes]:
    """Hashes of lines of KEY_WORDS words or more, and of the shortest blocks that reach as many from a shorter line on."""
    import xxhash

    keys = set()
    end = total = 0  # words of lines start to end
    for start, n in enumerate(words):
        while end < len(words) and total < KEY_WORDS:
            total += words[end]
            end += 1
        if total < KEY_WORDS:
            break
        if n >= KEY_WORDS:
            keys.add(hashes[start])
        elif n:
            keys.add(xxhash.xxh3_128_digest(b"".join(hashes[start:end])))
        total -= n
    return keys


def _hashed(batches):
    import xxhash

    for batch in batches:
        rows: list[list] = [[], [], []]
        for text in as_bytes(batch.column("text")):
            lines = text.split(b"\n")
            words = [len(x.split()) for x in lines]
            hashes = [xxhash.xxh3_128_digest(x.strip()) for x in lines]
            for column, value in zip(rows, (hashes, words, list(pairing_keys(hashes, words)))):
                column.append(value)
        types = (pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column("rank"), batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(rows, types))], names=["rank", "doc_id", "lines", "words", "keys"])


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by the first number, in which the second increases."""
    ends: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        i = bisect_left(ends, j)
        back[k] = at[i - 1] if i else -1
        ends[i : i + 1] = [j]
        at[i : i + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _once(lines: list) -> dict:
    """The place of each line that occurs once."""
    count = Counter(lines)
    return {x: k for k, x in enumerate(lines) if count[x] == 1}


def _numbered(lines: list) -> dict:
    """The place of each (line, how many of it came before)."""
    seen: Counter = Counter()
    out = {}
    for k, x in enumerate(lines):
        out[x, seen[x]] = k
        seen[x] += 1
    return out


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions of a and b: equal ends, then lines unique in both, in the order that most of them share, then what lies between them. Without unique ones, occurrences of lines take their place."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i == n or j == m:
            continue
        for places in (_once, _numbered):
            in_a, in_b = places(a[i:n]), places(b[j:m])
            anchors = _increasing([(i + k, j + in_b[x]) for x, k in in_a.items() if x in in_b])
            if anchors:
                break
        else:
            continue
        out += anchors
        for (p, q), (r, s) in zip([(i - 1, j - 1), *anchors], [*anchors, (n, m)]):
            todo.append((p + 1, r, q + 1, s))
    return sorted(out)


def common_blocks(later: list, earlier: list, words: list[int]) -> list[int]:
    """Lines of the later document in aligned blocks of KEY_WORDS words or more."""
    out: list[int] = []
    block: list[int] = []
    before = (-2, -2)
    for i, j in [*patience(later, earlier), (-9, -9)]:
        if (i, j) != (before[0] + 1, before[1] + 1):
            if sum(words[x] for x in block) >= KEY_WORDS:
                out += block
            block = []
        block.append(i)
        before = (i, j)
    return out


def _align(batches):
    for batch in batches:
        found = [common_blocks(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("lines", "earlier", "words")))]
        yield pa.RecordBatch.from_arrays([batch.column("rank"), pa.array(found, pa.list_(pa.int32()))], names=["rank", "removed"])


def hashed_lines(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(rank_column(docs).alias("rank"), "doc_id", text_or_empty().alias("text"))
    return written(to_python(rows).mapInArrow(_hashed, f"rank binary, doc_id {kind}, lines array<binary>, words array<int>, keys array<binary>"), "lines")


def candidate_pairs(lines: DataFrame) -> DataFrame:
    """rank, first: documents and the earliest holders of their lines."""
    keys = lines.select("rank", F.explode("keys").alias("key"))
    holders = written(keys.groupBy("key").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first <> last").select("key", "first"), "holders")
    shared = keys.join(holders.hint("shuffle_hash"), "key")
    return shared.where("first <> rank").select("rank", "first").distinct()


def removed_lines(lines: DataFrame) -> DataFrame:
    """rank, removed: numbers of the lines to be deleted, ascending. lines: of hashed_lines."""
    one = written(lines.dropDuplicates(["rank"]).select("rank", "lines", "words"), "distinct-lines")
    pairs = written(candidate_pairs(lines), "pairs")
    later = pairs.join(one, "rank")
    earlier = one.select(F.col("rank").alias("first"), F.col("lines").alias("earlier"))
    aligned = later.join(earlier, "first").select("rank", "lines", "earlier", "words").mapInArrow(_align, "rank binary, removed array<int>")
    each = aligned.select("rank", F.explode("removed").alias("line")).distinct()
    return each.groupBy("rank").agg(F.sort_array(F.collect_list("line")).alias("removed"))


def without_blocks(docs: DataFrame) -> DataFrame:
    """docs without the deleted lines; those of which nothing is left are dropped. n_chars, if there, follows the text."""
    removed = written(removed_lines(hashed_lines(docs)), "removed")
    joined = boxed(docs).join(removed.hint("shuffle_hash"), "rank", "left")
    left = F.filter(F.split(F.col("doc.text"), "\n"), lambda _, i: ~F.array_contains(F.col("removed"), i))
    changed = F.col("removed").isNotNull()
    kept = joined.select(with_text(docs, F.array_join(left, "\n"), changed), changed.alias("changed"))
    return kept.where(~F.col("changed") | F.col("doc.text").rlike(r"[^\x20\x09-\x0D]")).select("doc.*")


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and removed_lines of each document: a null text is one line, repeated rows are returned alike; no rows for an empty table."""
    lines = hashed_lines(table(spark, sf_dir, "documents"))
    found = lines.select("rank", "doc_id", F.size("lines").alias("n_lines")).join(written(removed_lines(lines), "removed"), "rank", "left")
    none = F.array().cast("array<int>")
    return found.select("doc_id", "n_lines", F.size(F.coalesce("removed", none)).alias("n_removed"), F.coalesce("removed", none).alias("removed_lines"))
