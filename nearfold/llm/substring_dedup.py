"""Substring dedup by hashing lines, which are cut at points that their own words set.

A line is cut after each word whose hash is the least within REACH words, so
that equal passages are cut alike wherever they begin and end, and every unit has
MIN_UNIT_WORDS words or more. Units are normalised (lower case, one space
between words) and their digests grouped over the whole corpus. The earliest
occurrence by document rank and place stays; every other one is a repeat.

Repeats that follow each other in a document form a run. Removed are runs of
MIN_PASSAGE_WORDS words or more, and of shorter ones every whole line, down to
MIN_UNIT_WORDS words: a part of a line that is as short occurs twice by chance.
Each run is returned with its offsets in the original text, in code points.
Lines of fewer than MIN_UNIT_WORDS words have no unit: between two repeats they
belong to the run.

Groups of any size are summed with partial aggregation; only digests that occur
more than once are joined to their occurrences, and that join can be split.

Null and empty texts have no units. Null doc_id: ranked last, by text. Rows equal
in doc_id and text are one document: its runs are returned once. Rows equal in
doc_id only are ranked by text. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm.common import boxed, rank_column, segments, table, text_or_empty, to_python, with_text, written

MIN_UNIT_WORDS = 5
MIN_PASSAGE_WORDS = 15
#: Words on either side among which a cut has the least hash.
REACH = 4

#: Texts that are cut together, by their characters, and words whose hashes are kept.
CHUNK = 1 << 20
MEMO_WORDS = 200_000
#: Whether a code point is blank, up to the last that is.
BLANKS = np.array([chr(c).isspace() for c in range(0x3001)] + [False])


class Hashes(dict):
    """CRC-32 of words, each worked out once."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        found = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return found


HASHES = Hashes()


def cuts(hashes: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Whether a unit ends after each word. line: the number of each word's line, ascending from 0."""
    n = len(hashes)
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    size = np.diff(np.append(first, n))
    rank = np.cumsum(np.concatenate([[True], line[1:] != line[:-1]])) - 1
    place = np.arange(n) - first[rank]
    # Lines are set REACH places apart, so that no window crosses a line end.
    at = np.arange(n) + REACH * (rank + 1)
    laid = np.full(at[-1] + 1 + REACH, 1 << 62, np.int64)
    laid[at] = hashes
    cut = (place >= MIN_UNIT_WORDS - 1) & (place < size[rank] - MIN_UNIT_WORDS)
    for k in range(1, REACH + 1):  # of equal ones the first
        cut &= (hashes < laid[at - k]) & (hashes <= laid[at + k])
    cut[first + size - 1] = True
    return cut


def units_of(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The words of each unit of all texts, lower-case with one space between them; and a row for each: the text's number, its offsets there, how many words, 1 if it begins a line plus 2 if it ends one."""
    whole = "\n".join(texts)
    words = whole.lower().split()
    if not words:
        return [], np.zeros((0, 5), np.int64)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = np.concatenate([[True], BLANKS[np.minimum(points, len(BLANKS) - 1)], [True]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[::2], edge[1::2]
    line = np.searchsorted(np.flatnonzero(points == 10), start)
    last = np.flatnonzero(cuts(np.fromiter(map(HASHES.__getitem__, words), np.int64, len(words)), line))
    first = np.concatenate([[0], last[:-1] + 1])
    begins = np.concatenate([[True], line[last[:-1]] != line[first[1:]]])
    place = begins + 2 * np.append(begins[1:], True)
    size = last + 1 - first
    whole_units = np.flatnonzero(size >= MIN_UNIT_WORDS)
    first, last, place, size = (x[whole_units] for x in (first, last, place, size))
    begun = np.cumsum([0] + [len(t) + 1 for t in texts])
    text = np.searchsorted(begun, start[first], side="right") - 1
    rows = np.stack([text, start[first] - begun[text], end[last] - begun[text], size, place], axis=1)
    return [" ".join(words[i:j]) for i, j in zip(first.tolist(), (last + 1).tolist())], rows


def units(text: str) -> list[tuple[str, int, int, int, int]]:
    """Of each unit of one text: its words, offsets, number of words, and place in its line."""
    words, rows = units_of([text])
    return [(w, *r[1:]) for w, r in zip(words, rows.tolist())]


def _chunks(texts: list[str]):
    """Ranges of texts of about CHUNK characters, at least one text each."""
    lo = held = 0
    for hi, text in enumerate(texts):
        held += len(text)
        if held > CHUNK:
            yield lo, hi + 1
            lo, held = hi + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


COLUMNS = ("digest", "rank", "unit", "start", "end", "words", "place")


def _digests(batches):
    from xxhash import xxh3_128_digest

    for batch in batches:
        texts, ranks = batch.column("text").to_pylist(), batch.column("rank")
        for lo, hi in _chunks(texts):
            words, rows = units_of(texts[lo:hi])
            digests = pa.array([xxh3_128_digest(w.encode("utf-8", "surrogatepass")) for w in words], pa.binary())
            text = rows[:, 0]
            unit = np.arange(len(text)) - np.searchsorted(text, text)
            columns = [pa.array(c.astype(np.int32)) for c in (unit, *rows.T[1:])]
            yield pa.RecordBatch.from_arrays([digests, ranks.take(pa.array(text + lo)).cast(pa.binary()), *columns], names=list(COLUMNS))


def removed_runs(repeats: list[dict]) -> list[list[dict]]:
    """Runs of one document's repeated units, given in order: those that are long enough, and the whole lines of the others."""
    runs: list[list[dict]] = []
    for row in repeats:
        if runs and runs[-1][-1]["unit"] == row["unit"] - 1:
            runs[-1].append(row)
        else:
            runs.append([row])
    out = []
    for run in runs:
        if sum(r["words"] for r in run) < MIN_PASSAGE_WORDS:
            begun = next((i for i, r in enumerate(run) if r["place"] & 1), len(run))
            ended = next((i for i in range(len(run), begun, -1) if run[i - 1]["place"] & 2), begun)
            run = run[begun:ended]
        if run:
            out.append(run)
    return out


def _runs(batches):
    for group in segments(batches, "rank"):
        seen: set[bytes] = set()
        repeats = []
        last = None
        for row in group.sort_by("unit").to_pylist():
            if row["unit"] == last:  # the same row of the table again
                continue
            last = row["unit"]
            if row["rank"] != row["first"] or row["digest"] in seen:
                repeats.append(row)
            seen.add(row["digest"])
        found = removed_runs(repeats)
        if found:
            columns = [[run[0]["start"] for run in found], [run[-1]["end"] for run in found], [sum(r["words"] for r in run) for run in found]]
            rank, first = pa.array([row["rank"]] * len(found), pa.binary()), pa.array([run[0]["first"] for run in found], pa.binary())
            yield pa.RecordBatch.from_arrays([rank, *(pa.array(c, pa.int32()) for c in columns), first], names=["rank", "start", "end", "words", "first"])


def id_of(rank) -> F.Column:
    """The doc_id in a rank."""
    number = F.conv(F.hex(F.substring(rank, 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(2**63)).cast("decimal(20,0)")
    return F.when(F.hex(F.substring(rank, 1, 1)) == "00", number.cast("long"))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """rank, start, end, words, first: the runs to be removed, and the rank of the document that keeps the first unit's earliest occurrence."""
    ranked = docs.select(rank_column(docs).alias("rank"), text_or_empty().alias("text"))
    found = written(to_python(ranked).mapInArrow(_digests, "digest binary, rank binary, unit int, start int, end int, words int, place int"), "units")
    groups = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    repeated = written(groups.where("n > 1").select("digest", "first"), "repeated-units")
    occurrences = found.join(repeated.hint("shuffle_hash"), "digest").repartition("rank").sortWithinPartitions("rank")
    return occurrences.mapInArrow(_runs, "rank binary, start int, end int, words int, first binary")


def without_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """docs with the runs cut out of their texts."""
    spans = runs.groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    text = F.col("doc.text")
    joined = boxed(docs).join(spans.hint("shuffle_hash"), "rank", "left")
    from_ = F.concat(F.array(F.lit(0)), F.transform("spans", lambda x: x["end"]))
    to = F.concat(F.transform("spans", lambda x: x["start"]), F.array(F.length(text)))
    kept = F.array_join(F.transform(F.arrays_zip(from_.alias("a"), to.alias("b")), lambda x: F.substring(text, x["a"] + 1, x["b"] - x["a"])), "")
    return joined.select(with_text(docs, kept, F.col("spans").isNotNull())).select("doc.*")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """A row for each removed run of documents, words of short lines in between not counted. Null and empty texts, and those without repeats, have none."""
    runs = repeated_runs(table(spark, sf_dir, "documents"))
    return runs.select(id_of("rank").alias("doc_id"), "start", "end", "words", id_of("first").alias("keep_id"))
