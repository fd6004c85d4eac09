"""Quality rules by divergence from language references.

A first pass counts, for each language of the corpus, its character classes and
its common words; a second compares each document's own histograms with those of
its language by Jensen-Shannon distance (base 2, so within 0 and 1). Counts of a
language cover all its documents. Short documents have rough histograms, so each
limit has a slack that shrinks with the square root of the length, and below a
minimum length a test is not made at all.

Besides, simple counts (repeated lines, words in repeated 8-word windows) reject
documents that are too short or repeat themselves.

Null text: no words, rejected by length. Null language: a language of its own,
and the empty string another.
A language with fewer than MIN_LANGUAGE_WORDS words is compared with the whole
corpus. Empty table: no rows. Repeated rows: each judged alike. Extra columns
are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm.common import as_bytes, table, to_python

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: A common word has at most this many bytes; the COMMON most frequent of a language make up its histogram.
COMMON_BYTES = 6
COMMON = 64
MIN_LANGUAGE_WORDS = 2_000
#: Words held while counting, before they are passed on.
FLUSH = 300_000
#: Largest distances, with slack / sqrt(length), and the least lengths at which they are tested.
CHAR_LIMIT, CHAR_SLACK, CHAR_MIN = 0.15, 2.6, 100
WORD_LIMIT, WORD_SLACK, WORD_MIN = 0.17, 2.2, 50

CLASSES = ("lower", "upper", "digit", "blank", "line", "stop", "symbol", "other punctuation", "control", "two-byte", "longer")


def _class_table() -> np.ndarray:
    """Class of each byte; continuation bytes have none (the last)."""
    t = np.full(256, len(CLASSES), np.int64)
    t[:32], t[127] = 8, 8
    t[33:127] = 7
    t[97:123], t[65:91], t[48:58] = 0, 1, 2
    t[[32, 9, 11, 12, 13]], t[10] = 3, 4
    t[[ord(x) for x in ".,;:'\"-()?"]] = 5
    t[[ord(x) for x in SYMBOLS + "@^_=+~{}[]\\/`!"]] = 6
    t[0xC2:0xE0], t[0xE0:] = 9, 10
    return t


CLASS_OF = _class_table()


def char_classes(text: bytes) -> np.ndarray:
    return np.bincount(CLASS_OF[np.frombuffer(text, np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]


def plain_word(word: bytes) -> bytes:
    """Lower case, without punctuation around it."""
    return word.lower().strip(b".,;:!?\"'()")


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 0 if one is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, d / 2)))


def repeated(ids: np.ndarray, width: int = WINDOW) -> int:
    """Words inside windows that occur more than once."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n].astype(np.uint64)
        h ^= h >> np.uint64(29)
    _, back, count = np.unique(h, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[back] > 1)
    if not len(at):
        return 0
    rows = np.lib.stride_tricks.sliding_window_view(ids, width)[at]  # the windows themselves decide
    _, back, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    at = at[count[back.ravel()] > 1]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((edge.cumsum() > 0).sum())


def base_counts(text: bytes) -> tuple[list[bytes], np.ndarray, dict[bytes, int], dict]:
    words = text.split()
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    s = text.decode()
    seen: set[bytes] = set()
    again = 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    return words, ids, index, {
        "n_words": len(words),
        "word_chars": len(s) - sum(map(s.count, BLANKS)),
        "n_symbols": sum(map(s.count, SYMBOLS)),
        "n_dup_lines": again,
        "n_repeat_words": repeated(ids),
    }


def _count(batches):
    """Character classes and common words of each language in one part of the corpus. At most FLUSH words and one batch's are held."""
    names = ["lang", "kind", "item", "n"]
    kept: dict = {}  # by language: character classes, all words, common words

    def flush():
        rows = []
        for lang, (classes, total, common) in kept.items():
            rows += [(lang, "class", str(i).encode(), int(n)) for i, n in enumerate(classes)]
            rows += [(lang, "word", w, n) for w, n in common.items() if w]
            rows.append((lang, "all", b"", total))
        kept.clear()
        for lo in range(0, len(rows), 1 << 16):
            columns = zip(*rows[lo : lo + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.int64()))], names=names)

    for batch in batches:
        words: dict = {}
        for text, lang in zip(as_bytes(batch.column("text")), batch.column("lang").to_pylist()):
            held = kept.setdefault(lang, [np.zeros(len(CLASSES), np.int64), 0, Counter()])
            held[0] += char_classes(text)
            words.setdefault(lang, Counter()).update(text.split())
        for lang, counted in words.items():
            held = kept[lang]
            held[1] += counted.total()
            for w, n in counted.items():
                if len(w) <= COMMON_BYTES + 2 and len(p := plain_word(w)) <= COMMON_BYTES:
                    held[2][p] += n
        if sum(len(held[2]) for held in kept.values()) > FLUSH:
            yield from flush()
    yield from flush()


class Reference:
    def __init__(self, rows):
        """rows: lang, kind, item, n; at most COMMON words for each language."""
        self.words = {r["item"]: r["n"] for r in rows if r["kind"] == "word"}
        self.classes = np.zeros(len(CLASSES))
        for r in rows:
            if r["kind"] == "class":
                self.classes[int(r["item"])] += r["n"]
        self.total = sum(r["n"] for r in rows if r["kind"] == "all")
        self.order = {w: i for i, w in enumerate(sorted(self.words))}
        common = [self.words[w] for w in sorted(self.words)]
        self.hist = np.array([*common, max(0, self.total - sum(common))], np.float64)


def language_references(docs: DataFrame) -> tuple[dict, Reference]:
    """A Reference for each language (null is one, the empty string another), and for the whole corpus. What comes to the driver is bounded by the number of languages."""
    from pyspark.sql import Window

    counts = to_python(docs.select("text", "lang")).mapInArrow(_count, "lang string, kind string, item binary, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))

    def first(df: DataFrame, *by) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("lang", "kind", *by).orderBy(F.desc("n"), "item"))
        return df.withColumn("rank", rank).where((F.col("kind") != "word") | (F.col("rank") <= COMMON))

    # First in each of many parts of a language's words, then among those.
    rows = [r.asDict() | {"item": bytes(r["item"])} for r in first(first(counts, F.pmod(F.xxhash64("item"), F.lit(256)))).collect()]
    whole: Counter = Counter()
    by: dict = {}
    for r in rows:
        whole[r["kind"], r["item"]] += r["n"]
        by.setdefault(r["lang"], []).append(r)
    everything = Reference([{"kind": k, "item": w, "n": n} for (k, w), n in whole.items()])
    own = {lang: Reference(held) for lang, held in by.items()}
    return {lang: ref for lang, ref in own.items() if ref.total >= MIN_LANGUAGE_WORDS}, everything


def distances(text: bytes, n_words: int, ids: np.ndarray, index: dict[bytes, int], ref: Reference) -> tuple[float, float]:
    by_id = np.bincount(ids, minlength=len(index))
    hist = np.zeros(len(ref.hist))
    for w, i in index.items():
        if len(w) <= COMMON_BYTES + 2 and (k := ref.order.get(plain_word(w))) is not None:
            hist[k] += by_id[i]
    hist[-1] = n_words - hist.sum()
    return js_distance(char_classes(text), ref.classes), js_distance(hist, ref.hist)


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean"


def _judge(references: tuple[dict, Reference], keep_only: bool):
    own, everything = references

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {f.split()[0]: [] for f in FIELDS.split(", ")}
            for text, lang in zip(as_bytes(batch.column("text")), batch.column("lang").to_pylist()):
                words, ids, index, row = base_counts(text)
                n = len(words)
                failed = n < MIN_WORDS or 100 * row["n_repeat_words"] > MAX_REPEAT_PERCENT * n
                c, w = distances(text, n, ids, index, own.get(lang, everything))
                kept = not failed and not (row["word_chars"] >= CHAR_MIN and c > CHAR_LIMIT + CHAR_SLACK / row["word_chars"] ** 0.5) and not (n >= WORD_MIN and w > WORD_LIMIT + WORD_SLACK / n**0.5)
                for k, v in (row | {"base_failed": failed, "char_distance": c, "word_distance": w, "kept": kept}).items():
                    out[k].append(v)
            if keep_only:
                yield batch.filter(pa.array(out["kept"], pa.bool_()))
            else:
                types = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
                fields = [(x.split()[0], types[x.split()[1]]) for x in FIELDS.split(", ")]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[k], t) for k, t in fields)], names=["doc_id", *(k for k, _ in fields)])

    return run


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, both distances and the verdict for each row of docs."""
    judge = _judge(language_references(docs), keep_only=False)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return to_python(docs.select("doc_id", "text", "lang")).mapInArrow(judge, f"doc_id {kind}, {FIELDS}")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, unchanged."""
    return to_python(docs).mapInArrow(_judge(language_references(docs), keep_only=True), docs.schema)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """quality of all documents: null and empty texts are rejected, repeated rows judged alike; no rows for an empty table."""
    return quality(table(spark, sf_dir, "documents"))
