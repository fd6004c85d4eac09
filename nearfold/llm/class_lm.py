"""Scoring texts by a Brown class-based bigram model.

Tokens are the words of a text, A-Z lower-cased, then one end. Exchange
clustering assigns every word that training has MIN_COUNT times or more to one of
CLASSES classes. A token's probability is

    p(class | class before) * p(word | class)

Words that are rarer, and unseen ones, are a class of their own, whose words have
add-one probabilities with one share for unseen words; DISCOUNT is taken off the
count of each other word and passed to this class. What follows a rare word
depends on the class of the last word before it that isn't rare. Transitions are
smoothed by the frequency of the class. Probabilities sum to 1 over the known
words and the unseen share.

- The ANCHORS most frequent tokens exchange one at a time, in the driver, by
  their counts of each other: a square table of bounded size.
- All other words exchange together, as a table: for each its counts of anchor
  classes before and after it. In each of ROUNDS rounds every word moves to the
  class under which its neighbours are likeliest, and the classes' counts are
  summed anew. The table has a row for each word, so it grows with the
  vocabulary; what is broadcast is the class table.
- Transitions are counted over all training tokens, in their final classes.

The driver gets the HEAD most frequent words with their classes, a bound that
doesn't grow with the corpus. Tokens outside the head are joined to the
vocabulary by word; no word there is frequent, for the frequent ones are in the
head.

Null text: empty, one end token. Null doc_id: like an empty id for the choice of
training documents. Repeated rows: counted and scored each. Empty table: no
rows; no training documents: N = 0 and all tokens unknown, score 0. Extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm.common import as_bytes, table, to_python
from nearfold.llm.simhash import TO_LOWER

HEAD = 200_000
ANCHORS = 1000
CLASSES = 100
MIN_COUNT = 2
#: Most rounds of the anchors, and rounds of the other words.
ANCHOR_ROUNDS = 8
ROUNDS = 3
#: Weight of the class's own frequency in a class transition.
PRIOR = 5.0
#: Taken off each count within a class, for words that are rare or unseen.
DISCOUNT = 0.75
#: Words held while counting, before they are passed on.
FLUSH = 200_000
#: Bytes of texts that are looked at together.
CHUNK = 1 << 20
END = b""
#: A code with its count, as one word's are packed on their way.
VISIT = np.dtype([("code", "<i2"), ("n", "<i8")])


def tokens_of(text: bytes) -> list[bytes]:
    return [*text.translate(TO_LOWER).split(), END]


def _chunks(column: pa.Array):
    """(first row, texts as bytes), about CHUNK bytes at a time, at least one text each: no more of a batch is held as bytes."""
    import pyarrow.compute as pc

    lo = held = 0
    for hi, size in enumerate(pc.binary_length(column).to_pylist()):
        held += size or 0
        if held > CHUNK:
            yield lo, as_bytes(column.slice(lo, hi + 1 - lo))
            lo, held = hi + 1, 0
    if lo < len(column):
        yield lo, as_bytes(column.slice(lo))


def on_disk(df: DataFrame) -> DataFrame:
    """df, computed once and kept on the executors' disks until it is unpersisted; lost parts are computed again. No files are written
    to the shared folder: on a local file system Hadoop starts a process for each, which looks as large as the whole executor until it has begun."""
    df.persist(StorageLevel.DISK_ONLY).count()
    return df


def _count_words(batches):
    seen: Counter = Counter()

    def flush():
        words = list(seen)
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        seen.clear()
        return out

    for batch in batches:
        for _, texts in _chunks(batch.column("text")):
            for text in texts:
                seen.update(tokens_of(text))
                if len(seen) > FLUSH:
                    yield flush()
    yield flush()


def _summed(total: np.ndarray, name: str):
    """Rows of the positions that are not 0."""
    at = np.flatnonzero(total)
    for i in range(0, len(at), 1 << 16):
        part = at[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part].astype(np.int64))], names=[name, "n"])


def _count_anchors(anchors: list[bytes]):
    """Counts of (anchor, next anchor), as rows of before * anchors + after."""

    def run(batches):
        size = len(anchors) + 1  # the last stands for all other words
        index = {w: i for i, w in enumerate(anchors)}
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for _, texts in _chunks(batch.column("text")):
                ids = np.fromiter(map(index.get, chain.from_iterable(map(tokens_of, texts)), repeat(size - 1)), np.int64)
                before = np.concatenate([[index[END]], ids[:-1]])
                total += np.bincount(before * size + ids, minlength=size * size)
        yield from _summed(np.ascontiguousarray(total.reshape(size, size)[:-1, :-1]).ravel(), "pair")

    return run


def _visit_rows(word: pa.Array, code: np.ndarray, n: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """word, visits: each word with the codes and counts between two ends, packed as VISIT."""
    visits = np.empty(len(code), VISIT)
    visits["code"], visits["n"] = code, n
    offsets = (ends * VISIT.itemsize).astype(np.int32)
    return pa.RecordBatch.from_arrays([word, pa.Array.from_buffers(pa.binary(), len(word), [None, pa.py_buffer(offsets), pa.py_buffer(visits)])], names=["word", "visits"])


def _count_neighbours(anchors: list[bytes], member: np.ndarray, classes: int, packed: bool = False):
    """For each other word: code, n; packed: the word with all of them that are counted together, as visits. Codes are the class of an anchor before it, classes + that of one after it, and 2 * classes for each occurrence."""

    def run(batches):
        width = 2 * classes + 1
        index = {w: i for i, w in enumerate(anchors)}
        class_of = np.append(member, -1)  # -1: no anchor
        names, codes, counts = list(index), [], []

        def flush():
            code, back = np.unique(np.concatenate(codes), return_inverse=True)
            n = np.bincount(back, np.concatenate(counts)).astype(np.int64)
            word = code // width
            first = np.flatnonzero(np.diff(word, prepend=-1)) if packed else np.arange(len(word))
            ends = np.append(first, len(word))
            for i in range(0, len(first), 1 << 16):
                now = ends[i : i + (1 << 16) + 1]
                part = slice(now[0], now[-1])
                name = pa.array([names[w] for w in word[now[:-1]].tolist()], pa.binary())
                if packed:
                    yield _visit_rows(name, code[part] % width, n[part], now - now[0])
                else:
                    yield pa.RecordBatch.from_arrays([name, pa.array((code[part] % width).astype(np.int16)), pa.array(n[part])], names=["word", "code", "n"])
            for name in names[len(anchors) :]:
                del index[name]
            del names[len(anchors) :]
            codes.clear()
            counts.clear()

        for batch in batches:
            for _, texts in _chunks(batch.column("text")):
                tokens = list(chain.from_iterable(map(tokens_of, texts)))
                get, known = index.get, len(names)
                ids = np.fromiter(map(get, tokens, repeat(-1)), np.int64, len(tokens))
                new = np.flatnonzero(ids < 0).tolist()
                fresh = list(dict.fromkeys(tokens[i] for i in new))
                index.update(zip(fresh, range(known, known + len(fresh))))
                names.extend(fresh)
                ids[new] = [index[tokens[i]] for i in new]
                at = np.flatnonzero(ids >= len(anchors))
                near = class_of[np.minimum(np.concatenate([[index[END]], ids]), len(anchors))]
                lead, follow = near[at], near[np.minimum(at + 2, len(ids))]  # near is one place on; a word is never last
                base = ids[at] * width
                found = np.concatenate([(base + lead)[lead >= 0], (base + classes + follow)[follow >= 0], base + 2 * classes])
                code, n = np.unique(found, return_counts=True)
                codes.append(code)
                counts.append(n)
                if len(names) > FLUSH:
                    yield from flush()
        if codes:
            yield from flush()

    return run


def _gather(width: int, packed: bool = False):
    """Rows sorted by word (word, code, n, or packed: word, visits) as one row for each word: n, codes, counts."""

    def made(batch, first):
        """first: whether a row is the first of its word."""
        packed = batch.column("visits")
        ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
        visits = np.frombuffer(packed.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(VISIT)
        words = int(first.sum())
        row = np.repeat(np.cumsum(first) - 1, np.diff(ends) // VISIT.itemsize)
        key, back = np.unique(row * width + visits["code"], return_inverse=True)
        total = np.bincount(back, visits["n"]).astype(np.int64)
        row, code = key // width, key % width
        occurrences = np.zeros(words, np.int64)
        own = code == width - 1
        occurrences[row[own]] = total[own]
        keep = ~own & (occurrences >= MIN_COUNT)[row]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=words))]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), x) for x in (pa.array(code[keep].astype(np.int16)), pa.array(total[keep]))]
        return pa.RecordBatch.from_arrays([batch.column("word").filter(pa.array(first)), pa.array(occurrences), *lists], names=["word", "n", "codes", "counts"])

    def starts(batch):
        import pyarrow.compute as pc

        word = batch.column("word")
        return np.concatenate([[True], pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False).astype(bool)])

    def run(batches):
        held: list[pa.RecordBatch] = []  # rows of the last word
        for batch in batches:
            if not batch.num_rows:
                continue
            if not packed:
                batch = _visit_rows(batch.column("word"), batch.column("code").to_numpy(), batch.column("n").to_numpy(), np.arange(batch.num_rows + 1))
            first = starts(batch)
            cut = int(np.flatnonzero(first)[-1])
            if held and (cut or batch.column("word")[0] != held[0].column("word")[0]):
                whole = _joined([*held, batch.slice(0, cut)])
                yield made(whole, starts(whole))
                held = []
            elif cut:
                yield made(batch.slice(0, cut), first[:cut])
            held.append(batch.slice(cut))
        if held:
            whole = _joined(held)
            yield made(whole, starts(whole))

    return run


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _xlogx(x):
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = ANCHOR_ROUNDS) -> np.ndarray:
    """The class of each unit. bigrams: counts of (unit before, unit). Units start dealt by falling count."""
    units = len(bigrams)
    classes = min(classes, units)
    counts = bigrams.sum(axis=0)
    member = np.empty(units, np.int64)
    member[np.argsort(-counts, kind="stable")] = np.arange(units) % classes
    one = np.eye(classes)[member]
    after, before = bigrams @ one, bigrams.T @ one  # counts of each unit followed, or preceded, by each class
    m = one.T @ after
    for _ in range(rounds):
        moved = 0
        for u in np.argsort(-counts, kind="stable"):
            a, follow, lead, own = member[u], after[u].copy(), before[u].copy(), bigrams[u, u]
            follow[a] -= own  # pairs of the unit with itself count apart
            lead[a] -= own
            m[a] -= follow
            m[:, a] -= lead
            m[a, a] -= own
            outward, inward = m.sum(axis=1), m.sum(axis=0)
            gain = (_xlogx(m + follow) - _xlogx(m)).sum(axis=1) + (_xlogx(m + lead[:, None]) - _xlogx(m)).sum(axis=0)
            d = m.diagonal()
            gain += _xlogx(d + follow + lead + own) - _xlogx(d + follow) - _xlogx(d + lead) + _xlogx(d)
            gain -= _xlogx(outward + follow.sum() + own) - _xlogx(outward) + _xlogx(inward + lead.sum() + own) - _xlogx(inward)
            b = int(np.argmax(gain)) if gain.max() > gain[a] + 1e-9 else a
            m[b] += follow
            m[:, b] += lead
            m[b, b] += own
            if b != a:
                moved += 1
                member[u] = b
                after[:, a] -= bigrams[:, u]
                after[:, b] += bigrams[:, u]
                before[:, a] -= bigrams[u]
                before[:, b] += bigrams[u]
        if not moved:
            break
    return np.unique(member, return_inverse=True)[1]  # an empty class has no number


def best_classes(lead: np.ndarray, follow: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The class of each word under which its neighbours are likeliest. lead, follow: counts of classes before and after; m: counts of (class, next class)."""
    log = np.log(m + 0.5)
    size = np.log(m.sum(axis=1) + 0.5 * len(m))
    return np.argmax(lead @ log + follow @ log.T - (n + follow.sum(axis=1))[:, None] * size, axis=1)


def _dense(batch, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lead, follow, n of each row."""
    codes, counts = batch.column("codes"), batch.column("counts")
    row = np.repeat(np.arange(batch.num_rows), np.diff(codes.offsets.to_numpy()))
    flat = np.bincount(row * 2 * classes + codes.flatten().to_numpy(), counts.flatten().to_numpy(), batch.num_rows * 2 * classes).reshape(-1, 2 * classes)
    return flat[:, :classes], flat[:, classes:], batch.column("n").to_numpy()


def _assigned(batch, m: np.ndarray, step: int = 8192):
    """(rows, class, lead, follow) in steps; the class is len(m) where a word is rare."""
    for lo in range(0, batch.num_rows, step):
        part = batch.slice(lo, step)
        lead, follow, n = _dense(part, len(m))
        yield part, np.where(n >= MIN_COUNT, best_classes(lead, follow, n, m), len(m)), lead, follow


def _class_counts(m: np.ndarray):
    def run(batches):
        total = np.zeros(m.shape)
        for batch in batches:
            for _, member, lead, follow in _assigned(batch, m):
                one = np.eye(len(m) + 1)[member][:, :-1]
                total += one.T @ follow + (one.T @ lead).T
        yield from _summed(total.ravel(), "pair")

    return run


def _assign(m: np.ndarray):
    def run(batches):
        for batch in batches:
            for part, member, _, _ in _assigned(batch, m):
                yield pa.RecordBatch.from_arrays([part.column("word"), part.column("n"), pa.array(member.astype(np.int16))], names=["word", "n", "class"])

    return run


def frequent(counts: DataFrame) -> list[tuple]:
    """Rows (word, n, ...) of at most HEAD words, by falling count: those above the least bound, in steps of a sixteenth of a power of 2, that leaves no more."""
    step = F.floor(F.log2("n") * 16)
    left, bound = HEAD, None
    for s, words in sorted(((r["s"], r["words"]) for r in counts.groupBy(step.alias("s")).agg(F.count("n").alias("words")).collect()), reverse=True):
        if words > left:
            break
        left, bound = left - words, s
    if bound is None:
        return []
    found = counts.where(step >= bound).toArrow()
    rows = zip(*(found.column(c).to_pylist() for c in found.column_names))
    return sorted(((bytes(r[0]), *r[1:]) for r in rows), key=lambda r: (-r[1], r[0]))


def _matrix(pairs: DataFrame, rows: int, columns: int) -> np.ndarray:
    """Sums of (pair, n) as a table."""
    found = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(rows * columns)
    out[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(rows, columns)


class Classes:
    """What all words of a class have together. The rare class is the last.

    States are the classes but the rare one, then each of them with rare words after it."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, start: int):
        """words, tokens: of each class. start: the class of the end token."""
        self.rare, self.start = len(words) - 1, start
        self.rare_share = math.log10(tokens[-1] + words[-1] + 1)
        self.left = np.where(words > 0, tokens - DISCOUNT * words, 1)
        self.passed = np.append((DISCOUNT * words / np.maximum(tokens, 1))[:-1], 0)  # from each class to the rare one

    def emission(self, n: np.ndarray, member: np.ndarray) -> np.ndarray:
        """log10 of p(word | class) for words of these counts and classes; count 0 is an unseen word."""
        rare = member == self.rare
        return np.where(rare, np.log10(n + 1) - self.rare_share, np.log10((np.maximum(n, 1) - DISCOUNT) / self.left[member]))

    def transitions(self, m: np.ndarray) -> np.ndarray:
        """log10 of p(next class | state), from counts."""
        prior = (m.sum(axis=0) + 1) / (m.sum() + m.shape[1])
        p = (m + PRIOR * prior) / (m.sum(axis=1, keepdims=True) + PRIOR)
        moved = p * self.passed
        p -= moved
        p[:, -1] += moved.sum(axis=1)
        return np.log10(p)


class Vocabulary:
    """The head's words with their classes, none of which is the rare one."""

    def __init__(self, head: list[tuple[bytes, int, int]], words: np.ndarray, tokens: np.ndarray, total: int, distinct: int):
        """head: word, count, class. words, tokens: of each class. total, distinct: of all training tokens."""
        self.index = {w: i for i, (w, _, _) in enumerate(head)}
        self.member = np.array([c for _, _, c in head], np.int64)
        at = self.index.get(END)
        self.classes = Classes(words, tokens, 0 if at is None else int(self.member[at]))
        n = np.array([k for _, k, _ in head], np.float64)
        self.total, self.base_share = total, math.log10(total + distinct + 1)
        self.base, self.emit = np.log10(n + 1), self.classes.emission(n, self.member)

    @property
    def rare(self) -> int:
        return self.classes.rare


DOCUMENT = "n_tokens long, n_known long, base double, emit double, pairs array<int>, counts array<int>"
OUTSIDE = "out_word array<binary>, out_place array<int>, out_before array<short>, out_after array<short>"


def _lists(row: np.ndarray, rows: int, *values: pa.Array) -> list[pa.Array]:
    """Values by ascending row number as lists of each row."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]), pa.int32())
    return [pa.ListArray.from_arrays(offsets, v) for v in values]


def _documents(shared, names: list[str]):
    """Of each document: what its tokens of the head give, the pairs of classes among them, and its other tokens with their places and the classes beside them (-1: another such token before; after: likewise)."""

    def run(batches):
        model = shared.value
        get, width = model.index.get, model.rare + 1
        member, base, emit = (np.append(x, 0) for x in (model.member, model.base, model.emit))
        for batch in batches:
            for lo, texts in _chunks(batch.column("text")):
                hi = lo + len(texts)
                split = [tokens_of(t) for t in texts]
                size = np.fromiter(map(len, split), np.int64, len(split))
                tokens = list(chain.from_iterable(split))
                ids = np.fromiter(map(get, tokens, repeat(-1)), np.int64, len(tokens))
                doc = np.repeat(np.arange(hi - lo), size)
                inside = ids >= 0
                classes = np.where(inside, member[ids], -1)
                first = np.cumsum(size) - size
                before = np.concatenate([[0], classes[:-1]])
                before[first] = model.classes.start
                both = inside & (before >= 0)
                key, n = np.unique(doc[both] * width * width + before[both] * width + classes[both], return_counts=True)
                pairs = _lists(key // (width * width), hi - lo, pa.array((key % (width * width)).astype(np.int32)), pa.array(n.astype(np.int32)))
                at = np.flatnonzero(~inside)
                after = np.append(classes, -1)[at + 1]
                place = at - first[doc[at]]
                out = [pa.array([tokens[i] for i in at.tolist()], pa.binary()), pa.array(place.astype(np.int32)), pa.array(before[at].astype(np.int16)), pa.array(np.where(place + 1 < size[doc[at]], after, -1).astype(np.int16))]
                sums = [np.bincount(doc, np.where(inside, x[ids], 0.0), hi - lo) for x in (base, emit)]
                known = np.bincount(doc[inside], minlength=hi - lo)
                columns = [pa.array(size), pa.array(known.astype(np.int64)), pa.array(sums[0] - size * model.base_share), pa.array(sums[1]), *pairs, *_lists(doc[at], hi - lo, *out)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *columns], names=[*names, *(f.split()[0] for f in f"{DOCUMENT}, {OUTSIDE}".split(", "))])

    return run


def _outside_pairs(batch, rare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of documents' tokens outside the head: row, state * classes + next class, and the tokens' own order: (row, class, count)."""
    items = batch.column("items")
    row = np.repeat(np.arange(batch.num_rows), np.diff(items.offsets.to_numpy()))
    place, before, after, member, n = (items.flatten().field(f).to_numpy().astype(np.int64) for f in ("place", "before", "after", "class", "n"))
    order = np.lexsort([place, row])
    row, before, after, member, n = (x[order] for x in (row, before, after, member, n))
    # The last class before or at each token that isn't rare: its own, that before it, or as of the token before.
    own = np.where(member < rare, member, before)
    last = own[np.maximum.accumulate(np.where(own >= 0, np.arange(len(own)), 0))]
    state = np.where(member < rare, member, rare + last)
    before = np.where(before >= 0, before, np.concatenate([state[:1], state[:-1]]))
    closed = after >= 0
    width = rare + 1
    return np.concatenate([row, row[closed]]), np.concatenate([before * width + member, (state * width + after)[closed]]), (row, member, n)


def _outside_counts(rare: int):
    def run(batches):
        size = 2 * rare * (rare + 1)
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_outside_pairs(batch, rare)[1], minlength=size)
        yield from _summed(total, "pair")

    return run


def _outside_scores(classes: Classes, moves: np.ndarray):
    def run(batches):
        flat = moves.ravel()
        for batch in batches:
            row, pairs, (token, member, n) = _outside_pairs(batch, classes.rare)
            rows = batch.num_rows
            score = np.bincount(row, flat[pairs], rows) + np.bincount(token, classes.emission(n.astype(np.float64), member), rows)
            known, base = np.bincount(token[n > 0], minlength=rows), np.bincount(token, np.log10(n + 1.0), rows)
            yield pa.RecordBatch.from_arrays([batch.column("tag"), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], names=["tag", "known", "base", "score"])

    return run


def _inside_scores(moves: np.ndarray):
    def run(batches):
        flat = moves.ravel()
        for batch in batches:
            pairs, counts = batch.column("pairs"), batch.column("counts")
            row = np.repeat(np.arange(batch.num_rows), np.diff(pairs.offsets.to_numpy()))
            score = np.bincount(row, flat[pairs.flatten().to_numpy()] * counts.flatten().to_numpy(), batch.num_rows) + batch.column("emit").to_numpy()
            names = [n for n in batch.schema.names if n not in ("pairs", "counts", "emit")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(score)], names=[*names, "score"])

    return run


def train(train_docs: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The head's vocabulary, and the table of all words but the anchors (word, n, class), for the caller to unpersist."""
    texts = to_python(train_docs.select("text"))
    counts = on_disk(texts.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    if not total:
        counts.unpersist()
        empty = train_docs.sparkSession.createDataFrame([], "word binary, n long, class short")
        return Vocabulary([], np.zeros(2), np.zeros(2), 0, 0), empty
    top = {bytes(r["word"]): r["n"] for r in counts.where((F.col("n") >= MIN_COUNT) | (F.length("word") == 0)).orderBy(F.desc(F.length("word") == 0), F.desc("n"), "word").limit(ANCHORS).collect()}
    counts.unpersist()
    anchors = list(top)
    m = _matrix(texts.mapInArrow(_count_anchors(anchors), "pair long, n long"), len(anchors), len(anchors))
    member = exchange(m)
    classes = int(member.max()) + 1
    one = np.eye(classes)[member]
    fixed = now = one.T @ m @ one
    visits = texts.mapInArrow(_count_neighbours(anchors, member, classes, packed=True), "word binary, visits binary")
    gathered = visits.repartition("word").sortWithinPartitions("word").mapInArrow(_gather(2 * classes + 1, packed=True), "word binary, n long, codes array<short>, counts array<long>")
    words = on_disk(gathered)
    for _ in range(ROUNDS - 1):
        now = fixed + _matrix(words.where(F.col("n") >= MIN_COUNT).mapInArrow(_class_counts(now), "pair long, n long"), classes, classes)
    assigned = on_disk(words.mapInArrow(_assign(now), "word binary, n long, class short"))
    words.unpersist()
    sums = {r["class"]: (r["words"], r["tokens"]) for r in assigned.groupBy("class").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).collect()}
    held = np.array([sums.get(c, (0, 0)) for c in range(classes + 1)], np.float64)
    for w, c in zip(anchors, member):
        held[c] += 1, top[w]
    head = [(w, top[w], int(c)) for w, c in zip(anchors, member)] + frequent(assigned.where(F.col("n") >= MIN_COUNT))
    return Vocabulary(head, held[:, 0], held[:, 1], total, distinct), assigned


def class_scores(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for each row of docs. held_out: a Column, true for rows that the model must not learn from.

    The result is read from two tables that stay on the executors' disks until spark.catalog.clearCache()."""
    spark = docs.sparkSession
    model, assigned = train(docs.where(~held_out))
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["tag", "doc_id", "held_out"]
    tagged = to_python(docs.select(F.monotonically_increasing_id().alias("tag"), "doc_id", held_out.alias("held_out"), "text"))
    rows = on_disk(tagged.mapInArrow(_documents(shared, names), f"tag long, doc_id {kind}, held_out boolean, {DOCUMENT}, {OUTSIDE}"))
    shared.unpersist()  # executors need not hold the head any longer; where rows are lost it is sent again
    outside = rows.select("tag", "held_out", F.inline(F.arrays_zip("out_word", "out_place", "out_before", "out_after"))).toDF("tag", "held_out", "word", "place", "before", "after")
    known = outside.join(assigned, "word", "left").select("tag", "held_out", "place", "before", "after", F.coalesce("class", F.lit(model.rare).cast("short")).alias("class"), F.coalesce("n", F.lit(0)).alias("n"))
    grouped = known.groupBy("tag", "held_out").agg(F.collect_list(F.struct("place", "before", "after", "class", "n")).alias("items"))
    items = on_disk(grouped)
    assigned.unpersist()
    inner = rows.where(~F.col("held_out")).select(F.inline(F.arrays_zip("pairs", "counts"))).toDF("pair", "n").select(F.col("pair").cast("long").alias("pair"), F.col("n").cast("long").alias("n"))
    outer = items.where(~F.col("held_out")).mapInArrow(_outside_counts(model.rare), "pair long, n long")
    moves = model.classes.transitions(_matrix(inner.unionByName(outer), 2 * model.rare, model.rare + 1))
    each = rows.select("tag", "doc_id", "held_out", "n_tokens", "n_known", "base", "emit", "pairs", "counts").mapInArrow(_inside_scores(moves), f"tag long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double")
    other = items.mapInArrow(_outside_scores(model.classes, moves), "tag long, known long, base double, score double").toDF("tag", "o_known", "o_base", "o_score")
    joined = each.join(other, "tag", "left")
    score = F.col("score") + F.coalesce("o_score", F.lit(0.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("o_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("o_base", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )


def op10_class_lm(spark, sf_dir: str) -> DataFrame:
    """class_scores of all documents: null and empty texts have one end token, repeated rows are each scored; no rows for an empty table."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return class_scores(table(spark, sf_dir, "documents"), held_out)
