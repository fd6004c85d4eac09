import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfold.llm import class_lm as C


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), ""]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def is_held():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


SIZES = [dict(HEAD=200_000), dict(HEAD=15), dict(HEAD=0, ANCHORS=7, CLASSES=4), dict(HEAD=30, ANCHORS=12, CLASSES=5, FLUSH=20, CHUNK=500)]


def set_sizes(monkeypatch, sizes):
    for name, value in (dict(ANCHORS=40, CLASSES=8) | sizes).items():
        monkeypatch.setattr(C, name, value)
    monkeypatch.setattr(C.exchange, "__defaults__", (C.CLASSES, C.ANCHOR_ROUNDS))


@pytest.mark.parametrize("sizes", SIZES)
def test_base_score_equals_brute_force(docs, texts, sizes, monkeypatch):
    set_sizes(monkeypatch, sizes)
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in C.class_scores(docs, is_held()).collect())
    count = Counter(w for i, t in texts if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in texts)
    assert got == want


class Brute:
    """The model from its classes alone, by plain loops over the training texts."""

    def __init__(self, class_of, count, rare, texts):
        self.class_of, self.count, self.rare = class_of, count, rare
        self.n, self.v = Counter(), Counter()
        for w, k in count.items():
            self.n[self.kind(w)] += k
            self.v[self.kind(w)] += 1
        self.moves = Counter()
        for t in texts:
            self.moves.update((s, c) for s, c, _ in self.walk(t))
        self.out, self.into = Counter(), Counter()
        for (s, c), k in self.moves.items():
            self.out[s] += k
            self.into[c] += k
        self.all = sum(self.into.values())

    def kind(self, w):
        return self.class_of.get(w, self.rare)

    def walk(self, text):
        """(state, class, word) of each token; a state is (last class that isn't rare, whether rare words followed it)."""
        state = self.kind(""), False
        for w in tokens(text):
            c = self.kind(w)
            yield state, c, w
            state = (state[0], True) if c == self.rare else (c, False)

    def word(self, state, c, w):
        def move(x):
            return (self.moves[state, x] + C.PRIOR * (self.into[x] + 1) / (self.all + self.rare + 1)) / (self.out[state] + C.PRIOR)

        if c != self.rare:
            return move(c) * (self.count[w] - C.DISCOUNT) / self.n[c]
        passed = sum(move(x) * C.DISCOUNT * self.v[x] / self.n[x] for x in range(self.rare) if self.n[x])
        return (move(c) + passed) * (self.count[w] + 1) / (self.n[c] + self.v[c] + 1)

    def score(self, text):
        return sum(math.log10(self.word(*x)) for x in self.walk(text))


def brute_model(docs, texts):
    """The model's classes, and a brute-force model of them. Words are bytes there and text here."""
    model, assigned = C.train(docs.where(~is_held()))
    train = [t for i, t in texts if not held(i)]
    count = Counter(w for t in train for w in tokens(t))
    kinds = {w.decode(): int(model.member[i]) for w, i in model.index.items()} | {bytes(r["word"]).decode(): r["class"] for r in assigned.collect()}
    assert set(kinds) == set(count)
    assert all((count[w] < C.MIN_COUNT and w != "") == (c == model.rare) for w, c in kinds.items())
    return Brute({w: c for w, c in kinds.items() if c != model.rare}, count, model.rare, train)


@pytest.mark.parametrize("sizes", SIZES)
def test_scores_equal_brute_force(docs, texts, sizes, monkeypatch):
    set_sizes(monkeypatch, sizes)
    brute = brute_model(docs, texts)
    got = sorted((str(r["doc_id"]), round(r["score"], 6), round(r["perplexity"], 3)) for r in C.class_scores(docs, is_held()).collect())
    want = [(i, brute.score(t), len(tokens(t))) for i, t in texts]
    assert got == sorted((str(i), round(s, 6), round(10 ** (-s / n), 3)) for i, s, n in want)


def test_probabilities_sum_to_one(docs, texts, monkeypatch):
    set_sizes(monkeypatch, dict(ANCHORS=12, CLASSES=5))
    brute = brute_model(docs, texts)
    for state in [(c, r) for c in range(brute.rare) for r in (False, True)]:
        total = sum(brute.word(state, brute.kind(w), w) for w in brute.count) + brute.word(state, brute.rare, "an unseen word")
        assert total == pytest.approx(1)


def test_frequent_words(spark, monkeypatch):
    counts = spark.createDataFrame([(f"w{i}".encode(), 1 + i // 10, 3) for i in range(100)], "word binary, n long, class short")
    for most in (0, 5, 10, 37, 100, 500):
        monkeypatch.setattr(C, "HEAD", most)
        got = C.frequent(counts)
        assert len(got) == min(most // 10 * 10, 100) and sorted(n for _, n, _ in got) == sorted(1 + i // 10 for i in range(100))[100 - len(got) :]


@pytest.mark.parametrize("flush, chunk", [(400_000, 4 << 20), (3, 100)])
def test_neighbours_equal_brute_force(spark, docs, texts, monkeypatch, flush, chunk):
    monkeypatch.setattr(C, "FLUSH", flush)
    monkeypatch.setattr(C, "CHUNK", chunk)
    anchors, member = ["", "the", "of", "a"], [1, 0, 1, 2]
    kind = dict(zip(anchors, member))
    want = {}
    for _, t in texts:
        words = ["", *tokens(t)]
        for before, w, after in zip(words, words[1:], words[2:]):
            if w not in kind:
                entry = want.setdefault(w, Counter())
                entry["n"] += 1
                if before in kind:
                    entry[kind[before]] += 1
                if after in kind:
                    entry[3 + kind[after]] += 1
    visits = docs.select("text").mapInArrow(C._count_neighbours([a.encode() for a in anchors], np.array(member), 3), "word binary, code short, n long")
    rows = visits.repartition("word").sortWithinPartitions("word").mapInArrow(C._gather(7), "word binary, n long, codes array<short>, counts array<long>").collect()
    got = {bytes(r["word"]).decode(): Counter({"n": r["n"]} | dict(zip(r["codes"], r["counts"]))) for r in rows}
    assert len(got) == len(rows)
    assert got == {w: entry if entry["n"] >= C.MIN_COUNT else Counter(n=entry["n"]) for w, entry in want.items()}


@pytest.mark.parametrize("flush, chunk, batch", [(400_000, 4 << 20, 10_000), (3, 100, 2)])
def test_packed_neighbours_are_the_same_in_fewer_rows(spark, docs, monkeypatch, flush, chunk, batch):
    monkeypatch.setattr(C, "FLUSH", flush)
    monkeypatch.setattr(C, "CHUNK", chunk)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)  # words go over batches
    made, seen = [], []
    for packed, kind in ((False, "code short, n long"), (True, "visits binary")):
        count = C._count_neighbours([b"", b"the", b"of", b"a"], np.array([1, 0, 1, 2]), 3, packed)
        visits = docs.select("text").mapInArrow(count, f"word binary, {kind}")
        seen.append(visits.count())
        rows = visits.repartition("word").sortWithinPartitions("word").mapInArrow(C._gather(7, packed), "word binary, n long, codes array<short>, counts array<long>").collect()
        made.append(sorted((bytes(r["word"]), r["n"], tuple(r["codes"]), tuple(r["counts"])) for r in rows))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert made[0] == made[1] and len(made[0]) > 100 and len(dict((w, n) for w, n, *_ in made[1])) == len(made[1])
    assert seen[1] < seen[0]


def test_best_class_is_the_likeliest():
    rng = np.random.default_rng(5)
    m = rng.poisson(9, (6, 6)).astype(float)
    lead, follow = rng.poisson(2, (50, 6)), rng.poisson(2, (50, 6))
    n = lead.sum(axis=1) + 1
    for row, got in enumerate(C.best_classes(lead, follow, n, m)):
        value = []
        for b in range(6):
            size = m[b].sum() + 3
            value.append(sum(lead[row, c] * math.log(m[c, b] + 0.5) + follow[row, c] * math.log((m[b, c] + 0.5) / size) for c in range(6)) - n[row] * math.log(size))
        assert value[got] == pytest.approx(max(value))


def test_exchange_finds_the_classes():
    rng = np.random.default_rng(0)
    kind = np.arange(30) % 3  # units of kind k are followed by those of kind k + 1
    m = rng.poisson(20, (30, 30)) * (kind[:, None] == (kind[None, :] - 1) % 3) + rng.poisson(0.3, (30, 30))
    member = C.exchange(m[np.ix_(order := rng.permutation(30), order)].astype(float), 3, 20)
    assert len({(kind[o], c) for o, c in zip(order, member)}) == 3


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(1)
    m = rng.poisson(2, (40, 40)).astype(float)

    def value(member):
        one = np.eye(6)[member]
        x = one.T @ m @ one
        return C._xlogx(x).sum() - C._xlogx(x.sum(axis=0)).sum() - C._xlogx(x.sum(axis=1)).sum()

    values = [value(C.exchange(m, 6, r)) for r in range(6)]
    assert all(b >= a - 1e-9 for a, b in zip(values, values[1:]))


def test_bigrams_beat_unigrams(spark):
    import random

    rng = random.Random(2)
    rows = [(i, " ".join(w for _ in range(30) for w in (rng.choice("abcdef"), rng.choice("uvwxyz")))) for i in range(120)]
    got = C.class_scores(spark.createDataFrame(rows, "doc_id long, text string"), is_held()).where("held_out").collect()
    assert got and all(r["score"] > r["base_score"] + 10 for r in got)


def test_empty(no_docs, spark):
    assert C.class_scores(no_docs, is_held()).count() == 0
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = C.class_scores(rows, F.lit(True)).collect()  # nothing to learn from
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert all(r["score"] == pytest.approx(r["n_tokens"] * math.log10(0.5)) for r in got)


def test_no_files_are_written_on_the_way(spark, docs, monkeypatch):
    from nearfold import scratch

    paths, made = [], scratch.scratch_path
    monkeypatch.setattr(scratch, "scratch_path", lambda *a: paths.append(made(*a)) or paths[-1])
    spark.sparkContext._jvm.System.gc()
    before = set(spark.sparkContext._jsc.getPersistentRDDs())
    result = C.class_scores(docs, is_held())
    kept = set(spark.sparkContext._jsc.getPersistentRDDs()) - before
    assert result.count() == docs.count()
    assert not paths and len(kept) == 2  # the tables that the result is read from; those of training are gone


@pytest.mark.parametrize("count", [lambda: C._count_words, lambda: C._count_anchors([b"", b"the"]), lambda: C._count_neighbours([b"", b"the"], np.array([0, 1]), 2)])
def test_a_batch_is_not_held_as_bytes_at_once(texts, monkeypatch, count):
    sizes, convert = [], C.as_bytes
    monkeypatch.setattr(C, "CHUNK", 2000)
    monkeypatch.setattr(C, "as_bytes", lambda column: sizes.append([len(t) for t in convert(column)]) or convert(column))
    batch = C.pa.RecordBatch.from_pydict({"text": C.pa.array([t for _, t in texts] * 3, C.pa.string())})
    assert sum(b.num_rows for b in count()(iter([batch])))
    assert sum(map(len, sizes)) == batch.num_rows and len(sizes) > 10
    assert all(sum(s[:-1]) <= 2000 for s in sizes)
