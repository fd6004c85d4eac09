import random
import re
import zlib

from nearfold.llm import substring_dedup as U
from tests.llm.conftest import prose


def plain_units(text):
    """units by its definition, a line and a word at a time: (words, start, end, whether it begins and ends a line)."""
    out, at = [], 0
    for line in text.split("\n"):
        spans = [(m.start() + at, m.end() + at) for m in re.finditer(r"\S+", line)]
        words = [text[a:b].lower() for a, b in spans]
        h = [zlib.crc32(w.encode()) for w in words]
        first = 0
        for i in range(len(words)):
            left, right = h[max(0, i - 4) : i], h[i + 1 : i + 5]
            inner = 4 <= i < len(words) - 5 and all(h[i] < x for x in left) and all(h[i] <= x for x in right)
            if inner or i == len(words) - 1:
                if i + 1 - first >= 5:
                    out.append((words[first : i + 1], spans[first][0], spans[i][1], first == 0, i == len(words) - 1))
                first = i + 1
        at += len(line) + 1
    return out


def test_units_equal_their_definition(texts):
    rng = random.Random(6)
    more = [" ".join(rng.choice(["a", "b", "c", "d\n", "e", "Ünit", "\n", "İx"]) for _ in range(rng.randrange(90))) for _ in range(200)]
    for text in [t or "" for _, t in texts] + more:
        got = U.units(text)
        assert [(w.split(" "), a, b, bool(p & 1), bool(p & 2)) for w, a, b, _, p in got] == plain_units(text)
        assert all(n == len(w.split(" ")) >= U.MIN_UNIT_WORDS for w, _, _, n, _ in got)


def brute(texts):
    """Runs of all documents in order, by plain loops."""
    order = sorted({(i is None, i or 0, t or "") for i, t in texts})
    seen, out = set(), {}
    for d in order:
        runs, before = [], False
        for w, a, b, begins, ends in plain_units(d[2]):
            again = tuple(w) in seen
            seen.add(tuple(w))
            if again and before:
                runs[-1].append((a, b, len(w), begins, ends))
            elif again:
                runs.append([(a, b, len(w), begins, ends)])
            before = again
        out[d] = []
        for run in runs:
            if sum(x[2] for x in run) < U.MIN_PASSAGE_WORDS:
                while run and not run[0][3]:
                    run = run[1:]
                while run and not run[-1][4]:
                    run = run[:-1]
            if run:
                out[d].append((run[0][0], run[-1][1], sum(x[2] for x in run)))
    return out


def test_runs_equal_brute_force(docs, texts):
    rows, texts = docs.where("doc_id <> 8"), [(i, t) for i, t in texts if i not in (None, 8)]
    got = sorted((r["doc_id"], r["start"], r["end"], r["words"]) for r in U.repeated_runs(rows).select(U.id_of("rank").alias("doc_id"), "start", "end", "words").collect())
    want = sorted((d[1], *x) for d, runs in brute(texts).items() for x in runs)
    assert got == want and len({x[0] for x in want}) >= 8


def test_texts_without_runs(docs, no_docs, spark):
    runs = U.repeated_runs(docs)
    out = U.without_runs(docs, runs)
    assert out.columns == docs.columns and out.count() == docs.count()
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    assert not left[103].strip() and left[1] == prose(1)
    assert U.repeated_runs(no_docs).count() == 0
    a, b = prose(70, 1, 60), prose(71, 2, 20)
    rows = spark.createDataFrame([(1, a), (2, f"{b}\n{a}\n{b.upper()}")], "doc_id long, text string")
    found = U.repeated_runs(rows).select(U.id_of("rank").alias("doc_id"), "start", "end", U.id_of("first").alias("keep")).collect()
    assert [(r["doc_id"], r["start"], r["end"], r["keep"]) for r in found] == [(2, len(b) + 1, 2 * len(b) + len(a) + 2, 1)]
    assert {r["text"] for r in U.without_runs(rows, U.repeated_runs(rows)).collect()} == {a, b + "\n"}


def test_passages_inside_sentences_are_found(spark):
    """51 words that begin and end within longer lines, by documents of their own words."""
    rng = random.Random(12)
    own = lambda: " ".join(f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(20, 40)))
    passages = [" ".join(f"p{i}x{rng.randrange(10**9)}" for _ in range(51)) for i in range(60)]
    rows = [(2 * i + k, f"{own()} {p} {own()}") for i, p in enumerate(passages) for k in (0, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r[0]: rows[r[0]][1][r[1] : r[2]] for r in U.repeated_runs(table).select(U.id_of("rank"), "start", "end").collect()}
    assert all(text in passages[i // 2] and i % 2 for i, text in found.items())
    assert len(found) >= 58 and sum(len(t.split()) for t in found.values()) > 30 * len(found)


def test_negative_and_missing_ids(spark):
    t = prose(80, 3, 20)
    rows = spark.createDataFrame([(-5, t), (2**62, t), (None, t)], "doc_id long, text string")
    got = {r[0]: r[1] for r in U.repeated_runs(rows).select(U.id_of("rank"), U.id_of("first")).collect()}
    assert got == {2**62: -5, None: -5}


def test_short_lines_are_runs_and_short_parts_are_not(spark):
    line, part = "All rights of this page reserved", "in the course of the year"
    rows = [(i, f"{prose(90 + i, 2, 20)}\n{line}\nword{i} of{i} its{i} own{i} line{i} {part} and{i} more{i} of{i} these{i} own{i}") for i in range(4)]
    runs = U.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r[0], r[1], r[2]) for r in runs.select(U.id_of("rank"), "words", U.id_of("first")).collect()) == [(i, 6, 0) for i in (1, 2, 3)]


def test_many_share_a_line_of_twenty_words(spark):
    line = " ".join(f"word{i}" for i in range(20))
    rows = spark.createDataFrame([(i, f"{prose(300 + i, 2, 20)}\n{line}") for i in range(50)], "doc_id long, text string")
    runs = U.repeated_runs(rows)
    assert sorted(r[0] for r in runs.select(U.id_of("rank")).collect()) == list(range(1, 50))
    assert sum(line in r["text"] for r in U.without_runs(rows, runs).collect()) == 1
