import math
import re
from collections import Counter

import numpy as np
import pytest

from nearfold.llm import quality as Q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(8)}
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside)


def test_counts_equal_brute_force(docs, texts):
    got = Q.quality(docs).collect()
    want = sorted((str(i), *brute(t or "")) for i, t in texts)
    assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


@pytest.mark.parametrize("text", ["a b c d e f g h a b c d e f g h", "x " * 30, "a b c d e f g", "p q r s t u v w x y p q r s t u v w"])
def test_repeated_windows(text):
    index = {}
    ids = np.array([index.setdefault(w, len(index)) for w in text.split()])
    assert Q.repeated(ids) == brute(text)[4]


def test_js_distance():
    assert Q.js_distance(np.array([1.0, 0]), np.array([0, 5.0])) == pytest.approx(1)
    assert Q.js_distance(np.array([2.0, 4]), np.array([1.0, 2])) == 0
    p, q = np.array([0.5, 0.5]), np.array([0.9, 0.1])
    m = (p + q) / 2
    want = math.sqrt(sum((a * math.log2(a / c) + b * math.log2(b / c)) / 2 for a, b, c in zip(p, q, m)))
    assert Q.js_distance(p, q) == pytest.approx(want)


def test_junk_goes_and_prose_stays(spark):
    import random

    from tests.llm.conftest import WORDS

    rng = random.Random(1)
    clean = [(i, " ".join(rng.choice(WORDS) for _ in range(200)) + ".", "en") for i in range(60)]
    junk = [(100, " ".join(w + "###" for w in clean[0][1].split()), "en"), (101, clean[1][1].upper().replace(" ", "!! "), "en"), (102, " | ".join(f"Xq{i}zz" for i in range(90)), "en")]
    got = {r["doc_id"]: r["kept"] for r in Q.quality(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] for i in range(60)) and not any(got[i] for i in (100, 101, 102))


def test_keep_good_keeps_rows_unchanged(docs, no_docs):
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns
    want = {str(r["doc_id"]) for r in Q.quality(docs).where("kept").collect()}
    assert {str(r["doc_id"]) for r in kept.collect()} == want
    assert Q.keep_good(no_docs).count() == 0 and Q.quality(no_docs).count() == 0


def brute_class(c):
    if c == "\n":
        return "line"
    if c in " \t\x0b\x0c\r":
        return "blank"
    if ord(c) < 32 or ord(c) == 127:
        return "control"
    if ord(c) >= 128:
        return "two-byte" if ord(c) < 0x800 else "longer"
    for name, chars in (("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("stop", ".,;:'\"-()?"), ("symbol", "#*$%&|<>@^_=+~{}[]\\/`!")):
        if c in chars:
            return name
    return "other punctuation"


def brute_common(text):
    """Common words of a text, and all words, by plain loops."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    plain = (re.sub(r"[A-Z]", lambda m: m[0].lower(), w).strip(".,;:!?\"'()") for w in words if len(w.encode()) <= 8)
    return Counter(p for p in plain if p and len(p.encode()) <= 6), len(words)


def brute_distance(p, q, keys):
    a, b = sum(p.get(k, 0) for k in keys), sum(q.get(k, 0) for k in keys)
    if not a or not b:
        return 0.0
    out = 0.0
    for k in keys:
        x, y = p.get(k, 0) / a, q.get(k, 0) / b
        for z in (x, y):
            out += z * math.log2(2 * z / (x + y)) if z else 0.0
    return math.sqrt(max(0.0, out / 2))


def brute_verdicts(rows):
    """Distances and kept of (id, text, lang), references included."""
    languages = {}
    for _, text, lang in rows:
        classes, common, total = languages.setdefault(lang, (Counter(), Counter(), [0]))
        words, n = brute_common(text or "")
        classes.update(map(brute_class, text or ""))
        common.update(words)
        total[0] += n
    top = {lang: dict(sorted(common.items(), key=lambda x: (-x[1], x[0].encode()))[:64]) for lang, (_, common, _) in languages.items()}
    refs = {lang: (classes, top[lang], total[0]) for lang, (classes, _, total) in languages.items()}
    whole = sum((r[0] for r in refs.values()), Counter()), sum((Counter(r[1]) for r in refs.values()), Counter()), sum(r[2] for r in refs.values())
    out = []
    for i, text, lang in rows:
        text = text or ""
        ref = refs[lang] if refs[lang][2] >= 2000 else whole
        n, chars, _, _, repeated = brute(text)
        mine, theirs = Counter(), dict(ref[1])
        for w, k in brute_common(text)[0].items():
            if w in theirs:
                mine[w] = k
        mine[None], theirs[None] = n - sum(mine.values()), max(0, ref[2] - sum(theirs.values()))
        c = brute_distance(Counter(map(brute_class, text)), ref[0], set(ref[0]) | set(map(brute_class, text)))
        w = brute_distance(mine, theirs, theirs)
        bad = n < 20 or 100 * repeated > 30 * n or (chars >= 100 and c > 0.15 + 2.6 / math.sqrt(chars)) or (n >= 50 and w > 0.17 + 2.2 / math.sqrt(n))
        out.append((str(i), round(c, 6), round(w, 6), not bad))
    return sorted(out)


@pytest.mark.parametrize("flush", [300_000, 5])
def test_verdicts_equal_brute_force(spark, docs, monkeypatch, flush):
    import random

    monkeypatch.setattr(Q, "FLUSH", flush)
    rng = random.Random(2)
    own = {"en": "the of and to in river, stone".split(), "de": "der die und zu Straße von \"Fluß\"".split(), None: "el la y de RÍO que".split(), "": "le les et à la (mer)".split()}
    rows = [(1000 + i, " ".join(rng.choice(own[lang]) for _ in range(rng.choice([5, 60, 300]))) + rng.choice(["", ".\n\x01ok 日本 ~ 12"]), lang) for i in range(120) for lang in own]
    rows += [(2000 + i, " ".join(rng.choice(own[b]) for _ in range(200)), a) for i, (a, b) in enumerate((a, b) for a in own for b in own)]
    rows += [(r["doc_id"], r["text"], r["lang"]) for r in docs.select("doc_id", "text", "lang").collect()]
    got = Q.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = brute_verdicts(rows)
    assert sorted((str(r["doc_id"]), round(r["char_distance"], 6), round(r["word_distance"], 6), r["kept"]) for r in got) == want
    kept = {r["doc_id"]: r["kept"] for r in got}
    # Null and the empty string are languages apart: a text of one goes under the other.
    assert [kept[2000 + i] for i, (a, b) in enumerate((a, b) for a in own for b in own) if not a and not b] == [True, False, False, True]
