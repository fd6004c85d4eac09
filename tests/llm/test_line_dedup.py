import random

from nearfold.llm import line_dedup as L


def test_patience_aligns_in_order():
    rng = random.Random(5)
    for _ in range(200):
        a = [rng.randrange(12) for _ in range(rng.randrange(15))]
        b = [rng.randrange(12) for _ in range(rng.randrange(15))]
        pairs = L.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p < r and q < s for (p, q), (r, s) in zip(pairs, pairs[1:]))
    assert L.patience([1, 2, 3, 9, 4], [7, 1, 2, 3, 4]) == [(0, 1), (1, 2), (2, 3), (4, 4)]
    assert L.patience([], [1]) == []


def test_blocks_need_words():
    assert L.common_blocks([1, 2, 3], [1, 9, 3], [2, 5, 6]) == [2]
    assert L.common_blocks([1, 2], [1, 2], [2, 3]) == [0, 1]


def plain_patience(a, b):
    """Patience diff as a recursion over lists of (place, line)."""
    if not a or not b:
        return []
    if a[0][1] == b[0][1]:
        return [(a[0][0], b[0][0]), *plain_patience(a[1:], b[1:])]
    if a[-1][1] == b[-1][1]:
        return [*plain_patience(a[:-1], b[:-1]), (a[-1][0], b[-1][0])]
    la, lb = [x for _, x in a], [x for _, x in b]
    pairs = [(i, lb.index(x)) for i, x in enumerate(la) if la.count(x) == 1 == lb.count(x)]
    if not pairs:
        numbered = [[(x, side[:i].count(x)) for i, x in enumerate(side)] for side in (la, lb)]
        pairs = [(i, numbered[1].index(x)) for i, x in enumerate(numbered[0]) if x in numbered[1]]
    if not pairs:
        return []
    best = [1] * len(pairs)
    back = [-1] * len(pairs)
    for k in range(len(pairs)):
        for h in range(k):
            if pairs[h][1] < pairs[k][1] and best[h] + 1 > best[k]:
                best[k], back[k] = best[h] + 1, h
    k, chain = max(range(len(pairs)), key=lambda k: best[k]), []
    while k >= 0:
        chain.insert(0, pairs[k])
        k = back[k]
    out, before = [], (-1, -1)
    for p in [*chain, (len(a), len(b))]:
        out += plain_patience(a[before[0] + 1 : p[0]], b[before[1] + 1 : p[1]])
        if p[0] < len(a):
            out.append((a[p[0]][0], b[p[1]][0]))
        before = p
    return out


def plain_blocks(later, earlier):
    """Lines of the later document in aligned blocks of 5 words or more."""
    pairs = plain_patience(list(enumerate(later)), list(enumerate(earlier)))
    out = set()
    for k, (i, j) in enumerate(pairs):
        block, n = [i], k
        while n + 1 < len(pairs) and pairs[n + 1] == (pairs[n][0] + 1, pairs[n][1] + 1):
            n += 1
            block.append(pairs[n][0])
        n = k
        while n and pairs[n - 1] == (pairs[n][0] - 1, pairs[n][1] - 1):
            n -= 1
            block.append(pairs[n][0])
        if sum(len(later[x].split()) for x in block) >= 5:
            out.add(i)
    return sorted(out)


def brute(texts):
    """Removed lines by a loop over documents in order, each aligned with the earliest holders of its lines and of its blocks of short lines."""
    order = sorted({(i is None, i or 0, t or "") for i, t in texts})
    lines = {d: [x.strip(" \t\n\x0b\x0c\r") for x in d[2].split("\n")] for d in order}
    first, keys = {}, {}
    for d in order:
        keys[d] = set()
        for i, x in enumerate(lines[d]):
            if x:
                for end in range(i + 1, len(lines[d]) + 1):
                    if len(" ".join(lines[d][i:end]).split()) >= 5:
                        keys[d].add(tuple(lines[d][i:end]))
                        break
        for key in keys[d]:
            first.setdefault(key, d)
    return {d: sorted({k for p in {first[key] for key in keys[d]} - {d} for k in plain_blocks(lines[d], lines[p])}) for d in order}


def test_repeated_lines_align():
    assert L.patience([9, 1, 1, 2, 2, 8], [7, 1, 1, 2, 2, 6]) == [(1, 1), (2, 2), (3, 3), (4, 4)]
    rng = random.Random(7)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(14))] for _ in range(2))
        assert bool(L.patience(a, b)) == bool(set(a) & set(b)) == bool(plain_patience(list(enumerate(a)), list(enumerate(b))))


def test_twice_repeated_lines_go(spark):
    shared = "\n".join(f"a line that is there twice, number {i}\na line that is there twice, number {i}" for i in range(16))
    rows = spark.createDataFrame([("b", f"first words of its own\n{shared}\nlast words of its own"), ("a", f"other words begin this one\n{shared}\nand end it here too")], "doc_id string, text string")
    lines = L.hashed_lines(rows)
    assert {r["doc_id"]: r["removed"] for r in lines.join(L.removed_lines(lines), "rank").collect()} == {"b": list(range(1, 33))}


def test_removed_lines_equal_brute_force(docs, texts):
    texts = [(i, t) for i, t in texts if i not in (7, 8)] + [(7, next(t for i, t in texts if i == 7))]  # one id with two texts is ordered by hash
    rows = docs.where("doc_id is null or doc_id <> 8").dropDuplicates(["doc_id", "text"])
    lines = L.hashed_lines(rows)
    got = {r["doc_id"]: r["removed"] for r in lines.join(L.removed_lines(lines), "rank").select("doc_id", "removed").collect() if r["doc_id"] is not None}
    want = {d[1]: x for d, x in brute(texts).items() if x and not d[0]}
    assert got == want and len(want) >= 9


def test_first_occurrence_stays(docs, no_docs):
    out = L.without_blocks(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    before = {x.strip() for r in docs.collect() for x in (r["text"] or "").split("\n")}
    after = {x.strip() for r in rows for x in (r["text"] or "").split("\n")}
    assert before == after
    assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"])
    assert L.without_blocks(no_docs).count() == 0


def test_a_common_line_pairs_each_document_once(spark):
    rows = [(i, f"the very same line of words\nown line number {i} with words") for i in range(300)]
    lines = L.hashed_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert L.candidate_pairs(lines).count() == 299
    assert L.removed_lines(lines).count() == 299


def test_common_lines_pair_beside_rarer_ones(spark):
    common = "a line of words that all of them have"
    rows = [(i, f"{common}\nown line number {i} with words") for i in range(200)]
    rows += [(1000, "a rarer line that only two documents have"), (1001, f"a rarer line that only two documents have\n{common}\nand a new line of words here")]
    lines = L.hashed_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["removed"] for r in lines.join(L.removed_lines(lines), "rank").collect()}
    assert got == {1001: [0, 1], **{i: [0] for i in range(1, 200)}}


def test_blocks_of_short_lines_pair(spark):
    rows = [(1, "Salt\nOil\nTwo eggs\n\nSome flour\nA cup of milk"), (2, "Other words stand here first\nSalt\nOil\nTwo eggs\n\nSome flour\nSugar"), (3, "Salt\nOil")]
    lines = L.hashed_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["removed"] for r in lines.join(L.removed_lines(lines), "rank").collect()} == {2: [1, 2, 3, 4, 5]}
