import math
import re

import numpy as np
import pytest
import xxhash

from nearfold.llm import simhash as S
from nearfold.llm.components import components


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    group = {p: p for p in prints}

    def find(p):
        while group[p] != p:
            p = group[p]
        return p

    distinct = sorted(set(prints))
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                group[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in distinct}


def test_codes_cover_their_blocks():
    for _, size, radius in S.BLOCKS:
        by = S.patterns(size, radius + 1)
        assert max(min(int(e).bit_count() for e in p) for p in by) == radius
        assert sum(map(len, by)) == sum(math.comb(size, k) for k in range(radius + 2))
    assert len(S.patterns(23, 4)) == 2048 and len(S.patterns(18, 2)) == 16
    assert sum(size for _, size, _ in S.BLOCKS) == 64 and len(S.BLOCKS) * (S.IN_BLOCK + 1) > S.THRESHOLD


@pytest.mark.parametrize("first, size, radius", S.BLOCKS)
def test_anchors_are_all_code_words_in_reach(first, size, radius):
    rng = np.random.default_rng(size)
    single = S.checks(size)
    block = rng.integers(0, 1 << size, 40)
    rows, anchor = S.anchors(block, size, radius)
    got = {(int(r), int(a)) for r, a in zip(rows, anchor)}
    assert len(got) == len(rows)

    def syndrome(x):
        out = 0
        for i in range(size):
            out ^= single[i] if x >> i & 1 else 0
        return out

    assert all(syndrome(a) == 0 and (a ^ int(block[r])).bit_count() <= radius + 1 for r, a in got)
    for r, x in enumerate(block.tolist()):  # one bit apart: they meet
        for i in range(size):
            _, other = S.anchors(np.array([x ^ 1 << i]), size, radius)
            assert {a for k, a in got if k == r} & set(other.tolist())


@pytest.mark.parametrize("refine", [False, True])
def test_links_equal_brute_force(spark, refine):
    rng = np.random.default_rng(3)
    prints = [int(x) for x in rng.integers(0, 2**63, 300)]
    for p in prints[:60]:
        for k in range(1, 7):
            for _ in range(k):
                p ^= 1 << int(rng.integers(0, 64))
            prints.append(p)
    chain = 0
    for i in range(15):
        prints.append(chain)
        chain ^= 0b1111 << (4 * i)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in set(signed)], "fp long")
    got = {r["u"]: r["v"] for r in components(S.links(frame, refine)).collect()}
    want = brute_components(prints)
    pairs = {}
    for p, s in zip(prints, signed):
        pairs.setdefault(want[p], set()).add(got.get(s, s))
    assert all(len(x) == 1 for x in pairs.values())
    assert len({next(iter(x)) for x in pairs.values()}) == len(pairs)


def test_dense_groups_are_stars():
    fps = np.unique(np.array([b for b in range(1 << 11)], np.int64) * 3)
    u, v = S.stars(fps)
    assert len(u) == len(fps) - 1 and len(set(v.tolist())) == 1


def test_documents_equal_brute_force(docs, texts):
    got = S.near_dedup(docs).collect()
    prints = [brute_print(t) for _, t in texts]
    assert sorted((str(r["doc_id"]), r["fp"] & (1 << 64) - 1) for r in got) == sorted((str(i), p) for (i, _), p in zip(texts, prints))
    group, least = brute_components(prints), {}
    for (i, _), p in zip(texts, prints):
        if i is not None:
            least[group[p]] = min(i, least.get(group[p], i))
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == sorted((str(i), str(least.get(group[p]))) for (i, _), p in zip(texts, prints))


def test_one_of_each_group_stays(docs, texts, no_docs):
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    prints = [brute_print(t) for _, t in texts]
    assert kept.count() == len(set(brute_components(prints).values()))
    assert S.keep_one(no_docs).count() == 0 and S.near_dedup(no_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(7, 7), (9, 8)]
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(101, 141)}, **{i: 500 for i in range(501, 560)}, 9: 8}
