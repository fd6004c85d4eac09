import math
import re
from collections import Counter, defaultdict

import pytest

from nearfold.llm.mixing import mix, mixed, source_targets


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets(sizes):
    """By reshare of the excess, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, out = 1.5 * sum(sizes.values()), {}
    open_ = set(names)
    while open_:
        left, w = total - sum(out.values()), sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / w > 2 * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / w for s in open_}
        out |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 3, "é": 50, "B": 7}, {"a": 5}, {"a": 0, "b": 9}, {f"s{i}": i * i for i in range(30)}])
def test_targets_equal_repeated_reshare(spark, sizes):
    got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = targets(sizes)
    assert {r["source"]: round(r["target"], 6) for r in got} == {s: round(t, 6) for s, t in want.items()}


def test_budgets_are_met_exactly(docs, texts):
    got = mix(docs).collect()
    assert len(got) == len(texts)
    by = defaultdict(list)
    for r in got:
        by[r["source_size"], r["target"]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    for (s, t), rows in by.items():
        assert sum(r["size"] for r in rows) == s
        assert sum(r["taken"] for r in rows) == math.floor(t)
    assert sorted(map(str, got)) == sorted(map(str, mix(docs.repartition(5)).collect()))


def test_mixed_rows_hold_the_words_taken(docs, no_docs):
    plan, out = mix(docs).collect(), mixed(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    taken, got = Counter(), Counter()
    for r in plan:
        taken[r["doc_id"]] += r["taken"]
    for r in rows:
        assert r["n_chars"] == len(r["text"]) and r["rank"] == "r" and r["size"] == -1
        got[r["doc_id"]] += size(r["text"])
    assert +taken == +got
    assert mix(no_docs).count() == 0 and mixed(no_docs).count() == 0
