import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfold.llm.common import scratch_path
from nearfold.llm.exact_dedup import BinaryFuse, Snapshot, exact_dedup, screen_batch


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 60_000])
def test_filters_have_no_false_negatives_and_few_false_positives(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**64, n, dtype=np.uint64)
    f = BinaryFuse.load(BinaryFuse.build(np.concatenate([keys, keys[:5]])).dump())
    assert f.contains(keys).all()
    assert f.contains(rng.integers(0, 2**64, 20_000, dtype=np.uint64)).mean() < 0.01
    if n > 10_000:
        assert len(f.slots) < 1.3 * n


def brute(texts):
    bare = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in texts]
    groups = {}
    for (i, t), b in zip(texts, bare):
        groups.setdefault(b, []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    stayed = set()
    for (i, t), b in zip(texts, bare):
        best = min(groups[b], key=lambda x: x[:3])
        kept = best == (-len(t or ""), i is None, i or 0, i) and b not in stayed
        if kept:
            stayed.add(b)
        out.append((str(i), str(best[3]), len(groups[b]), kept, hashlib.sha256(b.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("history", ["doc_id % 2 = 0", "true", "false", "doc_id > 105"])
def test_groups_equal_brute_force(docs, texts, history):
    got = exact_dedup(docs, F.expr(history)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted((str(r[0]), str(r[1]), *r[2:]) for r in got) == brute(texts)


def test_empty(no_docs):
    assert exact_dedup(no_docs, F.expr("doc_id % 2 = 0")).count() == 0


def test_longest_then_smallest_id_stays(spark):
    rows = [(5, "ab"), (3, "a b"), (9, "a  b"), (2, "a\tb "), (4, " "), (1, None)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), F.expr("doc_id > 3")).collect()
    assert {r["doc_id"]: r["keep_id"] for r in got} == {5: 2, 3: 2, 9: 2, 2: 2, 4: 4, 1: 4}


@pytest.mark.parametrize("history", ["true", "false", "length(text) > 4", "doc_id = 6"])
def test_one_row_stays_where_an_id_repeats(spark, history):
    least = -(2**63)
    rows = [(5, "a b c"), (5, "abc"), (6, "abc"), (least, "x y"), (least, "x\ty"), (least, "x y"), (7, "xy"), (None, "q q"), (None, "qq"), (None, "q q"), (8, "alone")]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), F.expr(history)).collect()
    assert sorted((str(r[0]), str(r[1]), *r[2:]) for r in got) == brute(rows)
    assert sum(r["kept"] for r in got) == 4


def test_a_snapshot_serves_later_batches(spark, docs, texts, no_docs):
    path = scratch_path(spark, "test-snapshot")
    Snapshot.write(docs.where("doc_id % 2 = 0"), path)
    held = {re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in texts if i is not None and i % 2 == 0}
    for batch in ([(1, "new text"), (2, " newtext"), (3, None)], [(i, t) for i, t in texts if i is None or i % 2], [(9, t) for t in sorted(held)]):
        snapshot = Snapshot(spark, path)  # read again, as by a later job
        got = screen_batch(spark.createDataFrame(batch, "doc_id long, text string"), snapshot).collect()
        bare = {hashlib.sha256(b.encode()).hexdigest(): b for b in (re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in batch)}
        assert [r["in_snapshot"] for r in got] == [bare[r["text_sha256"]] in held for r in got]
        want = [(str(i), str(k), n, kept and bare[h] not in held, h) for i, k, n, kept, h in brute(batch)]
        assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in got) == sorted(want)
    with pytest.raises(Exception, match="(?i)exist"):
        Snapshot.write(no_docs, path)
    empty = Snapshot.write(no_docs, scratch_path(spark, "test-snapshot"))
    assert screen_batch(docs, empty).where("in_snapshot").count() == 0 and screen_batch(no_docs, empty).count() == 0
