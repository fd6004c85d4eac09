import random
from collections import defaultdict

import duckdb
import pytest

from nearfold.llm.chat_format import OP4_SQL, op4_perspective_rotation, rotate
from nearfold.llm.common import table

ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, None, "é!"), (1, 2, "bob", None), (1, 2, "al", "tie"),
    (2, 0, "system", "alone"), (3, 1030, "ann", "late"), (3, 5, "bob", "early"), (4, None, "ann", "loose"), (4, 1, "ann", "first"), (4, None, "bob", "loose too"),
    (5, 0, "ann", "a"), (5, 1023, "bob", "b"), (5, 2046, "ann", "c"), (5, -3069, "bob", "d" * 5000),
    (None, 0, "ann", "no id"), (None, 0, "bob", "none either"), (None, None, None, None),
]
SCHEMA = "conv_id long, turn long, role string, text string, part string, range string, turns string, perspective string, start long, n long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "w", "v", "x", "y", 1, 2) for r in rows], SCHEMA)


def brute(rows):
    """The whole rendering and its masks for each participant of each conversation."""
    talks = defaultdict(set)
    for c, t, r, x in rows:
        talks[c].add((t is not None, t or 0, r or "unknown", x or ""))
    out = {}
    for c, turns in talks.items():
        for p in {r for _, _, r, _ in turns} - {"system"}:
            text, masks = "", []
            for _, _, r, x in sorted(turns):
                text += "<|im_start|>" + ("system" if r == "system" else "assistant" if r == p else f"user name={r}") + "\n"
                start = len(text)
                text += x + "<|im_end|>"
                if r == p:
                    masks.append((start, len(text)))
                text += "\n"
            out[c, p] = text, masks, len(turns)
    return out


def joined(rows):
    """Parts of each perspective put together."""
    out = {}
    for r in sorted(rows, key=lambda r: r["part"]):
        text, masks, n = out.get((r["conv_id"], r["perspective"]), ("", [], 0))
        out[r["conv_id"], r["perspective"]] = text + r["rendered"], masks + [tuple(m) for m in r["masks"]], n + r["n_turns"]
    return out


@pytest.mark.parametrize("part_turns", [16_384, 4, 3, 1])
def test_rotation_equals_brute_force(spark, part_turns):
    got = rotate(frame(spark, ROWS), part_turns=part_turns).collect()
    assert joined(got) == brute(ROWS)
    assert all(r["n_turns"] <= part_turns for r in got)
    if part_turns > 8:
        assert len(got) == len(brute(ROWS))


@pytest.mark.parametrize("part_turns", [16_384, 700])
def test_one_conversation_may_hold_most_rows(spark, part_turns):
    rng = random.Random(8)
    rows = [(1, rng.choice([None, rng.randrange(10**6)]), rng.choice("abc"), f"text {i}") for i in range(3000)] + [(i % 50 + 2, i, "ab"[i % 2], "x") for i in range(300)]
    got = rotate(frame(spark, rows).repartition(7), part_turns=part_turns).collect()
    assert joined(got) == brute(rows)
    assert max(r["part"] for r in got) == 3000 // part_turns


def test_no_rows_and_system_only(spark):
    assert rotate(frame(spark, [])).count() == 0
    assert rotate(frame(spark, [(2, 0, "system", "alone")])).count() == 0


def test_native_plan(spark):
    plan = rotate(frame(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_sql_has_nulls_and_scattered_turns(spark, tmp_path):
    path = str(tmp_path / "conversations.parquet")
    frame(spark, ROWS).coalesce(1).write.parquet(path)
    got = op4_perspective_rotation(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = con.execute(OP4_SQL)
    names = [c[0] for c in want.description]
    assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, [spark_row(names, r) for r in want.fetchall()]))
    assert table(spark, str(tmp_path), "conversations").count() == len(ROWS)


def spark_row(names, values):
    from pyspark.sql import Row

    return Row(**dict(zip(names, values)))
