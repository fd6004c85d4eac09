"""Multi-party perspective rotation of conversations, with DataFrame functions only.

For every participant of a conversation, the dialogue is rendered with that
speaker as the assistant and all others as users of their names; system turns
stay system turns. Masks are the spans of the assistant's contents and their end
marks, in code points of the whole rendering.

A conversation is one row for each participant, whatever its turn numbers are.
Only one of more than PART_TURNS turns, which no row could be sure to hold, is
handed out in parts of as many turns: the parts of a perspective, joined in
their order, are the whole rendering, and offsets go on from part to part. Turns
are ranked by a range sort and prefix sums over its ranges, so that no task gets
more of a conversation than a range or a part, of whatever length it is.

Turns are ordered by number (those without one first), then speaker, then text.
Exactly repeated rows are one turn. A null text is empty; a null speaker is a
participant named "unknown". Rows without a conv_id are one conversation. A
conversation of system turns only has no participant, hence no row. Empty table:
no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfold.llm.common import table, written

PART_TURNS = 16_384
SYSTEM = "system"
UNKNOWN = "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURN = ("turn", "speaker", "text")


def _head(speaker, own):
    return F.when(speaker == SYSTEM, F.lit(f"{OPEN}system\n")).when(own, F.lit(f"{OPEN}assistant\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), speaker, F.lit("\n")))


def _same(a: str, b: str, *columns: str):
    """Equality of these columns of two aliases; null equals null."""
    on = F.lit(True)
    for c in columns:
        on &= F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return on


def in_parts(turns: DataFrame, part_turns: int) -> DataFrame:
    """conv_id, turn, speaker, text and the number of the part that each distinct turn is in."""
    # The start of a text orders as the text does, and bounds what the choice of ranges brings to the driver.
    by = F.col("conv_id"), F.col("turn"), F.col("speaker"), F.substring("text", 1, 32)
    ranged = written(turns.distinct().repartitionByRange(*by).withColumn("range", F.spark_partition_id()), "turns")
    counts = ranged.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # A conversation goes on at the start of a range only, so there are at most as many rows as ranges.
    going_on = counts.withColumn("before", F.sum("n").over(earlier)).where("before > 0").select("conv_id", "range", "before")
    within = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*TURN)) - 1
    placed = ranged.withColumn("within", within).alias("r").join(F.broadcast(going_on).alias("g"), _same("r", "g", "conv_id", "range"), "left")
    place = F.col("within") + F.coalesce("before", F.lit(0))
    return placed.select("r.conv_id", *(f"r.{c}" for c in TURN), F.floor(place / part_turns).alias("part"))


def part_starts(rows: DataFrame, people: DataFrame) -> DataFrame:
    """conv_id, perspective, part, start: the code points before each part but the first, of each perspective. Nothing here holds a text."""
    other = F.length(_head(F.col("speaker"), F.lit(False)))
    length = other + F.length("text") + len(CLOSE) + 1
    more = F.when(F.col("speaker") != SYSTEM, F.length(F.lit(f"{OPEN}assistant\n")) - other).otherwise(0)
    longer = rows.where("part > 0").select("conv_id").distinct()
    kept = rows.alias("r").join(longer.alias("l"), _same("r", "l", "conv_id"), "left_semi").select("conv_id", "part", "speaker", length.alias("length"), more.alias("more"))
    own = kept.groupBy("conv_id", "part", "speaker").agg(F.sum("length").alias("length"), F.sum("more").alias("more"))
    sums = own.groupBy("conv_id", "part").agg(F.sum("length").alias("length"))
    grid = sums.alias("s").join(people.alias("p"), _same("s", "p", "conv_id")).select("s.conv_id", "s.part", "s.length", "p.perspective")
    on = _same("x", "o", "conv_id", "part") & (F.col("x.perspective") == F.col("o.speaker"))
    full = grid.alias("x").join(own.alias("o"), on, "left").select("x.conv_id", "x.part", "x.perspective", (F.col("x.length") + F.coalesce("o.more", F.lit(0))).alias("length"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return full.withColumn("start", F.sum("length").over(earlier)).where("part > 0").select("conv_id", "perspective", "part", "start")


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, perspective, part, n_turns, rendered, masks for each participant of each conversation; part is 0 but for conversations of more than part_turns turns."""
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(speaker), F.lit(UNKNOWN)).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = in_parts(rows, part_turns)
    parts = written(rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct(*TURN))).alias("turns")), "parts")
    each = parts.select("conv_id", "part", F.explode("turns").alias("t")).select("conv_id", "part", "t.*")
    people = each.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    seen = parts.alias("c").join(people.alias("p"), _same("c", "p", "conv_id")).select("c.conv_id", "p.perspective", "c.part", "c.turns")
    starts = part_starts(each, people)
    seen = seen.alias("c").join(starts.alias("s"), _same("c", "s", "conv_id", "perspective", "part"), "left").select("c.*", F.coalesce("s.start", F.lit(0)).cast("long").alias("start"))

    def piece(t):
        own = t["speaker"] == F.col("perspective")
        return F.struct(_head(t["speaker"], own).alias("head"), F.concat(t["text"], F.lit(CLOSE)).alias("body"), own.alias("own"))

    pieces = seen.withColumn("pieces", F.transform("turns", piece))
    length = F.transform("pieces", lambda x: F.struct(F.length(x["head"]).cast("long").alias("head"), F.length(x["body"]).cast("long").alias("body"), x["own"].alias("own")))
    empty = F.struct(F.col("start").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc, x):
        start = acc["at"] + x["head"]
        end = start + x["body"]
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(x["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    rendered = F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "")
    return pieces.select("conv_id", "perspective", "part", F.size("turns").alias("n_turns"), rendered.alias("rendered"), F.aggregate(length, empty, step, lambda acc: acc["spans"]).alias("masks"))


def op4_perspective_rotation(spark, sf_dir: str) -> DataFrame:
    """rotate of all conversations; masks as text (start:end, comma-separated). Nulls, repeated rows and ties as the module states; no rows for an empty table."""
    out = rotate(table(spark, sf_dir, "conversations"))
    spans = F.transform("masks", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string")))
    return out.withColumn("masks", F.array_join(spans, ","))


OP4_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
x AS (
  SELECT t.conv_id, perspective, turn, speaker, text, speaker = perspective AS own,
         CASE WHEN speaker = 'system' THEN '<|im_start|>system' || chr(10) WHEN speaker = perspective THEN '<|im_start|>assistant' || chr(10)
              ELSE '<|im_start|>user name=' || speaker || chr(10) END AS head,
         text || '<|im_end|>' AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
y AS (
  SELECT *, (row_number() OVER w - 1) // 16384 AS part, sum(length(head) + length(body) + 1) OVER w AS after
  FROM x WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, CAST(count(*) AS INTEGER) AS n_turns,
       string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, speaker, text) AS rendered,
       coalesce(string_agg(CASE WHEN own THEN CAST(after - length(body) - 1 AS BIGINT) || ':' || CAST(after - 1 AS BIGINT) END, ',' ORDER BY turn NULLS FIRST, speaker, text), '') AS masks
FROM y GROUP BY conv_id, perspective, part
"""
