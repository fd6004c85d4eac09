"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source, documents are cut
into 4,096 ranges of that key and sorted in each; the ranges' sums are summed up
in 16 lots of 256, and the lots' sums over the lots, which together with the sums
of rows within a range are the prefix sums of the source. The mix takes whole epochs of a source while its budget lasts,
then documents in key order, and cuts the last one at the exact word.

Sources are weighed 3, 1, 2, repeating, in code point order with null last.
They share 150 % of all words; no source gives more than twice its words, and
what it cannot give is shared among the others by weight.

Null text has no words and gives none. Null source: a source of its own. Null
doc_id: the key is of the text. Equal keys (repeated rows): by doc_id, then size. Empty table: no rows. A source of
empty texts has target 0. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfold.llm.common import WORD, boxed, rank_column, table, text_or_empty, with_text, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2


def keyed_sizes(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, key and range of each document. The first three hexadecimal digits of the key are its range."""
    by_text = F.concat(F.lit("text:"), F.md5(text_or_empty().cast("binary")))
    name = F.when(F.col("doc_id").isNull(), by_text).otherwise(F.col("doc_id").cast("string"))
    key = F.md5(F.concat(F.lit("mix:"), name).cast("binary"))
    sized = docs.select("doc_id", "source", *extra, F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"), key.alias("key"))
    return sized.withColumn("range", F.substring("key", 1, 3))


def source_targets(sums: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target. sums: source, source_size; a row for each source, which one task ranks.

    Targets are min(most * size, weight * level) at the level that uses up the
    total: sources are taken by the level at which they are exhausted, and each
    is exhausted if the level of those not exhausted before it exceeds its own.
    """
    every = Window.partitionBy(F.lit(0))
    ranked = sums.withColumn("i", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("i") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    limits = weighed.withColumn("limit", (F.col("source_size") * most).cast("double")).withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    rise = every.orderBy(F.col("limit") / F.col("weight"), "i")
    before = F.coalesce(F.sum("limit").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(rise.rowsBetween(0, Window.unboundedFollowing))
    tested = limits.withColumn("full", F.col("limit") / F.col("weight") * open_weight < F.col("total") - before)
    left = F.col("total") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(every)
    weight_left = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    shared = F.least(F.col("limit"), F.col("weight") * left / weight_left)
    return tested.select("source", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(shared).alias("target"))


def _before(column: str, *by: str):
    """Exclusive prefix sums in the order of the last of `by`, for each value of the others."""
    return F.coalesce(F.sum(column).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def mix(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken and the extra columns, for each document. taken counts repeated words again."""
    rows = written(keyed_sizes(docs, extra), "mix")
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")))
    ranges = ranges.withColumn("lot", F.substring("range", 1, 1)).withColumn("in_lot", _before("range_size", "source", "lot", "range"))
    lots = ranges.groupBy("source", "lot").agg(F.sum("range_size").alias("lot_size")).withColumn("lot_start", _before("lot_size", "source", "lot"))
    starts = ranges.alias("a").join(lots.alias("l"), F.col("a.source").eqNullSafe(F.col("l.source")) & (F.col("a.lot") == F.col("l.lot")))
    starts = starts.select("a.source", "a.range", (F.col("lot_start") + F.col("in_lot")).alias("range_start"))
    starts = starts.alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "range", "range_start", "source_size", "target")
    in_range = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(in_range), F.lit(0)))
    joined = placed.alias("r").join(starts.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.range") == F.col("s.range")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size") - F.col("range_start") - F.col("before")
    taken = (epochs * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))).cast("long")
    return joined.select("r.doc_id", *(f"r.{c}" for c in extra), "r.size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: docs that give words, a row for each copy; the copy that the budget cuts ends after its last word taken.

    Rows equal in doc_id and text share what they give. n_chars, if there, follows the text.
    """
    plan = mix(docs.select("doc_id", "source", "text", rank_column(docs).alias("rank")), ("rank",))
    plan = plan.where("taken > 0").groupBy("rank").agg(F.sum("taken").alias("taken"), F.max("size").alias("size"))
    rows = boxed(docs).dropDuplicates(["rank"]).join(written(plan, "plan").hint("shuffle_hash"), "rank")
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    pieces = F.split(F.col("doc.text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each a word with the blanks before it
    cut = F.array_join(F.slice(pieces, F.lit(1), words), "")
    return copies.select(with_text(docs, cut, words < F.col("size"))).select("doc.*")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """mix of all documents: null and empty texts give nothing, repeated rows are each placed; no rows for an empty table."""
    return mix(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, '')))) AS key
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS DOUBLE) AS weight,
         CAST(2 * source_size AS DOUBLE) AS lim, sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS total,
         row_number() OVER (ORDER BY source NULLS LAST) AS i
  FROM sums),
tested AS (
  SELECT *, lim / weight * sum(weight) OVER (ORDER BY lim / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
     < total - coalesce(sum(lim) OVER (ORDER BY lim / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent
  FROM weighed),
targets AS (
  SELECT source, source_size, CASE WHEN spent THEN lim ELSE least(lim, weight
     * (total - sum(CASE WHEN spent THEN lim ELSE 0 END) OVER ()) / sum(CASE WHEN spent THEN 0 ELSE weight END) OVER ()) END AS target
  FROM tested),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
lots AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(budget - epochs * source_size - before, size)) AS BIGINT) AS taken
FROM lots
"""
