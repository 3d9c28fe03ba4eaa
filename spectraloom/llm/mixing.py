"""Mixing sources to target weights by a low-discrepancy schedule of token blocks.

Each slot of the schedule is a golden-ratio point in [0, 1), which the sources'
cumulative targets map to a source. The r-th slot of a source takes the r-th
block of ``block_tokens`` words of its shuffled documents, starting over at
their end. All of it is DataFrame work on small rows: no text is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.common import stored

#: A word.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights that sources take in turn.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words of a block, at every size.
BLOCK_TOKENS = 64
#: Cells of [0, 1) in which slots meet sources.
CELLS = 4096
_GOLDEN = (math.sqrt(5) - 1) / 2
_LOW_BITS = 20
_GOLDEN_HIGH = (0x9E3779B97F4A7C15 << _LOW_BITS) % 2**64 / 2**64


def running_sum(df: DataFrame, group: str, bucket: str, order: list, value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` in all earlier rows of its group.

    Rows are ordered by bucket, then ``order``. Only rows of one bucket meet in
    a task; a group's earlier buckets come in as sums.
    """
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, bucket, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(sums, [group, bucket]).withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_before")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source of rows (source, size): src, source_size, target, low, high.

    src numbers the sources by code point, null last; it picks the weight.
    Targets share ``share`` times all sizes by weight, stop at ``most`` times
    the source's size, and what is over is shared again: with the sources
    ordered by cap over weight, the first at which the fill level stays under
    its own ratio gives the level for it and all behind. low and high bound the
    source's part of [0, 1).
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    line = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("src", F.row_number().over(line) - 1)
    weights = F.array(*map(F.lit, WEIGHTS))
    by = by.withColumn("w", F.element_at(weights, (F.col("src") % len(WEIGHTS) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "src")
    before, every = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    by = by.withColumn("level", left / weight_left).withColumn("level", F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level")))
    by = by.withColumn("level", F.first("level", ignorenulls=True).over(every))
    by = by.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))))
    total = F.greatest(F.sum("target").over(every), F.lit(1e-9))
    up_to = F.sum("target").over(line.rowsBetween(Window.unboundedPreceding, 0))
    return by.select("source", F.col("src").cast("int").alias("src"), "source_size", "target", ((up_to - F.col("target")) / total).alias("low"), (up_to / total).alias("high"))


def point(slot: Column) -> Column:
    """Golden-ratio point of a slot; high and low bits apart, so that doubles stay exact enough for any slot."""
    high, low = F.shiftright(slot, _LOW_BITS), slot.bitwiseAND((1 << _LOW_BITS) - 1)
    x = high * F.lit(_GOLDEN_HIGH) + low * F.lit(_GOLDEN) + F.lit(0.5)
    return x - F.floor(x)


def schedule(by: DataFrame, block_tokens: int, slots: int) -> DataFrame:
    """slot, src, rank: the source of each slot and the slot's rank within it (from 0)."""
    spark = by.sparkSession
    every = spark.range(slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("x"))
    every = every.withColumn("cell", F.least(F.floor(F.col("x") * CELLS), F.lit(CELLS - 1)).cast("int"))
    cell = lambda c: F.least(F.floor(F.col(c) * CELLS), F.lit(CELLS - 1)).cast("int")
    parts = by.filter("high > low").select("src", "low", "high", F.explode(F.sequence(cell("low"), cell("high"))).alias("cell"))
    met = every.join(parts, "cell").filter("x >= low and x < high").select("slot", "src", F.shiftright("slot", 16).alias("span"), F.lit(1).alias("one"))
    return running_sum(met, "src", "span", ["slot"], "one", "rank").select("slot", "src", F.col("rank").cast("long").alias("rank"))


def mix(docs: DataFrame, seed: int = 7, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, spans, schedule) of a mix of ``docs`` (doc_id, text, source).

    rows: doc_id, row, cls (hash of the text), size, source, source_size, target, taken.
    spans: row, src, rank, epoch, words: what each block takes of each document.
    schedule: slot, src, rank.

    A null text has size 0; a null source is a source. Rows that repeat are
    documents of their own. An empty table gives empty results. Only doc_id,
    text and source are read. Rows of one doc_id follow by the hash of their
    text, so that reruns over other file splits agree.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    base = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("cls")))
    by = stored(targets(base))
    total = by.agg(F.sum("target")).first()[0] or 0.0
    block = block_tokens
    plan = schedule(by, block, math.ceil(total / block))
    rows = base.join(by.select(F.col("source").alias("_s"), "src", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))).withColumn("bucket", F.substring("key", 1, 3))
    rows = running_sum(rows, "src", "bucket", ["key", "doc_id", "cls", "row"], "size", "start")
    laps = rows.filter("size > 0").select("row", "src", "size", F.posexplode(F.array(F.col("start"), F.col("start") + F.col("source_size"))).alias("epoch", "at"))
    blocks = laps.select("*", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))).alias("rank"))
    inside = F.least(F.col("at") + F.col("size"), (F.col("rank") + 1) * block) - F.greatest(F.col("at"), F.col("rank") * block)
    spans = blocks.select("row", "src", "rank", "epoch", inside.alias("words")).join(plan, ["src", "rank"], "left_semi")
    taken = spans.groupBy("row").agg(F.sum("words").alias("taken"))
    out = rows.join(taken, "row", "left")
    return out.select("doc_id", "row", "cls", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")), spans, plan


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """``docs`` as often as the mix takes them: once for each pass over a source that takes more than half of the text.

    A document without words is not taken, one without an id is. Columns are those of ``docs``.
    """
    rows, _, _ = mix(docs, seed)
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 63)))
    copies = rows.filter("taken > 0").groupBy(number("doc_id").alias("__mix_id"), F.col("cls").alias("__mix_cls")).agg(F.max(F.round(F.col("taken") / F.col("size"))).cast("int").alias("__mix_copies"))
    met = docs.join(copies.filter("__mix_copies > 0"), (number("doc_id") == F.col("__mix_id")) & (F.xxhash64("text") == F.col("__mix_cls")))
    return met.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*docs.columns)
