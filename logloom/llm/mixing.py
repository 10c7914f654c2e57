"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets: the weights share out a budget; no target passes its source's cap, and what is above goes
to the others by weight. Each source's documents are shuffled by hash into a stream of words, as
often as the cap allows, and cut into blocks of `block` words. Slot j of the schedule takes the point
frac(j * golden ratio); the cumulative targets say whose turn it is, the slot's rank among its
source's slots says which block. Ranks past a source's last block fall out, blocks without a slot
go to the end, so every source gives exactly its target, rounded down. Ranks and offsets are sums in
two steps, over chunks and within them, so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.llm.registry import query, table
from logloom.llm.words import WORD
from logloom.session import stored

BLOCK = 4096  # words
SHARE, CAP = 1.5, 2.0
WEIGHTS = (3.0, 1.0, 2.0)
CHUNK = 10_000  # rows that one window orders
CELLS = 1024  # equal parts of [0, 1) under which points meet the sources' intervals
# The golden ratio's fraction in units of 2^-62: points are exact integers.
UNIT = 1 << 62
STEP = 2850178171849254813


def sized(docs: DataFrame, id: str, text: str, source: str) -> DataFrame:
    """Words of every row; no window, no shuffle."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id).alias("id"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(F.col(text)).alias("hash"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from one (source, source_size) row per source.

    Sources in code-point order, null last, have the weights in turn. A source's target is
    level * weight up to its cap; the sources that reach their cap are those with the least cap per
    weight, so the level follows from one pass in that order. One narrow row per source is ordered.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.array(*map(F.lit, weights))[at]).withColumn("most", cap * F.col("source_size"))
    by_need = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    budget = share * F.sum("source_size").over(Window.partitionBy())
    level = (budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = weighed.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") > F.col("most"))
    # Levels rise up to the first source below its cap, whose level holds, and fall after it.
    last = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy())
    return levelled.withColumn("last", last).select(
        "source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.least("most", F.col("last") * F.col("weight"))).alias("target")
    )


def _running(rows: DataFrame, by: list[str], chunk: Column, value: Column, order: list, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over the earlier rows of the group. Chunks must rise with the order."""
    rows = rows.withColumn("_chunk", chunk).withColumn("_value", value)
    sums = rows.groupBy(*by, "_chunk").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_chunk").alias("_of"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    match = F.col("_chunk") == F.col("_of")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    within = Window.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_inside", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return inside.join(starts, match).withColumn(name, F.col("_start") + F.col("_inside")).drop("_chunk", "_value", "_of", "_start", "_inside", *(f"_{c}" for c in by))


def schedule(spark, shares: DataFrame, block: int = BLOCK) -> DataFrame:
    """`shares`: (source, target). One row per slot: (slot, source, rank), `quota` slots a source.

    Slots past the planned number are the blocks that the points did not reach, in source order.
    """
    quotas = shares.filter("target >= 1").withColumn("quota", F.ceil(F.floor("target") / block).cast("long"))
    total = quotas.agg(F.sum("quota")).first()[0] or 0
    order = Window.orderBy(F.col("source").asc_nulls_last())
    edge = F.sum("quota").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Cumulative weights as integers out of UNIT.
    cum = lambda e: F.floor(e.cast("decimal(38,0)") * F.lit(UNIT).cast("decimal(20,0)") / F.lit(max(1, total))).cast("long")
    laid = quotas.withColumn("high", cum(edge)).withColumn("low", cum(edge - F.col("quota"))).withColumn("high", F.when(edge == total, F.lit(UNIT)).otherwise(F.col("high")))
    cell = UNIT // CELLS
    spans = laid.filter("high > low").withColumn(
        "cell", F.explode(F.sequence(F.expr(f"low div {cell}"), F.expr(f"(high - 1) div {cell}")))
    )
    turn = F.col("id").cast("decimal(18,0)") * F.lit(STEP).cast("decimal(19,0)") % F.lit(UNIT).cast("decimal(19,0)")
    points = spark.range(total).select(F.col("id").alias("slot"), turn.cast("long").alias("point"))
    points = points.withColumn("cell", F.expr(f"point div {cell}"))
    hits = points.join(spans.select("source", "quota", "low", "high", "cell"), "cell").filter("point >= low and point < high").select("slot", "source", "quota")
    ranked = _running(hits, ["source"], F.expr(f"slot div {CHUNK}"), F.lit(1), ["slot"], "rank").filter("rank < quota")
    # What the points left short.
    ranked = stored(ranked.select("slot", "source", F.col("rank").cast("long").alias("rank")), "schedule")
    reached = ranked.groupBy(F.col("source").alias("_source")).agg(F.count(F.lit(1)).alias("reached"))
    short = (
        quotas.join(reached, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
        .filter("reached < quota").select("source", F.explode(F.sequence("reached", F.col("quota") - 1)).alias("rank"))
    )
    return ranked.unionByName(short.select((F.lit(total) + F.col("rank")).alias("slot"), "source", "rank"))


def _streams(docs: DataFrame, id: str, text: str, source: str, weights: tuple, share: float, cap: float, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes of all rows, targets of their sources, and the place of every row with words in its source's shuffled stream."""
    rows = stored(sized(docs, id, text, source), "sizes")
    sizes = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "targets")
    held = rows.agg(F.count(F.lit(1))).first()[0]
    buckets = max(1, held // (CHUNK // 10))
    mixed = F.xxhash64(F.lit(seed), "id", "hash")
    bucket = F.floor(F.shiftrightunsigned(mixed, 11) / 2.0 ** 53 * buckets).cast("long")
    full = rows.filter("size > 0").withColumn("_mixed", F.shiftrightunsigned(mixed, 11))
    placed = _running(full, ["source"], bucket, F.col("size"), ["_mixed", "id", "hash", "size"], "offset")
    return rows, sizes, stored(placed.select("id", "source", "size", "offset"), "streams")


def _pieces(placed: DataFrame, sizes: DataFrame, cap: float, block: int) -> DataFrame:
    """(slot, source, id, offset, pass, start, words): what each slot of the schedule takes, of `_streams`' rows."""
    slots = schedule(placed.sparkSession, sizes.select("source", "target"), block).select("slot", F.col("source").alias("_source"), F.col("rank").alias("_rank"))
    turns = placed.join(sizes.select(F.col("source").alias("_of"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    turns = turns.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max(1, -int(-cap // 1))) - 1)))
    turns = turns.withColumn("from", F.col("offset") + F.col("pass").cast("long") * F.col("source_size"))
    end = F.least(F.col("from") + F.col("size"), F.floor("target"))
    cut = turns.withColumn("end", end).filter("`end` > `from`").withColumn(
        "rank", F.explode(F.sequence(F.expr(f"`from` div {block}"), F.expr(f"(`end` - 1) div {block}")))
    )
    first = F.greatest("from", F.col("rank") * block)
    words = F.least("end", (F.col("rank") + 1) * block) - first
    used = cut.join(slots, (F.col("rank") == F.col("_rank")) & F.col("source").eqNullSafe(F.col("_source")))
    return used.select("slot", "source", "id", "offset", "pass", (first - F.col("from")).alias("start"), words.alias("words"))


def pieces(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS,
           share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """The mix itself: (slot, source, id, offset, pass, start, words), sorted by slot, offset within pass to be read in order.

    A slot is one block of a source; its pieces are `words` words of a document from word `start` on. A document may
    come again in a later pass over its source. Edge cases as in `mix`.
    """
    _, sizes, placed = _streams(docs, id, text, source, weights, share, cap, seed)
    return _pieces(placed, sizes, cap, block).withColumnRenamed("id", id).orderBy("slot", "pass", "offset")


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS,
        share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken (words, repeats counted), summed over the mix's pieces.

    taken is at most ceil(cap) times the size. Null texts and texts without words have size 0 and
    are taken 0 times; a null source is a source of its own, the last. Equal rows are interchangeable,
    so reruns agree. Empty tables are fine, other columns are ignored.
    """
    rows, sizes, placed = _streams(docs, id, text, source, weights, share, cap, seed)
    took = _pieces(placed, sizes, cap, block).groupBy(F.col("source").alias("_source"), F.col("offset").alias("_offset")).agg(F.sum("words").alias("taken"))
    filled = placed.join(took, (F.col("offset") == F.col("_offset")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    all_rows = filled.select("id", "source", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")).unionByName(
        rows.filter("size = 0").select("id", "source", "size", F.lit(0).cast("long").alias("taken"))
    )
    return all_rows.join(sizes.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of"))).select(
        F.col("id").alias(id), "size", "source_size", "target", "taken"
    )


@query("op5_mix")
def op5_mix(spark, folder):
    return mix(table(spark, folder, "documents"))
