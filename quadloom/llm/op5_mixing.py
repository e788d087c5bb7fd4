"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points are mapped through the cumulative target weights of the sources, so every
prefix of the schedule is close to the target mix.  The slots of a source are ranked, and the
rank picks a block of its shuffled documents laid end to end, block after block and then round
again.  Slots that the points leave a source short of follow after the schedule.  Blocks of a source have equal token counts (they differ by one at most).  The last slot
of a source is trimmed, so what is taken equals the target rounded to a word.

Order inside a source is by hash, and every running count is done in two steps (within hash or
slot ranges, then over the ranges), so no task handles a whole source.

Edge cases: a NULL text has size 0 and is never taken; a NULL source is a source of its own,
last in order; with no words at all targets are 0; equal rows are interchangeable; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NO_SPACE_CLASS, materialise

WEIGHTS = (5, 2, 1)
GOLDEN = (math.sqrt(5) - 1) / 2
CELLS = 4096
ROWS_PER_RANGE = 20_000
SLOTS_PER_RANGE = 1 << 14


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and the hash that shuffles a source."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(NO_SPACE_CLASS + "+")).cast("bigint")
    return docs.select("doc_id", "source", size.alias("size"),
                       F.xxhash64(F.lit("order"), "doc_id", "text").alias("h"))


def water_levels(totals: DataFrame, weights=WEIGHTS, most: int = 3) -> DataFrame:
    """Adds the target of every row of ``totals(source, source_size)``.

    Giving the excess of full sources to the others by weight ends at one level L with targets
    min(most * size, L * weight): sources fill up in the order of most * size / weight, and L is
    the first level at which no further source is full.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int"))
    rows = totals.select("*", weight.cast("double").alias("weight"))
    rows = rows.withColumn("full", most * F.col("source_size") / F.col("weight"))
    order = W.orderBy("full", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = F.sum("source_size").over(W.partitionBy()) - most * F.coalesce(
        F.sum("source_size").over(before), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = (rest / left).alias("level")
    rows = rows.select("*", level)
    # the first row that the level does not fill gives the level for all later ones
    first = F.min_by("level", F.when(F.col("level") <= F.col("full"), F.col("full"))).over(W.partitionBy())
    return rows.select("source", "source_size", "weight",
                       F.least(most * F.col("source_size"), F.coalesce(first, F.lit(0.0)) * F.col("weight"))
                       .cast("double").alias("target"))


def edge(k: Column) -> Column:
    """First word of block ``k`` of a source."""
    width = F.col("source_size") / F.col("blocks")
    return F.when(k >= F.col("blocks"), F.col("source_size")).otherwise(F.floor(k.cast("double") * width))


def block_of(word: Column) -> Column:
    """The block that holds a word of a source."""
    guess = F.floor(word.cast("double") * F.col("blocks") / F.col("source_size"))
    return F.when(edge(guess) > word, guess - 1).when(edge(guess + 1) <= word, guess + 1).otherwise(guess)


def running(df: DataFrame, keys: list[str], part: str, order: list, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over earlier rows of ``keys``, where ``part`` is a
    column that grows with the order.  Sums within (keys, part) and over the parts are apart."""
    inner = W.partitionBy(*keys, part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    parts = df.groupBy(*keys, part).agg(F.sum(value).alias("_sum"))
    parts = parts.select(*[F.col(k).alias(f"_{k}") for k in [*keys, part]],
                         F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_before"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, part]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return (df.withColumn("_own", F.coalesce(F.sum(value).over(inner), F.lit(0)))
            .join(parts, cond).withColumn(name, F.col("_own") + F.col("_before"))
            .drop("_own", "_before", *[f"_{k}" for k in [*keys, part]]))


def schedule(plan: DataFrame, slots: int) -> DataFrame:
    """(sid, rank) of the first ``slots`` golden-ratio points mapped through the cumulative
    weights of ``plan(sid, low, high)``.  Points and intervals meet in cells of equal width."""
    spark = plan.sparkSession
    point = ((F.col("id") + 0.5) * GOLDEN) % 1
    points = spark.range(slots).select("id", point.alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * CELLS))
    last = F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1))
    spans = plan.where("high > low").select(
        "sid", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS), last)).alias("cell"))
    hit = (points.join(spans, "cell").where("u >= low AND u < high")
           .select("sid", "id", F.floor(F.col("id") / SLOTS_PER_RANGE).alias("range")))
    return running(hit, ["sid"], "range", ["id"], F.lit(1), "rank").select("sid", "rank")


def with_missing_ranks(ranked: DataFrame, plan: DataFrame) -> DataFrame:
    """``ranked(sid, rank)`` and, after them, the ranks that the common schedule leaves a source
    of ``plan(sid, need)`` short of.  A slot is added for the rounding of targets and blocks."""
    have = ranked.groupBy("sid").agg(F.count("*").alias("have"))
    short = plan.join(have, "sid", "left").select(
        "sid", F.coalesce("have", F.lit(0)).cast("bigint").alias("first"),
        F.when(F.col("need") > 0, F.ceil("need")).otherwise(F.lit(-1)).cast("bigint").alias("last"))
    return ranked.unionByName(short.where("first <= last").select(
        "sid", F.explode(F.sequence("first", "last")).alias("rank")))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = 3, block: int = 1024) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``."""
    sized = materialise(sizes(docs), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = water_levels(totals, weights, most)
    # the number of points of a source follows the slots it needs, so that blocks of any size
    # are taken equally often
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / block))
    need = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("blocks", blocks).withColumn("need", need)
    order = W.orderBy(F.col("source").asc_nulls_last())
    high = F.sum("need").over(order) / F.greatest(F.sum("need").over(W.partitionBy()), F.lit(1e-9))
    low = F.coalesce(F.lag("high").over(order), F.lit(0.0))
    plan = materialise(plan.select("*", high.alias("high"), F.row_number().over(order).alias("sid"))
                       .withColumn("low", low), "mix-plan")
    total = plan.agg(F.sum("need").alias("n"), F.count("*").alias("k")).first()
    needed, count = total.n or 0.0, total.k
    # points of an interval differ from its share by a few times the logarithm at most
    slots = math.ceil(needed) + count * (3 * math.ceil(math.log2(needed + 2)) + 8) if needed else 0
    ranked = with_missing_ranks(materialise(schedule(plan, slots), "schedule"), plan)
    info = plan.select("sid", "source_size", "target", "blocks")
    uses = ranked.join(info, "sid").where("source_size > 0").withColumn(
        "block", F.col("rank") % F.col("blocks"))
    begin = F.floor(F.col("rank") / F.col("blocks")) * F.col("source_size") + edge(F.col("block"))
    size = edge(F.col("block") + 1) - edge(F.col("block"))
    cut = F.least(size, F.round("target").cast("bigint") - begin)
    uses = (uses.withColumn("cut", cut).withColumn("width", size).where("cut > 0")
            .groupBy("sid", "block").agg(
                F.sum((F.col("cut") == F.col("width")).cast("int")).alias("whole"),
                F.max(F.when(F.col("cut") < F.col("width"), F.col("cut")).otherwise(F.lit(0))).alias("trim")))
    ranges = 64 + sized.count() // ROWS_PER_RANGE
    placed = running(sized.withColumn("range", F.pmod(F.shiftright("h", 24), F.lit(ranges))),
                     ["source"], "range", ["h", F.col("doc_id").asc_nulls_first(), "size"], F.col("size"), "start")
    placed = placed.join(plan.select(F.col("source").alias("_source"), "sid", "source_size", "target", "blocks"),
                         F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    numbered = placed.withColumn("row", F.monotonically_increasing_id())
    numbered = materialise(numbered, "placed")  # the row number must not change between reads
    pieces = numbered.where("size > 0").select(
        "row", "sid", "start", "size", "source_size", "blocks",
        F.explode(F.sequence(block_of(F.col("start")), block_of(F.col("start") + F.col("size") - 1))).alias("block"))
    left, right = F.greatest("start", edge(F.col("block"))), F.least(
        F.col("start") + F.col("size"), edge(F.col("block") + 1))
    trimmed = F.least(right, edge(F.col("block")) + F.col("trim"))
    got = (F.col("whole") * (right - left) + F.greatest(trimmed - left, F.lit(0))).cast("bigint")
    taken = (pieces.join(uses, ["sid", "block"]).select("row", got.alias("got"))
             .groupBy("row").agg(F.sum("got").alias("taken")))
    return numbered.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
