"""Best-fit packing row by row, bulk-synchronously: every step is a distributed one over pieces and gaps.

A round sorts pieces and gaps together by size, from the largest, gaps before pieces of their size, by ranges. Read so, a gap opens a
bracket and a piece closes the nearest open one, which is the smallest gap that holds it: its successor. Brackets are matched by
running sums (of each range, and of the ranges before it): a piece closes the last gap of its depth. So each gap gets one piece, of those that
want it the one of the highest rank; gaps shrink, and the next round matches the rest. Pieces that no gap holds, nor what is left of
one, open new sequences: the larger ones of them, as many as their volume fills, and all above half a sequence.

A round writes two tables to the shared folder; of the second, the next round's pieces and gaps, and the places, are projections.
What reaches the driver is a row a round, what is broadcast a row a range.

The query doesn't use this but `packing.placed`: the README has the figures of both.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import stored

RANGE_ROWS = 200_000
LEAST_RANGES = 6
ALONE = 1 << 62


def levelled(elements: DataFrame, ranges: int) -> DataFrame:
    """elements (kind: 0 gaps, 1 pieces; id, size) with level, the brackets open after each, and lowest, the least level before it."""
    order = [F.desc("size"), "kind", "id"]
    dealt = elements.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
    window = Window.partitionBy("range").orderBy(*order)
    step = 1 - 2 * F.col("kind")
    own = dealt.withColumn("own", F.sum(step).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    own = own.withColumn("own_low", F.min("own").over(window.rowsBetween(Window.unboundedPreceding, -1)))
    own = stored(own, "pack-sums")
    sums = own.groupBy("range").agg(F.sum(step).alias("total"), F.min("own").alias("low"))  # a row a range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0)))
    sums = sums.withColumn("base_low", F.least(F.lit(0), F.coalesce(F.min(F.col("base") + F.col("low")).over(before), F.lit(0))))
    both = own.join(F.broadcast(sums.select("range", "base", "base_low")), "range")
    lowest = F.least("base_low", F.col("own_low") + F.col("base"))  # nulls, of a range's first row, are passed over
    return both.select("kind", "id", "size", (F.col("own") + F.col("base")).alias("level"), lowest.alias("lowest"))


def matched(elements: DataFrame, ranges: int) -> DataFrame:
    """elements with alone and rank (of pieces without a gap, 1 the largest), gap_id and gap (of the other pieces), by (the size of
    the piece that takes a gap, or null)."""
    rows = levelled(elements, ranges)
    alone = (F.col("kind") == 1) & (F.col("level") < F.col("lowest"))  # a new minimum: no bracket was open
    rows = rows.withColumn("alone", alone).withColumn("rank", -F.col("level"))
    depth = F.when(F.col("alone"), F.lit(-ALONE) + F.col("id")).otherwise(F.col("level") + F.col("kind"))
    at = Window.partitionBy("depth").orderBy(F.desc("size"), "kind", "id")
    rows = rows.withColumn("depth", depth).withColumns({"gap_id": F.lag("id").over(at), "gap": F.lag("size").over(at), "by": F.when(F.lead("kind").over(at) == 1, F.lead("size").over(at))})
    return stored(rows.select("kind", "id", "size", "alone", "rank", "gap_id", "gap", "by"), "pack-matches")


def placed(pieces: DataFrame, capacity: int, ranges: int | None = None) -> tuple[DataFrame, int]:
    """id, sequence_id, offset of pieces (id, size), and the number of rounds."""
    kind = lambda k: F.lit(k).alias("kind")
    elements = pieces.select(kind(1), "id", F.col("size").cast("long").alias("size"))
    number = pieces.count()
    done, made, rounds, pending = [], 0, 0, number
    parts = ranges or max(LEAST_RANGES, -(-number // RANGE_ROWS))
    while pending:
        rounds += 1
        rows = matched(elements, parts)
        rest = rows.where("kind = 0").select(kind(0), "id", (F.col("size") - F.coalesce("by", F.lit(0))).alias("size")).where("size > 0")
        lone = rows.where("alone")
        most = rest.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
        large = F.col("size") > most
        pending, volume, halves = lone.agg(F.count("*"), F.sum(F.when(large, F.col("size"))), F.count_if(large & (F.col("size") * 2 > capacity))).first()
        opened = max(halves, -(-(volume or 0) // capacity))
        opens = lone.where(F.col("rank") <= opened).select((F.col("rank") - 1 + made).alias("sequence_id"), "id", "size")
        done.append(rows.where("kind = 1 AND NOT alone").select("id", F.col("gap_id").alias("sequence_id"), (F.lit(capacity) - F.col("gap")).cast("long").alias("offset")))
        done.append(opens.select("id", "sequence_id", F.lit(0).cast("long").alias("offset")))
        fresh = opens.select(kind(0), F.col("sequence_id").alias("id"), (F.lit(capacity) - F.col("size")).alias("size")).where("size > 0")
        elements = rest.unionByName(fresh).unionByName(lone.where(F.col("rank") > opened).select(kind(1), "id", "size"))
        made += opened
        pending -= opened
    empty = pieces.select("id", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).limit(0)
    return (reduce(DataFrame.unionByName, done) if done else empty), rounds
