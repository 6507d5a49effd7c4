"""Balanced label propagation: documents with equal texts gather in one shard, sizes stay even (DataFrame
functions only).

Linked documents (rows that share a text) start in pseudo-random shards. Rows of one text that start in one
shard form a *cell*, and the cells of a text a *unit*; only a text with more rows than any shard may hold is split, into units
of a whole shard's rows and one of the rest. In each round, Spark joins give the cells of every unit the shard that holds most of
the unit (ties: by hash) among those with room for all of it; units ask to move there, and a shard admits
askers, larger ones first, then in hash order, while its room lasts. Those turned away ask again in the next round, with the rooms
as they are then, and so do all smaller than they are (by powers of two). A unit for which no shard has room is halved, by its
cells' starts, down to single cells. Rounds end when no unit asks any more.
Rows of texts that occur once have no edge to cut; they fill every shard to its exact count at the end,
together with cells that no shard has room for. The law is therefore `rows`: counts are at most one apart, always.

So a text that fits a shard is cut only once no shard has room for it. A round in which a shard turns a unit away places one before
it there, and that shard has no room for its size any more, so rounds end.

What reaches the driver: the load of each shard by powers of two of units' sizes, in each round. What is broadcast: ranks' offsets, if small.

Defined cases: a null text counts as empty (size 16, CRC 0, equal to an empty one); a null doc_id is placed
like any other; repeated rows are separate rows; fewer rows than shards leave shards empty; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import ranked, salt_of, salts_in, stored, table

SHARDS = 40
SALTS = 48
RANK_BUCKET_ROWS = 50_000
ROW = ["doc_id", "size", "text_crc32", "digest"]
UNIT = ["digest", "unit", "part"]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, digest: the only pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"),
    )


def array(xs: list[int]) -> Column:
    return F.array(*[F.lit(int(x)).cast("long") for x in xs])


def linked_texts(rows: DataFrame, salts: int) -> DataFrame:
    """digest, salt, n for each digest of two or more rows; found and looked up by salted digests."""
    cells = rows.groupBy("digest", "salt").agg(F.count("*").alias("n"))
    groups = cells.groupBy("digest").agg(F.sum("n").alias("n"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")).where("n > 1")
    return groups.select("digest", "n", salts_in(F.col("salts"), salts).alias("salt"))


def in_units(linked: DataFrame, most: int, quota: int, buckets: int) -> DataFrame:
    """linked rows with their unit: 0, or, of texts with more than `most` rows, their rank over the quota."""
    small = linked.where(F.col("n") <= most).withColumn("unit", F.lit(0).cast("long"))
    large = ranked(linked.where(F.col("n") > most), "rank", ["digest"], ["doc_id", "size"], buckets)
    return small.unionByName(large.withColumn("unit", F.floor(F.col("rank") / max(1, quota)).cast("long")).drop("rank"))


def asked(units: DataFrame, room: list[int], round_: int, buckets: int) -> DataFrame:
    """UNIT, target, class, admitted of units (UNIT, n, votes): the roomy shard of most votes (null: none), and whether it
    has room beside the askers before; classes of sizes are negative, so that the largest come first."""
    hashed = lambda s: F.pmod(F.xxhash64(*UNIT, s, F.lit(round_)), F.lit(1 << 30))
    shards = F.sequence(F.lit(0), F.lit(len(room) - 1))
    roomy = F.filter(shards, lambda s: F.element_at(array(room), s + 1) >= F.col("n"))
    rated = F.transform(roomy, lambda s: F.struct(F.coalesce(F.try_element_at("votes", s), F.lit(0)).alias("votes"), hashed(s).alias("hash"), s.alias("shard")))
    order = F.pmod(F.xxhash64(*UNIT, F.lit("order")), F.lit(1 << 40))
    rows = units.withColumn("target", F.array_max(rated)["shard"]).withColumns({"class": -F.floor(F.log2("n")), "hash": order})
    rows = rows.withColumn("bucket", F.floor(F.col("hash") / ((1 << 40) / buckets)))
    keys = ["target", "class", "bucket"]
    own = F.sum("n").over(Window.partitionBy(*keys).orderBy("hash", *UNIT).rowsBetween(Window.unboundedPreceding, 0))
    before = F.sum("_n").over(Window.partitionBy("target").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.where("target is not null").groupBy(*keys).agg(F.sum("n").alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    wish = rows.where("target is not null").withColumn("_own", own).join(offsets, keys)
    admitted = F.col("_own") + F.col("_before") <= F.element_at(array(room), F.col("target") + 1)
    wish = wish.select(*UNIT, "target", "class", admitted.alias("admitted"))
    none = rows.where("target is null").select(*UNIT, F.lit(None).cast("int").alias("target"), "class", F.lit(False).alias("admitted"))
    return wish.unionByName(none)


def propagated(cells: DataFrame, wanted: list[int], buckets: int) -> tuple[DataFrame, list[int]]:
    """digest, unit, start, shard (null: no shard had room) of cells (digest, unit, start, n), and the shards' loads."""
    room = list(wanted)
    done, level, round_ = None, 0, 0
    left = cells.select("digest", "unit", F.lit(0).alias("part"), "start", "n")
    while not left.isEmpty():
        votes = left.groupBy(*UNIT, "start").agg(F.sum("n").alias("v"))
        units = votes.groupBy(*UNIT).agg(F.sum("v").alias("n"), F.count("*").alias("cells"), F.map_from_entries(F.collect_list(F.struct("start", "v"))).alias("votes"))
        units = stored(units, "shard-units")
        wish = asked(units, room, round_, buckets).join(units.select(*UNIT, "cells"), UNIT)
        moved = stored(left.join(wish, UNIT), "shard-cells")
        seen = moved.where("target is not null").groupBy("target", "class", "admitted").agg(F.sum("n").alias("n")).collect()  # rows per shard and class
        turned_away = min((r["class"] for r in seen if not r.admitted), default=0)
        moved = moved.withColumn("admitted", F.col("admitted") & (F.col("class") <= turned_away))  # smaller ones wait for larger ones
        for r in seen:
            if r.admitted and r["class"] <= turned_away:
                room[r.target] -= r.n
        alone = (F.col("cells") == 1) & F.col("target").isNull()
        placed = moved.where(F.col("admitted") | alone).select("digest", "unit", "start", F.col("target").alias("shard"))
        done = placed if done is None else done.unionByName(placed)
        left = moved.where(~F.col("admitted") & ~alone)
        if left.where("target is not null").isEmpty():  # no unit that is left has room anywhere: halve them all
            level += 1
            left = left.withColumn("part", F.pmod("start", F.lit(1 << level)))
        left = left.select(*UNIT, "start", "n")
        round_ += 1
    if done is None:
        done = cells.select("digest", "unit", "start", F.lit(0).alias("shard"))
    return done, [w - r for w, r in zip(wanted, room, strict=True)]


def assigned(docs: DataFrame, shards: int = SHARDS, salts: int = SALTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs (doc_id, text)."""
    rows = stored(measured(docs), "shard-rows").withColumn("salt", salt_of("doc_id", salts=salts))
    total = rows.count()
    quota = total // shards
    wanted = [quota + (s < total % shards) for s in range(shards)]
    buckets = max(64, total // RANK_BUCKET_ROWS)
    texts = stored(linked_texts(rows, salts), "shard-texts")
    known = rows.join(texts, ["digest", "salt"], "left")
    linked = in_units(known.where("n is not null").select(*ROW, "n"), max(wanted, default=0), quota, buckets)
    linked = linked.withColumn("start", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(shards)).cast("int")).drop("n")
    linked = stored(linked, "shard-linked")
    cells = stored(linked.groupBy("digest", "unit", "start").agg(F.count("*").alias("n")), "shard-starts")
    cell, held = propagated(cells, wanted, buckets)
    homes = linked.join(cell, ["digest", "unit", "start"])
    kept = ranked(homes.where("shard is not null").select(*ROW, "shard"), "slot", ["shard"], ["digest", "doc_id", "size"], buckets)
    rest = known.where("n is null").select(*ROW).unionByName(homes.where("shard is null").select(*ROW))
    first = [sum(wanted[:s]) - sum(held[:s]) for s in range(shards)]  # of the rest's ranks, by shard
    filled = ranked(rest, "place", [], ["doc_id", "size", "text_crc32"], buckets)
    filled = filled.withColumn("shard", (F.size(F.filter(array(first), lambda x: x <= F.col("place"))) - 1).cast("int"))
    slot = F.col("place") - F.element_at(array(first), F.col("shard") + 1) + F.element_at(array(held), F.col("shard") + 1)
    columns = ["doc_id", "size", "text_crc32", "shard"]
    both = kept.select(*columns, "slot").unionByName(filled.select(*columns, slot.alias("slot")))
    return both.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(table(spark, sf_dir, "documents"))
