"""Best-fit packing of tokenised documents into sequences, bulk-synchronously.

Documents become pieces of 1 to `capacity` ids. Pieces and gaps are sorted by size; as both have at most
`capacity` sizes, a sorted table of either is a row for each size with a count, whatever the corpus. A round
takes the pieces of one size, largest first: a sweep over the gaps finds, for all of them at once, the smallest gaps
that hold one (successors); pieces that want the same gap are told apart by their rank within the size,
those left open new sequences, and the gaps' table is updated. Rounds go on to the smallest size. The result equals
sequential best-fit decreasing.

A round's decision is a *run*: ranks low.. of a size go to consecutive sequences from a base, so many in each.
Ranks are found distributedly, in hash buckets with offsets; each piece then looks its run up. Only counts by
size reach the driver, and only runs are broadcast: at most a run for each size and each group of sequences
filled alike, of which a round makes two more at most.

Defined cases: a null text counts as empty and gives one piece, of the final id 0; a null doc_id is packed like any
other; rows that repeat a doc_id are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import byte_bpe
from quire.llm.common import new_path, ranked, small_batches, table

CAPACITY = 2048
END = 0
BATCH_ROWS = 1000
RANK_BUCKETS = 256
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter than capacity."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """PIECES of docs (doc_id, text); ids are little-endian unsigned 32-bit numbers."""
    kinds = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = byte_bpe.encoder(path, added=True)
        end = np.uint32(END).tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = code(text or "") + end
                for k, (start, n) in enumerate(cuts(len(ids) // 4, capacity)):
                    out.append((doc, k, start, n, ids[4 * start : 4 * (start + n)]))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(encode, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (size, low, each, base, offset): from rank `low` on, `each` pieces go to a sequence, the first of
    them at `offset`, sequences counted from `base`."""
    runs = []
    gaps: list[int] = []  # sorted; of each, groups (base, count) of sequences
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)
    new = 0

    def leave(gap: int, base: int, count: int) -> None:
        if gap and count:
            if not groups[gap]:
                bisect.insort(gaps, gap)
            groups[gap].append((base, count))

    for size in sorted(counts, reverse=True):
        left, low = counts[size], 0
        while left:
            at = bisect.bisect_left(gaps, size)
            if at < len(gaps):
                gap = gaps[at]
                base, count = groups[gap].pop()
                if not groups[gap]:
                    gaps.pop(at)
            else:
                gap, base, count = capacity, new, -(-left // (capacity // size))
                new += count
            each = gap // size
            full = min(count, left // each)
            if full:
                runs.append((size, low, each, base, capacity - gap))
                leave(gap - each * size, base, full)
                low, left = low + full * each, left - full * each
            if left and full < count:  # the last sequence of the round takes fewer
                runs.append((size, low, left, base + full, capacity - gap))
                leave(gap - left * size, base + full, 1)
                low, left, full = low + left, 0, full + 1
            leave(gap, base + full, count - full)
    return runs


def placed(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sizes (doc_id, piece, start, length and other columns) with sequence_id and offset."""
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row a size
    runs = sorted(plan(counts, capacity))
    table_ = np.array(runs, dtype=np.int64).reshape(-1, 5)
    spark = sizes.sparkSession
    shared = spark.sparkContext.broadcast((table_[:, 0] * (1 << 44) + table_[:, 1], table_))
    rank = ranked(sizes, "rank", ["length"], ["doc_id", "piece", "start"], RANK_BUCKETS)

    at, last = sizes.columns.index("length"), len(sizes.columns)

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, run = shared.value
        for b in batches:
            size, r = b.column(at).to_numpy(), b.column(last).to_numpy()
            own = run[np.searchsorted(keys, size * (1 << 44) + r, side="right") - 1]
            step, place = np.divmod(r - own[:, 1], own[:, 2])
            added = [pa.array(own[:, 3] + step), pa.array(own[:, 4] + place * size)]
            yield pa.RecordBatch.from_arrays([*b.columns[:last], *added], names=[*b.schema.names[:last], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sizes.schema)
    return rank.mapInArrow(look_up, f"{schema}, sequence_id long, offset long")


def stored_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    at = new_path(docs.sparkSession, "pieces")
    with small_batches(docs.sparkSession, BATCH_ROWS):
        pieces(docs, path, capacity).write.option("compression", "zstd").parquet(at)
    return docs.sparkSession.read.schema(PIECES).parquet(at)


def sized(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))


def sequences(found: DataFrame, where: DataFrame) -> DataFrame:
    """sequence_id, ids (binary): the packed sequences of PIECES and the places of `sized` pieces. A sequence
    holds at most `capacity` ids. Pieces alike in all columns stand for each other."""
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"p.{k}").eqNullSafe(F.col(f"w.{k}"))
    rows = found.withColumn("ids_crc32", F.crc32("ids")).dropDuplicates(key).alias("p").join(where.alias("w"), same)
    parts = F.array_sort(F.collect_list(F.struct(F.col("w.offset").alias("offset"), F.col("p.ids").alias("ids"))))
    return rows.groupBy("w.sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text)."""
    found = stored_pieces(docs, path, capacity)
    return placed(sized(found), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), default_path())
