"""Helpers shared by the training-data operators: shared-folder tables and skew-safe ranks and groups."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one, on a local master only (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


_MADE: list[str] = []


def mark() -> int:
    """How many tables this session has made, for cleanup of those made later."""
    return len(_MADE)


def cleanup(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Deletes the tables that operators of this session wrote to the shared folder since a mark, but for the last
    ones. Call it when their results are no longer needed: DataFrames that they return read these tables."""
    jvm = spark.sparkContext._jvm
    gone = _MADE[since : len(_MADE) - but]
    del _MADE[since : len(_MADE) - but]
    for path in map(jvm.org.apache.hadoop.fs.Path, gone):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again: lineage ends there, and the
    files outlive any executor. Spark's commit protocol makes retried tasks safe."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now. It does so once the driver has collected what
    refers to them, which may else take half an hour while disks fill up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def salt_of(*cols: str, salts: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def salts_in(mask: Column, salts: int) -> Column:
    """One row per bit set in mask. salts is at most 63."""
    every = F.array(*[F.lit(i) for i in range(salts)])
    return F.explode(F.filter(every, lambda i: F.call_function("getbit", mask, i) == 1))


def ranked(df: DataFrame, name: str, group: list[str], order: list[str], buckets: int = 64) -> DataFrame:
    """Adds name, a rank from 0 without gaps within each group, without bringing a group into one task:
    rows are numbered within hash buckets of their order columns, and the buckets' counts (at most
    `buckets` for a group) give the offsets. Rows alike in the order columns may swap ranks."""
    b = df.withColumn("_bucket", salt_of(*order, salts=buckets))
    keys = [*group, "_bucket"]
    own = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = b.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    numbered = b.withColumn("_own", own).alias("a")
    same = None
    for k in keys:
        c = F.col(f"a.{k}").eqNullSafe(F.col(f"o.{k}"))
        same = c if same is None else same & c
    joined = numbered.join(offsets.alias("o"), same)
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a._own") + F.col("o._before")).cast("long").alias(name))


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Actions within send Python so many rows at once; the session's setting is restored. For steps that are stored at once:
    a plan that runs later doesn't see it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def sliced_batches(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows at most. Spark bounds a batch's bytes (64 MB by default); this bounds what
    is made from one at a time, whatever a session sets."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def runs(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.Table]:
    """Tables of whole groups of sorted batches: each holds one or more groups, all of their rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(column).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1]))  # the last group may go on
        if cut or (held and held[-1].column(column)[-1].as_py() != k[0]):
            head = batch.slice(0, cut)
            ready = pa.Table.from_batches([*held, head])
            if held and cut == 0:
                ready = pa.Table.from_batches(held)
            if ready.num_rows:
                yield ready
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
