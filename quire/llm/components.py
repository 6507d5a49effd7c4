"""Connected components of an edge table, by repeated contraction with DataFrame joins until few edges are left."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored

#: A key with more than this part of all rows, and LEAST rows, is heavy: fewer than HEAVY keys are.
HEAVY = 2000
LEAST = 100
#: So many edges or fewer are connected by one task, whatever the size of the table that they are left of.
FEW = 1 << 18


def looked_up(rows: DataFrame, key: str, table: DataFrame, heavy: DataFrame, name: str, value: str) -> DataFrame:
    """rows with column `name`: the value that table has for their key, null if it has none. Rows of the heavy keys, of which
    there are few, find it in a broadcast table; only those of other keys, none of which has many, are shuffled by it."""
    few = F.broadcast(heavy.select(F.col("u").alias("_k"), F.col(value).alias("_few")))
    most = table.join(F.broadcast(heavy.select(F.col("u").alias("_h"))), F.col("u") == F.col("_h"), "left_anti").select(F.col("u").alias("_k"), F.col(value).alias(name))
    marked = rows.join(few, F.col(key) == F.col("_k"), "left").drop("_k")
    columns = [*rows.columns, name]
    own = marked.where("_few IS NOT NULL").withColumnRenamed("_few", name).select(*columns)
    rest = marked.where("_few IS NULL").drop("_few").join(most, F.col(key) == F.col("_k"), "left").select(*columns)
    return own.unionByName(rest)


def connected(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, to (the smallest node reached) of all nodes of edges (u, v), which are held whole."""
    columns = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for batch in batches:
        for held, c in zip(columns, batch.columns, strict=True):
            held.append(c.to_numpy(zero_copy_only=False))
    nodes, ends = np.unique(np.concatenate([x for held in columns for x in held]), return_inverse=True)
    u, v = np.split(ends, 2)
    root = np.arange(len(nodes))
    while len(u):
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
        u, v = root[u], root[v]
        apart = u != v
        u, v = u[apart], v[apart]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[root], pa.int64())], names=["u", "to"])


def hooked(roots: DataFrame, hooks: DataFrame) -> DataFrame:
    """roots (node, root), where hooks (u, to) have a root's own root."""
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > max(LEAST, roots.count() // HEAVY)).select("root")
    heavy = hooks.join(F.broadcast(large), F.col("u") == F.col("root"), "left_semi")
    return looked_up(roots, "root", hooks, heavy, "_to", "to").select("node", F.coalesce("_to", "root").alias("root"))


def components(edges: DataFrame, name: str = "components", few: int = FEW) -> DataFrame:
    """node, root (the smallest node reached) of all nodes of edges (u, v), a stored table.

    Each round hooks every node to the first of its neighbours in a random order, if before itself, and replaces edges by those
    between the hooks; of a path about half the nodes stay, so rounds grow with the logarithm, however nodes are numbered. Minima
    are combined on the map side, and the few nodes that have a large part of all edges, or are the root of a large part of all nodes, are looked up in a broadcast table, so that
    a node of very many edges burdens no task. Once there are `few` edges at most, one task connects them: a round is several jobs,
    whose plans the driver keeps. Tables of a round are written to the shared folder."""
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    roots, round_ = None, 0
    while (left := e.count()) > few:
        order = lambda c: F.xxhash64(c, F.lit(round_))  # noqa: B023, E731
        round_ += 1
        both = e.where("u != v").unionByName(e.where("u != v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = both.groupBy("u").agg(F.min_by("v", order("v")).alias("m"), F.count("*").alias("degree"))
        hooks = hooks.select("u", F.when(order("m") < order("u"), F.col("m")).otherwise(F.col("u")).alias("to"), "degree")
        hooks = stored(hooks, f"{name}-hooks")
        if roots is None:
            loops = e.where("u = v").select(F.col("u").alias("node")).distinct()
            roots = hooks.select(F.col("u").alias("node"), F.col("to").alias("root")).unionByName(
                loops.join(hooks, F.col("node") == F.col("u"), "left_anti").select("node", F.col("node").alias("root"))
            )
            roots = stored(roots, f"{name}-roots")
        else:
            roots = stored(hooked(roots, hooks), f"{name}-roots")
        heavy = hooks.where(F.col("degree") > max(LEAST, 2 * left // HEAVY))
        e = looked_up(e.where("u != v"), "u", hooks, heavy, "a", "to")
        e = looked_up(e, "v", hooks, heavy, "b", "to").where("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        e = stored(e.distinct(), f"{name}-edges")
    if left or roots is None:
        rest = stored(e.repartition(1).mapInArrow(connected, "u long, to long"), f"{name}-rest")
        if roots is None:
            return rest.select(F.col("u").alias("node"), F.col("to").alias("root"))
        roots = stored(hooked(roots, rest), f"{name}-roots")
    low = stored(roots.groupBy("root").agg(F.min("node").alias("low"), F.count("*").alias("n")).withColumnRenamed("root", "u"), f"{name}-low")
    heavy = low.where(F.col("n") > max(LEAST, roots.count() // HEAVY))
    return looked_up(roots, "root", low, heavy, "smallest", "low").select("node", F.col("smallest").alias("root"))
