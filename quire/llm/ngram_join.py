"""Similarity join on word n-gram sets: which documents link at a Jaccard similarity of PERCENT or more.

1. Each text becomes its set of n-gram hashes (64 bits). Equal sets are one *set* from here on, named by half of a 128-bit
   digest; where different sets share that half, by the other half.
2. Count vectors: the n-grams of a set, hashed into groups, give a point of group counts. Two sets can share no more
   than the summed minima of their coordinates; an R-tree over the points, whose boxes keep the largest coordinates
   and the range of sizes, finds the points whose bound is high enough.
3. One R-tree over a corpus would have to open nearly all its boxes (texts of one size have similar counts), so points
   are dealt to many trees: sets that link share one of their rarest tenth of n-grams (prefix filter, exact), and all
   sets with such an n-gram in common form a block with a tree of its own. Rarity is counted over all documents, in a
   table of BUCKETS counters; any order would do for right results. n-grams with a counter above HOT are counted
   one by one, and those that are in more than HOT texts aren't searched: their sets of similar size are joined as they are, as
   candidates. So a block holds HOT sets at most, whatever the corpus. The larger the sets, the weaker is the
   bound, so large sets are split by hash into shares, with points and rarest tenths of their own: if two sets link, at least one
   share of theirs is as similar as the whole. Shares are so small that unlike ones fall short of the bound by twice what it
   allows links (`share_size`), at any similarity.
4. Blocks give candidate families: components under the bound, found from a spanning forest for each block, never from
   all pairs. Families are verified with the whole sets, by the R-tree and a union-find that skips pairs already
   connected. Families of over FAMILY sets are split: every part meets the first part, then only sets outside the
   main component meet the others.
5. Components of the verified links, over sets, give the documents' components.

Defined cases: null texts and texts without words have no n-gram and link with nothing; fewer than N words are one
n-gram; equal sets link, also of rows that repeat a doc_id; a null doc_id is larger than any other; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import cleanup, mark, runs, salt_of, salts_in, small_batches, stored, table
from quire.llm.components import components

N = 3
PERCENT = 90
BUCKETS = 1 << 20
SLICES = 32
GROUPS = 16
FINE_GROUPS = 64
HOT = 1000
FAMILY = 128
LEAF = 16
FILTER = 1 << 18
BATCH_ROWS = 500
SALTS = 48
WORDS_KEPT = 200_000
CHUNK_ROWS = 250
CHUNK_BYTES = 1 << 20
LONGEST_KEPT = 64
BASE = "kind int, doc_id long, n long, set_id long, other long, data binary"
ID_BITS = 64
KEYS = "hot boolean, key long, set_id long, size long, v0 long, v1 long"

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


# Sets


class Words(dict):
    def __missing__(self, word: bytes) -> bytes:
        out = xxhash.xxh3_64_digest(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = out
        return out


_WORDS = Words()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def hashed(texts: list[str | None], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of the n-grams of each text, one text after the other, and where each starts.
    A-Z are lower-cased, white space is ASCII; fewer than n words are one n-gram."""
    lists = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]  # of bytes: ASCII only, both
    words = np.array([len(x) for x in lists], np.int64)
    get = _WORDS.__getitem__
    w = np.frombuffer(b"".join([b"".join(map(get, x)) for x in lists]), "<u8")
    sizes = np.minimum(words, n)
    counts = np.where(words > 0, words - sizes + 1, 0)
    ends = np.cumsum(words)
    h = np.full(len(w), n, np.uint64)
    for i in range(n):
        part = w[i:] if i else w
        h[: len(part)] = (h[: len(part)] ^ part) * (_A, _B, _C)[i % 3] + np.uint64(i + 1)
        h ^= h >> np.uint64(29)
    for k in np.flatnonzero((words > 0) & (words < n)).tolist():
        x = np.full(1, sizes[k], np.uint64)
        for i in range(int(sizes[k])):
            x = (x ^ w[ends[k] - words[k] + i]) * (_A, _B, _C)[i % 3] + np.uint64(i + 1)
            x ^= x >> np.uint64(29)
        h[ends[k] - words[k]] = x[0]
    at = np.concatenate(([0], np.cumsum(counts)))
    first = np.repeat(ends - words - at[:-1], counts) + np.arange(at[-1])
    h = mixed(h[first])
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        h[s:e].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[at[:-1][counts > 0]] = True
    return h[new], np.concatenate(([0], np.cumsum(new)))[at]


def shingles(text: str | None, n: int = N) -> np.ndarray:
    return hashed([text], n)[0]


def slices(batches: Iterable[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of CHUNK_ROWS rows, and, beyond one row, CHUNK_BYTES of text at most. The words kept are
    forgotten at the end, so that later tasks of the worker have the memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK_ROWS):
            part = batch.slice(at, CHUNK_ROWS)
            if part.column(text).nbytes <= CHUNK_BYTES:
                yield part
            else:
                size = pc.fill_null(pc.binary_length(part.column(text)), 0).to_pylist()
                first, held = 0, 0
                for i, n in enumerate(size):
                    if held and held + n > CHUNK_BYTES:
                        yield part.slice(first, i - first)
                        first, held = i, 0
                    held += n
                yield part.slice(first)
    _WORDS.clear()


def halves(h: np.ndarray, id_bits: int = ID_BITS) -> tuple[int, int]:
    """The two halves of a set's digest; id_bits: of the first one that are used."""
    d = blake2b(h.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True) >> (64 - id_bits), int.from_bytes(d[8:], "little", signed=True)


@dataclass(frozen=True)
class Names:
    """How sets are named: by the first half of the digest, or by the second where the first stands for several sets."""

    id_bits: int = ID_BITS
    clashes: frozenset[int] = frozenset()

    def of(self, h: np.ndarray) -> int:
        a, b = halves(h, self.id_bits)
        return b if a in self.clashes else a


def vector(h: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((h & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def links(a: int, b: int, common: int, percent: int = PERCENT) -> bool:
    return 100 * common >= percent * (a + b - common)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets have in common."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


# R-tree


class RTree:
    """Over points of group counts. A box keeps the largest of each coordinate and the range of the points' sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int = PERCENT):
        self.percent = percent
        tile = (np.log(np.maximum(sizes, 1)) * 20).astype(np.int64)
        self.order = np.lexsort((points[:, 1], points[:, 0], tile)) if len(points) else np.zeros(0, np.int64)
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > LEAF:
            p, low, high = self.levels[-1]
            at = np.arange(0, len(p), LEAF)
            self.levels.append((np.maximum.reduceat(p, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Positions of points that may link with this one: the summed minima are high enough for a link."""
        nodes = np.arange(len(self.levels[-1][0]))
        least = self.percent * size / 100
        for k in range(len(self.levels) - 1, -1, -1):
            p, low, high = self.levels[k]
            nodes = nodes[(high[nodes] >= least) & (low[nodes] * self.percent <= 100 * size)]
            bound = np.minimum(p[nodes], point).sum(axis=1)
            other = np.maximum(low[nodes], least)
            nodes = nodes[bound * (100 + self.percent) >= self.percent * (size + other) - 1e-6]
            if k:
                nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
                nodes = nodes[nodes < len(self.levels[k - 1][0])]
        return self.order[nodes]


def forest(points: np.ndarray, sizes: np.ndarray, label: np.ndarray, verify: Callable[[int, int], bool] | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Edges that connect all that link; label: what is connected from the start. Pairs already connected are skipped."""
    out = []
    label = label.copy()
    tree = RTree(points, sizes, percent)
    for i in range(len(points)):
        near = tree.search(points[i], int(sizes[i]))
        near = near[label[near] != label[i]]
        for j in near.tolist():
            if label[j] != label[i] and (verify is None or verify(i, j)):
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


# Step 1: sets, and how frequent n-grams are


def based(docs: DataFrame, n: int, id_bits: int = ID_BITS) -> DataFrame:
    """BASE: a row of kind 0 for each document; rows of kind 1 hold slices of each task's table of counters."""
    kinds = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("set_id", pa.int64()), ("other", pa.int64()), ("data", pa.binary())])

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        some = False
        for batch in slices(batches, 1):
            h, at = hashed(batch.column(1).to_pylist(), n)
            ns = np.diff(at)
            sets = [halves(h[s:e], id_bits) if e > s else (None, None) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            first, second = zip(*sets, strict=True) if sets else ((), ())
            counts += np.bincount((h >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64), minlength=BUCKETS)
            some = True
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(ns), pa.int32()), batch.column(0), pa.array(ns, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.nulls(len(ns), pa.binary())], schema=kinds)
        if some:
            c = zstandard.ZstdCompressor(level=1)
            data = [c.compress(x.tobytes()) for x in np.split(counts, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array([1] * SLICES, pa.int32()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.array(range(SLICES), pa.int64()), pa.nulls(SLICES, pa.int64()), pa.array(data, pa.binary())], schema=kinds)

    return docs.mapInArrow(make, BASE)


def counters(base: DataFrame) -> np.ndarray:
    """The summed table: BUCKETS numbers."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(d.decompress(x), np.int64)
                sums[k] = sums[k] + own if k in sums else own
        c = zstandard.ZstdCompressor(level=1)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([c.compress(x.tobytes()) for x in sums.values()], pa.binary())], names=["part", "data"])

    parts = base.where("kind = 1").select(F.col("set_id").alias("part"), "data")
    sums = parts.repartition(SLICES, "part").mapInArrow(add, "part long, data binary").collect()
    out = np.zeros((SLICES, BUCKETS // SLICES), np.int64)
    for r in sums:
        out[r.part] += np.frombuffer(zstandard.ZstdDecompressor().decompress(r.data), np.int64)
    return out.ravel()


# Steps 2 to 4a: keys, blocks, candidates


def packed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of counts a shift, and the counts in a byte each, rounded up: (c << shift) >= v."""
    shift = np.zeros(len(v), np.int64)
    c = v.astype(np.int64)
    while len(c) and (big := c.max(axis=1) > 255).any():
        shift += big
        c = -(-v >> shift[:, None])
    return shift, c.astype(np.uint8)


def share_size(percent: int) -> float:
    """The least n-grams of a share; the most is four times that. Two unlike shares with x n-grams a group are expected to
    miss 1 / sqrt(pi x) of each other, links at most (1 - J) / (1 + J)."""
    return max(4.0, GROUPS / (16 * np.pi * ((100 - percent) / (100 + percent)) ** 2)) if percent < 100 else 1e9


def shared_out(sizes: np.ndarray, percent: int, other: bool) -> np.ndarray:
    """In how many shares sets of these sizes are split: a power of four. Sets that link may be split differently by
    size alone; so where a smaller or larger set that may link is split otherwise, `other` gives that number too
    (else 0)."""
    least = share_size(percent)
    of = lambda x: 1 << 2 * np.maximum(0, np.floor(np.log2(np.maximum(x, 1) / least) / 2)).astype(np.int64)
    own = of(sizes)
    if not other:
        return own
    low, high = of(np.floor(sizes * percent / 100)), of(np.ceil(sizes * 100 / percent))
    return np.where(low != own, low, np.where(high != own, high, 0))


def keyed(docs: DataFrame, counts: np.ndarray, n: int, percent: int, hot: int, names: Names = Names()) -> DataFrame:
    """KEYS: for each set the rarest n-grams of which it must share one with whatever it links with."""
    # 1 to 32 for a counter's bit length; counters above `hot` may be those of n-grams that are in very many sets
    rank = np.frompyfunc(lambda x: int(x).bit_length(), 1, 1)(counts).astype(np.uint64) | (counts > hot).astype(np.uint64) << np.uint64(5)
    frequency = docs.sparkSession.sparkContext.broadcast(rank.astype(np.uint8))
    columns_ = [f.split()[0] for f in KEYS.split(", ")]
    types = [pa.bool_(), *[pa.int64()] * 5]
    least = -(-percent // max(1, 100 - percent))  # smaller sets link with equal ones only

    def one(h: np.ndarray, size: np.ndarray, ids: np.ndarray, split: np.ndarray) -> pa.RecordBatch:
        """Keys of sets (all their hashes h, sizes, names) that are split in so many shares each."""
        shares = np.repeat(split, size)
        first = np.cumsum(split) - split
        share = np.repeat(first, size) + ((h >> np.uint64(8)).astype(np.int64) & (shares - 1))
        count = int(split.sum())
        r = frequency.value[(h >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)].astype(np.uint64)
        key = (r << np.uint64(58)) | (mixed(h + shares.astype(np.uint64) * _B) >> np.uint64(6))
        n = np.bincount(share, minlength=count)
        shift, c = packed(np.bincount(share * GROUPS + (h & np.uint64(GROUPS - 1)).astype(np.int64), minlength=count * GROUPS).reshape(count, GROUPS))
        order = np.argsort(key)
        order = order[np.argsort(share[order], kind="stable")]
        place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        order = order[place < np.repeat(n - -(-percent * n // 100) + 1, n)]
        key, own = key[order], share[order]
        v = np.ascontiguousarray(c).view("<i8")
        columns = [key >> np.uint64(63) == 1, key.view(np.int64), np.repeat(ids, split)[own], (n + (shift << 48))[own], v[own, 0], v[own, 1]]
        return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(columns, types, strict=True)], names=columns_)

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            h, at = hashed(batch.column(1).to_pylist(), n)
            sizes = np.diff(at)
            some = sizes >= least
            if not some.any():
                continue
            h, size = h[np.repeat(some, sizes)], sizes[some]
            ids = np.array([names.of(h[s : s + k]) for s, k in zip((np.cumsum(size) - size).tolist(), size.tolist(), strict=True)], np.int64)
            yield one(h, size, ids, shared_out(size, percent, False))
            also = shared_out(size, percent, True)
            if also.any():
                yield one(h[np.repeat(also > 0, size)], size[also > 0], ids[also > 0], also[also > 0])

    return docs.mapInArrow(make, KEYS)


def block_edges(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """u, v from rows (key, set_id, size, v0, v1) sorted by key: spanning forests of the blocks' candidates. What
    a task has connected once it doesn't search again."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    for t in runs(batches, 0):
        key = t.column(0).to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        lengths = np.diff(np.append(starts, len(key)))
        many = np.repeat(lengths > 1, lengths)
        if not many.any():
            continue
        t, lengths = t.filter(pa.array(many)), lengths[lengths > 1]
        starts = np.cumsum(lengths) - lengths
        ids, size, v0, v1 = (t.column(i).to_numpy() for i in range(1, 5))
        n, shift = size & ((1 << 48) - 1), size >> 48
        points = np.stack([v0, v1], axis=1).view(np.uint8).reshape(len(ids), GROUPS).astype(np.int64) << shift[:, None]
        u, v = [], []
        two = starts[lengths == 2]
        if len(two):
            bound = np.minimum(points[two], points[two + 1]).sum(axis=1)
            a, b = n[two], n[two + 1]
            low, high = np.minimum(a, b), np.maximum(a, b)
            ok = (ids[two] != ids[two + 1]) & (bound * (100 + percent) >= percent * (a + b)) & (100 * low >= percent * high)
            for x, y in set(zip(ids[two][ok].tolist(), ids[two + 1][ok].tolist(), strict=True)):
                if (a := find(x)) != (b := find(y)):
                    root[a] = b
                    u.append(x)
                    v.append(y)
        for s, m in zip(starts[lengths > 2].tolist(), lengths[lengths > 2].tolist(), strict=True):
            own, at = np.unique(ids[s : s + m], return_index=True)
            label = [find(x) for x in own.tolist()]
            if len(set(label)) < 2:
                continue
            at += s
            for i, j in forest(points[at], n[at], np.unique(label, return_inverse=True)[1], None, percent):
                x, y = int(own[i]), int(own[j])
                root[find(x)] = find(y)
                u.append(x)
                v.append(y)
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def candidate_edges(keys: DataFrame, percent: int, hot: int) -> DataFrame:
    """u, v: between sets that may link, or, for very frequent n-grams, between a set and a node for the n-gram and
    a range of sizes. Each set joins the ranges before and after its own half-way, so that sets that may link meet.
    Rows of a frequent n-gram are looked up and dealt by salt, never in one task."""
    columns = ["key", "set_id", "size", "v0", "v1"]
    unsure = keys.where("hot").withColumn("salt", salt_of("set_id", salts=SALTS))
    many = stored(unsure.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"), "join-frequent")
    salted = many.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    cold = keys.where("not hot").select(*columns).unionByName(unsure.join(salted, ["key", "salt"], "left_anti").select(*columns))
    near = cold.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: block_edges(it, percent), "u long, v long")
    n = F.col("size").bitwiseAND(F.lit((1 << 48) - 1))
    tile = F.floor(F.log(n.cast("double")) / float(np.log(100 / percent))).cast("long")
    tiles = F.explode(F.array(tile, tile + 1))
    virtual = unsure.join(salted, ["key", "salt"], "left_semi").select("key", F.col("set_id").alias("u"), tiles.alias("tile"))
    return near.unionByName(virtual.select("u", F.xxhash64("key", "tile", F.lit("tile")).alias("v"))).distinct()


# Step 4b: verification


def whole_sets(docs: DataFrame, members: DataFrame, n: int, names: Names = Names()) -> DataFrame:
    """members (set_id, doc_id and others) without doc_id, with n and data: the hashes of each set, from the text of one of
    its documents. Texts that can't be wanted stay where they are: the wanted ones' hash buckets, FILTER at most, are
    broadcast. Where a doc_id and its text repeat, so does the set."""
    kept = [c for c in members.columns if c not in ("set_id", "doc_id")]
    kinds = pa.schema([("set_id", pa.int64()), *[(c, pa.int64()) for c in kept], ("n", pa.int64()), ("data", pa.binary())])

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            out = []
            for text, want, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = shingles(text, n)
                if len(h) and names.of(h) == want:
                    out.append((want, *rest, len(h), h.tobytes()))
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER)).cast("int")
    near = members.select(bucket.alias("bucket")).distinct()
    some = docs.withColumn("bucket", bucket).join(F.broadcast(near), "bucket", "left_semi")
    rows = some.join(members.withColumnRenamed("doc_id", "_doc"), F.col("doc_id").eqNullSafe(F.col("_doc"))).select("text", "set_id", *kept)
    return rows.mapInArrow(make, ", ".join(["set_id long", *[f"{c} long" for c in kept], "n long", "data binary"]))


def verify_edges(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """u, v from rows (task, set_id, label, n, data) sorted by task."""
    for t in runs(batches, 0):
        task, ids, label, n = (t.column(i).to_numpy() for i in range(4))
        data = t.column(4)
        starts = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1])))
        out = []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(task)], strict=True):
            own, at = np.unique(ids[s:e], return_index=True)
            at += s
            sets = [np.frombuffer(data[int(i)].as_py(), np.uint64) for i in at]
            points = np.stack([vector(h, FINE_GROUPS) for h in sets])
            number = np.unique(label[at], return_inverse=True)[1]
            check = lambda i, j, sets=sets: links(len(sets[i]), len(sets[j]), shared(sets[i], sets[j]), percent)
            out += [(own[i], own[j]) for i, j in forest(points, n[at], number, check, percent)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"])


def verified(rows: DataFrame, percent: int) -> DataFrame:
    """u, v of rows (task, set_id, label, n, data)."""
    dealt = rows.select("task", "set_id", "label", "n", "data").repartition("task").sortWithinPartitions("task")
    return dealt.mapInArrow(lambda it: verify_edges(it, percent), "u long, v long")


def parted(members: DataFrame, family: int) -> DataFrame:
    """members (set_id, doc_id, comp) of families of two or more sets, with the number of parts that the family is
    split into, and the set's part."""
    sizes = members.groupBy("comp").agg(F.count("*").alias("m")).where("m > 1")
    rows = members.join(sizes, "comp").withColumn("parts", F.ceil(F.col("m") / family).cast("long")).drop("m")
    return rows.withColumn("part", F.pmod(F.xxhash64("set_id", F.lit("part")), F.col("parts")))


def family_links(sets: DataFrame, percent: int, family: int) -> DataFrame:
    """u, v: verified links that connect all of sets (set_id, comp, parts, part, n, data) that are connected."""
    alone = F.when(F.col("parts") == 1, F.array(F.lit(0).cast("long")))
    dealt = alone.when(F.col("part") == 0, F.sequence(F.lit(1).cast("long"), F.col("parts") - 1)).otherwise(F.array("part"))
    first = sets.withColumn("at", F.explode(dealt)).withColumns({"task": F.xxhash64("comp", "at"), "label": F.col("set_id")})
    found = stored(verified(first, percent), "join-links")
    large = sets.where("parts > 1")
    if large.isEmpty():
        return found
    # Parts other than the first have met only it: sets outside a family's main component now meet all parts.
    roots = components(found, "join-large").select(F.col("node").alias("set_id"), "root")
    rows = large.select("comp", "set_id", "parts", "part").distinct().join(roots, "set_id", "left").withColumn("label", F.coalesce("root", "set_id"))
    by = rows.groupBy("comp", "label").agg(F.count("*").alias("k"))
    main = by.groupBy("comp").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.sum("k").alias("all"), F.max("k").alias("most"))
    rows = rows.join(main.where("all > most"), "comp").withColumn("blocks", F.ceil((F.col("all") - F.col("most")) / family).cast("long"))
    rows = stored(rows.select("comp", "set_id", "label", "main", "parts", "part", "blocks"), "join-minor")
    if rows.isEmpty():
        return found
    zero = F.lit(0).cast("long")
    block = F.pmod(F.xxhash64("set_id", F.lit("block")), F.col("blocks"))
    minor = rows.where("label != main").withColumn("block", block).select("comp", "set_id", "label", "block", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("part"))
    every = rows.select("comp", "set_id", "label", "part", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"))
    second = minor.unionByName(every, allowMissingColumns=True).select(F.xxhash64("comp", "part", "block", F.lit("second")).alias("task"), "set_id", "label").distinct()
    return found.unionByName(verified(second.join(large.select("set_id", "n", "data"), "set_id"), percent))


# All together


def gathered(rows: DataFrame) -> DataFrame:
    """set_id, doc_id (the smallest), salts, low, high (of `other`) of rows (doc_id, set_id, other, salt)."""
    cells = rows.where("set_id is not null").groupBy("set_id", "salt").agg(F.min("doc_id").alias("doc_id"), F.min("other").alias("low"), F.max("other").alias("high"))
    salts = F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")
    return cells.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), salts, F.min("low").alias("low"), F.max("high").alias("high"))


def joined(docs: DataFrame, n: int = N, percent: int = PERCENT, hot: int = HOT, family: int = FAMILY, id_bits: int = ID_BITS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    with small_batches(spark, BATCH_ROWS):
        base = stored(based(own, n, id_bits), "join-base")
    rows = base.where("kind = 0").select("doc_id", "n", "set_id", "other").withColumn("salt", salt_of("doc_id", salts=SALTS))
    sets = stored(gathered(rows), "join-sets")
    names = Names(id_bits, frozenset(r.set_id for r in sets.where("low != high").select("set_id").collect()))  # of 2^64 ids, those of two sets
    if names.clashes:
        rows = rows.withColumn("set_id", F.when(F.col("set_id").isin(list(names.clashes)), F.col("other")).otherwise(F.col("set_id")))
        sets = stored(gathered(rows), "join-sets")
    before = mark()
    counts = counters(base)
    with small_batches(spark, BATCH_ROWS):
        keys = stored(keyed(own, counts, n, percent, hot, names), "join-keys")
    near = stored(candidate_edges(keys, percent, hot), "join-candidates")
    cleanup(spark, before, but=1)  # the keys have done their work
    families = components(near, "join-families")
    members = sets.join(families, F.col("set_id") == F.col("node")).select("set_id", "doc_id", F.col("root").alias("comp"))
    members = stored(members, "join-family")
    with small_batches(spark, BATCH_ROWS):
        full = stored(whole_sets(own, stored(parted(members, family), "join-parts"), n, names), "join-whole")
        found = stored(family_links(full, percent, family), "join-found")
    roots = components(found, "join-roots")
    linked = sets.join(roots, F.col("set_id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "set_id"))
    lowest = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = linked.join(lowest, "root").select("set_id", "component_id", salts_in(F.col("salts"), SALTS).alias("salt"))
    some = rows.where("set_id is not null").join(named, ["set_id", "salt"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = rows.where("set_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none)


def representatives(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with their columns, whose doc_id names a component: one document of each stays. Rows
    without words all stay."""
    keep = joined(docs, n, percent).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(keep, F.col("doc_id").eqNullSafe(F.col("_id"))).select(*[docs[c] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(x) = 0 THEN [] WHEN len(x) < 3 THEN [array_to_string(x, chr(9))] ELSE list_transform(range(1, len(x) - 1), lambda i: x[i] || chr(9) || x[i + 1] || chr(9) || x[i + 2]) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
u AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT x AS doc_id, y AS root FROM u UNION SELECT r.doc_id, u.y FROM r JOIN u ON u.x = r.root)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.root), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id
"""
