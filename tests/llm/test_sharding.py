import random
import zlib
from collections import Counter, defaultdict

import pytest

from quire.llm import sharding as m
from quire.llm.common import table
from tests.llm.util import odd


def check(got, texts, shards):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts
    )
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert 0 <= r.shard < shards and r.law == "rows" and r.grown_shard is None
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def cut(got):
    """Rows outside the shard that holds most of their text's copies."""
    by = defaultdict(Counter)
    for r in got:
        by[r.text_crc32, r.size][r.shard] += 1
    return sum(sum(c.values()) - max(c.values()) for c in by.values())


@pytest.mark.parametrize("shards", [40, 7])
def test_table(spark, sf, shards):
    docs = table(spark, sf, "documents")
    got = m.assigned(docs, shards).collect()
    check(got, [(r.doc_id, r.text) for r in docs.collect()], shards)


def test_copies_stay_together(spark):
    random.seed(1)
    texts = [(i, f"group {i % 50}" if i < 400 else f"single {i}") for i in range(2000)]
    got = m.assigned(odd(spark, texts), 10).collect()
    check(got, texts, 10)
    assert cut(got) == 0


def grouped(sizes, total):
    """Rows of groups of these sizes, mixed with rows of texts of their own."""
    texts = [f"group {g}" for g, n in enumerate(sizes) for _ in range(n)]
    texts += [f"single {i}" for i in range(total - len(texts))]
    random.Random(3).shuffle(texts)
    return list(enumerate(texts))


def fewest_cut(texts, shards):
    """Rows outside the fullest shard of a text that is larger than any shard: all but a quota."""
    most = -(-len(texts) // shards)
    return sum(n - len(texts) // shards for n in Counter(t or "" for _, t in texts).values() if n > most)


@pytest.mark.parametrize("sizes", [[200] * 4, [390] * 9 + [100], [400] * 10, [100, 150, 200, 250, 300, 350, 400], [133] * 30, [399, 2, 2, 2] * 8, [900, 300, 100]])
def test_groups_that_fit_are_not_cut(spark, sizes):
    texts = grouped(sizes, 4000)
    got = m.assigned(odd(spark, texts), 10).collect()
    check(got, texts, 10)
    assert cut(got) == fewest_cut(texts, 10)


def test_groups_without_room_are_cut_least(spark):
    texts = grouped([300] * 13, 4000)  # ten fit whole; the others find 100 places in each shard
    got = m.assigned(odd(spark, texts), 10).collect()
    check(got, texts, 10)
    copies = Counter(zlib.crc32(t.encode()) for _, t in texts)
    assert sum(n == 1 for t, n in whole(got).items() if copies[t[0]] == 300) == 10 and cut(got) <= 3 * 225


def whole(got):
    """Of each text, as CRC and size, the number of shards it is in."""
    by = defaultdict(set)
    for r in got:
        by[r.text_crc32, r.size].add(r.shard)
    return {t: len(s) for t, s in by.items()}


def test_hot_group_and_odd_rows(spark):
    texts = [(i, "hot") for i in range(700)] + [(i, f"t{i}") for i in range(700, 1000)] + [(None, None), (None, ""), (5, "é" * 30_000)]
    got = m.assigned(odd(spark, texts), 10).collect()
    check(got, texts, 10)
    assert cut(got) == fewest_cut(texts, 10)


def test_all_linked(spark):
    texts = [(i, f"pair {i // 2}") for i in range(500)]
    got = m.assigned(odd(spark, texts), 8).collect()
    check(got, texts, 8)
    assert cut(got) <= 4  # 62 or 63 rows a shard: a pair is cut for every two shards of 63


def test_empty_and_tiny(spark):
    assert m.assigned(odd(spark, []), 4).count() == 0
    check(m.assigned(odd(spark, [(1, "a"), (1, "a")]), 4).collect(), [(1, "a"), (1, "a")], 4)
