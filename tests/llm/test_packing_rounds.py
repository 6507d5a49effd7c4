import random
from collections import defaultdict

import pytest

from quire.llm import packing_rounds as m
from tests.llm.test_packing import best_fit


def check(spark, sizes, capacity, ranges=4):
    rows = spark.createDataFrame(list(enumerate(sizes)), "id long, size long")
    out, rounds = m.placed(rows, capacity, ranges)
    got = out.collect()
    assert sorted(r.id for r in got) == list(range(len(sizes)))
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, sizes[r.id]))
    for x in by.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by), rounds


@pytest.mark.parametrize("seed", range(1))
def test_rounds_pack_about_as_well_as_best_fit(spark, seed):
    random.seed(seed)
    sizes = [random.randint(1, random.choice([20, 50, 100])) for _ in range(400)]
    n, rounds = check(spark, sizes, 100)
    assert n <= best_fit(sizes, 100) * 1.03 + 1 and rounds < 60


def test_odd_sizes(spark):
    assert check(spark, [100, 100, 51, 49, 1], 100)[0] == 4
    assert check(spark, [5], 100) == (1, 1)
    out, rounds = m.placed(spark.createDataFrame([], "id long, size long"), 100)
    assert out.count() == 0 and rounds == 0
