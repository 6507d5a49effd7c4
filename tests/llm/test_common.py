import os

from quire.llm import common as m


def test_stored_and_cleanup(spark):
    df = m.stored(spark.range(5), "t")
    path = m._MADE[-1]
    assert df.count() == 5 and os.path.isdir(path) and path.startswith(m.shared_dir(spark))
    m.cleanup(spark)
    assert not os.path.exists(path) and not m._MADE


def test_ranked(spark):
    rows = [(i % 3 if i % 5 else None, i // 7) for i in range(200)]
    out = m.ranked(spark.createDataFrame(rows, "g int, o int"), "r", ["g"], ["o"], 8).collect()
    by = {}
    for x in out:
        by.setdefault(x.g, []).append(x.r)
    assert len(out) == 200 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_small_batches_restore_the_setting(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    sizes = lambda it: ((__import__("pyarrow").RecordBatch.from_pydict({"n": [b.num_rows]})) for b in it)
    with m.small_batches(spark, 7):
        assert max(r.n for r in spark.range(0, 100, 1, 1).mapInArrow(sizes, "n long").collect()) == 7
    assert spark.conf.get(key) == before


def test_cleanup_since_a_mark(spark):
    first = m.stored(spark.range(1), "a")
    at = m.mark()
    m.stored(spark.range(2), "b")
    last = m.stored(spark.range(3), "c")
    gone = m._MADE[at]
    m.cleanup(spark, at, but=1)
    assert not os.path.exists(gone) and (first.count(), last.count(), len(m._MADE)) == (1, 3, at + 1)


def test_a_cluster_needs_a_shared_folder():
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    import pytest

    with pytest.raises(RuntimeError, match="checkpoint"):
        m.shared_dir(Session())
