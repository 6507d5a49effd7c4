from pyspark.sql import functions as F

from quire.llm import exact_dedup as m
from tests.llm.util import duck, odd, rows


def test_equals_sql(spark, sf):
    assert rows(m.query(spark, sf)) == duck(m.SQL, sf)


def test_odd_rows(spark):
    long = "x " * 60_000
    data = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, "A"), (5, "a "), (None, "a"), (6, long), (7, long), (None, "z")]
    got = {(r.doc_id, r.text_sha256[:0], r.keep_id, r.group_size, r.kept) for r in m.duplicates(odd(spark, data)).collect()}
    assert got == {(1, "", 2, 2, False), (2, "", 2, 2, True), (3, "", 3, 3, True), (4, "", 4, 1, True), (5, "", 5, 1, True),
                   (None, "", 3, 3, False), (6, "", 7, 2, False), (7, "", 7, 2, True), (None, "", None, 1, True)}
    assert m.duplicates(odd(spark, data)).count() == len(data)


def test_digest_clash_is_settled_by_content(spark):
    data = [(i, f"t{i % 3}") for i in range(30)]
    weak = m.duplicates(odd(spark, data), digest=lambda c: F.unhex(F.lit("00")))
    assert rows(weak) == rows(m.duplicates(odd(spark, data)))
    assert {r.group_size for r in weak.collect()} == {10}


def test_empty(spark):
    assert m.duplicates(odd(spark, [])).count() == 0


def test_large_group(spark):
    got = m.duplicates(odd(spark, [(i, "same") for i in range(3000)])).collect()
    assert {r.keep_id for r in got} == {2999} and sum(r.kept for r in got) == 1


def test_kept_documents(spark):
    docs = odd(spark, [(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, None), (4, ""), (None, "q")])
    assert sorted((r.doc_id or 0, r.text) for r in m.kept_documents(docs).collect()) == [(0, "q"), (1, "b"), (2, "a"), (4, "")]
    assert m.kept_documents(docs).columns == docs.columns
