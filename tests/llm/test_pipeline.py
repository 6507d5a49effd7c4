import corpus_pipeline as m
from quire.llm import packing
from tests.llm import test_ngram_join as joins
from tests.llm import test_packing as packs
from tests.llm import test_secrets as secrets
from tests.llm.util import odd


def mask(text):
    """Overlapping spans together, under the kind of the first."""
    out, at = [], 0
    merged = []
    for start, n, end, kind in secrets.brute(text):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end, kind])
    for start, end, kind in merged:
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]]) if text else text


def expected(data):
    """With texts that are all in a learned language."""
    docs = [(i, t) for i, t in data if t and any(c.isalpha() for c in t)]
    last = {}
    for i, t in docs:
        last[t] = max(i, last.get(t, i))
    docs = [(i, t) for t, i in last.items()]
    first = {c for _, _, c in joins.brute(docs, m.PERCENT, m.WORDS)}
    return [(i, mask(t)) for i, t in docs if i in first]


def run(spark, docs):
    out = []
    for _, stage in m.STAGES:
        docs = stage(spark, docs, "")
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append(docs)
    return out


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    out = run(spark, docs)
    assert [s for s, _ in m.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "secret scans", "best-fit packing"]
    assert all(d.columns == docs.columns for d in out[:4])
    want = expected([(i, t) for i, t in data])
    assert sorted((r.doc_id, r.text) for r in out[3].collect()) == sorted(want) and len(want) < len(data)
    assert all(r.n_chars == len(r.text) for r in out[3].collect())
    packs.check(out[4].collect(), want, packing.CAPACITY)


def test_odd_rows(spark):
    data = [(1, None), (2, ""), (3, "123"), (4, "some words here now"), (5, "some words here now"), (5, "some words here now"), (6, "Some words here now"), (7, "password=hunter22 x"), (8, "long " * 30_000)]
    out = run(spark, odd(spark, data))
    assert sorted((r.doc_id, r.text) for r in out[3].collect()) == [(5, "some words here now"), (7, "[assign] x"), (8, "long " * 30_000)]
    assert all(d.columns == odd(spark, []).columns for d in out[:4])
    assert all(x.count() == 0 for x in run(spark, odd(spark, [])))


def test_the_prediction_decides(spark):
    data = [(i, f"the and with this that over number {i} of some words here") for i in range(60)] + [(100, "ප්රකාශයට " * 20), (101, "зачем " * 20)]
    docs = odd(spark, data[:60]).unionByName(odd(spark, data[60:], lang=None))
    assert {r.doc_id for r in m.language_stage(spark, docs, "").collect()} == set(range(60))


def test_no_languages(spark):
    docs = odd(spark, [(1, "some words"), (2, None), (3, "12")], lang=None)
    assert [r.doc_id for r in m.language_stage(spark, docs, "").collect()] == [1]


def test_run_leaves_its_own_rows_only(spark, sf):
    import os

    from quire.llm import common

    before = set(os.listdir(common.shared_dir(spark)))
    out = m.run(spark, sf)
    assert len([p for p in os.listdir(common.shared_dir(spark)) if p not in before]) == 1 and out.count() > 0
    assert set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
