import random
import zlib

import numpy as np

from quire.llm import language_id as m
from tests.llm.util import ODD, odd

WORDS = {"en": "the and with this that over".split(), "de": "der und für nicht straße mit".split(), "xx": "къде това няма само още".split()}


def corpus(n=300):
    random.seed(2)
    return [(i, " ".join(random.choices(WORDS[k], k=random.randint(3, 30))), k) for i in range(n) for k in [random.choice(list(WORDS))]]


def frame(spark, data):
    return spark.createDataFrame([(i, t, k, "s", None, 1, 2, 0.5, 3) for i, t, k in data], ODD)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = m.predictions(docs).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and len(held) > 200
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.99


def test_odd_rows(spark):
    data = corpus() + [(None, None, "en"), (None, "the and with", None), (900, "", "en"), (901, "123 !!", "en"), (902, "a", "en"), (903, "the and " * 300_000, None), (3, "mit der straße", "en"), (904, "一二三四五", None)]
    got = m.predictions(frame(spark, data)).collect()
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got}
    for i, t, k in data[:300]:
        if i != 3:
            assert by[i].lang_pred == k
    assert [by[i].lang_pred for i in (900, 901, 903)] == ["und", "und", "en"] and by[900].score == 0 and by[902].lang_pred in WORDS
    assert sorted(r.lang_pred for r in got if r.doc_id is None) == ["en", "und"] and all(0 <= r.score <= 1 for r in got)
    kept = m.accepted(frame(spark, data))
    assert kept.columns == frame(spark, data).columns and kept.count() == len(data) - 3


def test_nothing_to_learn_from(spark):
    assert {r.lang_pred for r in m.predictions(odd(spark, [(1, "a b c")], None)).collect()} == {"und"}
    assert m.predictions(odd(spark, [])).count() == 0


def test_many_languages(spark):
    data = [(i, f"{chr(0x4E00 + i % 70) * 3} " * 20, f"l{i % 70:02}") for i in range(700)]
    got = m.predictions(frame(spark, data)).collect()
    assert sum(r.lang_pred == f"l{r.doc_id % 70:02}" for r in got) == 700


def grams_one_by_one(text):
    out, last = [32], 32
    for c in text:
        f = int(m.fold()[ord(c)])
        if f != 32 or last != 32:
            out.append(f)
        last = f
    if last != 32:
        out.append(32)
    return max(0, len(out) - m.N + 1), sum(m.fold()[ord(c)] != 32 for c in text)


def test_grams_of_texts_together_and_alone():
    texts = ["", "a", "ab cd", "  the   --- end!", "x" * 50, "\n", "É à ç", "tail "]
    h, n, letters = m.grams(texts)
    alone = [m.grams([t]) for t in texts]
    assert np.array_equal(h, np.concatenate([a[0] for a in alone])) and n.tolist() == [int(a[1][0]) for a in alone]
    assert [(int(a), int(b)) for a, b in zip(n, letters)] == [grams_one_by_one(t) for t in texts]
    assert np.array_equal(m.grams(["The  End"])[0], m.grams(["the--end"])[0])


def test_filters_contain_all_that_was_put_in():
    h = m.grams(["some text that is put in"])[0]
    filters = np.zeros((1, m.SLOTS), np.uint64)
    for k in range(m.HASHES):
        np.bitwise_or.at(filters[0], m.slots(h, k), np.uint64(1))
    model = m.Model(("en",), filters, np.array([0.0]), 0, 1.0)
    assert m.shares(["text that is put"], model)[0][0, 0] == 1


def test_accepted_without_any_language(spark):
    docs = odd(spark, [(1, "some words"), (2, "123 !"), (3, None), (4, "")], lang=None)
    out = m.accepted(docs)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [1]


def test_letters_of_every_plane(spark):
    assert m.grams([chr(0x30000) + chr(0x30001)])[2].tolist() == [2]
    data = [(i, f"{chr(0x30000 + i % 2 * 50)}{chr(0x30001 + i % 2 * 50)} " * 20, f"l{i % 2}") for i in range(100)]
    assert {(r.doc_id % 2, r.lang_pred) for r in m.predictions(frame(spark, data)).collect()} == {(0, "l0"), (1, "l1")}


def test_the_prediction_decides_what_is_accepted(spark):
    data = corpus() + [(900, "ප්රකා ශයට " * 10, None), (901, "qzxj vkwq " * 30, None), (902, "qz", None), (903, "der und mit nicht " * 5 + "qzxj vkwq " * 5, None)]
    kept = {r.doc_id for r in m.accepted(frame(spark, data)).collect()}
    assert kept == set(range(300)) | {902, 903}


def brute(data, sample):
    """Predictions with sets of n-grams instead of filters, without false positives: (language, share of each)."""
    fold = lambda t: "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in t)
    cut = lambda t: (lambda p: [p[i : i + m.N] for i in range(len(p) - m.N + 1)])(" " + " ".join(fold(t).split()) + (" " if fold(t).split() else ""))
    counts = {}
    for i, t, lang in data:
        if t is not None and lang is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            c = counts.setdefault(lang, {})
            for g in cut(t):
                c[g] = c.get(g, 0) + 1
    rate = {k: {g: n / sum(c.values()) for g, n in c.items() if n >= m.LEAST} for k, c in counts.items()}
    most = {}
    for c in rate.values():
        for g, x in c.items():
            most[g] = max(x, most.get(g, 0))
    held = {k: {g for g, x in c.items() if x >= m.SHARE * most[g]} for k, c in rate.items()}
    out = {}
    for i, t, _ in data:
        own = cut(t or "")
        shares = {k: sum(g in s for g in own) / max(1, len(own)) for k, s in held.items()}
        out[i] = shares if any(map(str.isalpha, t or "")) else None
    return out


def test_whole_result_against_sets_of_n_grams(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    data = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    want = brute(data, len(data))
    got = m.predictions(docs, sample=10**9).collect()
    assert len(got) == len(data)
    for r in got:
        shares = want[r.doc_id]
        if shares is None:
            assert r.lang_pred == "und" and r.score == 0
        elif sum(shares.values()) > 0:
            first = max(shares.values())
            assert shares[r.lang_pred] >= first - 0.005 and abs(r.score - shares[r.lang_pred] / sum(shares.values())) < 0.02
