import random
import zlib

import numpy as np
import pytest

from quire.llm import toxicity as m
from tests.llm.util import odd


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = m.predictions(docs, labels).collect()
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    hits = sum(r.predicted == truth[r.doc_id] for r in held)
    assert len(held) > 40 and hits / len(held) > 0.975 and sum(truth[r.doc_id] for r in held) > 3


def brute(s):
    """Maximal segments by their definition: the best segment, then the same left and right of it."""

    def split(a, b):
        best = None
        for i in range(a, b):
            for j in range(i + 1, b + 1):
                x = sum(s[i:j])
                if x > 1e-12 and (best is None or x > best[0] + 1e-12 or abs(x - best[0]) <= 1e-12 and j - i < best[2] - best[1]):
                    best = (x, i, j)
        return [] if best is None else [*split(a, best[1]), (best[1], best[2]), *split(best[2], b)]

    return split(0, len(s))


@pytest.mark.parametrize("seed", range(150))
def test_segments_are_the_maximal_ones(seed):
    random.seed(seed)
    s = [random.choice([-1, 1]) * random.random() for _ in range(random.randint(0, 16))]
    found = m.segments(np.array(s, np.float64))
    assert [(f, e) for f, e, _ in found] == brute(s)
    assert all(abs(sum(s[f:e]) - x) < 1e-9 for f, e, x in found)


def corpus(n=600):
    random.seed(3)
    clean = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    docs, labels = [], []
    for i in range(n):
        words = random.choices(clean, k=random.randint(5, 200))
        toxic = random.random() < 0.3
        if toxic:
            at = random.randint(0, len(words))
            words[at:at] = random.choices(["scum", "idiot", "moron"], k=3)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic), "x"))
    return docs, labels


def test_passages_and_odd_rows(spark):
    docs, labels = corpus()
    long = "waa wab " * 50_000
    docs += [(None, "scum idiot moron"), (1000, None), (1001, ""), (1002, "123 !!"), (1003, long + "Scum, idiot: moron! " + long), (1004, long), (5, "waa scum moron idiot"), (5, "waa scum moron idiot")]
    labels += [(None, 1, 1, "x"), (1000, 1, None, "x"), (7, 0, 1, "x"), (7, 0, 0, "x")]
    d, lab = odd(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, score string")
    got = m.predictions(d, lab).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = {i: t for i, _, t, _ in labels[:600] if i not in (5, 7)}
    assert all(r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth)
    by = {r.doc_id: r for r in got}
    assert [by[i].predicted for i in (None, 1000, 1001, 1002, 1003, 1004, 5)] == [1, 0, 0, 0, 1, 0, 1]
    model = m.learned(d, lab)
    found = {r.doc_id: r.passages for r in m.passages(d.select("doc_id", "text"), model).collect()}
    (p,) = found[1003]
    assert (long + "Scum, idiot: moron! " + long)[p.start : p.end] == "Scum, idiot: moron" and found[1004] == []


def test_nothing_to_learn_from(spark):
    d = odd(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in m.predictions(d, none).collect()} == {(0.0, 0)}
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in m.predictions(d, one).collect()} == {(1.0, 1)}
    assert m.predictions(odd(spark, []), none).count() == 0


def test_extreme_value():
    decay, scale = m.extreme_value(np.array([1.0, -1.0]), np.array([1.0, 3.0]))
    assert abs(decay - np.log(3)) < 1e-6 and scale == 0.25


def brute_scores(docs, labels):
    """Scores of all texts (doc_id: text) with plain dictionaries, and segments found by trying all cuts of the sums."""
    import math
    import zlib
    from collections import Counter

    rows = {(docs[i] or "", y) for i, y in labels if i in docs and y in (0, 1) and zlib.crc32(str(i).encode()) % 5}
    by = {y: Counter() for y in (0, 1)}
    for t, y in rows:
        by[y].update({f for w in m.LETTERS.findall(t.lower()) for f in (w, *(w[:k] + "*" for k in m.STEMS if len(w) > k))})
    n = {y: sum(c.values()) for y, c in by.items()}
    scores = {}
    for f in by[0] | by[1]:
        own = m.FLAT + m.PRIOR * (by[0][f] + by[1][f]) / (n[0] + n[1])
        side = lambda y: math.log((by[y][f] + own) / (n[y] + m.PRIOR - by[y][f] - own))  # noqa: B023, E731
        s = side(1) - side(0)
        if abs(s / math.sqrt(1 / (by[1][f] + own) + 1 / (by[0][f] + own))) >= m.Z_LEAST:
            scores[f] = s - m.DRIFT
    rest = [n[y] - sum(by[y][f] for f in scores) for y in (0, 1)]
    rest = math.log((rest[1] + 1) / (n[1] + 1)) - math.log((rest[0] + 1) / (n[0] + 1)) - m.DRIFT

    def tokens(t):
        return [next((scores[f] for f in (w, *(w[:k] + "*" for k in m.STEMS if len(w) > k)) if f in scores), rest) for x in t.split() for w in m.LETTERS.findall(x.lower())]

    clean = Counter(np.float32(s) for t, y in rows if y == 0 for s in tokens(t))
    decay, scale = m.extreme_value(np.array(list(clean), float), np.array(list(clean.values()), float))

    def best(x):
        """(score) of maximal segments: the best one, and those left and right of it (Ruzzo and Tompa's definition)."""
        out, todo = [], [(0, len(x))]
        total = np.concatenate(([0.0], np.cumsum(np.array(x, np.float32), dtype=np.float64)))
        while todo:
            a, b = todo.pop()
            top, low = (0.0, 0, 0), a
            for e in range(a + 1, b + 1):
                if total[e - 1] < total[low]:
                    low = e - 1
                if total[e] - total[low] > top[0] + 1e-12:
                    top = (total[e] - total[low], low, e)
            if top[0] > 0:
                out.append(top[0])
                todo += [(a, top[1]), (top[2], b)]
        return out

    def total(t):
        x = tokens(t or "")
        return sum(e for s in best(x) if (e := decay * s - math.log(max(scale * len(x), 1e-300))) > -math.log(m.E_MOST))

    known = Counter(y for i, y in labels if i is not None and y in (0, 1) and zlib.crc32(str(i).encode()) % 5)
    x = np.log1p([total(t) for t, _ in rows])
    a, b = m.curve(x, np.array([y for _, y in rows], float), np.ones(len(rows)))
    return {i: 1 / (1 + math.exp(-max(-30.0, min(30.0, a * math.log1p(total(t)) + b)))) for i, t in docs.items()}, known


def test_whole_result_against_brute_force(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    want, _ = brute_scores({r.doc_id: r.text for r in docs.collect()}, [(r.doc_id, r.toxic) for r in labels.collect()])
    got = {r.doc_id: r.score for r in m.predictions(docs, labels).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-3 for i in want)


def test_every_significant_token_is_kept(spark):
    counts = spark.range(120_000).selectExpr("concat('t', id) AS token", "if(id % 2 = 0, 300L, 0L) AS n0", "if(id % 2 = 0, 0L, 300L) AS n1")
    odds, _ = m.log_odds(counts, m.PRIOR, m.Z_LEAST)
    assert len(odds) == 120_000 and odds["t1"] > 0 > odds["t0"]
