import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import ngram_join as m
from quire.llm.common import mark
from quire.llm.components import components
from tests.llm.util import duck, odd, rows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def grams(text, n=3):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def brute(data, percent=90, n=3):
    sets = [grams(t, n) for _, t in data]
    distinct = sorted({s for s in sets if s}, key=len)
    root = {s: s for s in distinct}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if percent * len(b) > 100 * len(a):
                break
            if 100 * len(a & b) >= percent * len(a | b):
                root[find(a)] = find(b)
    low = {}
    for (d, _), s in zip(data, sets, strict=True):
        if s:
            r = find(s)
            low[r] = d if low.get(r) is None else low[r] if d is None else min(low[r], d)
    return sorted(((d, len(s), low[find(s)] if s else d) for (d, _), s in zip(data, sets, strict=True)), key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(m.joined(docs)) == want and sum(d != c for d, _, c in want) > 30


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert rows(m.query(spark, sf)) == duck(m.SQL, sf)


def near(seed, families=12, size=25, length=120, edits=3):
    random.seed(seed)
    word = lambda: "".join(random.choices("abcdefgh", k=4))
    out = []
    for _ in range(families):
        w = [word() for _ in range(random.randint(length // 2, length))]
        for _ in range(size):
            c = list(w)
            for _ in range(random.randint(0, edits)):
                at = random.randrange(len(c))
                c[at : at + random.randint(0, 2)] = [word() for _ in range(random.randint(0, 2))]
            out.append(" ".join(c))
    random.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed,hot,family", [(1, 1000, 400), (2, 3, 7), (3, 1, 4)])
def test_families(spark, seed, hot, family):
    data = near(seed)
    want = brute(data)
    assert got(m.joined(odd(spark, data), hot=hot, family=family)) == want
    assert len({c for _, _, c in want}) > 12


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    ten = " ".join("abcdefghijkl")
    data = [(5, None), (6, ""), (7, " \t\n"), (8, "One two"), (9, "one\ttwo"), (3, "one two three"), (2, "ONE  two three"), (2, "one two three"), (None, "one two three"), (None, "x y z"), (20, ten), (21, ten[:-2]),
            (22, "É a b"), (23, "é a b"), (24, "a\xa0b c d"), (30, long), (31, long + " end"), (32, "x " * 5000), (33, "x x x"), (34, "x x")] + [(100 + i, "many copies of one text") for i in range(500)]
    assert got(m.joined(odd(spark, data))) == brute(data)
    assert m.joined(odd(spark, [])).count() == 0
    kept = m.representatives(odd(spark, [(1, "a b c d"), (2, "a b c d"), (3, None), (4, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4] and kept.columns == odd(spark, []).columns


@pytest.mark.parametrize("seed", range(6))
def test_tree_finds_all_that_link(seed):
    sets = [m.shingles(t) for _, t in near(seed, 6, 20)]
    points, sizes = np.stack([m.vector(s, 16) for s in sets]), np.array([len(s) for s in sets])
    tree = m.RTree(points, sizes)
    for i, a in enumerate(sets):
        found = set(tree.search(points[i], len(a)).tolist())
        assert found >= {j for j, b in enumerate(sets) if m.links(len(a), len(b), m.shared(a, b))}
        assert m.shared(a, sets[0]) == len(set(a.tolist()) & set(sets[0].tolist()))


def test_packed_coordinates_are_upper_bounds():
    v = np.array([[0, 1, 255, 256], [255] * 4, [511, 512, 70_000, 3], [0] * 4])
    shift, c = m.packed(v)
    back = c.astype(np.int64) << shift[:, None]
    assert (back >= v).all() and (back < v + (1 << shift)[:, None]).all() and shift[1] == shift[3] == 0
    assert len(m.packed(np.zeros((0, 4), np.int64))[0]) == 0


def test_hashes_of_texts_together_and_alone():
    texts = [None, "a", "", "a b", "A\tb c", "a b c d e a b c", " \n", "x", "one two three four"]
    h, at = m.hashed(texts)
    alone = [m.shingles(t) for t in texts]
    assert [h[s:e].tolist() for s, e in zip(at, at[1:], strict=False)] == [x.tolist() for x in alone]
    assert [len(x) for x in alone] == [len(grams(t)) for t in texts] and m.shingles("a b").tolist() != m.shingles("a").tolist()
    assert set(m.shingles("a b c").tolist()) < set(alone[5].tolist())


def test_sets_that_may_link_are_split_alike_once():
    for a in range(1, 6000, 7):
        for b in {a, a * 9 // 10 + 1, -(-a * 9 // 10)}:
            of = lambda x: {int(m.shared_out(np.array([x]), 90, o)[0]) for o in (False, True)} - {0}
            assert of(a) & of(b)


def test_long_near_copies(spark):
    random.seed(9)
    data = []
    for f in range(6):
        w = [f"{random.randrange(400)}" for _ in range(random.choice([600, 1100, 2300]))]
        for i in range(8):
            c = list(w)
            for _ in range(random.choice([2, 8, 20, 60])):
                c[random.randrange(len(c))] = "new"
            data.append((10 * f + i, " ".join(c)))
    assert got(m.joined(odd(spark, data))) == brute(data)


@pytest.mark.parametrize("rows,size", [(250, 1 << 20), (3, 50), (100, 1)])
def test_slices(monkeypatch, rows, size):
    monkeypatch.setattr(m, "CHUNK_ROWS", rows)
    monkeypatch.setattr(m, "CHUNK_BYTES", size)
    texts = ["a" * (i * 7 % 40) if i % 5 else None for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts)], names=["i", "t"])
    out = list(m.slices([batch, batch], 1))
    assert [t for b in out for t in b.column(1).to_pylist()] == texts * 2 and all(0 < b.num_rows <= rows for b in out)


def test_runs():
    keys = [1, 1, 2, 3, 3, 3, 3, 3, 4, 5, 5]
    for step in range(1, 12):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + step])], names=["k"]) for i in range(0, len(keys), step)]
        tables = [t.column(0).to_pylist() for t in m.runs(batches, 0)]
        assert [x for t in tables for x in t] == keys and all(a[-1] != b[0] for a, b in zip(tables, tables[1:], strict=False))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 300), (300, 200), (7, 7), (500, 500)] + [(1000, 2000 + i) for i in range(50)]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100, 500: 500, 1000: 1000} | {2000 + i: 1000 for i in range(50)}


@pytest.mark.parametrize("id_bits", [6])
def test_sets_that_share_a_name_are_told_apart(spark, id_bits):
    data = near(5, 6, 12)
    assert got(m.joined(odd(spark, data), id_bits=id_bits)) == brute(data)


def test_components_of_heavy_nodes(spark):
    edges = [(0, i) for i in range(1, 900)] + [(5000 + i, 4000) for i in range(700)] + [(899, 5000)] + [(9000 + i, 9001 + i) for i in range(300)]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {i: 0 for i in [*range(900), 4000, *range(5000, 5700)]} | {9000 + i: 9000 for i in range(301)}


@pytest.mark.parametrize("few", [0, 1, 40, 500])
def test_components_in_rounds_and_at_once(spark, few):
    random.seed(few)
    edges = [(random.randrange(900), random.randrange(900)) for _ in range(400)] + [(5000 + i, 4000) for i in range(300)] + [(5, 5), (7777, 7777)]
    edges += [(8000 + i, 8001 + i) for i in range(200)] + edges[:50]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        low, high = sorted((find(u), find(v)))
        root[high] = low
    frame = spark.createDataFrame(edges, "u long, v long")
    assert {r.node: r.root for r in components(frame, few=few).collect()} == {x: find(x) for x in list(root)}
    assert components(frame.where("u < 0"), few=few).count() == 0


def test_few_edges_take_no_rounds(spark):
    before = mark()
    out = components(spark.createDataFrame([(i, i + 1) for i in range(3000)], "u long, v long"))
    assert mark() - before == 1 and {r.root for r in out.collect()} == {0}
