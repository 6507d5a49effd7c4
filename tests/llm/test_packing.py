import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import byte_bpe
from quire.llm import packing as m
from tests.llm.util import odd

PATH = m.default_path()


def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def own(text):
    return np.frombuffer(byte_bpe.encoder(PATH)(text), "<u4").tolist()


TEXTS = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b c", "it's 's  's", "a\nb", "a \nb", "a\n b", "a  b", "naïve 123 x9!!! ...", "don't  \n\t x", "<|endoftext|> a", "\x1c a \x1d", "日本 語 𝔘", "\n\n a b\n"]


def test_ids_equal_the_library(sf):
    import pyarrow.parquet as pq

    ids = library()
    for t in TEXTS + pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()[:60]:
        assert own(t) == ids(t), t[:80]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t'sab1.é　 \x1c-"), max_size=20))
def test_ids_equal_the_library_on_white_space(text):
    assert own(text) == LIBRARY(text)


LIBRARY = library()


def check(got, docs, capacity):
    want = []
    for i, t in docs:
        ids = [*LIBRARY(t or ""), 0]
        first = len(ids) % capacity or capacity
        bounds = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            want.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for x in by.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


def best_fit(sizes, capacity):
    gaps = Counter()
    n = 0
    for s in sorted(sizes, reverse=True):
        g = min((g for g in gaps if g >= s), default=None)
        if g is None:
            n, g = n + 1, capacity
        else:
            gaps[g] -= 1
            gaps += Counter()
        gaps[g - s] += 1
    return n


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = m.packed(docs, PATH).collect()
    n = check(got, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert n == best_fit([r.length for r in got], 2048)


def test_odd_rows(spark):
    data = [(1, None), (2, ""), (None, "a b"), (None, "a b"), (2**62 + 1, "large id"), (3, "x y"), (3, "z"), (3, "z"), (4, "word " * 30_000), (5, "w" * 5000)] + [(10 + i, "same text") for i in range(300)]
    check(m.packed(odd(spark, data), PATH, 64).collect(), data, 64)
    assert m.packed(odd(spark, []), PATH).count() == 0


def test_sequences(spark):
    data = [(i, "word " * (i % 9 + 1)) for i in range(50)] + [(3, "other"), (3, "other")]
    found = m.stored_pieces(odd(spark, data), PATH, 32)
    places = m.placed(m.sized(found), 32)
    out = [np.frombuffer(r.ids, "<u4").tolist() for r in m.sequences(found, places).collect()]
    assert all(len(x) <= 32 for x in out)
    assert sum(map(len, out)) == sum(len(LIBRARY(t)) + 1 for _, t in data)


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit_decreasing(seed):
    random.seed(seed)
    capacity = random.choice([7, 20, 100])
    sizes = [random.randint(1, random.randint(1, capacity)) for _ in range(random.randint(1, 400))]
    counts = Counter(sizes)
    seen, used = Counter(), Counter()
    runs = sorted(m.plan(counts, capacity))
    for k, (size, low, each, base, offset) in enumerate(runs):
        high = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == size else counts[size]
        seen[size] += high - low
        for r in range(low, high):
            used[base + (r - low) // each] += size
            assert offset + (r - low) % each * size + size <= capacity
    assert seen == counts and max(used.values()) <= capacity and len(used) == best_fit(sizes, capacity)


def test_added_tokens_are_ids():
    t = Tokenizer.from_file(PATH)
    code = byte_bpe.encoder(PATH, added=True)
    for text in [*TEXTS, "<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|><|endoftext|>\n b", "<|endoftext| >"]:
        assert np.frombuffer(code(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_long_runs():
    for text in ("a" + " " * 3_000_000 + "b", "\n" * 60_000, "w" * 200_000, "<|endoftext|>" + " " * 200_000):
        t = Tokenizer.from_file(PATH)
        assert np.frombuffer(byte_bpe.encoder(PATH, added=True)(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_packing_takes_added_tokens_as_ids(spark):
    got = m.packed(odd(spark, [(1, "<|endoftext|>")]), PATH).collect()
    assert [r.length for r in got] == [2]
