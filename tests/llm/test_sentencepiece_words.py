import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as pb

from quire.llm import sentencepiece_words as m
from tests.llm.util import odd

PATH = m.default_path()


def as_unigram():
    """The same pieces and scores, read as a unigram model."""
    with open(PATH, "rb") as f:
        spec = pb.ModelProto.FromString(f.read())
    spec.trainer_spec.model_type = m.UNIGRAM
    return spec.SerializeToString()


LIBRARY = {m.BPE: sentencepiece.SentencePieceProcessor(model_file=PATH), m.UNIGRAM: sentencepiece.SentencePieceProcessor(model_proto=as_unigram())}
OWN = {m.BPE: m.Model(PATH), m.UNIGRAM: m.Model(proto=as_unigram())}
TEXTS = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b c", "\n", "a\nb\n", "naïve 𝔘 日本 ﬁ ½", "▁x▁▁y", " ▁ ", "<s> </s> <0x0A>", "x" * 300, "the " * 50, " " * 40 + "end", "aaaa bbbb aaab", "a\x00b　c"]


def ids(kind, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in OWN[kind].encode(texts)]


def test_bpe_equals_the_library(sf):
    import pyarrow.parquet as pq

    texts = TEXTS + pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()[:60]
    assert ids(m.BPE, texts) == [LIBRARY[m.BPE].encode(t) for t in texts]
    assert [OWN[m.BPE].decode(x) for x in OWN[m.BPE].encode(texts)] == [LIBRARY[m.BPE].decode(LIBRARY[m.BPE].encode(t)) for t in texts]


WORD = st.text(alphabet=st.sampled_from("aeinrst hol▁É\n.'"), max_size=14)


@settings(max_examples=400, deadline=None)
@given(st.lists(WORD, max_size=5))
def test_bpe_equals_the_library_on_any_text(texts):
    assert ids(m.BPE, texts) == [LIBRARY[m.BPE].encode(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=20))
def test_round_trip(text):
    (x,) = OWN[m.BPE].encode([text])
    assert OWN[m.BPE].decode(x) == text.replace(m.MARK, " ")


def test_unigram_scores_equal_the_library():
    random.seed(4)
    p, own = LIBRARY[m.UNIGRAM], OWN[m.UNIGRAM]
    words = ["".join(random.choices("abcdeinorst", k=random.randint(1, 9))) for _ in range(300)]

    def score(pieces):
        return sum(own.scores[x] for x in pieces)

    for word, pieces in own.pieces(sorted(m.MARK + w for w in words)):
        assert score(pieces) == pytest.approx(score(p.encode(word[1:], out_type=str)), rel=1e-5)


def test_prefixes_are_shared():
    words = sorted(m.MARK + w for w in ("in", "inter", "internal", "international", "internet", "into"))
    steps = []
    own = m.Model(PATH)
    step = own.step
    own.step = lambda word, at, states: steps.append(word[: at + 1]) or step(word, at, states)
    list(own.pieces(words))
    assert len(steps) == len(set(steps)) == len({w[:i] for w in words for i in range(1, len(w) + 1)})


def test_odd_rows(spark):
    data = [(1, None), (2, ""), (None, "a b"), (3, "x"), (3, "x"), (4, "long word " * 20_000)] + [(10 + i, t) for i, t in enumerate(TEXTS)]
    rows = m.decoded(m.encoded(odd(spark, data), PATH), PATH).collect()
    p = LIBRARY[m.BPE]
    want = [(i, np.array(p.encode(t or ""), "<u4").tobytes(), (t or "").replace(m.MARK, " ")) for i, t in data]
    assert sorted([(r.doc_id, bytes(r.ids), r.text) for r in rows], key=repr) == sorted(want, key=repr)
    assert m.encoded(odd(spark, []), PATH).count() == 0


def test_query(spark, sf):
    p = LIBRARY[m.BPE]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = m.query(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got[:80]:
        x = p.encode(texts[r.doc_id])
        assert (r.n_ids, r.ids_crc32) == (len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.decoded_chars == len(texts[r.doc_id]) for r in got)
