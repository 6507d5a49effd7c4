"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass over distinct words.

A text, with spaces turned into marks, falls into words: a mark or more and what follows up to the next mark. No piece
crosses a word's start (checked when a model is loaded), so words are encoded on their own. The distinct new words of a
batch of rows are sorted, which lays their trie out depth first: each word keeps the forward states of the prefix that it
shares with the one before and continues from there. Ids of words are kept for later batches.

For unigram models a state is the best score and the last piece of a prefix. For BPE models, as the given file, a
prefix has one encoding only, and a sequence of pieces is an encoding if and only if each two neighbours, alone,
encode as themselves; the state is its last piece, and the step looks for the one piece that may follow. Either way
results equal the library's. Characters without a piece become byte pieces.

Defined cases: a null text counts as empty and has no ids; marks (U+2581) within a text decode as spaces, as in the
library; a null doc_id is kept; rows that repeat are rows of their own; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import sliced_batches, table

MARK = "▁"
UNIGRAM, BPE = 1, 2  # fixed values: model types of the file format
UNKNOWN_PENALTY = 10.0
WORDS_KEPT = 400_000
PAIRS_KEPT = 2_000_000
LONGEST_KEPT = 64
BATCH_ROWS = 500
UNIT = re.compile(f"{MARK}+[^{MARK}]*")
ENCODED = "doc_id long, ids binary"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    def __init__(self, path: str | None = None, proto: bytes | None = None):
        from sentencepiece import sentencepiece_model_pb2 as pb

        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        spec = pb.ModelProto.FromString(proto)
        n = spec.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not n.escape_whitespaces:
            raise ValueError("only models that leave texts as they are, and mark their start, are supported")
        self.kind = spec.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.kind} isn't supported")
        p = sentencepiece.SentencePieceProcessor(model_proto=proto)
        ids = range(p.get_piece_size())
        own = [i for i in ids if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))]
        self.ids = {p.id_to_piece(i): i for i in own}
        self.scores = {p.id_to_piece(i): p.get_score(i) for i in own}
        self.unknown = p.unk_id()
        self.bytes = {int(p.id_to_piece(i)[3:5], 16): i for i in ids if p.is_byte(i)}
        if any(MARK in x.lstrip(MARK) for x in self.ids):
            raise ValueError("a piece crosses a word's start")
        self.longest = max(map(len, self.ids))
        self.least = min(self.scores.values()) - UNKNOWN_PENALTY
        back = {i: x.replace(MARK, " ").encode() for x, i in self.ids.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.text_of = [back.get(i, b" \xe2\x81\x87 " if i == self.unknown else b"") for i in ids]
        self.words: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    # Words

    def merged(self, word: str) -> list[str]:
        """BPE by its definition: the pair of best score first, the leftmost of equals."""
        parts = list(word)
        while True:
            best = None
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best[0]):
                    best = (s, i)
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def follows(self, last: str, piece: str) -> bool:
        key = (last, piece)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(last + piece) == ([last, piece] if last else [piece])
        return known

    def step(self, word: str, at: int, states: list) -> tuple:
        """The state of word[:at + 1], from those of its prefixes: (score, last piece)."""
        end = at + 1
        if self.kind == BPE:
            for size in range(1, min(self.longest, end) + 1):
                piece = word[end - size : end]
                if (size == 1 or piece in self.ids) and self.follows(states[end - size][1], piece):
                    return (0.0, piece)
            raise AssertionError(f"no encoding of {word[:end]!r}")
        best = None
        for size in range(min(self.longest, end), 0, -1):
            piece = word[end - size : end]
            score = self.scores.get(piece, self.least if size == 1 else None)
            if score is not None and (best is None or states[end - size][0] + score > best[0]):
                best = (states[end - size][0] + score, piece)
        return best

    def pieces(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """Pieces of each of the sorted words: a depth-first walk of their trie."""
        states: list[tuple] = [(0.0, "")]
        before = ""
        for word in words:
            same, most = 0, min(len(before), len(word))
            while same < most and before[same] == word[same]:
                same += 1
            del states[same + 1 :]
            for at in range(same, len(word)):
                states.append(self.step(word, at, states))
            out, end = [], len(word)
            while end:
                out.append(states[end][1])
                end -= len(out[-1])
            before = word
            yield word, out[::-1]

    def numbers(self, pieces: list[str]) -> list[int]:
        out = []
        for x in pieces:
            i = self.ids.get(x)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in x.encode("utf-8", "replace")]
            else:
                out.append(self.unknown)
        return out

    # Texts

    def units(self, text: str) -> list[str]:
        """Words without their first mark."""
        if MARK not in text and "  " not in text:
            return text.split(" ") if text and text[0] != " " else UNIT_KEYS(MARK + text.replace(" ", MARK)) if text else []
        return UNIT_KEYS(MARK + text.replace(" ", MARK))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit numbers."""
        units = [self.units(t) for t in texts]
        new = set().union(*units).difference(self.words) if units else set()
        for word, found in self.pieces(sorted(MARK + w for w in new)):
            self.words[word[1:]] = np.array(self.numbers(found), "<u4").tobytes()
        out = [b"".join(map(self.words.__getitem__, u)) for u in units]
        for w in new:
            if len(w) > LONGEST_KEPT:
                del self.words[w]
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        return out

    def decode(self, ids: bytes) -> str:
        found = b"".join(map(self.text_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return found[1:] if found.startswith(" ") else found


def UNIT_KEYS(marked: str) -> list[str]:
    return [u[1:] for u in UNIT.findall(marked)]


_LOADED: dict[str, Model] = {}


def model(path: str) -> Model:
    """One for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Model(path)
    return _LOADED[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """ENCODED of docs (doc_id, text): ids are little-endian unsigned 32-bit numbers."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in sliced_batches(batches, BATCH_ROWS):
            ids = m.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(encode, ENCODED)


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text of ENCODED rows."""

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in sliced_batches(batches, BATCH_ROWS):
            texts = [m.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return rows.select("doc_id", "ids").mapInArrow(decode, f"{ENCODED}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_chars, decoded_sha256 of every document."""
    path = default_path()
    rows = decoded(encoded(table(spark, sf_dir, "documents"), path), path)
    return rows.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
        F.length("text").cast("long").alias("decoded_chars"), F.sha2("text", 256).alias("decoded_sha256"),
    )
