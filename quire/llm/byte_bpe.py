"""Byte-level BPE ids of whole texts, as the `tokenizers` library gives them for the same vocabulary file with
add_special_tokens off: with `added`, strings of the file's added tokens are cut out and become their ids, as by default
there; without, they are ordinary text, as with encode_special_tokens set.

Texts are encoded as a whole. One with a run of white space that is too long for tiktoken's matcher is encoded by
`tokenizers`, with the same ids.
"""

from __future__ import annotations

import json
import re
from array import array

import tiktoken
from tokenizers import Tokenizer

#: The pre-tokenizer's pattern and the byte alphabet of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

LONG_RUN = 50_000
LONG = re.compile(rf"\s{{{LONG_RUN}}}")


def byte_of() -> dict[str, int]:
    out = {chr(b): b for b in PRINTABLE}
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> dict[bytes, int]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    b = byte_of()
    return {bytes(b[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}


def added_tokens(path: str) -> dict[str, bytes]:
    """Ids, as bytes, of the file's added tokens."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"].to_bytes(4, "little") for t in json.load(f).get("added_tokens", [])}


class Encoder:
    def __init__(self, path: str, added: bool = False):
        ranks = vocabulary(path)
        self.bpe = tiktoken.Encoding("quire", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path = path
        self.added = added_tokens(path) if added else {}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")

    def whole(self, text: str) -> bytes:
        if len(text) >= LONG_RUN and LONG.search(text):
            plain = Tokenizer.from_file(self.path)
            plain.encode_special_tokens = True
            return array("I", plain.encode(text, add_special_tokens=False).ids).tobytes()
        return self.bpe.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """Ids as bytes of little-endian 32-bit numbers."""
        if any(t in text for t in self.added):
            return b"".join(self.added[p] if p in self.added else self.whole(p) for p in self.cut.split(text) if p)
        return self.whole(text)


_LOADED: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, added: bool = False) -> Encoder:
    """One for each Python worker."""
    if (path, added) not in _LOADED:
        _LOADED[path, added] = Encoder(path, added)
    return _LOADED[path, added]
