"""Token ids of the `tokenizers` library for whole texts, through a cache of space-separated chunks.

A byte-level BPE never merges across its pre-tokens, and a pre-token never spans a space that follows a
non-space. So the ids of a text are the ids of its chunks (each with the space before it), put together.
Texts in which white space could be grouped across a chunk's border are encoded whole.
"""

from __future__ import annotations

import json
import re
import struct
from array import array
from functools import lru_cache

import numpy as np

_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_characters() -> dict[int, str]:
    """The visible character that stands for each byte: printable Latin-1 bytes stand for themselves, the others
    follow from U+0100 on in ascending order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def _model(path: str):
    """The file's BPE model without its own cache, which only costs time behind ours."""
    from tokenizers.models import BPE

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return BPE(model["vocab"], merges, cache_capacity=0)


class _Chunks(dict):
    """chunk -> ids as little-endian 32-bit integers; two generations bound its size."""

    def __init__(self, owner: "Encoder", mark: str):
        super().__init__()
        self.owner, self.mark, self.old = owner, mark, {}
        self.lead = mark and _byte_characters()[ord(mark)]

    def __missing__(self, chunk: str) -> bytes:
        got = self.old.get(chunk)
        if got is None:
            got = self.owner._chunk(self, chunk)
        self[chunk] = got
        return got

    def trim(self, most: int) -> None:
        if len(self) > most:
            self.old = dict(self)
            self.clear()


class Encoder:
    """`encode(text)` gives a text's ids as little-endian unsigned 32-bit bytes.

    Texts that hold the string of a special token are encoded whole, as the library finds these strings first. A null
    text counts as empty.
    """

    def __init__(self, path: str, cache_entries: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.most = cache_entries
        self._words, self._heads = _Chunks(self, " "), _Chunks(self, "")
        self._dots = {c: self._whole(c) for c in ".,"}
        self._newline = self._whole("\n")
        self._bytes = _byte_characters()
        self._tokenize = _model(path).tokenize

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, cache: _Chunks, chunk: str) -> bytes:
        if chunk.isalpha() and (chunk.isascii() or max(chunk) < "\u0250"):  # one pre-token
            marked = cache.lead + chunk if chunk.isascii() else (cache.mark + chunk).encode().decode("latin-1").translate(self._bytes)
            return array("I", [t.id for t in self._tokenize(marked)]).tobytes()
        if len(chunk) > 1 and chunk[-1] in self._dots and chunk[:-1].isalpha() and max(chunk) < "\u0250":
            return cache[chunk[:-1]] + self._dots[chunk[-1]]
        before, line, after = chunk.partition("\n")
        if line and before and after and "\n" not in after:
            return cache[before] + self._newline + self._heads[after]
        return self._whole(cache.mark + chunk)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "  " in text or "\n \n" in text or text.endswith("\n ") or _OTHER_SPACE.search(text) or any(map(text.__contains__, self.special)):
            return self._whole(text)
        head, *rest = text.split(" ")
        words = self._words
        out = (self._heads[head] if head else b"") + b"".join(map(words.__getitem__, rest))
        words.trim(self.most)
        self._heads.trim(self.most // 4)
        return out

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode(text), "<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process, which so keep its cache."""
    return Encoder(path)
