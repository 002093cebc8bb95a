"""Tokenizer files of the ``tokenizers`` library, with a memory of pieces.

Merging never crosses the pieces that a tokenizer's pattern cuts a text into,
so a piece that came before need not be merged again.  ``Pieces`` remembers
the ids of pieces (a fixed number of them, then it starts anew); a new
piece is merged by the library's own model.  Texts with characters outside
``SIMPLE``, where Unicode tables of Python and the library could differ, go
through the library whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

#: Pieces that are remembered at most (about 200 bytes each).
MEMORY = 400_000
#: Characters whose class, case and normal form are the same everywhere: ASCII and U+00C0 to U+012F.
NOT_SIMPLE = re.compile("[^\t-\r -~À-į]")


def byte_letters() -> list[str]:
    """The character that byte-level tokenizers write for each byte: printable
    Latin-1 characters stand for themselves, the others follow from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + rest.index(b)) for b in range(256)]


LETTERS = byte_letters()
_TO_LETTERS = dict(enumerate(LETTERS))


class Pieces(dict):
    """Piece to the bytes of its ids (little-endian unsigned 32-bit)."""

    def __init__(self, merge, memory: int = MEMORY):
        self.merge, self.memory = merge, memory

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.memory:
            self.clear()
        self[piece] = out = self.merge(piece)
        return out


class Vocabulary:
    def __init__(self, text: str):
        """``text``: the tokenizer file."""
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        config = json.loads(text)
        self.added = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.added_re = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.ids = config["model"]["vocab"]

    def merge(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(_TO_LETTERS)
        return np.fromiter((t.id for t in self.model.tokenize(letters)), "<u4").tobytes()

    def encode_whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @cached_property
    def token_bytes(self) -> list[bytes]:
        """The bytes of each id (byte-level vocabularies)."""
        back = {c: b for b, c in enumerate(LETTERS)}
        out = [b""] * (1 + max([*self.ids.values(), *self.added.values()]))
        for token, i in self.ids.items():
            out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.added.items():
            out[i] = token.encode()
        return out


_KEPT: dict[int, Vocabulary] = {}


def kept(text: str, kind=Vocabulary) -> Vocabulary:
    """The vocabulary of a tokenizer file; the worker keeps the last one."""
    key = hash((kind.__name__, text))
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = kind(text)
    return _KEPT[key]


def read_file(path: str) -> str:
    """Read on the driver; tasks get it by broadcast (a few MB, whatever the corpus)."""
    with open(path, encoding="utf-8") as f:
        return f.read()
