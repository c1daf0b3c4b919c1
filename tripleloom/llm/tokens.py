"""Token ids of whole texts with a public tokenizer file.

The tokenizer drops white space and never joins across it, so a text's ids are
the ids of its pieces between spaces and line feeds, one after another.  A
worker therefore encodes each distinct piece once and keeps its ids in a
bounded memory.  A piece that is a Latin-1 word with marks behind it needs
neither normalizing nor splitting beyond that: the library's model gets it as
it is.  Every other piece goes through the library's whole pipeline.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: Pieces kept by a worker, and the longest piece that is kept.
MEMORY, PIECE = 1_000_000, 32
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:*$%&#]*)").fullmatch


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in itself]
    return {b: b for b in itself} | {b: 256 + i for i, b in enumerate(others)}


class _Memory(dict):
    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece):
        ids = self.encode(piece)
        if len(piece) <= PIECE:
            if len(self) >= MEMORY:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes (null: none)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model, self.letters = self.tok.model, _byte_letters()
        self.memory = _Memory(self._piece)
        # only a pipeline for which the shortcut gives the same ids takes it
        probe = ["Thing,", "ÀÉÿß***", "Straße.", "ñandú", "The", "it!!"]
        self.short = True
        self.short = all(self._piece(p) == self._whole(p) for p in probe)
        # and only one that drops white space between words, and keeps no space with a word, has its texts cut there
        self.cut = True
        texts = ["a b", " The  thing,\nñandú !! ", "x\n\n y", "it's  3.5 %", "\t1 2\r\n3", "end. New Straße", "  ", "漢字 かな é"]
        self.cut = all(ids == self._whole(t) for ids, t in zip(self.encode(texts), texts, strict=True))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        if self.short and (m := _PLAIN(piece)):
            word, marks = m.groups()
            word = word.lower()
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self.letters)
            ids = np.array([t.id for t in self.model.tokenize(word)], dtype="<u4").tobytes()
            return ids + self._marks(marks) if marks else ids
        return self._whole(piece) if piece else b""

    def _marks(self, marks: str) -> bytes:
        if (ids := self.memory.get(marks)) is None:
            ids = self._whole(marks)
            if len(marks) <= PIECE:
                self.memory[marks] = ids
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.cut:
            return [self._whole(text) if text else b"" for text in texts]
        get = self.memory.__getitem__
        return [b"".join(map(get, text.replace("\n", " ").split(" "))) if text else b"" for text in texts]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """The worker's encoder; it and its memory last from task to task."""
    return Encoder(path)
