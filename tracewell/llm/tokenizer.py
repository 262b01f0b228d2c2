"""Byte-level BPE ids from the tokenizers library, with the ids of recent pieces kept.

The pre-tokenizer cuts a text into pieces (words with the blank before them, numbers, runs of signs, white space), and
the model encodes each piece by itself. So a text's ids are those of its pieces, one after another. Pieces are found by
the pre-tokenizer's own pattern and their ids, as the library's model gives them, are kept. Texts with characters whose
classes the pattern below doesn't spell out (control characters, characters beyond Latin) or with the special token's
text go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from .common import Recent

#: Letters and numbers among the characters up to U+024F, and the pattern of the pre-tokenizer with these classes.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+"
#: What the classes are not spelled out for.
UNPROVEN = re.compile(r"[^\t\n\x0b\x0c\r\x20-\x7e\xa1-ɏ]|<\|")
#: Characters of one byte in Latin-1 that are spelled out.
PROVEN_BYTES = bytes([9, 10, 11, 12, 13, *range(0x20, 0x7F), *range(0xA1, 0x100)])


def proven(text: str) -> bool:
    """Whether the pieces of the text are sure to be the library's."""
    try:
        return not text.encode("latin-1").translate(None, PROVEN_BYTES) and "<|" not in text
    except UnicodeEncodeError:
        return not UNPROVEN.search(text)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if printable in Latin-1, else the next one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    """texts to uint32 ids, as little-endian bytes."""

    def __init__(self, path: str, max_pieces: int = 500_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.pieces_of = re.compile(PIECES).findall
        self.pieces = Recent(self._piece_ids, max_pieces)

    def _piece_ids(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def ids(self, text: str | None) -> bytes:
        text = text or ""
        if not proven(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.pieces.__getitem__, self.pieces_of(text)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per file in a Python worker; tasks that the worker runs later find its pieces again."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
