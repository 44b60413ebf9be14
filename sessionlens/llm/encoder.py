"""Whole texts to token ids with the tokenizers library, remembering what chunks of text encode to.

A byte-level BPE cuts a text by a fixed pattern before merging. A single space between two visible
characters always begins a new cut, and a single line feed between two visible characters is a cut of
its own, so the stretches between them encode alone as they do inside the text. Texts consist mostly
of stretches seen before; only new ones go to the library. A text with a special token goes to it whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
from tokenizers import Tokenizer

# Texts with other white space than single spaces and line feeds between visible characters are cut with care.
_OTHER_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace() and c not in (10, 32)]
_PAIRS = ["  ", "\n\n", " \n", "\n "]
_CUTS = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")

#: Stretches remembered by a worker; the memory they take is bounded, and what was forgotten is encoded again.
REMEMBERED = 1_000_000

# Byte-level BPE writes bytes as visible characters: itself, or the next free one from 256 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _VISIBLE]
_LETTER_OF = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}
_WORD = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+")


class _Memory(dict):
    """Stretches after `before` (a space or nothing) and their ids. A word is one cut, so it goes to the merges at once."""

    def __init__(self, encoder: Encoder, before: str):
        super().__init__()
        self.encoder, self.before = encoder, before

    def __missing__(self, chunk: str) -> bytes:
        core = chunk.rstrip(".,;:!?")
        if core != chunk and core[-1:].isalpha() and core[-1:].isascii():
            got = self[core] + self.encoder.tail[chunk[len(core) :]]
        elif chunk.isalpha() and (chunk.isascii() or _WORD.fullmatch(chunk)):
            got = self.encoder.merged(self.before + chunk)
        else:
            got = self.encoder.whole(self.before + chunk)
        if len(self) >= REMEMBERED:
            self.clear()
        self[chunk] = got
        return got


class _Tails(dict):
    """Punctuation after a word and its ids."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, tail: str) -> bytes:
        got = self.encoder.whole(tail)
        if len(tail) < 4:
            self[tail] = got
        return got


class Encoder:
    """Ids of texts as little-endian bytes of `dtype`, the narrowest unsigned type for the vocabulary."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.model = self.tokenizer.model
        self.after_space, self.at_start, self.tail = _Memory(self, " "), _Memory(self, ""), _Tails(self)
        self.line_feed = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def merged(self, word: str) -> bytes:
        """Ids of a text that is one cut."""
        shown = word.replace(" ", _LETTER_OF[32]) if word.isascii() else "".join(map(_LETTER_OF.__getitem__, word.encode()))
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.whole(text)
        if text[0].isspace() or text[-1].isspace() or any(s in text for s in _PAIRS) or any(s in text for s in _OTHER_SPACE):
            return b"".join(map(self.at_start.__getitem__, _CUTS.split(text)))
        out, start, spaced = [], self.at_start, self.after_space.__getitem__
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(start[first])
            out.extend(map(spaced, rest))
            out.append(self.line_feed)
        out.pop()
        return b"".join(out)


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
