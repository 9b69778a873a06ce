"""Token ids of whole texts, by a public tokenizer file, a segment at a time.

The tokenizer splits at white space before anything else, so a text's ids are
those of its white-space-separated segments one after the other. Segments
repeat, so a bounded cache in each worker saves most of the work; ids are the
same as those of the whole text (tests compare the two).
"""

from __future__ import annotations

import os
import re
from array import array

#: ASCII signs that end a piece of letters; an apostrophe may begin a contraction, so it is none of them.
_SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters of ASCII and Latin-1, which normalisation leaves as they are but for lower case.
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE writes a byte as a visible character: itself where that is printable Latin-1, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class SegmentTokenizer(dict):
    """ids(texts) gives each text's ids as little-endian unsigned 32-bit integers; as a dict it maps segments to theirs.

    path: a file of the tokenizers library whose pre-tokenizer drops white space and has a piece of letters end where signs begin. max_cached bounds the segments kept in memory.
    """

    def __init__(self, path: str, max_cached: int = 400_000):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model.tokenize
        self._alphabet = _byte_alphabet()
        self._pieces: dict[bytes, bytes] = {}
        self._max = max_cached

    def __missing__(self, segment: bytes) -> bytes:
        word = segment.rstrip(_SIGNS)
        if word.isalpha() or _LETTERS.fullmatch(word):
            word_lower = word.lower()
            ids = self._pieces.get(word_lower) or self._piece(word_lower)
            if len(word) < len(segment):
                signs = segment[len(word) :]
                ids += self._pieces.get(signs) or self._piece(signs)
        else:
            ids = array("I", self._tokenizer.encode(segment.decode(), add_special_tokens=False).ids).tobytes()
        self[segment] = ids
        return ids

    def _piece(self, piece: bytes) -> bytes:
        """Ids of letters alone or signs alone: the library's BPE model, without the steps around it that leave such a piece as it is."""
        shown = piece.decode() if piece.isascii() else piece.decode().lower().encode().decode("latin-1").translate(self._alphabet)
        ids = self._pieces[piece] = array("I", [t.id for t in self._model(shown)]).tobytes()
        return ids

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """texts: UTF-8."""
        out: list[bytes] = []
        get = self.__getitem__
        for text in texts:
            out.append(b"".join(map(get, text.split())))
            if len(self) > self._max:
                self.clear()
            if len(self._pieces) > self._max:
                self._pieces.clear()
        return out


    def forget(self) -> None:
        """Empties the cache: at a task's end, as the worker lives on."""
        self.clear()
        self._pieces.clear()


_LOADED: dict[str, SegmentTokenizer] = {}


def tokenizer(path: str) -> SegmentTokenizer:
    """One for each worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = SegmentTokenizer(path)
    return _LOADED[path]
