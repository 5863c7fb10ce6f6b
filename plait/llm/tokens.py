"""Token ids by the ``tokenizers`` library, one pre-token at a time with bounded caches.

The word-BPE tokenizers lower-case a text, drop its white space and never merge across pre-tokens, so the
ids of a text are the ids of its pre-tokens in a row.  No pre-token crosses white space, so a text is first split into
words, and only a word that is not remembered is cut into pre-tokens; a pre-token that is not remembered goes to the library's
model.  Texts with any but plain characters take the library's whole path, chunk by chunk.
"""

from __future__ import annotations

import json
import sys
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import public_tokenizers
from tokenizers import Tokenizer

DEFAULT = "word_bpe_49k.json"

#: Texts whose pre-tokens are plain to see: ASCII white space, Latin letters below U+0250 (but U+0130, whose
#: lower case has two code points), ASCII digits and punctuation.
_PLAIN = re.compile(r"[\t\n\r -~\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]*")
#: The tokenizer's own split pattern, for such texts.
_PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def default_path() -> str:
    return public_tokenizers.path(DEFAULT)


#: Longer strings are not remembered.
LONG = 64


class Remembered(dict):
    """Results of ``make`` by string.  Beyond ``limit`` of them they become the older ones, and the older ones before go; those asked for again
    are taken over, so that frequent strings stay.  Twice ``limit`` are held at most."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        if len(key) > LONG:
            return self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        self[key] = out
        return out


class ChunkTokenizer:
    """Encodes texts to little-endian unsigned 32-bit ids.  ``limit`` bounds what is remembered of words, of chunks and, by its half, of pre-tokens."""

    def __init__(self, path: str, limit: int = 150_000):
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre = (kind.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.plain = kind["model"].get("end_of_word_suffix") == "</w>" and kind["normalizer"]["type"] == "Sequence" and "'ll|" in json.dumps(pre[0])
        if not self.plain:
            raise ValueError("only word-BPE tokenizers that drop white space are cut into chunks")
        self.model = self.whole.model
        self.words, self.pieces, self.chunks = Remembered(self._word, limit), Remembered(self._pre_token, limit // 2), Remembered(self._chunk, limit)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE shows these bytes as themselves
        table, n = {b: chr(b) for b in shown}, 0
        for b in range(256):
            if b not in table:
                table[b] = chr(256 + n)
                n += 1
        self.table = table

    def _word(self, word: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PRE.findall(word)))

    def _pre_token(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode("utf-8").decode("latin-1").translate(self.table)
        return _packed([t.id for t in self.model.tokenize(piece)])

    def _chunk(self, chunk: str) -> bytes:
        return _packed(self.whole.encode(chunk, add_special_tokens=False).ids)

    def encode(self, text: str | None, end: int | None = None) -> bytes:
        """Ids of the text (null: none), then ``end``."""
        text = text or ""
        if (text.isascii() or _PLAIN.fullmatch(text)) and "<|" not in text and not _CONTROL.search(text):
            out = b"".join(map(self.words.__getitem__, text.lower().split()))
        else:
            out = b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))
        return out if end is None else out + _packed([end])


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


@lru_cache(maxsize=2)
def tokenizer(path: str, limit: int = 150_000) -> ChunkTokenizer:
    """One a worker, kept between tasks."""
    return ChunkTokenizer(path, limit)
