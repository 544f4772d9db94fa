"""Ids of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re
import sys
from array import array
from functools import cache
from itertools import islice

from ._util import vocabulary_path

_BLANKS = re.compile(r" \s|\s ")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_LONGEST, _MOST = 48, 400_000
_LATIN = "ɏ"


def _packed(ids: list[int]) -> bytes:
    out = array("H", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Seen(dict):
    """Ids by word; asks for those it lacks."""

    def __init__(self, ask):
        super().__init__()
        self.ask = ask

    def __missing__(self, word: str) -> bytes:
        return self.ask(word)


class Encoder:
    """text -> ids as little-endian uint16, equal to the tokenizers library on the whole text.

    Texts within the Latin blocks go to the faster library as a whole. In others, as the vocabulary's pattern never
    joins a word with what stands before the single blank that leads it, a blank and the word after it are looked up
    by themselves among the words seen; words with letters beyond those blocks, and texts that hold a special token,
    go to the tokenizers library itself.
    """

    def __init__(self, vocabulary: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(vocabulary_path(f"{vocabulary}.json"))
        with open(vocabulary_path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.seen, self.older = _Seen(self._word), {}

    def _ids(self, text: str) -> bytes:
        if text.isascii() or max(text) <= _LATIN:
            return _packed(self.fast.encode_ordinary(text))
        return _packed(self.exact.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        ids = self.older.get(word) or self._ids(" " + word)
        if len(word) <= _LONGEST:
            if len(self.seen) >= _MOST:  # words that come again move on to the new generation
                self.older = dict(self.seen)
                self.seen.clear()
            self.seen[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if "<|" in text:
            return _packed(self.exact.encode(text, add_special_tokens=False).ids)
        if text.isascii() or max(text) <= _LATIN:
            return _packed(self.fast.encode_ordinary(text))
        words = _SAFE.split(text) if _BLANKS.search(text) else text.split(" ")
        return self._ids(words[0]) + b"".join(map(self.seen.__getitem__, islice(words, 1, None)))


@cache
def encoder(vocabulary: str = "byte_bpe_50k") -> Encoder:
    """One for each Python worker."""
    return Encoder(vocabulary)
