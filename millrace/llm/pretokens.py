"""Vocabulary files and the splitting of texts into pieces, which byte-pair encoding never crosses."""

from __future__ import annotations

import base64
import re
import unicodedata

import regex

#: The public splitting pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_FAST = re.compile(r" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank (the id) of every line of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


_EXACT, _SPACE, _LETTER, _NUMBER = (regex.compile(p) for p in (PATTERN, r"\s", r"\p{L}", r"\p{N}"))


class _Odd(dict):
    """Whether ``re`` and ``regex`` classify a character differently, looked up when it first occurs."""

    def __missing__(self, ch: str) -> bool:
        exact = "s" if _SPACE.match(ch) else "l" if _LETTER.match(ch) else "n" if _NUMBER.match(ch) else "o"
        fast = "s" if ch.isspace() else "n" if unicodedata.category(ch) == "Nd" else "l" if ch.isalnum() else "o"
        odd = self[ch] = exact != fast
        return odd


_odd = _Odd()
_ODD_ASCII = re.compile("[\x1c-\x1f]")


def pieces(text: str) -> list[str]:
    """The pieces of ``text``; their concatenation is the text."""
    odd = _ODD_ASCII.search(text) if text.isascii() else any(map(_odd.__getitem__, set(text)))
    return _EXACT.findall(text) if odd else _FAST.findall(text)
