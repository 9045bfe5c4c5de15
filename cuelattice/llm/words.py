"""Words of a text, as the problems define them."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

_DROP = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD])
_WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")


def folded(text: str) -> str:
    """Without zero-width characters and soft hyphens, NFKC, lower case."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_DROP))
    return text.lower()


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the folded text; each character from U+4E00 to U+9FFF is a word."""
    return _WORD.findall(folded(text)) if text else []


def spans(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words of an already folded text with their places in it."""
    found = list(_WORD.finditer(text))
    return [m.group() for m in found], [m.span() for m in found]


class _Hashes(dict):
    def __missing__(self, w: str) -> int:
        import xxhash

        h = self[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return h


class WordHash:
    """64-bit hashes of words, kept for the words met so far (the memo is emptied when it grows large)."""

    def __init__(self, most: int = 500_000) -> None:
        self.memo = _Hashes()
        self.most = most

    def __call__(self, ws: list[str]) -> np.ndarray:
        if len(self.memo) > self.most:
            self.memo.clear()
        return np.fromiter(map(self.memo.__getitem__, ws), np.uint64, len(ws))
