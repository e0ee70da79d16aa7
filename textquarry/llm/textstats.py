"""Counts over one whole text, shared by the quality operators.  Words are cut as in ``common.WORD``."""

from __future__ import annotations

import numpy as np

SPACES, SYMBOLS = " \t\n\r\x0b\x0c", "#*$%&|<>"


def word_codes(words: list[bytes]) -> tuple[np.ndarray, int]:
    """A number for each word, equal for equal words, and how many distinct ones there are."""
    seen: dict[bytes, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), "i8", len(words))
    return codes, len(seen)


def repeated_window_words(codes: np.ndarray, distinct: int, length: int = 3) -> int:
    """Words that stand in a window of ``length`` words found twice or more, the first time included."""
    n = len(codes) - length + 1
    if n < 2:
        return 0
    names = codes[:n]
    for j in range(1, length):
        pairs = names * distinct + codes[j : n + j]  # below the square of the word count
        _, names = np.unique(pairs, return_inverse=True)
    again = np.bincount(names)[names] > 1
    edge = np.zeros(len(codes) + 1, "i8")
    edge[:n] += again
    edge[length:] -= again  # n + 1 places from ``length`` on: the last is beyond the text
    return int((np.cumsum(edge)[: len(codes)] > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, lines equal to an earlier one, words in repeated windows."""
    words = text.encode().split()
    codes, distinct = word_codes(words)
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_window_words(codes, distinct)


#: Bytes of a text whose grams are held at a time.
SLICE = 1 << 20


def slices(text: bytes, length: int) -> list[bytes]:
    """Parts of a text whose grams of ``length`` bytes are together those of the text."""
    return [text[at : at + SLICE + length - 1] for at in range(0, max(len(text) - length + 1, 1), SLICE)]


def gram_buckets(text: bytes, length: int, bits: int) -> np.ndarray:
    """Hash buckets of every run of ``length`` bytes of ``text``."""
    data = np.frombuffer(text, "u1").astype("u4")
    n = len(data) - length + 1
    if n < 1:
        return np.zeros(0, "i8")
    code = data[:n].copy()
    for j in range(1, length):
        code *= np.uint32(0x01000193)
        code ^= data[j : n + j]
    code *= np.uint32(0x9E3779B1)
    return (code >> np.uint32(32 - bits)).astype("i8")
