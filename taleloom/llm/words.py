"""Words and word sequences of texts as hashed arrays.

Words are the maximal runs of Unicode letters and digits of the lower-cased text. A word
hashes to 64 bits, a sequence to a mixed polynomial of its words' hashes, so everything
behind the cutting of words works on whole arrays.
"""

from __future__ import annotations

import numpy as np
import xxhash

MIN_WORDS = 20
WORD_CACHE = 1_000_000

_ASCII_CUT = {c: " " for c in range(128) if not chr(c).isalnum()}
_FULL = None
_P = 0x9E3779B97F4A7C15
_64 = (1 << 64) - 1


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = value
        return value


_HASHES = _WordHashes()


def words(text: str | None) -> list[str]:
    global _FULL
    if not text:
        return []
    low = text.lower()
    if low.isascii():
        return low.translate(_ASCII_CUT).split()
    if _FULL is None:
        import regex

        _FULL = regex.compile(r"[\p{L}\p{N}]+")
    return _FULL.findall(low)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of the result can be used alone."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sequences(
    texts: list[str | None], n: int, min_words: int = MIN_WORDS, width: int = 0
) -> tuple[np.ndarray, ...]:
    """Distinct n-word sequences of each text with enough words.

    Returns (positions of those texts, hashes sorted within each text, start of each text's
    hashes with the total at the end). With a ``width`` the hashes stand in the order of the texts, and there follow
    the place of each hash's first occurrence among all words, the leading ``width`` bits of all words' hashes and the place of
    each text's first word.
    """
    kept, lengths, flat = [], [], []
    for i, text in enumerate(texts):
        w = words(text)
        if len(w) >= max(min_words, n):
            kept.append(i)
            lengths.append(len(w))
            flat.append(np.fromiter(map(_HASHES.__getitem__, w), np.uint64, len(w)))
    if not kept:
        none = np.zeros(0, np.int64)
        empty = none, np.zeros(0, np.uint64), np.zeros(1, np.int64)
        return (*empty, none, np.zeros(0, np.uint64), none) if width else empty
    h = np.concatenate(flat)
    # Prefix doubling: the key of 2k words comes from two keys of k words.
    span, key, power = 1, h, _P
    for bit in bin(n)[3:]:
        key = key[: len(key) - span] * np.uint64(power) + key[span:]
        power, span = power * power & _64, span * 2
        if bit == "1":
            key = key[: len(key) - 1] * np.uint64(_P) + h[span : span + len(key) - 1]
            power, span = power * _P & _64, span + 1
    size = np.asarray(lengths)
    ends = np.cumsum(size)
    begins = ends - size
    counts = size - n + 1
    at = np.arange(counts.sum()) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
    grams = mix(key[at])
    edges = np.concatenate([[0], np.cumsum(counts)])
    if width:
        places, total = [], [0]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            _, first = np.unique(grams[a:b], return_index=True)
            first.sort()
            places.append(first + a)
            total.append(total[-1] + len(first))
        chosen = np.concatenate(places)
        return np.asarray(kept), grams[chosen], np.asarray(total), at[chosen], h >> np.uint64(64 - width), begins
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        grams[a:b].sort()
    new = np.empty(len(grams), bool)
    new[0] = True
    np.not_equal(grams[1:], grams[:-1], out=new[1:])
    new[edges[:-1]] = True
    starts = np.concatenate([[0], np.cumsum(np.add.reduceat(new, edges[:-1]))])
    return np.asarray(kept), grams[new], starts
