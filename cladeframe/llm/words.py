"""Hashes of the words of many texts at once."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_ALNUM = np.array([48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128 for b in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Words(NamedTuple):
    """A hash of each word in order, the number of its text, its bytes' span in `data`, and for each stem length
    the hashes of the words' first bytes (0 for a word no longer than that)."""

    hashes: np.ndarray
    of: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    stems: tuple[np.ndarray, ...]
    data: bytes


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letters(octets: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to words: ASCII letters and digits, and characters beyond ASCII that are no signs.

    Signs are U+0080 to U+00BF but for the two ordinals and the micro sign, the times and division signs, U+2000 to U+2BFF
    (quotes, dashes, spaces, arrows, shapes), U+3000 to U+303F and U+1F000 to U+1FFFF (pictures).
    """
    inside = _ALNUM[octets]
    if not (octets >= 0xC2).any():
        return inside
    padded = np.concatenate([octets, np.zeros(3, np.uint8)])
    for lead, low, high, size in ((0xC2, 0x80, 0xBF, 2), (0xC3, 0x97, 0x97, 2), (0xC3, 0xB7, 0xB7, 2), (0xE2, 0x80, 0xAF, 3), (0xE3, 0x80, 0x80, 3), (0xF0, 0x9F, 0x9F, 4)):
        at = np.flatnonzero(octets == lead)
        second = padded[at + 1]
        at = at[(second >= low) & (second <= high) & ((lead != 0xC2) | ~np.isin(second, (0xAA, 0xB5, 0xBA)))]
        for k in range(size):
            inside[np.minimum(at + k, len(inside) - 1)] = False
    return inside


def words_of(texts: list[str], stems: tuple[int, ...] = ()) -> Words:
    """Words are runs of letters and digits, in lower case; `stems` are numbers of first bytes to be hashed besides."""
    coded = [text.lower().encode("utf-8", "replace") for text in texts]
    data = b" ".join([*coded, b""]) or b" "
    octets = np.frombuffer(data, np.uint8)
    inside = _letters(octets)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = (np.r_[0, edges] if inside[0] else edges).reshape(-1, 2).T
    none = np.empty(0, np.uint64)
    if not len(starts):
        return Words(none, np.empty(0, np.int64), starts, ends, tuple(none for _ in stems), data)
    sizes = ends - starts
    powers = np.cumprod(np.full(int(sizes.max()), _BASE, np.uint64))
    at = np.flatnonzero(inside)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(at)) - np.repeat(first, sizes)
    terms = (octets[at].astype(np.uint64) + np.uint64(1)) * powers[place]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
    hashes = mixed(sums[first + sizes] - sums[first])
    of = np.searchsorted(np.cumsum([len(c) + 1 for c in coded]), starts, side="right")
    found = []
    for k in stems:
        long = np.flatnonzero(sizes > k)
        own = np.zeros(len(sizes), np.uint64)
        own[long] = mixed((sums[first[long] + k] - sums[first[long]]) ^ _BASE)
        found.append(own)
    return Words(hashes, of, starts, ends, tuple(found), data)
