"""Sets of five-word shingles as 64-bit names, by array operations over many texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

from graphloom.llm.common import mix, words_at

SIZE = 5
LONG_WORD = 128
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every word: a run of anything but ASCII white space within one text."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    return np.flatnonzero(solid & (~before | edge[:-1])), np.flatnonzero(solid & (~after | edge[1:])) + 1


def word_names(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(name of every word, first word of every text and the total): words are runs of anything but
    ASCII white space, A-Z in lower case if `lower`. Names depend on all bytes of a word."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    data = _LOWER[data] if lower else data
    begin, end = word_bounds(data, offsets)
    length = end - begin
    eight = words_at(data)
    name = mix(length.astype(np.uint64))
    at = np.arange(len(begin))
    for k in range(0, LONG_WORD, 8):
        at = at[length[at] > k]
        if not len(at):
            break
        left = np.minimum(length[at] - k, 8).astype(np.uint64)
        part = eight[begin[at] + k]
        part = np.where(left < 8, part & ((np.uint64(1) << (left * np.uint64(8) & np.uint64(63))) - np.uint64(1)), part)
        name[at] = mix(name[at] * np.uint64(31) ^ part)
    for i in np.flatnonzero(length > LONG_WORD):
        name[i] = xxhash.xxh3_64_intdigest(data[begin[i] : end[i]].tobytes())
    return name, np.searchsorted(begin, offsets)


def sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle names of each text: of five words each, or of all words if there are
    fewer; none without words."""
    name, own = word_names(data, offsets)
    grams = name.copy()
    for k in range(1, SIZE):
        grams[:-k] = mix(grams[:-k] * np.uint64(0x9E3779B97F4A7C15) + name[k:]) if len(name) > k else grams[:-k]
    out = []
    for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True):
        if b - a >= SIZE:
            out.append(np.unique(grams[a : b - SIZE + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(name[a:b].tobytes(), seed=b - a)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_of(text: str) -> np.ndarray:
    raw = np.frombuffer((text or "").encode("utf-8"), np.uint8)
    return sets(raw, np.array([0, len(raw)], np.int64))[0]


def linked(a: np.ndarray, b: np.ndarray, percent: int = 80) -> bool:
    """100 * intersection >= percent * union, of two sorted sets that aren't empty."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
