"""Words of many texts at once, as 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and _BASE ** -i modulo 2^64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


#: A text is looked at in pieces of about so many bytes, so that what a worker keeps doesn't grow with the longest one.
PIECE = 1 << 18
_POWERS = _powers(PIECE + 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes, lower: bool = True, piece: int = PIECE) -> np.ndarray:
    """A hash of each word (run of bytes but space and 0x09-0x0D) of UTF-8 ``data``, A-Z lowered if asked; the same however
    the text is cut into pieces, which end at white space. A word longer than a piece has powers of its own.
    """
    raw = np.frombuffer(data, np.uint8)
    if len(raw) <= piece:
        return _hashes(raw, lower)
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + piece)
        while end < len(raw) and not _SPACE[raw[end]]:  # on to the next white space, some bytes at a time
            step = np.flatnonzero(_SPACE[raw[end : end + 4096]])
            end = end + int(step[0]) if len(step) else min(len(raw), end + 4096)
        parts.append(_hashes(raw[at:end], lower))
        at = end
    return np.concatenate(parts)


def _hashes(raw: np.ndarray, lower: bool) -> np.ndarray:
    if not len(raw):
        return np.zeros(0, np.uint64)
    gap = np.concatenate([[True], _SPACE[raw], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[0::2], edge[1::2]
    up, down = _POWERS if len(_POWERS[0]) > len(raw) else _powers(len(raw) + 1)
    codes = (_LOWER[raw] if lower else raw).astype(np.uint64) + np.uint64(1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(codes * up[: len(raw)], dtype=np.uint64)])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words; a text of fewer words has one run of all it has."""
    if not len(words):
        return words
    n = min(n, len(words))
    size = len(words) - n + 1
    value = np.zeros(size, np.uint64)
    for k in range(n):
        value = value * _BASE + words[k : k + size]
    return np.unique(mixed(value))


def batches(lengths: Iterable[int], most: int) -> Iterator[slice]:
    """Slices of a sequence whose lengths add up to about ``most``."""
    at = total = 0
    end = 0
    for end, n in enumerate(lengths, 1):
        total += n
        if total >= most:
            yield slice(at, end)
            at, total = end, 0
    if at < end:
        yield slice(at, end)
