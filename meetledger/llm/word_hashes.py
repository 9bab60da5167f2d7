"""Words of many texts as 64-bit numbers, without a Python object for each word.

Texts are laid out as one run of bytes. A word's number is a polynomial of its bytes, taken
from prefix sums of byte times power, so that equal words have equal numbers wherever they
stand; A to Z count as a to z, and ASCII white space parts words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BLOCK_BYTES = 1 << 20  # of text at once; a longer text is a block of its own
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_VALUE[_SPACE] = 0
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ...; at least ``n`` of them, kept up to a block's length."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 12), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 2 * BLOCK_BYTES:
            _POWERS[base] = have
    return have[:n]


def _numbers(block: list[bytes]) -> Iterator[np.ndarray]:
    data = np.frombuffer(b" ".join([*block, b""]) or b" ", np.uint8)
    inside = ~_SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _powers(_BASE, len(data)), out=total[1:])
    word = mix((total[end] - total[begin]) * _powers(_UNBASE, len(data))[begin] + (end - begin).astype(np.uint64))
    stops = np.cumsum([len(text) + 1 for text in block])
    places = np.searchsorted(begin, stops).tolist()
    for low, high in zip([0, *places], places):
        yield word[low:high]


def numbers_of(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """For each text the numbers of its words, in order."""
    block, size = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if block and size + len(raw) > BLOCK_BYTES:
            yield from _numbers(block)
            block, size = [], 0
        block.append(raw)
        size += len(raw) + 1
    if block:
        yield from _numbers(block)
