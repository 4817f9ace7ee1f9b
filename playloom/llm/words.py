"""Word hashes of many texts at once, with numpy, for use inside tasks.

Words are runs of bytes other than ASCII white space, A-Z in lower case. A word's
hash is a polynomial over random 64-bit values of its bytes, modulo 2**64, taken
from prefix sums over the whole batch, then mixed. It depends on the word only.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Texts are taken together up to so many bytes; a longer text stands alone.
CHUNK_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_forget: dict[str, Callable[[], None]] = {}


def remembers(owner: str, forget: Callable[[], None]) -> None:
    """Names what a worker keeps between tasks of one operator, and how it is forgotten."""
    _forget[owner] = forget


def release(owner: str | None = None) -> None:
    """Gives back what a task has freed, and forgets what other operators keep: Python workers live on between stages, beside the next ones."""
    for name, forget in _forget.items():
        if name != owner:
            forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, b in enumerate((_BASE | 1, pow(_BASE | 1, -1, 1 << 64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces of a string array: index of the first text, bytes of all its texts, offsets. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + CHUNK_BYTES, side="right")) - 1)
        yield begin, data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of a text that end at white space, of about CHUNK_BYTES; a longer word is in one piece."""
    begin = 0
    while begin < len(data):
        end = begin + CHUNK_BYTES
        while end < len(data):
            blank = np.flatnonzero(_SPACE[data[end : end + CHUNK_BYTES]])
            if len(blank):
                end += int(blank[0])
                break
            end += CHUNK_BYTES
        end = min(end, len(data))
        yield begin, end
        begin = end


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, for each text the index of its first word; one more entry at the end)."""
    if len(offsets) == 2 and len(data) > 2 * CHUNK_BYTES:  # one long text: piece by piece, so that memory follows the words
        hashes = np.concatenate([_hashed(data[a:b], np.array([0, b - a], np.int64))[0] for a, b in _pieces(data)])
        return hashes, np.array([0, len(hashes)], np.int64)
    return _hashed(data, offsets)


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = _SPACE[data]
    word = ~space
    starts_here = word.copy()
    starts_here[1:] &= space[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts_here[firsts] |= word[firsts]
    ends_here = word.copy()
    ends_here[:-1] &= space[1:]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends_here[lasts] |= word[lasts]
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[_LOWER[data]] * up[: len(data)], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)
