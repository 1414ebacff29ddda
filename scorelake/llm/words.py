"""Vectorised word hashing for operators that compare texts word by word.

A word is a run of bytes other than the ASCII white space (space and 0x09 to 0x0D). Hashes are
64 bits wide, the same in every process, and computed for whole batches of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_SPACES = b"\t\n\x0b\x0c\r "
_SLICE = 1 << 20
_SHORT = 64  # longer words are hashed one by one


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit words."""
    step = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(step)


_BYTE = stream(1, 256)
_BYTE[SPACE] = 0
_POWER = np.cumprod(np.full(_SHORT, stream(2, 1)[0] | np.uint64(1), dtype=np.uint64), dtype=np.uint64)
_LENGTH = stream(3, 1)[0]


def _slices(data: bytes) -> Iterator[bytes]:
    """Pieces of about ``_SLICE`` bytes that end at white space, so that memory stays bounded."""
    at = 0
    while len(data) - at > _SLICE:
        cut = at + _SLICE
        while cut < len(data) and data[cut] not in _SPACES:
            cut += 1
        yield data[at:cut]
        at = cut
    yield data[at:]


def _hash_slice(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word."""
    raw = np.frombuffer(data, dtype=np.uint8)
    space = SPACE[raw]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    last = ~space
    last[:-1] &= space[1:]
    length = np.flatnonzero(last) + 1 - starts
    offset = int(starts[0])
    spans = np.diff(np.append(starts, len(raw)))
    position = np.arange(offset, len(raw), dtype=np.int64) - np.repeat(starts, spans)
    values = _BYTE[raw[offset:]] * _POWER[np.minimum(position, _SHORT - 1)]
    hashes = np.add.reduceat(values, starts - offset)
    for i in np.flatnonzero(length > _SHORT):
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i]:starts[i] + length[i]])
    return starts, mix(hashes + length.astype(np.uint64) * _LENGTH)


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The hashes of each text's words, in order."""
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    group: list[int] = []
    size = 0

    def flush() -> None:
        if not group:
            return
        bounds = np.cumsum([0] + [len(texts[i]) + 1 for i in group])
        starts, hashes = _hash_slice(b"\n".join(texts[i] for i in group))
        cuts = np.searchsorted(starts, bounds)
        for k, i in enumerate(group):
            out[i] = hashes[cuts[k]:cuts[k + 1]]
        group.clear()

    for i, text in enumerate(texts):
        if len(text) > _SLICE:
            out[i] = np.concatenate([_hash_slice(part)[1] for part in _slices(text)])
            continue
        if size + len(text) > _SLICE:
            flush()
            size = 0
        group.append(i)
        size += len(text) + 1
    flush()
    return out


_SHINGLE = {n: stream(10 + n, n) | np.uint64(1) for n in range(1, 65)}


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of ``width`` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += hashes[k:k + n] * _SHINGLE[width][k]
    return mix(total)


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """The sorted distinct ``width``-word shingles; a shorter text is one shingle of all its words."""
    if 0 < len(hashes) < width:
        return windows(hashes, len(hashes))
    return np.unique(windows(hashes, width))
