"""Words and their 64-bit hashes straight from bytes, for many texts at once.

A word is a run of anything but ASCII white space (0x20, 0x09-0x0D). Its hash depends on its bytes alone. No
Python object is made for a word; the arrays of a call are about ten times its bytes.
"""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
LONG = 256  # longer words are hashed one by one


def mix(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def _eight(raw: bytes) -> np.ndarray:
    """Eight bytes from each position; ``raw`` ends in eight bytes more."""
    return np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and one beyond the last)."""
    raw = b" ".join([b"", *texts, b"\x00" * 8])  # white space before, between and after
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    inside = _IN_WORD[np.frombuffer(raw, dtype=np.uint8)[:-8]]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, n = edges[::2], edges[1::2] - edges[::2]
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    eight = _eight(raw)
    h = eight[starts] & _MASKS[np.minimum(n, 8)]
    h *= _A
    h += n.astype(np.uint64) * _B
    h = mix(h)
    more, at = np.flatnonzero(n > 8), 8
    while len(more) and at < LONG:
        part = eight[starts[more] + at] & _MASKS[np.minimum(n[more] - at, 8)]
        part *= _C
        h[more] = mix(h[more] * _A + part)
        at += 8
        more = more[n[more] > at]
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(raw[starts[i] : starts[i] + n[i]], 9)
    return h, first


def batches(items, size, most: int):
    """Lists of consecutive items of about ``most`` in all by ``size(item)``; a larger one is alone."""
    held, total = [], 0
    for item in items:
        n = size(item)
        if held and total + n > most:
            yield held
            held, total = [], 0
        held.append(item)
        total += n
    if held:
        yield held
