"""Word-shingle sets of texts as sorted 64-bit hashes, computed with numpy by the batch.

A word's hash is a polynomial over its bytes modulo 2^64, taken from running sums over the
batch; a shingle's hash mixes its words' hashes. Two texts are compared by their own sets
only, so the chance that a hash collision changes an overlap is about the product of two
set sizes over 2^64 for a pair, whatever the size of the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Bytes that are hashed together; a longer text is hashed alone.
CHUNK = 1 << 20

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240))
#: A random value per byte, odd constants per word of a shingle and per number of words.
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_PLACE = _rng.integers(0, 1 << 64, 64, dtype=np.uint64) | _U(1)
_COUNT = _rng.integers(0, 1 << 64, 64, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, CHUNK + 1), base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of a lower-cased text."""
    raw = np.frombuffer(body, dtype=np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power_tables(len(raw) + 1)
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[raw] * up[:len(raw)], dtype=np.uint64)))
    h = (total[ends] - total[starts]) * down[starts]
    return _mix(h + (ends - starts).astype(np.uint64)), starts


def _sets(bodies: list[bytes], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of one chunk."""
    hashes, starts = word_hashes(b" ".join(bodies))
    firsts = np.cumsum([0] + [len(b) + 1 for b in bodies])
    bounds = np.searchsorted(starts, firsts)
    n = max(0, len(hashes) - words + 1)
    mixed = np.zeros(n, dtype=np.uint64)
    for j in range(words):
        mixed += hashes[j:j + n] * _PLACE[j]
    mixed = _mix(mixed + _COUNT[words])
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= words:
            yield np.unique(mixed[lo:hi - words + 1].view(np.int64))
        elif hi > lo:
            short = (hashes[lo:hi] * _PLACE[:hi - lo]).sum(dtype=np.uint64, keepdims=True)
            yield _mix(short + _COUNT[hi - lo:hi - lo + 1]).view(np.int64)
        else:
            yield np.empty(0, dtype=np.int64)


def shingle_sets(bodies: Iterator[bytes], words: int = WORDS) -> Iterator[np.ndarray]:
    """For each UTF-8 text, A-Z lowered, the sorted distinct hashes of its word shingles.

    A text of fewer words is one shingle; a text without words has none.
    """
    chunk: list[bytes] = []
    size = 0
    for body in bodies:
        if chunk and size + len(body) > CHUNK:
            yield from _sets(chunk, words)
            chunk, size = [], 0
        chunk.append(body.lower())
        size += len(body) + 1
    if chunk:
        yield from _sets(chunk, words)


def set_key(hashes: np.ndarray) -> bytes:
    """A 128-bit key that equal sets share."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
