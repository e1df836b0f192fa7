"""Vectorised hashes of word windows, shared by near-dedup and decontamination."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

_M = (1 << 64) - 1
_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)
#: Words of a block and bytes of a word that are hashed as they are; longer words enter by digest.
BLOCK_WORDS, LONG_WORD = 1 << 15, 1 << 12


def _mixed(n: int, seed: int) -> np.ndarray:
    """``n`` well-spread 64-bit numbers by the SplitMix rule."""
    x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(_MUL)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mixed(256, 1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_MUL, _INV)):
            p = np.full(size, base & _M, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def _block(words: list[bytes], k: int) -> np.ndarray:
    text = b" ".join(words)
    buf = np.frombuffer(text, np.uint8)
    up, down = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=sums[1:])
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    first, last = starts[: len(words) - k + 1], ends[k - 1 :]
    return mix((sums[last] - sums[first]) * down[first])


def window_hashes(words: list[bytes], k: int) -> np.ndarray:
    """One 64-bit hash for each window of ``k`` words, in order; equal windows hash alike."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    if max(map(len, words)) > LONG_WORD:
        words = [w if len(w) <= LONG_WORD else b"\x00" + blake2b(w).digest() for w in words]
    parts = [_block(words[at : at + BLOCK_WORDS + k - 1], k) for at in range(0, len(words) - k + 1, BLOCK_WORDS)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)
