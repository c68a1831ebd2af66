"""Words and their hashes as numpy arrays, straight from a text's bytes."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
SLICE = 1 << 20  # bytes worked on at once


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _MULTIPLIER), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def _slices(data: bytes):
    """Parts of at most about SLICE bytes that end between words (a longer word stays whole)."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + SLICE)
        while end < n and not _BLANK[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order. Equal words have equal hashes."""
    return hashes_and_heads(data)[0]


def hashes_and_heads(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and its first three bytes as a number."""
    out, heads = [], []
    for part in _slices(data):
        arr = np.frombuffer(part, np.uint8)
        word = np.zeros(len(arr) + 2, np.int8)
        word[1:-1] = ~_BLANK[arr]
        turn = np.diff(word)
        starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        up, down = _upto(len(arr))
        total = np.zeros(len(arr) + 1, np.uint64)
        np.cumsum(_LETTERS[arr] * up[: len(arr)], out=total[1:])
        out.append(mix((total[ends] - total[starts]) * down[starts]))
        head = arr[starts].astype(np.uint64)
        for k in (1, 2):
            at = starts + k
            head = (head << np.uint64(8)) | np.where(at < ends, arr[np.minimum(at, len(arr) - 1)], 0).astype(np.uint64)
        heads.append(head)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(out), np.concatenate(heads)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; of fewer words, the whole sequence as one."""
    if not len(words):
        return words
    width = min(size, len(words))
    n, total = len(words) - width + 1, np.uint64(width)
    total = np.full(n, total, np.uint64)
    for k in range(width):
        total = mix(total * np.uint64(_MULTIPLIER) + words[k:k + n])
    return np.unique(total)
