"""Deep-shallow sorting of suffixes, for many small groups at once, in numpy.

Suffixes are compared by the eight-byte words of a buffer. The shallow part is a multikey quicksort: sort by one word inside each
tie, go on with the ties only. What still ties at the shallow depth goes to blind tries, built for all ties together: the first
suffix of a tie is its trie's path; every other one runs along the path to the depth where it leaves it, and only that depth
and the word there are kept. Suffixes that leave at the same depth by the same word share a subtrie and are a new tie below it;
those that never leave within the length are equal.
"""

from __future__ import annotations

import numpy as np

WORD = 8


def _words(buffer: np.ndarray) -> np.ndarray:
    """The big-endian word that begins at each byte."""
    return np.ndarray((len(buffer) - WORD + 1,), ">u8", buffer, strides=(1,))


def _ties(order: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by ``keys``: the rows that tie with a neighbour, and a number for each tie."""
    n = len(order)
    new = np.ones(n, bool)
    new[1:] = False
    for key in keys:
        sorted_key = key[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1
    return order[shared], number[shared]


def equal_classes(buffer: np.ndarray, at: np.ndarray, group: np.ndarray, length: int, shallow: int = 24) -> np.ndarray:
    """A number for each suffix (``at``: its first byte, ``group``: only suffixes of one group are compared) that is
    equal exactly where ``length`` bytes are equal; -1 where no other suffix of the group is equal. ``length`` and ``shallow`` are
    multiples of eight and the buffer holds ``length`` bytes from each suffix on."""
    out = np.full(len(at), -1, np.int64)
    if not len(at):
        return out
    words = _words(buffer)
    rows, tie = np.arange(len(at)), group
    for depth in range(0, shallow, WORD):  # multikey quicksort
        key = words[at[rows] + depth].astype(np.uint64)
        order = np.lexsort((key, tie))
        picked, number = _ties(order, tie, key)
        rows, tie = rows[picked], number
        if not len(rows):
            return out
    depth, label = np.full(len(rows), shallow), 0
    while len(rows):  # blind tries, one level of branches at a time; rows come tie by tie
        first = np.flatnonzero(np.r_[True, tie[1:] != tie[:-1]])
        path = np.repeat(first, np.diff(np.r_[first, len(rows)]))
        leave, value = np.full(len(rows), length), np.zeros(len(rows), np.uint64)
        on = np.flatnonzero((path != np.arange(len(rows))) & (depth < length))
        d = depth[on].copy()
        while len(on):
            mine, theirs = words[at[rows[on]] + d], words[at[rows[path[on]]] + d]
            off = mine != theirs
            leave[on[off]], value[on[off]] = d[off], mine[off]
            on, d = on[~off], d[~off] + WORD
            inside = d < length
            on, d = on[inside], d[inside]
        same = leave == length
        count = np.bincount(path[same], minlength=len(rows))
        shared = same & (count[path] > 1)
        out[rows[shared]] = label + path[shared]
        label += len(rows)
        rest = np.flatnonzero(~same)
        order = np.lexsort((value[rest], leave[rest], tie[rest]))
        picked, number = _ties(order, tie[rest], leave[rest], value[rest])
        keep = rest[picked]
        rows, tie, depth = rows[keep], number, leave[keep] + WORD
    return out
