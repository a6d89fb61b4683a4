"""Byte tries over many terms at once, in numpy.

A trie's edges carry eight bytes each (the last of a term fewer, filled up with zero bytes, which no term may
hold). All terms go down one level together: on a level, terms at the same node with the same next eight bytes
reach the same child. A term ends in one leaf, so equal terms, and only they, share one; no hash is involved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

EDGE = 8
#: Texts are read in stretches of about so many bytes.
STRETCH = 1 << 22
_KEEP = np.array([0, *(((1 << 64) - 1) ^ ((1 << 8 * (EDGE - k)) - 1) for k in range(1, EDGE + 1))], np.uint64)


def leaves(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leaf of each term, numbered from 0, and for each leaf one term that ends in it. Terms are not empty."""
    n = len(starts)
    found, places, leaf_count = np.empty(n, np.int64), [], 0
    if not n:
        return found, found
    padded = np.concatenate([data, np.zeros(EDGE, np.uint8)])
    edges = np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))
    alive, node, level = np.arange(n), None, 0
    while len(alive):
        left = lens[alive] - EDGE * level
        edge = edges[starts[alive] + EDGE * level].astype(np.uint64) & _KEEP[np.minimum(left, EDGE)]
        labels, child = np.unique(edge, return_inverse=True)
        if node is not None:
            _, child = np.unique(node * len(labels) + child, return_inverse=True)
        ends = left <= EDGE
        if ends.any():
            own, first, at = np.unique(child[ends], return_index=True, return_inverse=True)
            stopped = alive[ends]
            found[stopped] = leaf_count + at
            places.append(stopped[first])
            leaf_count += len(own)
        on = ~ends
        alive, node, level = alive[on], child[on], level + 1
    return found, np.concatenate(places)


def gathered(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the terms one after the other, and where each begins and the last ends."""
    offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    return data[np.repeat(starts - offsets[:-1], lens) + np.arange(offsets[-1])], offsets


def as_binary(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> pa.Array:
    """The terms as an Arrow column of bytes."""
    own, offsets = gathered(data, starts, lens)
    wide = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(own))])
    return wide.cast(pa.binary())


def from_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(data, starts, lens)`` of an Arrow column of bytes or text without nulls."""
    wide = column.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    ends = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, ends[:-1] - ends[0], np.diff(ends)


def runs(inside: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(starts, lens)`` of the maximal runs of true; a run ends at each of ``breaks``, too."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0] = edge[-1] = True
    edge[breaks] = True
    at = np.flatnonzero(edge)
    held = inside[at[:-1]]
    return at[:-1][held], np.diff(at)[held]


def stretches(texts: pa.Array, outside: np.ndarray, size: int = STRETCH) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """``(first, last + 1, bytes, offsets, whole)``: texts some at a time, about ``size`` bytes.

    A longer text comes alone and in parts, cut before a byte of which ``outside`` is true (a byte in no term), so no
    term is cut; ``whole`` is false for each part but its last.
    """
    data, starts, lens = from_binary(texts)
    ends = starts + lens
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + size, "right")))
        if to > at + 1 or lens[at] <= size:
            yield at, to, data[starts[at] : ends[to - 1]], np.append(starts[at:to], ends[to - 1]) - starts[at], True
        else:
            here = int(starts[at])
            while here < ends[at]:
                cut = min(here + size, int(ends[at]))
                while cut < ends[at]:
                    free = np.flatnonzero(outside[data[cut : min(cut + size, int(ends[at]))]])
                    cut = int(cut + free[0]) if len(free) else min(cut + size, int(ends[at]))
                    if len(free):
                        break
                yield at, to, data[here:cut], np.array([0, cut - here]), cut == ends[at]
                here = cut
        at = to
