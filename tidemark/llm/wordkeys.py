"""64-bit keys of all words of many texts at once, straight from their bytes.

A word is a run of ``[^\\x20\\x09-\\x0D]``, A-Z lower-cased. Its key is the sum, over its bytes, of a fixed
random number for the byte at its place: equal words have equal keys, and no word is made a Python object.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidemark.llm.shared import mix64

_PLACES = 64
SPACE_BYTES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_AT = mix64(np.arange(_PLACES * 256, dtype=np.uint64), np.uint64(0x77_6F_72_64))
#: The same for words: letters are lower-cased, and the spaces after a word add nothing.
_IN_WORD = np.where(SPACE_BYTES, np.uint64(0), _AT.reshape(_PLACES, 256)[:, _LOWER]).ravel()
_BLOCK = 1 << 16


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array without nulls, one after the other, and where each text starts and the last ends."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, ends - ends[0]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of each word, in order, and the place of its first byte; words end at the ends of texts."""
    solid = (data > 32) | (data < 9) | ((data > 13) & (data < 32))
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    begins[cut] = solid[cut]
    starts = np.flatnonzero(begins)
    keys = np.zeros(len(starts), np.uint64)
    # by blocks of words: the numbers of many bytes at once would be fresh memory each time
    blocks = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), _BLOCK)), len(starts)))
    for at, to in zip(blocks[:-1], blocks[1:]):
        own = starts[at:to]
        end = starts[to] if to < len(starts) else len(data)
        place = np.arange(end - own[0]) - np.repeat(own - own[0], np.diff(np.append(own, end)))
        values = _IN_WORD.take((np.minimum(place, _PLACES - 1) << 8) | data[own[0] : end])
        far = np.flatnonzero((place >= _PLACES) & solid[own[0] : end])
        if len(far):
            values[far] = mix64(place[far].astype(np.uint64), _LOWER[data[own[0] : end][far]].astype(np.uint64))
        keys[at:to] = np.add.reduceat(values, own - own[0])
    return keys, starts


def segment_keys(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The keys of the segments that begin at ``starts``, the first of them 0, and fill all of ``data``; case is kept."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    values = _AT[(np.minimum(place, _PLACES - 1) << 8) | data]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        values[far] = mix64(place[far].astype(np.uint64), data[far].astype(np.uint64))
    return np.add.reduceat(values, starts)


def word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The key of each word of all texts in turn, and each text's number of words."""
    data, offsets = bytes_of(texts)
    keys, starts = words_of(data, offsets)
    return keys, np.diff(np.searchsorted(starts, offsets))


def line_word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(key of each word, line of each word, text of each line, number of each line in its text)``; ``\\n`` parts lines."""
    data, offsets = bytes_of(texts)
    keys, starts = words_of(data, offsets)
    breaks = np.flatnonzero(data == 10)
    n_lines = np.diff(np.searchsorted(breaks, offsets)) + 1
    of = np.repeat(np.arange(len(n_lines)), n_lines)
    number = np.arange(len(of)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
    line = np.searchsorted(breaks, starts) + np.searchsorted(offsets[1:], starts, "right")
    return keys, line, of, number
