"""Whole-text tokenisation in tasks: distinct words are encoded once, texts are gathered from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that one Python worker remembers; the memory is emptied when full and only saves time.
REMEMBERED_WORDS = 600_000
CHUNK_BYTES = 6_000_000


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks_of_text(column: pa.Array, limit: int = CHUNK_BYTES):
    """``(first, last + 1, texts)`` slices of about ``limit`` bytes, a text at least; null is empty."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield at, to, texts.slice(at, to - at)
        at = to


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Runs of ``[^\\x20\\x09-\\x0D]``: the distinct words, each word's index among them, each text's word count."""
    words = pc.ascii_split_whitespace(texts)
    flat = words.flatten()
    counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        doc = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(doc[full], minlength=len(counts)).astype(np.int64)
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), counts


#: Words on which normalising changes no character's class; their pre-tokens can be counted beforehand.
PLAIN_WORD = r"^[!-~\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+$"
#: Closing punctuation after a letter is a pre-token of its own, whether or not white space parts them.
CLOSING = r"(\pL)([!-&(-/:-@\[-`{-~]+)(\s|$)"
PRE_TOKEN = r"'(?i:s|t|re|ve|m|ll|d)|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """Token ids of texts by a tokenizer file whose pre-tokeniser never crosses white space.

    The ids of a text are those of its words in turn, so each distinct word is encoded once. Plain
    words are encoded as one text and their ids told apart by the word-end tokens, of which each word
    has as many as pre-tokens; all others go one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.ends_word[i] = piece.endswith("</w>")
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.starts), len(self.starts) + len(words))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])

    def _learn(self, words: list[str]) -> None:
        column = pa.array(words, pa.large_string())
        plain = pc.and_(pc.match_substring_regex(column, PLAIN_WORD), pc.invert(pc.match_substring(column, "<|"))).to_numpy(zero_copy_only=False)
        easy = [w for w, p in zip(words, plain) if p]
        ids, lengths, kept = [], [], []
        if easy:
            parts = pc.count_substring_regex(pa.array(easy, pa.large_string()), PRE_TOKEN).to_numpy(zero_copy_only=False)
            for at in range(0, len(easy), 20_000):
                some = np.array(self.tokenizer.encode(" ".join(easy[at : at + 20_000]), add_special_tokens=False).ids, dtype=np.uint32)
                word_ends = np.flatnonzero(self.ends_word[some])[np.cumsum(parts[at : at + 20_000]) - 1]
                ids.append(some)
                lengths.append(np.diff(word_ends, prepend=-1))
            kept += easy
        for w in (w for w, p in zip(words, plain) if not p):
            one = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype=np.uint32)
            ids.append(one)
            lengths.append(np.array([len(one)]))
            kept.append(w)
        if kept:
            self._add(kept, np.concatenate(ids), np.concatenate(lengths).astype(np.int64))

    def _shrink(self, words: list[str]) -> None:
        """Forgets all but the known ones among ``words``."""
        kept = [w for w in words if w in self.known]
        at = np.array([self.known[w] for w in kept], dtype=np.int64)
        starts, lengths, ids = self.starts[at], self.lengths[at], self.ids
        self.known, self.starts, self.lengths, self.ids = {}, self.starts[:0], self.lengths[:0], self.ids[:0]
        self._add(kept, ids[spread(starts, lengths)], lengths)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn, and each text's number of ids."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # no special token: fewer distinct words, the same ids
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), CLOSING, r"\1 \2\3")
        distinct, index, counts = split_words(texts)
        distinct = distinct.to_pylist()
        if len(self.known) > REMEMBERED_WORDS:
            self._shrink(distinct)
        self._learn([w for w in distinct if w not in self.known])
        at = np.fromiter(map(self.known.__getitem__, distinct), dtype=np.int64, count=len(distinct))[index]
        lengths = self.lengths[at]
        upto = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)]
        return self.ids[spread(self.starts[at], lengths)], np.diff(upto, prepend=0)


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """This worker's encoder for a tokenizer file; it keeps its remembered words from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, ...`` over each length in turn."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
