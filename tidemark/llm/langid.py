"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a
word is the sum, over all its segmentations into pieces, of the products of the pieces'
probabilities; a forward pass over the word's positions sums them without listing them. The pieces'
probabilities are fitted by expectation-maximisation over the same segmentations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import give_back, staged
from tidemark.llm.tokens import chunks_of_text, split_words

#: Runs of up to so many letters are scored with others of just their length, longer ones with others up to LONGER times theirs.
EXACT, LONGER = 40, 1.25
#: A fit keeps the edges of runs of up to so many letters from its forward pass, and makes those of longer ones anew, as many at once.
AT_ONCE = 200
#: The forward pass brings its sums back to one at every so many positions, so they stay in range.
RESCALED = 8
#: Probability of a character that the vocabulary has no piece for, in every language.
UNKNOWN = 1e-9
SMOOTHING = 0.1
BOUNDARY = "▁"
_MULTIPLIER = 0x9E3779B97F4A7C15
_SLOTS = 20


class Vocabulary:
    """Lower-case letter pieces, found by a rolling hash of their characters."""

    def __init__(self, pieces: list[str]):
        found = sorted({p.lower() for p in pieces if p and p != BOUNDARY and (p.removeprefix(BOUNDARY).isalpha() or p == BOUNDARY)})
        self.size = len(found)
        self.longest = max(map(len, found), default=1)
        keys = np.array([_hash_of(p) for p in found], dtype=np.uint64)
        slots = 1 << _SLOTS
        self.at = np.full(slots + 64, self.size, dtype=np.int32)  # the piece behind each slot; size: none
        self.keys = np.zeros(slots + 64, dtype=np.uint64)
        self.probes = 1
        for i, k in enumerate(keys):
            s = int(k) >> (64 - _SLOTS)
            n = 1
            while self.at[s] != self.size:
                s, n = s + 1, n + 1
            self.at[s], self.keys[s], self.probes = i, k, max(self.probes, n)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The piece of each key, or ``size``."""
        slot = (keys >> np.uint64(64 - _SLOTS)).astype(np.int64)
        out = np.where(self.keys[slot] == keys, self.at[slot], self.size)
        for n in range(1, self.probes):
            out = np.where((self.keys[slot + n] == keys) & (out == self.size), self.at[slot + n], out)
        return out


def _hash_of(piece: str) -> int:
    h = 0
    for c in piece:
        h = ((h + ord(c) + 1) * _MULTIPLIER) % 2**64
    return h


def public_vocabulary(path: str) -> Vocabulary:
    """The pieces of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return Vocabulary([model.id_to_piece(i) for i in range(model.get_piece_size())])


def letter_runs(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-case runs of letters, with the marks on them, in each word, and the word each is in."""
    split = pc.split_pattern(pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(words), r"[^\p{L}\p{M}]+", " "), " "), " ")
    runs, of = split.flatten(), np.repeat(np.arange(len(words)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    keep = pc.match_substring_regex(runs, r"\p{L}").to_numpy(zero_copy_only=False)
    return (runs, of) if keep.all() else (runs.filter(pa.array(keep)), of[keep])


def _by_length(runs: pa.Array, most: int = 2_000_000):
    """``(numbers of the runs, their lengths, their characters after a word boundary, one row each)`` for runs of like length.

    Rows are filled up with zeros, which are no letter, to the longest; ``most`` bounds the characters at once, but for one run.
    """
    sizes = pc.utf8_length(runs).to_numpy(zero_copy_only=False).astype(np.int64)
    kind = np.where(sizes <= EXACT, sizes, EXACT + 1 + np.floor(np.log(np.maximum(sizes, 1) / EXACT) / np.log(LONGER)).astype(np.int64))
    for k in np.unique(kind):
        mine = np.flatnonzero(kind == k)
        step = max(1, most // int(sizes[mine].max()))
        for first in range(0, len(mine), step):
            at = mine[first : first + step]
            n = sizes[at]
            codes = np.frombuffer("".join(runs.take(pa.array(at)).to_pylist()).encode("utf-32-le"), dtype=np.uint32)
            chars = np.zeros((len(at), int(n.max()) + 1), dtype=np.uint32)
            chars[:, 0] = ord(BOUNDARY)
            chars[np.repeat(np.arange(len(at)), n), np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n) + 1] = codes
            yield at, n, chars


def _lattice(vocabulary: Vocabulary, chars: np.ndarray, first: int = 0, last: int | None = None):
    """``(start, end, piece of each row)`` for every stretch of positions that a piece can cover, starting from ``first`` to before ``last``."""
    n = chars.shape[1]
    codes = chars.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(first, n if last is None else last):
            h = np.zeros(len(chars), dtype=np.uint64)
            for j in range(i + 1, min(n, i + vocabulary.longest) + 1):
                h = (h + codes[:, j - 1]) * np.uint64(_MULTIPLIER)
                yield i, j, vocabulary.find(h)


def _weights(vocabulary: Vocabulary, table: np.ndarray, start: int, end: int, piece: np.ndarray) -> np.ndarray:
    """The pieces' probabilities; a single letter that is no piece has that of the unknown."""
    p = table[piece]
    return np.where((piece == vocabulary.size).reshape(-1, *[1] * (p.ndim - 1)), UNKNOWN, p) if end == start + 1 else p


def _forward(vocabulary: Vocabulary, table: np.ndarray, chars: np.ndarray, edges: list | None = None, wanted: np.ndarray | None = None) -> np.ndarray:
    """The logs of the forward sums of each run and further axis of ``table``.

    Without ``wanted`` those of all positions; the edges are taken down if asked. With it, only those at
    each run's own position: then no more than the longest piece's length of sums is held, whatever the run.
    """
    n, reach = chars.shape[1], vocabulary.longest + 1
    shape = (len(chars), *table.shape[1:])
    ring = np.zeros((reach, *shape))
    every = np.zeros((n + 1, *shape)) if wanted is None else None
    out, scale, at = np.zeros(shape), np.zeros(shape), 0
    ring[0] = 1

    def settle(i: int) -> None:
        """Position i gets no more: takes down its log and, now and then, brings the sums back to one."""
        nonlocal scale
        here = ring[i % reach]
        logs = np.log(here) + scale
        if every is not None:
            every[i] = logs
        else:
            done = wanted == i
            out[done] = logs[done]
        if i % RESCALED == 0:
            scale = logs
            for j in range(1, reach):
                ring[(i + j) % reach] /= here
            here[:] = 1

    for i, j, piece in _lattice(vocabulary, chars):
        if i > at:
            ring[at % reach] = 0  # the slot is position at + reach's from now on
            settle(i)
            at = i
        p = _weights(vocabulary, table, i, j, piece)
        ring[j % reach] += ring[i % reach] * p
        if edges is not None:
            edges.append((i, j, piece, p))
    settle(n)
    return out if every is None else every


def log_probabilities(vocabulary: Vocabulary, table: np.ndarray, runs: pa.Array) -> np.ndarray:
    """Log probability of each run in each language; ``table`` has a row for each piece, then one of zeros."""
    out = np.zeros((len(runs), table.shape[1]))
    for at, sizes, chars in _by_length(runs):
        out[at] = _forward(vocabulary, table, chars, wanted=sizes + 1)
    return out


def expected_counts(vocabulary: Vocabulary, table: np.ndarray, runs: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece, over all segmentations of the weighted runs; ``table`` is one language's.

    The backward pass carries the probability that a segmentation has a boundary at each position: an
    edge's share of the forward sum at its end, times that end's probability. The edges of runs of up to AT_ONCE
    letters are kept from the forward pass; of longer ones they are made anew, a stretch at a time from the end.
    """
    out = np.zeros(vocabulary.size + 1)
    for at, sizes, chars in _by_length(runs, most=200_000):
        n = chars.shape[1]
        edges: list | None = [] if n <= AT_ONCE + 1 else None
        logs = _forward(vocabulary, table, chars, edges)
        passed = np.zeros(logs.shape)
        passed[sizes + 1, np.arange(len(at))] = 1

        def back(some: list) -> None:
            for i, j, piece, p in reversed(some):
                with np.errstate(invalid="ignore"):
                    share = np.where(passed[j] > 0, p * np.exp(logs[i] - logs[j]) * passed[j], 0.0)
                passed[i] += share
                np.add.at(out, piece, share * weights[at])

        if edges is not None:
            back(edges)
        else:
            for last in range(n, 0, -AT_ONCE):
                some = _lattice(vocabulary, chars, max(0, last - AT_ONCE), last)
                back([(i, j, piece, _weights(vocabulary, table, i, j, piece)) for i, j, piece in some])
    return out[:-1]


@dataclass
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray
    table: np.ndarray
    vocabulary_path: str
    #: Each language's mean log probability of a letter in the rows it was learned from.
    per_letter: np.ndarray


def fit(docs: DataFrame, vocabulary_path: str, per_language: int = 1500, rounds: int = 3, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> LanguageModel:
    """Fits the pieces' probabilities on labelled rows.

    Takes about ``per_language`` rows of each language, chosen by a hash of id and text, with their whole
    texts and runs of any length; languages' priors come from all rows. The counts of a round are summed in Spark; a row
    for each language and piece reaches the driver. Rows without language or text teach nothing; repeated rows are
    taken or left together; an empty table gives a model without languages.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros(0), np.zeros((0, 0)), vocabulary_path, np.zeros(0))
    share = F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / sizes[k])))))
    sample = known.where(F.pmod(F.xxhash64(F.col("id").cast("string"), F.col("text"), F.lit("langid")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def runs_of(batches):
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), dtype=object)
            for first, to, texts in chunks_of_text(b.column(1)):
                for lang in set(langs[first:to]):
                    words, index, _ = split_words(texts.filter(pa.array(langs[first:to] == lang)))
                    runs, of = letter_runs(words)
                    n = np.bincount(index, minlength=len(words))[of]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(runs), pa.string()), runs.cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "run", "n"])

    counted = staged(sample.select("lang", "text").mapInArrow(runs_of, "lang string, run string, n bigint").groupBy("lang", "run").agg(F.sum("n").alias("n")), "langid-words")
    size = public_vocabulary(vocabulary_path).size
    table = np.vstack([np.full((size, len(languages)), 1 / max(1, size)), np.zeros((1, len(languages)))])
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((languages, table))

        def expect(batches):
            vocabulary, (names, now) = public_vocabulary(vocabulary_path), held.value
            total = np.zeros((vocabulary.size, len(names)))
            for b in batches:
                langs = np.array(b.column(0).to_pylist(), dtype=object)
                for k, name in enumerate(names):
                    mine = pa.array(langs == name)
                    runs = b.column(1).filter(mine).cast(pa.large_string())
                    total[:, k] += expected_counts(vocabulary, now[:, k], runs, b.column(2).filter(mine).to_numpy(zero_copy_only=False).astype(float))
            piece, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(piece, pa.int64()), pa.array(total[piece, k], pa.float64())], names=["k", "piece", "n"])

        sums = counted.mapInArrow(expect, "k bigint, piece bigint, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((size, len(languages)))
        counts[sums["piece"].to_numpy(), sums["k"].to_numpy()] = sums["n"].to_numpy()
        table = np.vstack([(counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * size), np.zeros((1, len(languages)))])
    held = spark.sparkContext.broadcast((languages, table))

    def letters(batches):
        vocabulary, (names, now) = public_vocabulary(vocabulary_path), held.value
        for b in batches:
            langs, n = np.array(b.column(0).to_pylist(), dtype=object), b.column(2).to_numpy(zero_copy_only=False).astype(float)
            for k, name in enumerate(names):
                mine = langs == name
                runs = b.column(1).filter(pa.array(mine)).cast(pa.large_string())
                logs = log_probabilities(vocabulary, now[:, k : k + 1], runs)[:, 0]
                size = pc.utf8_length(runs).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([float(logs @ n[mine])]), pa.array([float(size @ n[mine])])], names=["k", "logs", "letters"])
        give_back()

    per_letter = np.full(len(languages), -np.inf)
    for r in counted.mapInArrow(letters, "k bigint, logs double, letters double").groupBy("k").agg(F.sum("logs").alias("logs"), F.sum("letters").alias("letters")).collect():
        per_letter[r["k"]] = r["logs"] / r["letters"] if r["letters"] else -np.inf
    total = sum(sizes.values())
    return LanguageModel(languages, np.log([sizes[k] / total for k in languages]), table, vocabulary_path, per_letter)


def predicted(text: Column, model: LanguageModel, spark) -> Column:
    """A struct ``(lang, score, below)`` for each whole text.

    lang is the likeliest language, score its posterior probability (0 to 1), below how much less
    likely a letter of the text is than one of the rows the language was learned from, in nats.
    ``und`` with score and below 0 stands for a null text, one without any letter, or a model
    without languages. Ties go to the language whose name sorts first.
    """
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double, below: double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = held.value
        names = np.array([*model.languages, "und"], dtype=object)
        vocabulary = public_vocabulary(model.vocabulary_path) if model.languages else None
        for column in batches:
            langs, scores, belows = [], [], []
            for _, _, texts in chunks_of_text(column):
                best, score, below = np.full(len(texts), len(names) - 1), np.zeros(len(texts)), np.zeros(len(texts))
                if vocabulary:
                    words, index, counts = split_words(texts)
                    runs, of = letter_runs(words)
                    logs = log_probabilities(vocabulary, model.table, runs)
                    per_word = np.stack([np.bincount(of, weights=w, minlength=len(words)) for w in (*logs.T, pc.utf8_length(runs).to_numpy(zero_copy_only=False))], axis=1)
                    doc = np.repeat(np.arange(len(counts)), counts)
                    sums = np.stack([np.bincount(doc, weights=w[index], minlength=len(counts)) for w in per_word.T], axis=1)
                    joint = sums[:, :-1] + model.log_prior
                    shifted = np.exp(joint - joint.max(1, keepdims=True))
                    lettered = sums[:, -1] > 0
                    best = np.where(lettered, joint.argmax(1), best)
                    likeliest = np.minimum(best, len(model.languages) - 1)
                    below = np.where(lettered, model.per_letter[likeliest] - sums[np.arange(len(best)), likeliest] / np.maximum(sums[:, -1], 1), 0.0)
                    score = np.where(lettered, shifted.max(1) / shifted.sum(1), 0.0)
                langs += names[best].tolist()
                scores.append(score)
                belows.append(below)
            numbers = [pa.array(np.concatenate(x) if x else [], pa.float64()) for x in (scores, belows)]
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), *numbers], names=["lang", "score", "below"])
            give_back()

    return predict(text)
