"""Language-model scoring with a weighted backoff automaton over the whole corpus.

The automaton's states are the words seen as contexts, the start, and the root. A state has an arc
for every word seen after it, and a failure arc to the root, which has an arc for every word. With
c(u, w) bigrams, c(u) tokens u and a strength k, the weights are those of a Dirichlet-smoothed
bigram, whose arcs of a state sum to one:

    arc      log10((c(u,w) + k P(w)) / (c(u) + k))
    failure  log10(k / (c(u) + k)), then the root's log10 P(w) = log10((c(w)+0.5) / (N+0.5(V+1)))

No task holds the automaton. Texts are read in blocks; a block sends the distinct words and bigrams
it will walk over, with its training counts of them, to the owner tasks of these keys. An owner adds
up what all blocks counted and answers each block's keys in the order asked. The block then has just
the arcs and failure arcs on its texts' paths, and walks them once from left to right. Keys are
64-bit hashes; a word is in a block's message once, so frequent words make no hot task.

The strength is the one, of STRENGTHS, under which the training texts are likeliest when each token
is scored by the counts without itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import from_planes, mix64, planes, shuffle_width, staged
from tidemark.llm.tokens import chunks_of_text, split_words

STRENGTHS = (10.0, 100.0, 1_000.0, 10_000.0)
BLOCK_BYTES = 12_000_000
STEPS_AT_ONCE = 250_000
DOCS_PER_OWNER = 4_000
END, START = xxhash.xxh64_intdigest(b""), xxhash.xxh64_intdigest(b" ")

MESSAGE = pa.schema([("to", pa.int64()), ("block", pa.int64()), ("shard", pa.int64()), *((k, pa.binary()) for k in ("words", "hashes", "meta", "uni", "uni_n", "bi", "bi_n"))])
MESSAGE_DDL = "to bigint, block bigint, shard bigint, words binary, hashes binary, meta binary, uni binary, uni_n binary, bi binary, bi_n binary"


def _keys_out(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def _keys_in(raw: bytes) -> np.ndarray:
    return np.cumsum(from_planes(raw, np.uint64), dtype=np.uint64)


def _walk(words: np.ndarray, counts: np.ndarray, hashes: np.ndarray):
    """The tokens of a block: the text, word and state of each, and the sorted distinct words' and bigrams' keys.

    Returns ``(text, word, state, word keys, place of each word among them, bigram keys, place of each token's)``.
    """
    n = len(hashes)
    text = np.repeat(np.arange(len(counts), dtype=np.int32), counts + 1)
    ends = np.cumsum(counts + 1) - 1
    word = np.full(len(text), n, dtype=np.int32)
    inner = np.ones(len(text), dtype=bool)
    inner[ends] = False
    word[inner] = words
    state = np.roll(word, 1)
    state[ends - counts] = n + 1
    all_hashes = np.concatenate([hashes, np.array([END, START], dtype=np.uint64)])
    order = np.argsort(all_hashes)
    place = np.empty(n + 2, dtype=np.int32)
    place[order] = np.arange(n + 2)
    both = state.astype(np.int64) * (n + 2) + word
    turns = np.argsort(both)
    both = both[turns]
    new = np.ones(len(both), dtype=bool)
    new[1:] = both[1:] != both[:-1]
    pairs = both[new]
    del both
    of = np.empty(len(turns), dtype=np.int32)
    of[turns] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    del turns, new
    pair_keys = mix64(all_hashes[pairs // (n + 2)], all_hashes[pairs % (n + 2)])
    pair_order = np.argsort(pair_keys)
    pair_place = np.empty(len(pairs), dtype=np.int32)
    pair_place[pair_order] = np.arange(len(pairs), dtype=np.int32)
    return text, word, state, all_hashes[order], place, pair_keys[pair_order], pair_place[of]


def _asking(shards: int, block_bytes: int):
    def run(batches):
        part, serial = TaskContext.get().partitionId(), 0
        for b in batches:
            for first, to, texts in chunks_of_text(b.column(2), block_bytes):
                distinct, index, counts = split_words(pc.ascii_lower(texts))
                hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct.to_pylist()), dtype=np.uint64, count=len(distinct))
                ids = b.column(0).slice(first, to - first)
                held = b.column(1).slice(first, to - first).to_numpy(zero_copy_only=False).astype(np.int8)  # 1: learns nothing
                text, word, state, keys, place, pair_keys, pair_of = _walk(index, counts, hashes)
                learns = held[text] == 0
                uni_n = np.bincount(place[word[learns]], minlength=len(keys)).astype(np.uint32)
                starts = int((held == 0).sum())  # the start is a context, not a token
                bi_n = np.bincount(pair_of[learns], minlength=len(pair_keys)).astype(np.uint32)
                is_start = keys == np.uint64(START)
                uni_n[is_start] = starts
                block = (part << 24) + serial
                serial += 1
                no_id = pc.is_null(ids).to_numpy(zero_copy_only=False).astype(np.int64)
                meta = np.stack([pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64), no_id, held.astype(np.int64), counts])
                rows = [(-1 - block, block, -1, planes(index.astype(np.uint32)), hashes.tobytes(), meta.tobytes(), None, None, None, None)]
                edges = np.arange(shards + 1)
                at, pair_at = np.searchsorted(_shard(keys, shards), edges), np.searchsorted(_shard(pair_keys, shards), edges)
                for s in range(shards):
                    u, p = slice(at[s], at[s + 1]), slice(pair_at[s], pair_at[s + 1])
                    rows.append((s, block, s, None, None, None, _keys_out(keys[u]), planes(uni_n[u]), _keys_out(pair_keys[p]), planes(bi_n[p])))
                yield _batch(rows)

    return run


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """The owner of each key: equal ranges in key order."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), MESSAGE)], schema=MESSAGE)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]):
    found, of = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(of, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)
    return found, total, np.split(total[of], np.cumsum([len(k) for k in keys])[:-1])


def _owner(table: pa.Table) -> pa.Table:
    """Answers one shard's questions; a block's own rows pass through to it."""
    if table["shard"][0].as_py() < 0:
        return table.set_column(0, "to", table["block"])
    blocks = table["block"].to_pylist()
    uni_keys = [_keys_in(x) for x in table["uni"].to_pylist()]
    keys, total, uni = _summed(uni_keys, [from_planes(x, np.uint32) for x in table["uni_n"].to_pylist()])
    tokens = (total > 0) & (keys != np.uint64(START))
    facts = np.array([total[tokens].sum(), tokens.sum()], dtype=np.int64).tobytes()
    _, _, bi = _summed([_keys_in(x) for x in table["bi"].to_pylist()], [from_planes(x, np.uint32) for x in table["bi_n"].to_pylist()])
    shard = table["shard"][0].as_py()
    return pa.Table.from_batches([_batch([(b, b, shard, None, None, facts, None, planes(u.astype(np.int64)), None, planes(x.astype(np.int64))) for b, u, x in zip(blocks, uni, bi)])])


def _scoring(strengths: tuple[float, ...], schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["shard"])
        own, answers = rows[0], rows[1:]
        ids, no_id, held, counts = np.frombuffer(own["meta"], np.int64).reshape(4, -1)
        n_all, v_all = np.sum([np.frombuffer(a["meta"], np.int64) for a in answers], axis=0)
        uni = np.concatenate([from_planes(a["uni_n"], np.int64) for a in answers])
        bi = np.concatenate([from_planes(a["bi_n"], np.int64) for a in answers])
        text, word, state, _, place, _, pair_of = _walk(from_planes(own["words"], np.uint32), counts, np.frombuffer(own["hashes"], np.uint64))
        del rows, own, answers
        room = n_all + 0.5 * (v_all + 1)
        known, base = np.zeros(len(ids)), np.zeros(len(ids))
        scores, left = np.zeros((len(ids), len(strengths))), np.zeros((len(ids), len(strengths)))
        for at in range(0, len(text), STEPS_AT_ONCE):
            here = slice(at, at + STEPS_AT_ONCE)
            of = text[here]
            c_w, c_u, c_uw = uni[place[word[here]]], uni[place[state[here]]], bi[pair_of[here]]
            p, learns = (c_w + 0.5) / room, held[of] == 0
            left_p = np.where(learns, (c_w - 0.5) / (room - 1), 1.0)

            def per_text(x, of=of):
                return np.bincount(of, weights=x, minlength=len(ids))

            known += per_text(c_w > 0)
            base += per_text(np.log10(p))
            for i, k in enumerate(strengths):
                arc = np.log10((c_uw + k * p) / (c_u + k))
                failure = np.log10(k / (c_u + k)) + np.log10(p)
                scores[:, i] += per_text(np.where(c_uw > 0, arc, failure))
                left[:, i] += per_text(np.where(learns, np.log10((np.maximum(c_uw - 1, 0) + k * left_p) / (np.maximum(c_u - 1, 0) + k)), 0.0))
        columns = [pa.array(ids, mask=no_id > 0), pa.array(counts + 1), pa.array(known.astype(np.int64)), pa.array(np.full(len(ids), n_all)), pa.array(base)]
        columns += [pa.array(list(x), pa.list_(pa.float64())) for x in (scores, left)]
        pa.default_memory_pool().release_unused()
        return pa.Table.from_arrays([*columns, pa.array(held > 0)], schema=schema)

    return run


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", strengths: tuple[float, ...] = STRENGTHS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score, strength)``, one row per input row.

    Texts with ``held_out`` false teach the model; those where it is true or null don't. Every text's
    tokens are its words, A-Z lower-cased, and one end. Defined results: null or empty text is the
    end alone; repeated rows count and come out as often as they come; an empty table gives no rows;
    if nothing teaches, every word is unknown; other columns are ignored. Memory of a task is bounded
    by a block (or the longest text) and by one owner's keys; owners grow in number with the rows.
    """
    spark = docs.sparkSession
    shards = max(shuffle_width(spark), docs.count() // DOCS_PER_OWNER)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held"), F.col(text_col).cast("string").alias("text"))
    asked = rows.mapInArrow(_asking(shards, block_bytes), MESSAGE_DDL)
    answered = asked.groupBy("to").applyInArrow(_owner, MESSAGE_DDL)
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("scores", pa.list_(pa.float64())), ("left_out", pa.list_(pa.float64())), ("held", pa.bool_())])
    ddl = "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, scores array<double>, left_out array<double>, held boolean"
    scored = staged(answered.groupBy("to").applyInArrow(_scoring(strengths, out), ddl), "lm-scores")
    likely = scored.where(~F.col("held")).agg(*(F.sum(F.col("left_out")[i]).alias(f"k{i}") for i in range(len(strengths)))).first()
    best = max(range(len(strengths)), key=lambda i: likely[i] if likely[i] is not None else 0.0)
    return scored.select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", F.col("scores")[best].alias("score"), F.lit(strengths[best]).alias("strength"))
