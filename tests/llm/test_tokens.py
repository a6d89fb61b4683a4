"""Packing and SentencePiece against the tokenizer itself and a plain Viterbi."""

import functools
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import packing, sentencepiece_lattice
from tidemark.llm.tokens import default_path

WORDS, PIECES = default_path("word_bpe_49k.json"), default_path("piece_bpe_32k.model")


@functools.cache
def tokenizer():
    return Tokenizer.from_file(WORDS)


def ids_of(text):
    return np.array([*tokenizer().encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


ODD = [(20, "don't <|endoftext|> stop..., (now)!"), (21, "x1y22 ½ İstanbul ﬁne Ⅷ ...Hi'LL 'Tis"), (22, "中文 字 кот ёж nb​z")]


def test_pieces_hold_the_tokenizers_ids(docs_of, edge_rows):
    rows = edge_rows + ODD
    found = packing.token_pieces(docs_of(rows), WORDS, 500, with_ids=True).collect()
    want = sorted((str(i), k, s, zlib.crc32(ids[s : s + 500].tobytes()), len(ids[s : s + 500])) for i, t in rows for ids in [ids_of(t)] for k, s in enumerate(range(0, len(ids), 500)))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["ids_crc32"], r["length"]) for r in found) == want
    assert all(zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] for r in found)


@pytest.mark.parametrize("items_per_task, slack", [(300, 1.05), (20_000, 1.02)])
def test_packing_is_gapless_and_tight(spark, docs_of, items_per_task, slack):
    rng = np.random.default_rng(2)
    rows = [(i, 0, 0, int(n), 7) for i, n in enumerate(rng.integers(1, 101, 1500))] + [(5000 + i, 0, 0, 100, 7) for i in range(5)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"), 100, items_per_task).collect()
    bins = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    assert sorted(r["doc_id"] for r in found) == [r[0] for r in rows]
    assert len(bins) <= slack * -(-sum(r[3] for r in rows) // 100) + 1  # small tasks pack less tightly; production has 20,000 items in each


def test_repeated_and_null_ids_spread_over_the_tasks(spark):
    rows = [(None, 0, 0, 40, 7)] * 700 + [(5, 0, 0, 60, 7)] * 700
    found = packing.pack(spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"), 100, 100).collect()
    assert len(found) == 1400 and len({r["sequence_id"] for r in found}) <= 800


def test_best_fit_takes_the_tightest_space():
    assert packing.best_fit([6, 5, 4, 3, 2], 10) == [[0, 2], [1, 3, 4]]


def test_packing_of_documents_and_of_nothing(docs_of, edge_rows):
    found = packing.pack_documents(docs_of(edge_rows), WORDS, room=4096).collect()
    assert sum(r["length"] for r in found) == sum(len(ids_of(t)) for _, t in edge_rows)
    assert packing.pack_documents(docs_of(edge_rows).limit(0), WORDS).count() == 0


@functools.cache
def model():
    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    score = {m.id_to_piece(i): (i, -round(float(np.log(10 - m.get_score(i))) * 65536)) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
    return score, max(map(len, score)), m.piece_to_id("<0x00>")


def viterbi(unit):
    score, longest, first_byte = model()
    best = [(0, 0, [])]
    for to in range(1, len(unit) + 1):
        reach = []
        for start in range(max(0, to - longest), to):
            piece = unit[start:to]
            if piece in score:
                reach.append((best[start][0] + score[piece][1], -start, [score[piece][0]]))
            elif to - start == 1:
                raw = piece.encode()
                reach.append((best[start][0] - 20 * 65536 * len(raw), -start, [first_byte + b for b in raw]))
        s, back, own = max(reach, key=lambda r: r[:2])
        best.append((s, back, best[-back][2] + own))
    return best[-1][2]


def test_encoding_is_the_best_path_and_decodes(docs_of):
    rng = random.Random(9)
    rows = [(1, "The quick  brown fox"), (2, None), (3, ""), (4, "naïve Straße 中 😀!"), (5, "a\n b\t\tc  "), (6, " lead"), (7, "x" * 300), (7, "x" * 300), (None, "no id"), (None, "no id")]
    # units longer than a span: pieces that cross its ends, characters without a piece, and neither
    rows += [(8, "and " + "".join(rng.choice("theinganderst") for _ in range(1500)) + " so"), (9, "".join(rng.choice("中文äចe") for _ in range(700))), (10, "e" * 512), (11, "tion" * 64 + " " + "tion" * 129)]
    want = []
    for i, t in rows:
        ids = [x for u in _parts("▁" + (t or "").replace(" ", "▁")) for x in viterbi(u)]
        want.append((str(i), len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), True, ids))
    for list_bytes in (20, 10**6):
        found = sentencepiece_lattice.encode(docs_of(rows), PIECES, list_bytes=list_bytes).collect()
        assert sorted((str(r["doc_id"]), r["n_ids"], r["ids_crc32"], r["round_trip"], r["ids"]) for r in found) == sorted(want)
    back = sentencepiece_lattice.decode(sentencepiece_lattice.encode(docs_of(rows), PIECES), PIECES)
    assert sorted((str(r["doc_id"]), r["text"]) for r in back.collect()) == sorted((str(i), t or "") for i, t in rows)
    assert sentencepiece_lattice.encode(docs_of(rows).limit(0), PIECES).count() == 0


def test_decoding_keeps_every_row(spark):
    ids = model()[0]["▁the"][0]
    rows = [(1, [ids]), (1, [ids, model()[2] + ord("!")]), (None, []), (2, None), (3, [10**6, -1])]
    found = sentencepiece_lattice.decode(spark.createDataFrame(rows, "doc_id bigint, ids array<int>"), PIECES)
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in found.collect()) == [("1", "the"), ("1", "the!"), ("2", "None"), ("3", ""), ("None", "")]


def _parts(unit):
    """Parts before each run of white space that follows other characters."""
    out, at = [], 0
    blank = lambda c: c == "▁" or c.isspace()
    for k in range(1, len(unit)):
        if blank(unit[k]) and not blank(unit[k - 1]):
            out.append(unit[at:k])
            at = k
    return [*out, unit[at:]]
