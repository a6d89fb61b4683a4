"""Approximate nearest neighbours by score-aware anisotropic quantisation.

For the largest inner products, the part of a vector's quantisation error that is parallel to the
vector costs more than the rest. Vectors of unit length are product-quantised to four bits for each
pair of dimensions, under a loss that weighs the parallel error by ETA; both the codes and the
codebooks are chosen for that loss. A search scans the codes through a query's table of 16 partial
products a subspace, computes the exact cosine of the best ones, then that of every row that its code's
errors along and across the vector don't rule out: what is found doesn't hang on how well the codebooks fit.

Copies of a vector are one row of the index, with the smallest of their ids. Blocks of the index and slices of
queries meet in tasks, each of which hands on a query's k nearest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.shared import staged

CODES = 16
THRESHOLD = 0.2
SAMPLE = 8192
BLOCK_ROWS, SLICE_ROWS, QUERIES_AT_ONCE = 16_384, 8192, 128
#: Rows of a block whose cosines a query computes before the bounds; they decide the time alone.
FIRST = 32
#: More than the sums of codes in single precision can be off.
SLACK = 1e-4


@dataclass
class Quantiser:
    dims: int
    width: int  # dimensions of a subspace
    books: np.ndarray  # subspace, code, dimension
    eta: float

    def split(self, unit: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(unit), self.books.shape[0] * self.width))
        padded[:, : self.dims] = unit
        return padded.reshape(len(unit), -1, self.width)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(codes.shape[1]), codes].reshape(len(codes), -1)[:, : self.dims]

    def encode(self, unit: np.ndarray, rounds: int = 3) -> np.ndarray:
        """The code of each subspace; coordinate descent on the whole vector's loss."""
        parts = self.split(unit)
        codes = np.stack([_nearest(parts[:, s], self.books[s]) for s in range(len(self.books))], axis=1)
        return _descend(parts, self.books, codes, self.eta, rounds)


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((x[:, None] - book[None]) ** 2).sum(2).argmin(1)


def _parallel(part: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Each vector's error in this subspace, along the vector."""
    return ((part - centre) * part).sum(-1)


def _descend(parts: np.ndarray, books: np.ndarray, codes: np.ndarray, eta: float, rounds: int) -> np.ndarray:
    along = sum(_parallel(parts[:, s], books[s][codes[:, s]]) for s in range(len(books)))
    for _ in range(rounds):
        for s, book in enumerate(books):
            x = parts[:, s]
            rest = along - _parallel(x, book[codes[:, s]])
            error = ((x[:, None] - book[None]) ** 2).sum(2)
            here = (x**2).sum(1)[:, None] - x @ book.T
            codes[:, s] = (error + (eta - 1) * (rest[:, None] + here) ** 2).argmin(1)
            along = rest + _parallel(x, book[codes[:, s]])
    return codes


def fit_quantiser(sample: np.ndarray, width: int = 2, rounds: int = 6, threshold: float = THRESHOLD) -> Quantiser:
    """Codebooks for the unit vectors of a sample. The loss weighs parallel error (d-1)T²/(1-T²) times."""
    dims = sample.shape[1]
    eta = max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))
    n_books = -(-dims // width)
    q = Quantiser(dims, width, np.zeros((n_books, CODES, width)), eta)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    parts, rng = q.split(unit), np.random.default_rng(11)
    for s in range(n_books):
        book = parts[rng.integers(0, len(parts), CODES), s].copy()
        for _ in range(8):
            own = _nearest(parts[:, s], book)
            for c in range(CODES):
                if (own == c).any():
                    book[c] = parts[own == c, s].mean(0)
        q.books[s] = book
    codes = q.encode(unit, 1)
    for _ in range(rounds):
        along = sum(_parallel(parts[:, s], q.books[s][codes[:, s]]) for s in range(n_books))
        for s in range(n_books):
            x = parts[:, s]
            rest = along - _parallel(x, q.books[s][codes[:, s]])
            for c in range(CODES):
                mine = codes[:, s] == c
                if mine.any():  # the centre with the least loss solves a small linear system
                    y, target = x[mine], (rest + (x**2).sum(1))[mine]
                    q.books[s, c] = np.linalg.solve(mine.sum() * np.eye(width) + (eta - 1) * y.T @ y, y.sum(0) + (eta - 1) * (target[:, None] * y).sum(0))
            along = rest + _parallel(x, q.books[s][codes[:, s]])
        codes = _descend(parts, q.books, codes, eta, 1)
    return q


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, vec)``: vectors with an id that are neither null, empty nor zero and hold finite numbers only."""
    v = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec")).where("vec_id is not null and vec is not null")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.where(F.coalesce(finite, F.lit(False)) & F.exists("vec", lambda x: x != 0))


def build_index(vectors: DataFrame, copies: int, sample: int = SAMPLE) -> tuple[DataFrame, Quantiser | None, int]:
    """The coded rows ``(number, vec, ids, code, along, across)``, one for each different vector, the quantiser and the number of rows.

    ids are the ``copies`` smallest ids of the vector. The quantiser is fitted on about ``sample`` rows, chosen
    by a hash of the vector, and at most twice as many; every row is coded. Rows whose dimension is not the one that most rows have take
    no part.
    """
    spark = vectors.sparkSession
    sizes = vectors.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return vectors.select(F.col("vec_id").alias("number"), "vec", F.array("vec_id").alias("ids"), F.lit(None).cast("binary").alias("code")), None, 0
    dims = sizes[0]["d"]
    first = W.partitionBy("vec").orderBy("vec_id")
    few = vectors.where(F.size("vec") == dims).distinct().withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= copies)
    rows = staged(few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.monotonically_increasing_id().alias("number"), "vec", "ids"), "ann-vectors")
    n = rows.count()
    share = F.pmod(F.xxhash64("vec", F.lit("ann")), F.lit(1 << 20)) < int(min(1.0, sample / n) * (1 << 20)) + 1
    taken = rows.where(share).limit(2 * sample).select("vec").toArrow()["vec"]
    if not len(taken):
        taken = rows.limit(sample).select("vec").toArrow()["vec"]
    quantiser = fit_quantiser(_matrix(taken, dims))
    held = spark.sparkContext.broadcast(quantiser)

    def encode(batches):
        q = held.value
        for b in batches:
            x = _matrix(b.column(1), dims)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            codes = q.encode(unit).astype(np.uint8)
            along, across = _bounds(unit, q.decode(codes))
            even = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
            packed = even[:, ::2] | even[:, 1::2] << 4
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(along), pa.array(across)], names=["number", "vec", "ids", "code", "along", "across"])

    return staged(rows.mapInArrow(encode, "number bigint, vec array<double>, ids array<bigint>, code binary, along double, across double"), "ann-index"), quantiser, n


def _bounds(unit: np.ndarray, decoded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a code loses of each unit vector: the error along the vector, and the length of the error across it."""
    error = unit - decoded
    along = (error * unit).sum(1)
    return along, np.sqrt(((error - along[:, None] * unit) ** 2).sum(1))


def _best(ids: list, scores: np.ndarray, own: int, k: int) -> list[tuple[int, float]]:
    """The ``k`` nearest different ids of some rows, without ``own``; ties go to the smaller id. An id with several vectors counts by its nearest."""
    found: dict[int, float] = {}
    order = np.argsort(-scores, kind="stable")
    at = 0
    while at < len(order) and len(found) < k:
        end = at + 1
        while end < len(order) and scores[order[end]] == scores[order[at]]:
            end += 1
        for i in sorted({i for row in order[at:end] for i in ids[row]}):
            if i != own and len(found) < k:
                found.setdefault(i, float(scores[order[at]]))
        at = end
    return list(found.items())


def _searcher(quantiser: Quantiser, k: int, first: int):
    """One block of codes for one slice of queries: the ``k`` nearest ids in the block, by exact cosine.

    The ``first`` rows by the codes give a cosine t that k ids reach. Let a row x have the code's product g, its
    error a along x and p across it: a cosine c with q keeps |(1 - a) c - g| <= p sqrt(1 - c*c), so that a row with
    g + p sqrt(1 - t*t) < (1 - a) t lies below t. All other rows are computed, too: no row is left out by its estimate.
    """
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        if not data.num_rows or not queries.num_rows:
            return schema.empty_table()
        n_books, n = len(quantiser.books), data.num_rows
        packed = np.frombuffer(b"".join(data["code"].to_pylist()), np.uint8).reshape(n, -1)
        codes = np.ascontiguousarray(np.stack([packed & 15, packed >> 4], axis=2).reshape(n, -1)[:, :n_books].T)
        x, ids = _matrix(data["vec"], quantiser.dims), data["ids"].to_pylist()
        lengths, along, across = np.sqrt((x * x).sum(1)), data["along"].to_numpy(), data["across"].to_numpy()
        asked, q = queries["query"].to_numpy(), _matrix(queries["vec"], quantiser.dims)
        out, take = [], min(first, n)

        def cosines(some: np.ndarray, one: np.ndarray) -> np.ndarray:
            return (x[some] * one).sum(1) / (lengths[some] * np.sqrt((one * one).sum()))

        for at in range(0, len(q), QUERIES_AT_ONCE):
            some = q[at : at + QUERIES_AT_ONCE]
            tables = np.einsum("qsw,scw->sqc", quantiser.split(some / np.sqrt((some * some).sum(1, keepdims=True))), quantiser.books).astype(np.float32)
            sums = np.zeros((len(some), n), dtype=np.float32)
            for s in range(n_books):
                sums += tables[s][:, codes[s]]
            near = np.argpartition(-sums, take - 1, axis=1)[:, :take] if take < n else np.broadcast_to(np.arange(n), sums.shape)
            for one, own, guess, rows in zip(some, asked[at : at + QUERIES_AT_ONCE].tolist(), sums, near):
                scores = cosines(rows, one)
                best = _best([ids[r] for r in rows], scores, own, k)
                if take < n:
                    t = best[-1][1] if len(best) == k else -np.inf
                    # the root falls with t from 0 on; below that it is 1 at most
                    open_ = guess + across * math.sqrt(1 - min(max(t, 0.0), 1.0) ** 2) + along * t >= t - SLACK if np.isfinite(t) else np.ones(n, bool)
                    open_[rows] = False
                    rest = np.flatnonzero(open_)
                    more = cosines(rest, one)
                    rest, more = rest[more >= t], more[more >= t]
                    best = _best([ids[r] for r in rows] + [ids[r] for r in rest], np.concatenate([scores, more]), own, k)
                out.extend((own, i, score) for i, score in best)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema) if out else schema.empty_table()

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", first: int = FIRST, block_rows: int = BLOCK_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest of each query row, by cosine.

    Queries are the usable rows where ``is_query``, a condition on ``vec_id``, holds; candidates are
    all usable rows but those with the query's id. The index goes in blocks, queries in slices; each block
    is scanned for each slice by one task, which computes the exact cosine in double precision of ``first`` rows and of
    all rows that their codes can't rule out: ``first`` and the codebooks decide the time, never the result. Ties go to the
    smaller id. Defined results: null, empty, zero and non-finite vectors, null ids and vectors of a rare dimension take no
    part; an id that several query rows have asks once, with the least of their vectors; fewer candidates than
    ``k`` are all returned; an empty table gives no rows; other columns are ignored.
    """
    found = usable(vectors, id_col, vector_col)
    index, quantiser, n = build_index(found, k + 1)
    if quantiser is None:
        return index.select(F.col("number").alias("query_id"), F.lit(1).alias("rank"), F.col("number").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
    queries = found.where(is_query).where(F.size("vec") == quantiser.dims).groupBy(F.col("vec_id").alias("query")).agg(F.min("vec").alias("vec"))
    queries = staged(queries, "ann-queries")
    blocks, slices = max(1, -(-n // block_rows)), max(1, -(-queries.count() // slice_rows))
    dealt = lambda c, m, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(m))
    data = index.select("vec", "ids", "code", "along", "across", dealt("number", blocks, "block").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    asked = queries.select("query", "vec", dealt("query", slices, "slice").cast("int").alias("slice"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"))
    scored = data.groupBy("block", "slice").cogroup(asked.groupBy("block", "slice")).applyInArrow(_searcher(quantiser, k, first), "query_id bigint, vec_id bigint, score double")
    # an id with several vectors counts by its nearest
    scored = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
