"""Near-duplicate embeddings by spherical-cap filters.

Filters are unit directions of random product codes: the dimensions, randomly rotated, are split into two blocks, each
block has its own few random code vectors, and every combination of one code vector a block is a direction. A vector is
list-decoded to all directions whose product with it exceeds a threshold: code vectors of the first block that can't
reach the threshold with any of the second are dropped. Vectors of equal label that share a filter meet and
are verified by their exact cosine. Vectors of a cosine of ``LEAST`` or more exceed nearly the same directions; how
many directions there are follows from the wanted recall at exactly that cosine, and how high the threshold is from the
number of vectors, so that a filter holds as many vectors at any size.

Groups of copies don't make pairs. Equal vectors are one row. Vectors within half the angle of one pivot are a class:
any two of them are linked, by the triangle inequality, without being compared; a class counts its members, and
only vectors of different classes are verified. A filter of very many vectors is cut into slabs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.shared import staged

LEAST = 0.93
#: Vectors of a filter, of the label with the most vectors. Two vectors at the least cosine share no filter with
#: probability ``MISS`` if filters were independent; they aren't quite, hence ``SPARE`` times as many.
OCCUPANCY, MISS, SPARE = 32, 0.003, 1.3
CODES = 32
#: Shorter vectors are filled up with zeros, which leaves cosines as they are.
LEAST_DIMS = 16
#: Vectors of a filter beyond which it is cut into slabs.
SLAB = 4096


@dataclass(frozen=True)
class Directions:
    """The filters for vectors of ``dims`` dimensions: ``CODES`` product codes of two blocks, each with a rotation of its own.

    One code of as many directions would do in theory; several even out that some vectors lie well to one code's
    few vectors a block and others don't.
    """

    dims: int
    threshold: float
    rotations: list[np.ndarray]
    books: list[tuple[np.ndarray, np.ndarray]]


def _tail(dims: int) -> tuple[np.ndarray, np.ndarray]:
    """``(t, p)``: a random unit vector's product with a fixed one is ``t`` or more with probability ``p``."""
    t = np.linspace(-1, 1, 200_001)
    density = np.maximum(0, 1 - t * t) ** ((dims - 3) / 2)
    upper = np.cumsum(density[::-1])[::-1]
    return t, upper / upper[0]


def cap(dims: int, vectors: int, least: float, occupancy: int, miss: float) -> tuple[float, float, float]:
    """``(share, threshold, wanted)``: a filter's share of random vectors, its threshold, and the filters a vector needs.

    Of two vectors at cosine ``least`` the second exceeds a filter of the first with some probability, so about
    ``wanted`` filters make them share one but for ``miss``.
    """
    share = min(0.02, occupancy / max(1, vectors))
    t, p = _tail(dims)
    threshold = float(np.interp(-share, -p, t))
    over = threshold + (1 - threshold) * (np.arange(4000) + 0.5) / 4000
    weight = (1 - over * over) ** ((dims - 3) / 2)
    needed = (threshold - least * over) / np.sqrt((1 - least**2) * (1 - over * over))
    shared = float((weight * np.interp(needed, *_tail(dims - 1), left=1, right=0)).sum() / weight.sum())
    return share, threshold, -math.log(miss) / shared * SPARE


def directions(dims: int, vectors: int, least: float = LEAST, occupancy: int = OCCUPANCY, miss: float = MISS) -> Directions:
    """Filters for labels of up to ``vectors`` vectors of ``dims`` dimensions, the same ones wherever they are made."""
    dims = max(dims, LEAST_DIMS)
    share, threshold, wanted = cap(dims, vectors, least, occupancy, miss)
    each = max(2, math.ceil(math.sqrt(wanted / share / CODES)))
    rng, rotations, books = np.random.default_rng(dims), [], []
    for _ in range(CODES):
        rotations.append(np.linalg.qr(rng.normal(size=(dims, dims)))[0])
        pair = [rng.normal(size=(each, w)) for w in (dims // 2, dims - dims // 2)]
        books.append(tuple(c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(2) for c in pair))
    return Directions(dims, threshold, rotations, books)


def decode(unit: np.ndarray, filters: Directions) -> tuple[np.ndarray, np.ndarray]:
    """``(vector, filter)`` of all directions that each unit vector exceeds, by vector."""
    padded = np.zeros((len(unit), filters.dims))
    padded[:, : unit.shape[1]] = unit
    found = []
    for k, (rotation, (one, two)) in enumerate(zip(filters.rotations, filters.books)):
        turned = padded @ rotation
        first, second = turned[:, : one.shape[1]] @ one.T, turned[:, one.shape[1] :] @ two.T
        vector, a = np.nonzero(first >= filters.threshold - second.max(1, keepdims=True))  # the others can't reach it any more
        row, b = np.nonzero(second[vector] >= (filters.threshold - first[vector, a])[:, None])
        found.append((vector[row], (k * len(one) + a[row]) * len(two) + b))
    vector, number = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(vector, kind="stable")
    return vector[order], number[order]


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix, each of unit length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # very large and very small ones, too
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _decoder(make, cells: int = 1 << 17):
    def run(batches):
        made: dict[int, Directions] = {}
        for b in batches:
            sizes = np.diff(b.column(1).offsets.to_numpy())
            for dims in np.unique(sizes).tolist():
                some = b.filter(pa.array(sizes == dims))
                unit = _matrix(some.column(1))
                if dims not in made:
                    made[dims] = make(dims)
                lists, rows = [], max(16, cells // len(made[dims].books[0][0]))
                for at in range(0, len(unit), rows):
                    vector, number = decode(unit[at : at + rows], made[dims])
                    cuts = np.searchsorted(vector, np.arange(1, min(rows, len(unit) - at)))
                    lists += np.split(number, cuts)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([np.sort(x) for x in lists], pa.list_(pa.int64()))], names=["number", "filters"])

    return run


def _pivots(half: float):
    """Rows with a pivot within the half angle."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                sizes, close = np.diff(b.column(2).offsets.to_numpy()), np.zeros(b.num_rows, bool)
                for dims in np.unique(sizes):
                    some = pa.array(np.flatnonzero(sizes == dims))
                    close[some] = (_matrix(b.column(2).take(some)) * _matrix(b.column(3).take(some))).sum(1) >= half
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["number", "pivot"]).filter(pa.array(close))

    return run


FOUND = pa.schema([("number", pa.int64()), ("links", pa.int64()), ("lead", pa.int64())])


def _leads(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches."""
    lead = np.arange(n)
    while True:
        low = np.minimum(lead[i], lead[j])
        now = lead.copy()
        np.minimum.at(now, i, low)
        np.minimum.at(now, j, low)
        np.minimum.at(now, lead[i], low)
        np.minimum.at(now, lead[j], low)
        now = now[now]
        if (now == lead).all():
            return lead
        lead = now


def _verifier(least: float, side: int = 1024):
    """One slab of a filter: for each vector its links to vectors of other classes, and the first vector it reaches there.

    A pair that shares several filters is counted in the first of them.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        here, cell = key[2].as_py(), key[3].as_py()
        table = table.sort_by([("class", "ascending"), ("number", "ascending")])
        number, kind, copies, slab = (table[c].to_numpy() for c in ("number", "class", "copies", "slab"))
        spread = table["spread"].to_numpy(zero_copy_only=False)
        unit = _matrix(table["vec"])
        before = _before(table["filters"], here)
        row, col = divmod(cell, 1 << 31)
        pairs = []
        for a in range(0, len(unit), side):
            for b in range(a, len(unit), side):
                if kind[a] == kind[min(b + side, len(unit)) - 1]:
                    continue  # sorted by class, so all of one class
                ok = unit[a : a + side] @ unit[b : b + side].T >= least
                ok &= kind[a : a + side, None] != kind[None, b : b + side]
                i, j = np.nonzero(ok)
                i, j = i + a, j + b
                fine = (i < j) & ~(spread[i] & spread[j] & (cell != 0))
                if row != col:
                    fine &= slab[i] != slab[j]
                i, j = i[fine], j[fine]
                for at in range(0, len(i), 1 << 14):  # those that share no earlier filter are counted here
                    x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                    shared = before[x][:, :, None] == before[y][:, None, :]
                    new = ~(shared & (before[x] >= 0)[:, :, None]).any((1, 2))
                    pairs.append((x[new], y[new]))
        if not pairs:
            return FOUND.empty_table()
        i, j = (np.concatenate(c) for c in zip(*pairs))
        links = np.zeros(len(unit), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        lead = _leads(len(unit), i, j)
        some = np.flatnonzero(links)
        return pa.Table.from_arrays([pa.array(number[some]), pa.array(links[some]), pa.array(number[lead[some]])], schema=FOUND)

    return run


def _before(lists: pa.ChunkedArray, here: int) -> np.ndarray:
    """Each row's filters that come before ``here``, filled up with -1."""
    own = lists.combine_chunks()
    size = pc.list_value_length(own).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(own)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out = np.full((len(own), int(size.max(initial=1))), -1, np.int64)
    number = own.flatten().to_numpy(zero_copy_only=False)
    out[row, at] = np.where(number < here, number, -1)
    return out[:, : max(1, int((out >= 0).sum(1).max(initial=0)))]  # they are sorted


def near_duplicate_vectors(vectors: DataFrame, least: float = LEAST, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", occupancy: int = OCCUPANCY, miss: float = MISS, slab: int = SLAB) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each row of ``vectors``.

    Two rows of equal label are linked if they are found and their cosine, in double precision, is ``least`` or more.
    ``component_id`` is the smallest id reached by links, ``kept`` tells the row that has it. Null labels, null
    ids, and vectors that are null, empty, zero or hold null or non-finite components link with nothing: they are their own
    component and stay (a null id's component is null). Vectors of different length aren't compared. Repeated rows
    are rows: they link with each other, and all those of the smallest id are kept. An empty table gives no rows; other columns are ignored.
    """
    if not 0 < least < 1:
        raise ValueError("least is a cosine between 0 and 1")
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"  # a float is exact as a double, and half as long
    v = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("vec"), F.col(label_col).cast("string").alias("label"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = v.where(usable).select("vec_id", "label", F.transform("vec", lambda x: F.when(x == 0, F.lit(0).cast(kind)).otherwise(x)).alias("vec"))  # -0.0 is 0.0
    # one row for each different vector of a label, numbered by its smallest id: no id has two vectors, or the number tells them apart
    different = rows.groupBy("label", "vec").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    different = staged(different.withColumn("number", F.monotonically_increasing_id()), "caps-vectors")
    most = different.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    make = partial(directions, vectors=most, least=least, occupancy=occupancy, miss=miss)
    listed = different.select("number", "vec").mapInArrow(_decoder(make), "number bigint, filters array<bigint>")
    listed = staged(different.select("number", "vec", "label", "copies").join(listed, "number"), "caps-filters")

    # classes: all within half the angle of a pivot, the first vector of one of their filters
    half = math.cos(math.acos(least) / 2) + 1e-9
    sized = F.size("vec").alias("dims")
    each = listed.select("number", "vec", "label", sized, F.explode("filters").alias("filter"))
    pivots = each.groupBy("label", "dims", "filter").agg(F.min("number").alias("pivot"))
    # one that is so near shares nearly all filters; a single one is mostly chance
    asked = each.select("number", "label", "dims", "filter").join(pivots, ["label", "dims", "filter"]).where("pivot <> number").groupBy("number", "pivot").agg(F.count("*").alias("n")).where("n > 1").select("number", "pivot")
    vec = different.select("number", "vec")
    met = asked.join(vec, "number").join(vec.select(F.col("number").alias("pivot"), F.col("vec").alias("pivot_vec")), "pivot").select("number", "pivot", "vec", "pivot_vec")
    chosen = met.mapInArrow(_pivots(half), "number bigint, pivot bigint").groupBy("number").agg(F.min("pivot").alias("pivot"))
    classed = staged(listed.join(chosen, "number", "left").withColumn("class", F.coalesce("pivot", "number")), "caps-classes")

    # a filter of more than a slab: if one class makes it large, its members are dealt out and the others go to every slab; else slabs meet two by two
    keys = ["label", "dims", "filter"]
    each = classed.select("number", "vec", "label", "copies", "class", "filters", sized, F.explode("filters").alias("filter"))
    counted = each.groupBy(*keys, "class").agg(F.count("*").alias("n"))
    large = counted.groupBy(*keys).agg(F.sum("n").alias("total"), F.max(F.struct("n", "class")).alias("top")).where(F.col("total") > slab)
    large = large.select(*keys, F.ceil(F.col("total") / slab).cast("int").alias("slabs"), F.when(F.col("total") - F.col("top.n") <= slab, F.col("top.class")).alias("main"))
    parted = each.join(large, keys, "left").withColumn("slab", F.when(F.col("slabs").isNull(), 0).otherwise(F.pmod(F.xxhash64("number"), F.col("slabs")).cast("int")))
    square = lambda i, j: i.cast("bigint") * (1 << 31) + j
    all_slabs = F.sequence(F.lit(0), F.col("slabs") - 1)
    cells = (
        F.when(F.col("slabs").isNull(), F.array(F.lit(0).cast("bigint")))
        .when(F.col("main") == F.col("class"), F.array(square(F.col("slab"), F.col("slab"))))
        .when(F.col("main").isNotNull(), F.transform(all_slabs, lambda j: square(j, j)))
        .otherwise(F.transform(all_slabs, lambda j: square(F.least("slab", j), F.greatest("slab", j))))
    )
    spread = F.coalesce(F.col("main") != F.col("class"), F.lit(False))
    dealt = parted.select("number", "vec", "label", "copies", "class", "filters", *keys[1:], "slab", spread.alias("spread"), F.explode(cells).alias("cell"))
    found = staged(dealt.groupBy(*keys, "cell").applyInArrow(_verifier(least), "number bigint, links bigint, lead bigint"), "caps-links")

    members = classed.groupBy("class").agg(F.sum("copies").alias("members"))
    sums = found.groupBy("number").agg(F.sum("links").alias("links"))
    counts = classed.select("number", "class").join(members, "class").join(sums, "number", "left").select("number", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    edges = found.select(F.col("number").alias("u"), F.col("lead").alias("v")).unionByName(classed.where("class <> number").select(F.col("number").alias("u"), F.col("class").alias("v")))
    reached = components(edges, "caps")
    told = different.join(reached.withColumnRenamed("node", "number"), "number", "left").withColumn("root", F.coalesce("root", "number"))
    smallest = told.groupBy("root").agg(F.min("first_id").alias("component_id"))
    groups = told.join(smallest, "root").join(counts, "number").select("label", "vec", "n_links", "component_id")
    linked = rows.join(groups, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = v.where(~usable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
