"""Embedding near-dedup by spherical-cap filters against all pairs."""

import numpy as np

from tidemark.llm import cap_filters


def brute(rows, least=0.93):
    """(id, links, component, kept) of (id, vector, label) rows."""
    ok = [i for i, (k, x, label) in enumerate(rows) if k is not None and label is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x)]
    near = {i: [] for i in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                u, v = (np.array(rows[k][1], float) / max(map(abs, rows[k][1])) for k in (a, b))
                if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= least:
                    near[a].append(b)
    out = []
    for i, (k, *_) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        root = min((rows[b][0] for b in seen), default=None) if k is not None else None
        out.append((k, len(near[i]), root, k == root))
    return sorted(out, key=str)


def told(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], f"vec_id bigint, embedding array<{how.pop('kind', 'double')}>, label int, number int, vec string, copies int").repartition(3)
    return sorted((tuple(r) for r in cap_filters.near_duplicate_vectors(df, **how).collect()), key=str)


def near_copies(rng, base, n, noise):
    return [(base + noise * rng.normal(size=len(base)) / np.sqrt(len(base))).tolist() for _ in range(n)]


def test_odd_vectors_and_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=8)
    rows = [(5, x.tolist(), 1), (3, (2 * x).tolist(), 1), (5, x.tolist(), 1), (9, x.tolist(), 2), (1, x.tolist(), None), (None, x.tolist(), 1), (2, None, 1), (4, [], 1), (6, [0.0] * 8, 1), (7, [float("nan"), 1.0], 1), (8, [float("inf"), 1.0], 1)]
    rows += [(10, [1.0, None], 1), (11, x[:4].tolist(), 1), (12, (-x).tolist(), 1), (13, [0.0, 1.0], 1), (14, [-0.0, 1.0], 1), (15, [1e-300, 1e-320], 3), (16, [1e300, 1e290], 3), (17, [3.0], 4), (18, [4.0], 4)]
    assert told(spark, rows) == brute(rows)
    assert told(spark, [(1, None, 1)]) == [(1, 0, 1, True)]
    assert cap_filters.near_duplicate_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).collect() == []


def test_groups_of_near_copies_slabs_and_chains(spark):
    rng = np.random.default_rng(2)
    vectors = []
    for size, noise in ((90, 0.05), (60, 0.2), (40, 0.33), (3, 0.1)):
        vectors += near_copies(rng, rng.normal(size=24) / np.sqrt(24), size, noise)
    chain = [np.cos(t) * np.eye(24)[0] + np.sin(t) * np.eye(24)[1] for t in np.arange(0, 3, 0.3)]  # each near the next only
    vectors += [c.tolist() for c in chain] + [vectors[0]] * 50 + rng.normal(size=(100, 24)).tolist()
    rows = [(int(k), v, 1) for k, v in zip(rng.permutation(len(vectors)), vectors)]
    want = brute(rows)
    for how in ({"miss": 1e-9}, {"miss": 1e-9, "slab": 20}, {"miss": 1e-9, "slab": 7}):
        assert told(spark, rows, **how) == want


def test_recall_at_the_threshold():
    """Pairs at exactly the least cosine share a filter; that is the worst case."""
    rng = np.random.default_rng(4)
    for dims in (16, 64, 300):
        for vectors in (1000, 50_000):
            filters = cap_filters.directions(dims, vectors)
            u = rng.normal(size=(400, dims))
            u /= np.linalg.norm(u, axis=1, keepdims=True)
            w = rng.normal(size=u.shape)
            w -= (w * u).sum(1, keepdims=True) * u
            v = 0.93 * u + np.sqrt(1 - 0.93**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
            a, b = ({*zip(*(x.tolist() for x in cap_filters.decode(x, filters)))} for x in (u, v))
            assert len({x for x, _ in a & b}) / 400 >= 0.97, (dims, vectors)


def test_decoding_finds_all_directions():
    rng = np.random.default_rng(6)
    unit = rng.normal(size=(20, 18))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    filters = cap_filters.directions(18, 500)
    want = set()
    for k, (rotation, (one, two)) in enumerate(zip(filters.rotations, filters.books)):
        every = np.array([np.concatenate([a, b]) for a in one for b in two])
        assert np.allclose(np.linalg.norm(every, axis=1), 1)
        vector, number = np.nonzero((unit @ rotation) @ every.T >= filters.threshold)
        want |= {*zip(vector.tolist(), (number + k * len(every)).tolist())}
    vector, number = cap_filters.decode(unit, filters)
    assert want == {*zip(vector.tolist(), number.tolist())} and (np.diff(vector) >= 0).all()


def test_float_vectors(spark):
    rng = np.random.default_rng(7)
    rows = [(i, np.float32(v).tolist(), i % 2) for i, v in enumerate(near_copies(rng, rng.normal(size=12), 40, 0.3))]
    assert told(spark, rows, kind="float", miss=1e-9) == brute(rows)
