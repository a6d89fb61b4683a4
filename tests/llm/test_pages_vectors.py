"""Main-text extraction and nearest neighbours."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import ann, html_main, queries
from tidemark.llm.html_blocks import blocks


def test_blocks_join_inline_text_and_skip_markup():
    html = "<nav><a href=/>Home</a></nav><p>One &amp; <b>two</b>\n  three<br>four<p>Five<script>var p='</p>';</script><!-- no --><style>p{}</style>"
    assert [b[0] for b in blocks(html)] == ["Home", "One & two three four", "Five"]
    assert blocks(None) == blocks("") == blocks("<br>  ") == []
    assert blocks("plain text")[0][0] == "plain text"


def test_blocks_keep_embedded_text_and_what_follows():
    assert [b[0] for b in blocks('<p>For <math><mi>x</mi><mo>=</mo><mn>2</mn></math> see <svg class="i"/> the <object data=a>fallback</object> text<p>next <video src=v>no video</video>')] == ["For x=2 see the fallback text", "next no video"]
    assert [b[0] for b in blocks("<p>a<svg><g><svg><text>in</text></svg></g></svg>b</p><p>c")] == ["ainb", "c"]


def test_pages_of_any_length_are_grouped_and_read(spark):
    sizes = [3, 5000, 1, 40, 40, 4096, 7]
    found = html_main.groups(sizes, 4096)
    assert sorted(i for g in found for i in g) == list(range(7)) and all(len(g) == 1 or len(g) * max(sizes[i] for i in g) <= 4096 for g in found)
    long = "<article>" + "".join(f"<p>word{i} more words here</p>" for i in range(50_000)) + "</article>"
    pages = [(1, long), (2, "<article><h1>Title</h1><p>Some words of the text.</p></article>"), (2, "<article><h1>Title</h1><p>Some words of the text.</p></article>"), (3, "<nav><a href=/>Home</a></nav>")]
    df = spark.createDataFrame(pages, "page_id bigint, html string").withColumn("text", F.lit("clash")).withColumn("t", F.lit(1))
    texts = [(r["page_id"], r["x"]) for r in df.select("page_id", html_main.main_text(F.col("html"), spark).alias("x")).collect()]
    assert len(texts) == 4 and texts[1] == texts[2]
    whole = next(t for i, t in texts if i == 1)
    assert set(whole.split("\n\n")) <= {f"word{i} more words here" for i in range(50_000)}


def test_net_labels_unseen_pages():
    pages, labels = html_main.training_set(120, seed=99)
    p = html_main.train().probabilities(pages)
    right = sum(int((p[t, k] >= 0.5) == y) for k, own in enumerate(labels) for t, y in enumerate(own))
    assert right / sum(map(len, labels)) > 0.97


def test_gradient_matches_finite_differences():
    pages, labels = html_main.training_set(3, seed=5)
    net, (x, mask) = html_main.Labeller(seed=1), html_main.features(pages)
    y = np.zeros(mask.shape[:2], dtype=np.float32)
    for k, own in enumerate(labels):
        y[: len(own), k] = own

    def loss():
        p = np.clip(net.probabilities(pages), 1e-7, 1 - 1e-7)
        return float((-(y * np.log(p) + (1 - y) * np.log(1 - p)) * mask[..., 0]).sum() / mask.sum())

    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    grads = net.gradient(x, mask, y)
    for name, at in (("fh", (2, 5)), ("bh", (1, 40)), ("fc", (20,)), ("o", (3,))):
        old = net.w[name][at]
        net.w[name][at] = old + 1e-3
        up = loss()
        net.w[name][at] = old - 1e-3
        down = loss()
        net.w[name][at] = old
        assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-3 * max(1, abs(grads[name][at])) + 1e-4


def test_main_text_of_pages(spark, sf_dir):
    found = queries.op8_html_main_text(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in found:
        assert r["text"] == "\n\n".join(t for t, path, _ in blocks(r["html"]) if "article" in path) and r["n_chars"] == len(r["text"])
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "<!-- x -->"), (4, "<nav>Home</nav>"), (5, "<p>" + "word " * 50_000)], "page_id bigint, html string")
    texts = {r["page_id"]: r["t"] for r in odd.select("page_id", html_main.main_text(F.col("html"), spark).alias("t")).collect()}
    assert texts[1] == texts[2] == texts[3] == "" and len(texts[5]) in (0, 249_999)


def brute(vectors, k):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for i, q in ok:
        if i % 50 == 0:
            scored = sorted((-float((x * q).sum() / (np.sqrt((x * x).sum()) * np.sqrt((q * q).sum()))), j) for j, x in ok if j != i)[:k]
            yield from ((i, rank + 1, j, -s) for rank, (s, j) in enumerate(scored))


def test_recall_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(16).astype(float).tolist()) for i in range(600)]
    rows += [(700 + i, rows[0][1]) for i in range(300)] + [(1050, None), (1100, [0.0] * 16), (1150, [float("nan")] + [1.0] * 15), (1200, [None] + [1.0] * 15), (1250, [1.0, 2.0]), (1300, []), (None, rows[1][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, rank int")
    found = ann.search(df, F.col("vec_id") % 50 == 0, block_rows=200, slice_rows=7).collect()
    got, want = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found}, {(q, k): (v, s) for q, k, v, s in brute([r for r in rows if r[1] is None or len(r[1]) == 16], 5)}
    assert got.keys() == want.keys()
    assert [got[0, k][0] for k in range(1, 6)] == [700, 701, 702, 703, 704]
    hits = len({(q, v) for (q, _), (v, _) in got.items()} & {(q, v) for (q, _), (v, _) in want.items()})
    assert hits / len(want) >= 0.95
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.search(df.where("vec_id < 3"), F.col("vec_id") % 50 == 0).count() == 2


def test_repeated_query_ids_ask_once_with_the_least_vector(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [0.0, 2.0]), (2, [3.0, 0.1]), (3, [3.0, 0.1])]
    found = ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0, k=2).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(found, key=lambda r: r["rank"])] == [(0, 1, 1), (0, 2, 2)]


def test_crowded_and_shifted_vectors_are_all_found(spark):
    rng = np.random.default_rng(5)
    crowd = rng.standard_normal(24) + 1e-3 * rng.standard_normal((900, 24))
    shifted = 40 + rng.standard_normal((900, 24))
    few = 1e-6 * rng.standard_normal((60, 24)) - np.eye(24)[0]
    rows = [(i, v.tolist()) for i, v in enumerate(rng.permutation(np.concatenate([crowd, shifted, few, 3 * crowd[:90]])))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in ann.search(df, F.col("vec_id") % 50 == 0, block_rows=700, slice_rows=20).collect()}
    want = {(q, v) for q, _, v, _ in brute(rows, 5)}
    assert len(got) == len(want) and len(got & want) / len(want) > 0.99


def test_recall_of_the_query(spark):
    found = queries.op10_nearest_neighbours(spark, "/root/testdata/sf0.1").collect()
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    want = {(q, v) for q, _, v, _ in brute([tuple(r) for r in rows], 5)}
    assert len(found) == len(want) and len({(r["query_id"], r["vec_id"]) for r in found} & want) / len(want) >= 0.9
