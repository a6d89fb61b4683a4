"""The corpus pipeline, stage by stage, against brute force on what the stage before it kept."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm.test_dedup import brute_similar
from tests.llm.test_lines_licences import brute_lines
from tests.llm.test_tokens import ids_of
from tidemark.llm import queries
from tidemark.llm.shared import staged


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_gives_what_sql_gives(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.SQL[name])


def test_all_are_registered():
    assert {*queries.QUERIES, "pipeline"} <= set(__spark_entry__.queries()) and set(queries.SQL) <= set(queries.QUERIES)


def lines_left(rows):
    dropped, want = brute_lines(rows), {}
    for i, t in rows:
        bad, lines = set(dropped[i, len(t or "")]), (t or "").split("\n")
        left = [x for k, x in enumerate(lines) if k not in bad]
        if not bad or any(x.split() for x in left):
            want[i] = "\n".join(left) if bad else t
    return want


def test_each_stage_takes_odd_tables(spark, docs_of):
    prose = "the cat and the dog sat on the mat with the hat while it rained on the roof of the old house by the sea"
    rows = [(1, prose, "en"), (1, prose, "en"), (2, prose + " today", "en"), (None, "another text of some length stands here without any id to tell it by at all", "en"), (None, "another text of some length stands here without any id to tell it by at all", "en"), (3, None, "en"), (4, "", None), (5, "word " * 40_000, "en"), (6, "der hund und die katze liegen auf der matte mit dem hut im alten haus am meer", "de")]
    docs = docs_of(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name
    told = corpus_pipeline.language_id(spark, docs, "")
    assert told.columns == docs.columns and {r["doc_id"] for r in told.collect()} >= {1, 6} and told.where("doc_id in (3, 4)").count() == 0
    lines = corpus_pipeline.line_dedup(spark, docs, "").collect()
    assert sorted(str(r["doc_id"]) for r in lines) == ["1", "1", "3", "4", "5", "6", "None", "None"]
    near = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert near.columns == docs.columns and sorted(str(r["doc_id"]) for r in near.collect()) == ["1", "3", "5", "6", "None"]
    packed = corpus_pipeline.best_fit_packing(spark, docs, "").collect()
    assert sum(r["length"] for r in packed) == sum(len(ids_of(r[1])) for r in rows)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(staged(stage(spark, kept[-1], sf_dir), name))
    read = [[tuple(r) for r in k.select("doc_id", "text").collect()] for k in kept[:4]]
    assert all(k.columns == docs.columns for k in kept[1:4])

    # language ID: clean prose stays
    gone = {i for i, _ in read[0]} - {i for i, _ in read[1]}
    clean = {r["doc_id"] for r in docs.where(F.col("lang").isNotNull() & (F.length("text") > 200)).collect()}
    assert len(gone & clean) <= 0.02 * len(clean)

    assert dict(read[2]) == lines_left(read[1])
    assert {i for i, _ in read[3]} == {i for (i, _), c in zip(read[2], brute_similar(read[2])) if i == c}

    packed = kept[4].collect()
    assert sum(r["length"] for r in packed) == sum(len(ids_of(t)) for _, t in read[3])
    assert len({r["sequence_id"] for r in packed}) <= 1.05 * -(-sum(r["length"] for r in packed) // 4096) + 1
