"""Queries against their SQL over rows that the small tables don't hold."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__


@pytest.fixture
def differing(spark, tmp_path):
    """How many rows differ between a registered query and its SQL, over given tables."""

    def count(name, **tables):
        con = duckdb.connect()
        con.execute("set timezone = 'UTC'")
        for table, rows in tables.items():
            path = f"{tmp_path}/{table}.parquet"
            rows.write.mode("overwrite").parquet(path)
            con.execute(f"create view {table} as select * from '{path}/*.parquet'")
        got, wanted = __spark_entry__.queries()[name](spark, str(tmp_path)).toArrow(), con.sql(__spark_entry__.oracle_sql()[name]).to_arrow_table()
        assert wanted.num_rows and sorted(got.column_names) == sorted(wanted.column_names)
        rows = lambda t: {tuple(map(str, r)) for r in zip(*(t[c].to_pylist() for c in sorted(t.column_names)))}
        return len(rows(got) ^ rows(wanted)) + abs(got.num_rows - wanted.num_rows)

    return count


def test_names_count_references_as_the_sql_does(spark, differing):
    html = ["<h1>token = &quot;7702</h1>", "<h2>a&amp;&amp b &lt;i&gt; &amp;lt;</h2><a href=\"/?x=1&y=2\">&copy &#39;now&#x27; &am</a>", "<h3> &nbsp; </h3>", "<h1>&amp;quot;</h1><h2></h2>"]
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], "page_id bigint, url string, html string")
    assert differing("accessible_names", pages=pages) == 0


def test_long_deep_and_wide_names_are_told(spark, differing):
    html = ["<h1>" + "x" * 9_000 + "</h1>", '<a href="/">' + "<span>" * 1_500 + "deep" + "</span>" * 1_500 + " end</a>", "<h2>" + "<i>w</i>" * 15_000 + "</h2>", "<div>" * 200 + "<h3>below</h3>"]
    assert differing("accessible_names", pages=spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], "page_id bigint, url string, html string")) == 0
    titled = [(i, "u", f"<title>{'y' * 9_000}</title><h1>one</h1><p>word</p>") for i in range(8)]
    assert differing("composed_names", pages=spark.createDataFrame(titled, "page_id bigint, url string, html string")) == 0


def test_placeholders_have_no_bound(spark, differing):
    docs = spark.range(900).selectExpr("id as doc_id", "case when id % 7 = 0 then null else concat('a', id % 600, '@b', id, '.com x@y.org') end as text", "case when id < 800 then 's' end as source")
    assert differing("intern_placeholders", documents=docs) == 0


def test_loops_stay_loops_beside_other_chains(spark, differing):
    assert differing("context_chains", events=spark.range(40_000).selectExpr("id as event_id")) == 0


@pytest.mark.parametrize("name", ["closed_sessions", "coalesced_frames"])
def test_a_streams_rows_are_written_by_many_tasks(spark, tmp_path, monkeypatch, name):
    from tidemark.plans import stream_queries

    spark.range(0, 400, 1, 4).selectExpr("id as event_id", "id % 9 as user_id", "timestamp_seconds(id * 7919) as ts").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(stream_queries, "shared_folder", lambda _, folder: f"{tmp_path}/{folder}")
    assert __spark_entry__.queries()[name](spark, str(tmp_path)).count() > 0
    assert len(list(tmp_path.glob("*/rows/part-*.parquet"))) > 2


@pytest.mark.parametrize("name", ["history_decode", "command_lines"])
def test_one_file_gives_more_than_one_task(spark, sf_dir, name):
    assert __spark_entry__.queries()[name](spark, sf_dir).rdd.getNumPartitions() > 1


@pytest.fixture
def events_near_bounds(spark):
    """Every fault, list and command beside users whose number is a list's bound, or near it."""
    users = spark.createDataFrame([(u,) for u in (0, 29, 30, 31, 299, 300, 301)], "user_id bigint")
    kinds = spark.range(11 * 25 * 66).where("id % 11 = 4 and floor(id / 11) % 3 = 2 or id % 11 = 5 and floor(id / 11) % 22 = 16 or id < 50").withColumnRenamed("id", "event_id")
    return kinds.crossJoin(users).selectExpr("event_id + 18150 * user_id as event_id", "user_id", "'view' as event_type", "12.5D as value", """'{"k": 1}' as props""")


def test_lists_refused_by_number_are_refused_as_text(spark, tmp_path, events_near_bounds):
    from tidemark.operators import contracts as C
    from tidemark.plans import message_queries as q

    events_near_bounds.write.parquet(f"{tmp_path}/events.parquet")
    whole = q.messages(spark, str(tmp_path))
    assert whole.where("body is null").count() == 0 < q.messages(spark, str(tmp_path), q.OVERFULL).where("body is null").count()
    by_text = whole.select("event_id", "message", C.is_any(F.col("message"), F.col("body")).alias("valid"))
    by_number = q.message_validity(spark, str(tmp_path))
    assert by_number.count() == whole.count() and by_number.exceptAll(by_text).count() == 0
    codes = C.refused_messages(whole).select("event_id", "message", "reject_code")
    told = q.message_rejects(spark, str(tmp_path)).select("event_id", "message", "code")
    assert told.count() == codes.count() and told.exceptAll(codes).count() == 0 < codes.where("reject_code = 'unsupported_version'").count()


@pytest.mark.parametrize("name", ["message_validity", "message_rejects"])
def test_lists_beyond_any_text_are_refused(spark, tmp_path, name):
    """The text of 40 million elements would be longer than a row can be."""
    spark.range(2000).where("id % 11 = 4 and floor(id / 11) % 3 = 2 and (id * 7 + 40000000) % 25 < 12").selectExpr("id as event_id", "40000000L as user_id", "'view' as event_type", "12.5D as value", "'1' as props").write.parquet(f"{tmp_path}/events.parquet")
    told = __spark_entry__.queries()[name](spark, str(tmp_path)).collect()
    assert told and {r["valid"] if name == "message_validity" else r["code"] for r in told} == {False if name == "message_validity" else "invalid_request"}


@pytest.mark.parametrize("name", ["message_validity", "message_rejects", "read_actions"])
def test_messages_of_one_file_are_made_by_many_tasks(spark, sf_dir, name):
    assert __spark_entry__.queries()[name](spark, sf_dir).rdd.getNumPartitions() > 1
