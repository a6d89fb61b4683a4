"""Edge cases of the page and session operators on hand-written rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geometry as g
from tidemark.functions import hashing, text
from tidemark.operators import folds, models, names, privacy, semantics, sessions, snapshots, validation, vision
from tidemark.plans import planner, prompts
from tidemark.sources import pages


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def nodes_of(spark, html):
    return pages.nodes(spark.createDataFrame([(1, html)], "page_id bigint, html string"))


# --- pages -------------------------------------------------------------------------------------


def test_ignored_subtrees_and_frames(spark):
    found = nodes_of(spark, '<main><script>var a = "<p>no</p>";</script><p>yes</p><iframe srcdoc="<b>in</b>"></iframe><iframe src="/x"></iframe><iframe></iframe><template><i>no</i></template></main>')
    assert {r["text"] for r in found.where("tag = '#text'").collect()} == {"yes", "in"}
    assert [r["access"] for r in pages.frames(found).orderBy("node").collect()] == ["same-origin", "opaque", "unloaded"]
    assert found.where("context = 1").count() == 2


def test_null_and_empty_pages_have_no_nodes(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "plain")], "page_id bigint, html string")
    assert [(r["page_id"], r["tag"]) for r in pages.nodes(df).collect()] == [(3, "#text")]


def test_subtree_and_cover(spark):
    found = nodes_of(spark, "<div id=a><p>x</p><div id=b><i>y</i></div></div><p>z</p>").cache()
    at = {r["attrs"].get("id"): r["node"] for r in found.where("tag = 'div'").collect()}
    roots = spark.createDataFrame([(1, at["a"]), (1, at["b"])], "page_id bigint, root int")
    assert [r["root"] for r in pages.covering(roots, found).collect()] == [at["a"]]
    below = pages.subtree(found, spark.createDataFrame([(1, at["b"])], "page_id bigint, root int"))
    assert sorted(r["tag"] for r in below.collect()) == ["#text", "div", "i"]


@pytest.mark.parametrize(
    "html, reasons",
    [
        ("<button>", ["native-control"]), ("<div role=tab tabindex=0>", ["role", "tabindex"]), ("<div contenteditable>", ["editable"]), ("<div contenteditable=false>", None), ("<div aria-live=polite>", ["context"]),
        ("<h2>", ["context"]), ("<iframe src=/x>", ["frame"]), ('<div style="cursor: pointer">', ["pointer"]), ('<a style="cursor:pointer">', ["native-control"]), ("<p>", None), ("<div role=alert>", ["role", "context"]),
    ],
)
def test_candidate_reasons(spark, html, reasons):
    found = semantics.candidates(nodes_of(spark, html)).collect()
    assert (found[0]["reasons"] if found else None) == reasons


@pytest.mark.parametrize(
    "html, role, source",
    [
        ("<a href=/x>", "link", "implicit"), ("<a>", None, "none"), ('<img alt="">', "presentation", "implicit"), ('<img alt="" title=t>', "img", "implicit"), ("<select multiple>", "listbox", "implicit"), ("<select size=4>", "listbox", "implicit"), ("<select>", "combobox", "implicit"),
        ("<input type=EMAIL>", "textbox", "implicit"), ("<input list=l>", "combobox", "implicit"), ("<input type=search>", "searchbox", "implicit"), ("<input type=hidden>", None, "none"), ("<section>", None, "none"), ("<section aria-label=s>", "region", "implicit"),
        ("<th scope=row>", "rowheader", "implicit"), ("<div role='nonsense tab'>", "tab", "explicit"), ("<div role=none>", "none", "explicit"), ("<button role=none>", "button", "implicit"), ("<div role=presentation aria-label=x>", None, "none"),
    ],
)
def test_roles(spark, html, role, source):
    r = semantics.with_roles(nodes_of(spark, html)).first()
    assert (r["role"], r["role_source"]) == (role, source)


def test_header_inside_a_section_is_no_banner(spark):
    found = semantics.with_roles(nodes_of(spark, "<header>a</header><article><header>b</header></article>"))
    assert [r["role"] for r in found.where("tag = 'header'").orderBy("node").collect()] == ["banner", None]


def test_names_stream_in_page_order_and_end_at_the_limits(spark):
    many = spark.createDataFrame([(i, f"<button>b{i} <i>x</i></button>" * 3) for i in range(500)] + [(900, "<div>" * 10_000 + "<button>deep</button>")], "page_id bigint, html string")
    rows = names.in_order(pages.nodes(many)).where("tag = 'button'").collect()
    assert len(rows) == 1501 and all(r["name"] == f"b{r['page_id']} x" for r in rows if r["page_id"] < 900)
    assert [r["status"] for r in rows if r["page_id"] == 900] == ["limited"]


def test_references_and_labels(spark):
    found = nodes_of(spark, "<b id=x>1</b><b id=x>2</b><i aria-labelledby='x none x'>t</i><label for=c>a</label><label for=c>b</label><input id=c>").cache()
    refs = semantics.references(found).orderBy("pos").collect()
    assert [(r["id"], r["target"]) for r in refs] == [("x", 0), ("none", None)]
    assert len(semantics.label_targets(found).first()["labels"]) == 2


def test_hidden_reaches_below(spark):
    found = nodes_of(spark, "<div hidden><p>a</p></div><p style='display:none'>b</p><p>c</p>")
    assert semantics.hidden_nodes(found).count() == 5


# --- snapshots ---------------------------------------------------------------------------------


def test_diff_and_apply(spark):
    ddl = "k int, doc string, v string"
    before = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, "a", "z")], ddl)
    after = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z")], ddl)
    d = snapshots.diff(before, after, ["k", "doc"], ["v"])
    assert sorted((r["k"], r["doc"], r["change"]) for r in d.collect()) == [(2, "a", "changed"), (3, "a", "removed"), (3, "b", "added")]
    again = snapshots.apply(before, d, ["k", "doc"], ["v"])
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, after.collect()), key=str)
    assert snapshots.diff(before.limit(0), after, ["k", "doc"], ["v"]).where("change = 'added'").count() == 3
    assert snapshots.diff(before, before, ["k", "doc"], ["v"]).count() == 0


def test_every_twentieth_observation_is_full(spark):
    found = snapshots.with_baseline(spark.range(45).select(F.lit(1).alias("d"), F.col("id").alias("o")), ["d"], ["o"], "o")
    assert [r["o"] for r in found.where("mode = 'full'").orderBy("o").collect()] == [0, 20, 40]
    assert found.where("baseline is null").count() == 1


def test_dirty_nodes_reach_rows_that_depend_on_them(spark):
    cached = spark.createDataFrame([(1, 5, [0, 2, 5], [9]), (1, 6, [0, 3, 6], None), (2, 5, [0, 2, 5], None)], "page_id bigint, node int, path array<int>, depends_on array<int>")
    dirty = spark.createDataFrame([(1, 9), (1, 3)], "page_id bigint, root int")
    assert sorted((r["page_id"], r["node"]) for r in snapshots.affected(cached, dirty).collect()) == [(1, 5), (1, 6)]


# --- privacy -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "value, kind, is_value, outcome, pii_class, shown",
    [
        ("a@b.c", "email", True, "redacted", "email", "{{EMAIL_3}}"), ("x", "password", True, "redacted", "secret", "{{SECRET}}"), ("5", "tel", True, "redacted", "phone", "{{PHONE_3}}"),
        ("x", "text", True, "withheld", "other", "{{TEXT_WITHHELD}}"), ("x", None, True, "withheld", "other", "{{TEXT_WITHHELD}}"), ("a@b.c", "email", False, "withheld", "email", "{{TEXT_WITHHELD}}"), ("", "email", True, "clear", None, ""), (None, None, False, "clear", None, ""),
    ],
)
def test_redaction_decisions(spark, value, kind, is_value, outcome, pii_class, shown):
    d = privacy.decide(F.lit(value).cast("string"), F.lit(kind).cast("string"), F.lit(is_value))
    r = one(spark, d.alias("d"), privacy.redacted_value(d, F.lit(3)).alias("v"))
    assert (r["d"]["outcome"], r["d"]["pii_class"], r["v"]) == (outcome, pii_class, shown)


def test_interning_numbers_by_first_use_and_keeps_its_capacity(spark):
    rows = [("s", 1, "email", "b"), ("s", 2, "phone", "b"), ("s", 3, "email", "a"), ("s", 4, "email", "b"), ("s", 5, "email", "B"), ("s", 6, "secret", "k"), ("s", 7, "email", "c")]
    found = privacy.intern(spark.createDataFrame(rows, "scope string, seq int, c string, v string"), ["scope"], "c", "v", ["seq"], entries=4)
    assert {(r["c"], r["v"]): r["placeholder"] for r in found.collect()} == {("email", "b"): "{{EMAIL_1}}", ("phone", "b"): "{{PHONE_1}}", ("email", "a"): "{{EMAIL_2}}", ("email", "B"): "{{EMAIL_3}}", ("secret", "k"): "{{SECRET}}", ("email", "c"): None}


def test_entry_500_has_a_placeholder_and_501_has_not(spark):
    rows = spark.range(501).select(F.lit("s").alias("scope"), F.col("id").alias("seq"), F.lit("email").alias("c"), F.col("id").cast("string").alias("v"))
    found = {r["entry"]: r["placeholder"] for r in privacy.intern(rows, ["scope"], "c", "v", ["seq"]).collect()}
    assert found[500] == "{{EMAIL_500}}" and found[501] is None


def test_binding_50_is_kept_and_51_is_not(spark):
    rows = spark.range(102).select(F.lit(1).alias("e"), (F.col("id") % 51).alias("f"), "id")
    found = {r["number"]: r["kept"] for r in privacy.bind(rows, ["e"], ["f"], ["id"]).collect()}
    assert len(found) == 51 and found[50] and not found[51]


# --- sessions ----------------------------------------------------------------------------------


def test_expiry_is_at_the_ttl_itself(spark):
    t, ttl, us = datetime(2026, 1, 1), timedelta(seconds=1800), timedelta(microseconds=1)
    rows = [("a", 1, t), ("a", 2, t + ttl - us), ("b", 1, t), ("b", 2, t + ttl), ("c", 1, t), ("c", 2, t + ttl + us)]
    found = sessions.sliding(spark.createDataFrame(rows, "k string, n int, ts timestamp"), "k", "ts", "n", "1800 seconds")
    assert {r["k"]: r["s"] for r in found.groupBy("k").agg(F.max("session").alias("s")).collect()} == {"a": 1, "b": 2, "c": 2}


@pytest.mark.parametrize("n, kept", [(0, []), (4, [0, 1, 2, 3]), (5, [0, 1, 2, 3, 4]), (6, [1, 2, 3, 4, 5]), (7, [2, 3, 4, 5, 6])])
def test_newest_of_an_array(spark, n, kept):
    history = F.array(*map(F.lit, range(n))) if n else F.array().cast("array<int>")
    assert one(spark, sessions.newest_of(history).alias("h"))["h"] == kept


def test_replies_are_later_and_in_time(spark):
    t = datetime(2026, 1, 1)
    asked = spark.createDataFrame([("p", 1, t), ("p", 2, t + timedelta(seconds=10)), ("q", 3, t)], "k string, id int, ts timestamp")
    answers = spark.createDataFrame([("p", 8, t), ("p", 9, t + timedelta(seconds=5)), ("q", 10, t + timedelta(seconds=6))], "k string, id int, ts timestamp")
    found = {r["request"]: r["answered"] for r in sessions.replies(asked, answers, "k", "id", "ts", "5 seconds").collect()}
    assert found == {1: t + timedelta(seconds=5), 2: None, 3: None}


def test_identity_rejects_name_the_first_reason(spark):
    known = spark.createDataFrame([(1, "t", 1)], "session_id int, task_id string, task_version int")
    asked = spark.createDataFrame([(1, "t", 1), (1, "u", 2), (1, "t", 2), (2, "t", 1)], "session_id int, task_id string, task_version int")
    found = sessions.identity_rejects(asked, known)
    assert sorted(str(r["code"]) for r in found.collect()) == ["None", "session_not_found", "task_mismatch", "task_version_mismatch"]


# --- folds -------------------------------------------------------------------------------------


def machine(spark, *events):
    rows = [(1, i, *e) for i, e in enumerate(events)]
    return folds.companion(spark.createDataFrame(rows, "k int, seq int, type string, generation bigint, task string"), ["k"], ["seq"]).first()


def test_companion_precedence_and_staleness(spark):
    assert machine(spark, ("task-started", 1, "a"), ("approval-requested", 1, "a"), ("acting", 1, "a"))["state"] == "needs-approval"
    assert machine(spark, ("task-started", 2, "a"), ("acting", 1, "a"))["rejected"] == "stale-generation"
    assert machine(spark, ("task-started", 2, "a"), ("acting", 2, "b"))["rejected"] == "stale-task"
    assert machine(spark, ("dance", 2, "a"))["rejected"] == "unknown-event"
    late = machine(spark, ("task-started", 2, "a"), ("task-cancelled", 2, "a"), ("acting", 2, "a"))
    assert (late["state"], late["rejected"], late["old_generation"]) == ("idle", "stale-generation", 2)


def test_a_late_capture_stop_clears_the_flag_only(spark):
    r = machine(spark, ("task-started", 1, "a"), ("audio-capture-confirmed", 1, "a"), ("acting", 2, "b"), ("audio-capture-ended", 1, "a"))
    assert (r["capture"], r["state"], r["generation"], r["rejected"]) == (False, "acting", 2, None)


def test_host_transitions_and_leases(spark):
    rows = [(1, i, e) for i, e in enumerate(["RELEASE", "ACQUIRE", "WORKER_READY", "ACQUIRE", "RELEASE", "IDLE_TIMEOUT"])]
    events = spark.createDataFrame(rows, "k int, seq int, event string")
    assert folds.host(events, ["k"], ["seq"]).first()["state"] == "idle"
    assert [r["leases"] for r in folds.leases(events, ["k"], ["seq"]).orderBy("seq").collect()] == [0, 1, 1, 2, 1, 1]


# --- validation --------------------------------------------------------------------------------


@pytest.mark.parametrize("raw, good", [("1", True), ("1.0", True), ("1.5", False), ("true", False), ('"1"', False), ("null", False), ("9007199254740991", True), ("9007199254740992", False), ("-1", False)])
def test_strict_integers(spark, raw, good):
    assert one(spark, validation.integer(validation.parsed(F.lit(raw))).alias("x"))["x"] is good


@pytest.mark.parametrize(
    "raw, code",
    [
        ('{"protocol":"1.0","session_id":"s1","seq":0}', None), ('{"protocol":"2.0","session_id":"s1","seq":0}', "unsupported_version"), ('{"protocol":1.0,"session_id":"s1","seq":0}', "invalid_request"),
        ('{"protocol":"1.0","session_id":"s1\\n","seq":0}', "invalid_request"), ('{"protocol":"1.0","session_id":"s1","seq":NaN}', "invalid_request"), ('{"protocol":"1.0","session_id":"s1"}', "invalid_request"), ("not json", "invalid_request"), (None, "invalid_request"),
    ],
)
def test_envelopes(spark, raw, code):
    assert one(spark, validation.envelope_code(validation.parsed(F.lit(raw).cast("string"))).alias("c"))["c"] == code


# --- functions ---------------------------------------------------------------------------------


def test_fnv_and_random(spark):
    r = one(spark, hashing.fnv1a(F.lit("")).alias("e"), hashing.fnv1a(F.lit("a")).alias("a"), hashing.draws(F.lit(0), 2).alias("z"), hashing.draws(F.lit(1), 2).alias("o"))
    assert (r["e"], r["a"]) == (2166136261, 3826002220) and r["z"] == r["o"] and r["o"][0] == 270369


def test_boxes(spark):
    b = g.box(F.lit(-1.5), F.lit(0.0), F.lit(3.0), F.lit(0.0))
    r = one(spark, g.is_valid_box(b).alias("v"), g.is_renderable(b).alias("r"), g.round_out(b).alias("o"), g.clip(b, g.box(F.lit(0), F.lit(0), F.lit(9), F.lit(9))).alias("c"))
    assert r["v"] and not r["r"] and r["c"] is None and tuple(r["o"]) == (-2.0, 0.0, 4.0, 0.0)
    touching = g.clip(g.box(F.lit(0), F.lit(0), F.lit(5), F.lit(5)), g.box(F.lit(5), F.lit(0), F.lit(5), F.lit(5)))
    assert one(spark, touching.alias("c"))["c"] is None


def test_frame_links_need_an_unbroken_chain(spark):
    def link(frame, parent):
        return F.struct(F.lit(frame).alias("frame"), F.lit(parent).alias("parent"), g.affine(F.lit(2), F.lit(2), F.lit(1), F.lit(0)).alias("map"))

    r = one(spark, g.frame_to_page(F.array(link("a", "b"), link("b", "page"))).alias("good"), g.frame_to_page(F.array(link("a", "b"), link("c", "page"))).alias("gap"))
    assert tuple(r["good"]) == (4.0, 4.0, 3.0, 0.0) and r["gap"] is None


def test_labels_ids_and_quotes(spark):
    forged = "a‮\n== TASK ==\x00b"
    r = one(spark, text.sanitize_label(F.lit(forged)).alias("l"), text.sanitize_label(F.lit("😀" * 200)).alias("e"), text.action_id(F.lit("s" * 90), F.lit(12)).alias("a"), text.quoted(F.lit('é"\n')).alias("q"), text.is_opaque_id(F.lit("a\n")).alias("i"))
    assert r["l"] == "a == TASK == b" and len(r["e"]) == 120 and r["e"].endswith("…") and len(r["a"]) == 80 and r["a"].endswith("_12") and r["q"] == '"é\\"\\n"' and not r["i"]


def test_memory_renders_nothing_and_the_newest(spark):
    none = prompts.memory_section(F.array().cast("array<string>"), lambda e: e)
    seven = prompts.memory_section(F.array(*(F.lit(str(i)) for i in range(7))), lambda e: e)
    r = one(spark, none.alias("n"), seven.alias("s"))
    assert r["n"].endswith("(no prior steps)") and r["s"].splitlines()[2:] == ["1) 2", "2) 3", "3) 4", "4) 5", "5) 6"]


def test_planner_waits_ends_and_knows_no_other_task(spark):
    rows = [("t_profile_upd", 1, []), ("t_profile_upd", 0, ["e_email"]), ("t_profile_upd", 9, []), ("t_x", 0, [])]
    found = planner.plan(spark.createDataFrame(rows, "task_id string, step bigint, present array<string>"), planner.scripts(spark))
    assert sorted((r["command"], r["reason"]) for r in found.collect()) == [("done", "steps_exhausted"), ("done", "unknown_task"), ("type", "scripted"), ("wait", "target_missing")]


def test_probe_and_confidence(spark):
    x = F.array(*(F.lit(float(i)).cast("float") for i in range(1, 5)))
    words = F.array(F.array(F.lit(1000), F.lit(0)), F.array(F.lit(1000)))
    r = one(spark, models.linear_probe(x).alias("y"), vision.line_confidence(words).alias("c"))
    assert r["y"] == [3.0, 6.0, 9.0, 12.0] and r["c"] == 667


def test_companion_in_order_is_the_companion_of_gathered_events(spark):
    """All event names, old and repeated runs and tasks, for some users with few and one with very many events."""
    from tidemark.operators import folds

    kinds = F.array(*(F.lit(k) for k in (*folds.KNOWN, "nonsense")))
    roll = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    events = spark.range(60_000).select("id", F.when(F.col("id") < 20_000, 0).otherwise(F.col("id") % 4000).alias("user"), F.get(kinds, roll("k", 12).cast("int")).alias("type"), F.when(roll("g", 40) > 0, F.floor(F.col("id") / 7000) + roll("r", 3) - 1).cast("bigint").alias("generation"), F.concat(F.lit("t"), roll("t", 2).cast("string")).alias("task"))
    want = {r["user"]: tuple(r) for r in folds.companion(events, ["user"], ["id"]).collect()}
    found = {r["user"]: tuple(r) for r in folds.companion_in_order(events, "user", ["id"]).collect()}
    assert found == want and len({t[1:4] for t in want.values()}) > 20
    assert folds.companion_in_order(events.limit(0), "user", ["id"]).count() == 0
