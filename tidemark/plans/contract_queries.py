"""Queries over message contracts, stored sessions, prompts and redaction, on small relations that both sides read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.geometry import is_valid_box
from tidemark.operators import catalog, messages, privacy, sessions, store, validation, vision
from tidemark.operators.models import first_working
from tidemark.plans import planner, prompts
from tidemark.sources.inline import common_table, dealt, dealt_table, frame
from tidemark.sources.tables import spread, table

PAYLOAD = "id bigint, operation string, direction string, payload string"
PAYLOADS = [
    (1, "ping", "request", '{"timestamp": 5}'), (2, "ping", "request", '{"timestamp": "5"}'), (3, "ping", "response", '{"timestamp": 5.5, "context": "worker"}'), (4, "ping", "response", '{"timestamp": 5, "context": "moon"}'), (5, "ping", "request", '{"timestamp": 1, "echo": null}'),
    (6, "ping", "request", '{"timestamp": 1, "echo": "x"}'), (7, "inference:runOCR", "request", '{"width": 10, "height": 20.5, "frame": "crop"}'), (8, "inference:runOCR", "request", '{"width": 0, "height": 2, "frame": "crop"}'), (9, "inference:runFaces", "request", '{"width": 1, "height": 2, "frame": "page"}'),
    (10, "inference:runIcons", "request", '{"width": 1, "height": 2, "frame": "image", "region": [0, 0, 1, 1]}'), (11, "inference:runIcons", "request", '{"width": 1, "height": 2, "frame": "image", "region": [0, 0, 1]}'), (12, "inference:runIcons", "request", '{"width": 1, "height": 2, "frame": "image", "region": [0, 0, 1, "1"]}'),
    (13, "inference:runDetector", "response", '{"status": "ok", "synthetic": true, "itemCount": 0, "durationMs": 1.5}'), (14, "inference:runDetector", "response", '{"status": "ok", "synthetic": false, "itemCount": 0, "durationMs": 1}'), (15, "inference:runDetector", "response", '{"status": "fine", "synthetic": true, "itemCount": 0, "durationMs": 1}'),
    (16, "inference:runDetector", "response", '{"status": "ok", "synthetic": true, "itemCount": -1, "durationMs": 1}'), (17, "dom:walk", "request", "{}"), (18, "dom:walk", "request", '{"docId": 7}'), (19, "dom:walk", "response", '{"docId": "d", "elementCount": 3, "timestamp": 1}'), (20, "dom:walk", "response", '{"docId": "d", "elementCount": 3}'),
    (21, "dom:probe", "request", '{"probe": true}'), (22, "dom:probe", "request", '{"probe": 1}'), (23, "dom:probe", "response", '{"active": false, "docId": "d"}'), (24, "task:status", "request", '{"taskId": "  "}'), (25, "task:status", "request", '{"taskId": " t "}'), (26, "task:status", "response", '{"taskId": "t", "state": "paused"}'),
    (27, "task:status", "response", '{"taskId": "t", "state": "lost"}'), (28, "host:acquire", "request", '{"consumer": ""}'), (29, "host:acquire", "response", '{"leaseId": "l", "generation": 2}'), (30, "host:release", "response", '{"released": true, "remainingLeases": 0}'), (31, "host:release", "request", '{"lease": "l"}'),
    (32, "host:status", "request", '{"any": 1}'), (33, "host:status", "response", '{"state": "idle", "generation": 1, "activeLeases": 0, "browser": "chrome"}'), (34, "host:status", "response", '{"state": "idle", "generation": 1, "activeLeases": 0, "browser": "other"}'), (35, "unheard:of", "request", '{"x": [1]}'), (36, "unheard:of", "request", "[1]"),
    (37, "unheard:of", "request", "null"), (38, "ping", "request", '"text"'), (39, "ping", "request", "{"),
]


def operation_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each payload keeps the rules of its operation and direction."""
    rows = dealt(table(spark, sf_dir, "events"), PAYLOAD, PAYLOADS)
    return rows.select("id", messages.payload_ok(F.col("operation"), F.col("direction"), validation.parsed(F.col("payload"))).alias("ok"))


MESSAGE = "id bigint, body string"
_END = '{"context": "ui"}, "destination": {"context": "content", "tabId": 3, "frameId": 0}'
ENVELOPES = [
    (1, f'{{"id": "a", "operation": "ping", "type": "request", "timestamp": 1, "source": {_END}}}'), (2, f'{{"id": " ", "operation": "ping", "type": "request", "timestamp": 1, "source": {_END}}}'), (3, f'{{"id": "a", "operation": "ping", "type": "ask", "timestamp": 1, "source": {_END}}}'),
    (4, f'{{"id": "a", "operation": "ping", "type": "error", "timestamp": 1, "source": {_END}}}'), (5, f'{{"id": "a", "operation": "ping", "type": "error", "timestamp": 1, "error": {{"code": "TIMEOUT", "message": "late"}}, "source": {_END}}}'),
    (6, f'{{"id": "a", "operation": "ping", "type": "error", "timestamp": 1, "error": {{"code": "OTHER", "message": "late"}}, "source": {_END}}}'), (7, '{"id": "a", "operation": "ping", "type": "request", "timestamp": 1, "source": {"context": "ui"}}'),
    (8, '{"id": "a", "operation": "ping", "type": "request", "timestamp": 1, "source": {"context": "ui", "tabId": 1.5}, "destination": {"context": "ui"}}'), (9, '{"id": "a", "operation": "ping", "type": "response", "timestamp": 1, "source": {"context": "ui", "tabId": 1.0}, "destination": {"context": "worker", "frameId": null}}'),
    (10, '{"id": "a", "operation": "ping", "type": "response", "timestamp": 1, "source": {"context": "ui", "tabId": 1.0}, "destination": {"context": "worker", "frameId": 9}}'), (11, "[]"), (12, f'{{"id": "a", "operation": "ping", "type": "request", "timestamp": "1", "source": {_END}}}'), (13, "not json"),
    (14, '{"id": "a", "operation": "ping", "type": "request", "timestamp": 1, "source": {"context": "ui", "tabId": -1}, "destination": {"context": "ui"}}'),
]


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "events"), MESSAGE, ENVELOPES).select("id", messages.is_envelope(validation.parsed(F.col("body"))).alias("ok"))


ENDPOINT = "context string, tab bigint, frame bigint"
_ENDPOINTS_FROM = {"tab": "tab + e_user % 2"}
ENDPOINTS = [("content", 1, None), ("content", 1, 0), ("content", 1, 2), ("content", 2, None), ("ui", None, None), ("ui", None, 0), ("worker", None, None), ("worker", 1, None)]


def endpoint_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each listed endpoint, how many events' endpoints are the same: those that join on the normalised triple."""
    told = frame(spark, ENDPOINT, ENDPOINTS).select(F.struct("context", "tab", "frame").alias("a"))
    met = dealt(table(spark, sf_dir, "events"), ENDPOINT, ENDPOINTS, **_ENDPOINTS_FROM).select(F.struct("context", "tab", "frame").alias("b"))
    both = met.join(told, F.col("a.context") == F.col("b.context"))
    both = both.where(messages.matches_endpoint(F.col("a"), F.col("b")))
    return both.groupBy("a.context", "a.tab", "a.frame").agg(F.count("*").alias("n"))


ERROR = "id bigint, code string, body string"
ERROR_ROWS = [
    (1, "session_expired", '{"session_id": "s_{u}", "task_id": "t_1", "task_version": 2, "seq": {u}, "text": "{t}"}'), (2, "unavailable", '{"session_id": "s 1", "seq": 3}'), (3, "rate_limited", "{}"), (4, "resync_required", '{"session_id": "s_1", "task_id": null}'),
    (5, "unauthorized", '{"task_version": 0}'), (6, "invalid_request", '{"task_version": 1.0, "seq": true}'), (7, "unsupported_version", '{"seq": 9007199254740991}'),
]


def error_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and body of each error: correlation that breaks the contract is left out, and so is all other content."""
    told = dealt(table(spark, sf_dir, "events"), ERROR, ERROR_ROWS).withColumn("e", messages.error_body(F.col("code"), messages.correlation(validation.parsed(F.col("body")))))
    return told.select("id", "e.status", "e.body")


VERSIONS = [
    (1, '{"protocol": "1.0", "session_id": "s_{u}", "seq": 0}'), (2, '{"protocol": "2.0", "session_id": "s_1", "seq": 0}'), (3, '{"protocol": 1.0, "session_id": "s_1", "seq": 0}'), (4, '{"protocol": "1.0", "session_id": "_1", "seq": 0}'), (5, '{"protocol": "1.0", "session_id": "s_{u}", "seq": 1.5}'),
    (6, '{"protocol": "1.0", "session_id": "s_{u}", "seq": 4.0}'), (7, '{"protocol": "1.0", "session_id": "s_{u}"}'), (8, '{"session_id": "s_1", "seq": 0}'), (9, "{"), (10, '{"protocol": "1.0", "session_id": 5, "seq": 0}'),
]


def envelope_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "events"), MESSAGE, VERSIONS).select("id", F.coalesce(validation.envelope_code(validation.parsed(F.col("body"))), F.lit("ok")).alias("code"))


def body_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' props as request bodies with room for nine bytes: why each is refused."""
    e = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 7 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    return e.select("event_id", F.coalesce(validation.capped_body(raw.cast("binary"), 9), F.lit("ok")).alias("code"))


HISTORY = "id bigint, raw string"
_STEP = '{"action_id": "a_{u}", "plan_step": 1, "seq": 2, "doc_id": "d{u}", "observation_id": 3, "action": {"type": "click", "target": "e1"}, "consequential": false, "risk": "low"'
HISTORIES = [
    (1, None), (2, "[]"), (3, f"[{_STEP}}}]"), (4, f'[{_STEP}, "result": {{"status": "ok", "page_changed": true}}}}]'), (5, f'[{_STEP}, "result": {{"status": "ok", "page_changed": 1}}}}]'), (6, f'[{_STEP}, "result": {{"status": "failed", "page_changed": false, "reason": "timeout"}}}}, {_STEP}}}]'),
    (7, f'[{_STEP}, "result": {{"status": "failed", "page_changed": false, "reason": "boredom"}}}}]'), (8, f'[{_STEP}, "expect": {{"appear": "e2"}}, "result": null}}]'), (9, f'[{_STEP}, "expect": []}}]'), (10, f"[{_STEP}}}, 5]"), (11, f"{_STEP}}}"), (12, "[{}]"), (13, "["), (14, "[1]"),
    (15, f'[{_STEP.replace(chr(34) + "seq" + chr(34) + ": 2", chr(34) + "seq" + chr(34) + ": 2.0")}}}]'), (16, f'[{_STEP.replace("low", "huge")}}}]'), (17, f'[{_STEP.replace("target", "aim")}}}]'), (18, f'[{_STEP.replace("a_{u}", "a {u}")}}}]'), (19, f'[{_STEP.replace("false", "0")}}}]'),
]


def history_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stored memory: whether its list can be read, how many steps it has if every one is right, and the last outcome."""
    told = dealt(spread(table(spark, sf_dir, "events"), "event_id"), HISTORY, HISTORIES).withColumn("h", store.decoded(F.col("raw")))
    last = F.element_at("h", -1)
    return told.select("id", store.entries(F.col("raw")).isNotNull().alias("listed"), F.when(F.col("h").isNotNull(), F.size("h")).cast("bigint").alias("steps"), F.when(F.size("h") > 0, prompts.outcome(last["result"])).alias("outcome"), store.stored(F.col("h")).alias("stored"))


RECORD = "session_id string, task_id string, task_version string, created_at string, task_text string, allowed_domains string, mode string, read_only string, doc_id string, last_action_id string, seq string, observation_id string, plan_step string, history string"
_RECORD = ("t_{u}", "3", "1.5", "Buy {t}", '["a.test", "b.test"]', "agent", "0", None, None, None, None, None, None)
_RECORDS_FROM = {"session_id": "concat('s', cast(e_id as varchar(20)))"}
RECORDS = [("s1", *_RECORD)] + [
    (f"s{i + 2}", *(v if k == at else old for k, old in enumerate(_RECORD)))
    for i, (at, v) in enumerate([(0, None), (0, "t 1"), (1, "x"), (2, "soon"), (4, "[1]"), (4, "a.test"), (5, "drive"), (6, "yes"), (6, "1"), (7, "d 1"), (7, "d1"), (8, ""), (8, "-"), (9, "4.0"), (9, "4"), (10, "5"), (11, "z"), (12, "["), (12, f"[{_STEP}}}]"), (3, ""), (3, None)])
]


def session_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored sessions that can be read, as prompt contexts."""
    got = store.prompt_context(dealt(table(spark, sf_dir, "events"), RECORD, RECORDS, **_RECORDS_FROM))
    return got.select("session_id", "task_id", "task_version", "task_text", F.array_join("allowed_domains", ",").alias("domains"), "mode", "read_only", F.size("history").cast("bigint").alias("steps"))


OPS = {"signup": "create", "view": "get", "click": "step", "purchase": "feedback", "error": "delete"}


def _operations(spark, sf_dir):
    """Events as operations on their users' sessions; a third of the feedback names another action than the last."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    names = F.create_map(*(F.lit(x) for kv in OPS.items() for x in kv))
    op = F.when((F.col("event_type") == "view") & (F.col("event_id") % 5 == 0), "escalate").when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), "step").otherwise(names[F.col("event_type")])
    e = e.withColumn("op", op)
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("op") == "step", F.col("event_id")), ignorenulls=True).over(w)
    number = F.when(F.col("op") == "step", F.col("event_id")).when((F.col("op") == "feedback") & (F.col("event_id") % 3 > 0), last)
    return e.withColumn("action_id", F.concat(F.lit("a"), number.cast("string")))


def session_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = store.lifecycle(_operations(spark, sf_dir), "user_id", ["ts", "event_id"], "ts", "2 days")
    return found.select("event_id", "user_id", "op", "status", "plan_step", "remembered")


REQUEST = "id bigint, path_id string, session_id string, task_id string, task_version bigint, kind string"
REQUESTS = [(1, "s1", "s1", "t1", 1, "full"), (2, "s1", "s1", "t1", 1, "diff"), (3, "s1", "s2", "t1", 1, "full"), (4, "s 1", "s 1", "t1", 1, "full"), (5, "s9", "s9", "t1", 1, "full"), (6, "s1", "s1", "t2", 1, "full"), (7, "s1", "s1", "t1", 2, "diff"), (8, "s2", "s2", "t2", 5, "full"), (9, "s1", None, "t1", 1, "full")]
KNOWN = "session_id string, task_id string, task_version bigint"
KNOWN_SESSIONS = [("s1", "t1", 1), ("s2", "t2", 5)]


def step_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = store.step_gate(dealt(table(spark, sf_dir, "events"), REQUEST, REQUESTS), frame(spark, KNOWN, KNOWN_SESSIONS))
    return told.select("id", F.coalesce("code", F.lit("ok")).alias("code"))


def bounded_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes as seconds to live and prices as body limits, preferences and themes by brand."""
    p = table(spark, sf_dir, "part")
    stored = F.when(F.col("p_partkey") % 4 == 0, "true").when(F.col("p_partkey") % 4 == 1, "false").when(F.col("p_partkey") % 4 == 2, '"true"').otherwise("1")
    told = p.select("p_brand", store.settings_ok(F.col("p_size") * 60, F.col("p_partkey") - 2).alias("ok"), validation.preference(validation.parsed(stored)).alias("on"), validation.theme(F.when(F.col("p_size") % 3 == 0, "dark").when(F.col("p_size") % 3 == 1, "blue")).alias("theme"))
    return told.groupBy("p_brand", "theme").agg(F.count_if("ok").alias("n_ok"), F.count_if("on").alias("n_on"))


IMAGE = "id bigint, width double, height double, x double, y double, w double, h double"
_IMAGES_FROM = {"width": "width * (1 + e_user % 3)", "w": "w + e_user % 2"}
IMAGES = [(1, 10.0, 10.0, None, None, None, None), (2, 10.5, 10.0, None, None, None, None), (3, 0.0, 10.0, None, None, None, None), (4, 10.0, 10.0, 0.0, 0.0, 2.5, 2.5), (5, 10.0, 10.0, 0.0, 0.0, 0.5, 2.0), (6, 10.0, 10.0, 8.0, 8.0, 2.0, 2.0), (7, 10.0, 10.0, 8.5, 8.0, 2.0, 2.0), (8, 10.0, 10.0, -1.0, 0.0, 2.0, 2.0), (9, 10.0, 10.0, float("inf"), 0.0, 2.0, 2.0), (10, 10.0, 10.0, float("nan"), 0.0, 2.0, 2.0)]


def image_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = dealt(table(spark, sf_dir, "events"), IMAGE, IMAGES, **_IMAGES_FROM)
    region = F.when(F.col("x").isNotNull(), F.struct("x", "y", "w", "h"))
    return i.select("id", F.coalesce(validation.image_code(F.col("width"), F.col("height"), region), F.lit("ok")).alias("code"))


SCALAR = "id bigint, raw string"


#: Values as events hold them: numbers, texts, objects and lists.
_SCALAR_OF = "case event_id % 5 when 0 then cast(cast(value as decimal(12,2)) as varchar(20)) when 1 then '\"' || event_type || ' é\"' when 2 then props when 3 then '[' || cast(user_id as varchar(20)) || ',true,null]' else '{\"z\":\"' || event_type || '\",\"a\":[' || cast(user_id as varchar(20)) || ',2]}' end"
_COMMAND_OF = "'{\"target\":\"e' || cast(user_id as varchar(20)) || '\",\"type\":\"' || event_type || '\",\"ms\":' || cast(event_id as varchar(20)) || '.0,\"on\":' || case when event_id % 2 = 0 then 'true' else 'null' end || '}'"
_NAMING_OF = "'{\"type\":\"annotate\",\"targets\":[\"e' || cast(user_id as varchar(20)) || '\",5],\"shapes\":[{\"element\":\"e' || cast(event_id % 9 as varchar(20)) || '\"},{\"to_element\":\"' || event_type || '\",\"x\":{\"appear\":\"v' || cast(event_id as varchar(20)) || '\"}}],\"list\":[[{\"target\":\"e' || cast(event_id % 5 as varchar(20)) || '\"}]],\"element\":7}'"


def _commands(spark, sf_dir, expression: str):
    return spread(table(spark, sf_dir, "events"), "event_id").select(F.col("event_id").alias("id"), F.expr(expression).alias("raw"))


def command_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _commands(spark, sf_dir, _SCALAR_OF).select("id", prompts.scalar(validation.parsed(F.col("raw"))).alias("shown"))




def command_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _commands(spark, sf_dir, _COMMAND_OF).select("id", prompts.action_command(validation.parsed(F.col("raw"))).alias("line"))


KEYED = [(1, '{"type": "click", "target": "e1"}'), (2, '{"type": "x"}'), (3, '{"summary": "s"}'), (4, '{"type": "say", "text": "t", "citations": []}'), (5, '{"target": 1, "url": 2}')]


def command_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many kinds of command take all keys of each, and whether any kind knows every key."""
    told = store.variants(dealt(table(spark, sf_dir, "events"), SCALAR, KEYED).withColumn("command", validation.parsed(F.col("raw"))))
    keys = F.map_keys(F.try_variant_get("command", "$", "map<string,variant>"))
    return told.select("id", F.size("fits").cast("bigint").alias("n_kinds"), F.get("fits", F.lit(0)).alias("first"), (F.size(F.array_except(keys, F.array(*map(F.lit, store.COMMAND_KEYS)))) == 0).alias("known"))


def command_element_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element ids that commands name, at any depth."""
    return _commands(spark, sf_dir, _NAMING_OF).select("id", F.array_join(messages.element_ids(validation.parsed(F.col("raw"))), ",").alias("ids"))


def script_element_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element ids of the script that each event's task follows."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "t_profile_upd").otherwise("t_search_demo").alias("task_id"))
    return e.join(F.broadcast(planner.referenced_ids(planner.scripts(spark))), "task_id").select("event_id", "task_id", F.array_join("ids", ",").alias("ids"))


def _screens(spark, sf_dir):
    """Conversations as screens: system turns as texts, the last turn as the user's, a tab for every third one."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("role"), F.substring(F.regexp_replace("text", r"[^A-Za-z0-9 ]", ""), 1, 40).alias("text"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    none = F.lit(None)
    page = F.struct(F.concat(F.lit("https://a.test/"), F.col("conv_id").cast("string")).alias("url"), F.lit("A page").alias("title"), F.struct(F.lit(1280).alias("w"), F.lit(720.5).alias("h"), (F.col("conv_id") % 9).alias("scroll_y"), F.lit(2000).alias("page_h"), F.when(F.col("conv_id") % 2 == 0, 3).alias("scroll_x"), none.cast("double").alias("page_w")).alias("viewport"))
    last, odd = F.element_at("t", -1), F.col("conv_id") % 2 == 1
    element = "array<struct<id:string,role:string,name:string,input_type:string,src:string,conf:double,bbox:struct<x:double,y:double,w:double,h:double>,value_state:string,value:string,pii_class:string,landmark:string,image:string,state:struct<disabled:boolean>,suspicious:boolean>>"
    result = F.when(F.size("t") > 2, F.struct(F.lit("a_1").alias("action_id"), F.when(odd, "ok").otherwise("failed").alias("status"), odd.alias("page_changed"), F.when(~odd, "timeout").alias("reason")))
    tabs = F.when(F.col("conv_id") % 3 == 0, F.array(F.struct(F.lit("t1").alias("tab"), F.lit("Mail").alias("title"), F.lit("2 new").alias("digest"))))
    s = F.struct(
        F.lit("1.0").alias("protocol"), F.concat(F.lit("s_"), F.col("conv_id").cast("string")).alias("session_id"), F.size("t").alias("seq"), F.lit("d1").alias("doc_id"), F.lit(1).alias("observation_id"), F.lit(0).alias("step"), F.when(F.col("conv_id") % 5 == 0, "diff").otherwise("full").alias("kind"),
        page.alias("page"), F.lit("v1").alias("redaction_scheme"), F.lit("agent").alias("mode"), F.lit(False).alias("suspicious"), F.array().cast(element).alias("elements"), F.transform(F.filter("t", lambda x: x["role"] == "system"), lambda x: x["text"]).alias("text_context"), result.alias("last_action_result"),
        F.when(last["role"] == "user", F.struct(F.lit("typed").alias("source"), F.lit(False).alias("interrupt"), last["text"].alias("text"))).alias("user_turn"), F.when(odd, F.struct(F.lit("click").alias("type"), F.lit("a_1").alias("after_step"), F.when(F.size("t") > 3, "e5").alias("target"))).alias("user_interaction"), tabs.alias("tabs"),
    )
    return g.select("conv_id", "t", s.alias("s"))


def screen_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _screens(spark, sf_dir).select("conv_id", prompts.screen_section(F.col("s"), ("disabled",)).alias("section"))


def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two messages for every full screen; the roles, the user's length, and the user's first and last line."""
    told = _screens(spark, sf_dir)
    task = prompts.task_section(F.struct(F.lit("t_1").alias("task_id"), F.lit(1).alias("task_version"), F.lit("agent").alias("mode"), F.lit(False).alias("read_only"), F.array(F.lit("a.test"), F.lit("b.test")).alias("domains"), F.element_at("t", 1)["text"].alias("task_text")))
    memory = prompts.memory_section(F.col("t"), lambda e: F.concat(e["role"], F.lit(" -> "), F.lit("pending")))
    user = prompts.user_message(F.col("s.kind"), task, memory, prompts.screen_section(F.col("s"), ("disabled",)))
    m = told.select("conv_id", prompts.messages(F.lit("rules"), user).alias("m"))
    return m.select("conv_id", F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), F.size("m").cast("bigint").alias("n"), F.col("m")[1]["content"].alias("content"))


NAME = "id bigint, name string"
FAILURES = [(1, "ValueError"), (2, "bad name"), (3, "_X9"), (4, "9x"), (5, ""), (6, "A" * 64), (7, "A" * 65)]


def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "events"), NAME, FAILURES).select("id", prompts.failure_reason(F.col("name")).alias("reason"))


def key_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors and model sessions by key, and which document ids are opaque ones."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("d"), F.col("p_size").cast("string")).alias("d"), F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("e"), "p_name", "p_brand")
    return p.select("p_partkey", text.anchor_key(F.col("d"), F.col("e")).alias("anchor"), text.session_key(F.col("p_brand"), F.col("d"), F.lit("wasm")).alias("session"), text.is_opaque_id(F.col("p_name")).alias("opaque"), text.key_token(F.col("p_brand")).alias("token"))


RAW = "id bigint, element string, role string, name string, w double, has_value boolean, value string, input_type string, src string, told string"
_RAWS_FROM = {"w": "w + e_user"}
RAWS = [
    (1, "e1", "button", "Go", 5.0, False, None, None, "dom", None), (2, "", "button", "Go", 5.0, False, None, None, "dom", None), (3, "e1", None, "Go", 5.0, False, None, None, "vision", None), (4, "e1", "button", "", 5.0, False, None, None, "vision", "dom_text"), (5, "e1", "textbox", "", 5.0, True, "", "email", "dom", None),
    (6, "e1", "textbox", "Mail", 5.0, True, "x@y.test", "email", "dom", None), (7, "e1", "textbox", "", 5.0, True, "hunter2", "password", "dom", None), (8, "e1", "textbox", "", 5.0, True, "free", "text", "dom", None), (9, "e1", "textbox", "", 5.0, True, None, "tel", "dom", None), (10, "e1", "textbox", "", float("nan"), True, "5", "tel", "dom", None),
    (11, "e1", "textbox", None, 5.0, True, "555", "tel", "vision", None),
]


def redacted_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = dealt(table(spark, sf_dir, "events"), RAW, RAWS, **_RAWS_FROM)
    box = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("w").alias("w"), F.lit(1.0).alias("h"))
    c = F.struct(F.col("element").alias("id"), "role", is_valid_box(box).alias("finite"), "name", "has_value", "value", "input_type")
    found = r.select("id", privacy.redacted_element(c, F.lit(1)).alias("r"), privacy.evidence_for(F.col("src"), F.col("told")).alias("evidence"))
    return found.select("id", "r.*", "evidence")


def kept_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as text entries of their conversation: only empty ones are clear, the others are counted."""
    c = table(spark, sf_dir, "conversations").withColumn("shown", F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text")))
    e = c.withColumn("d", privacy.decide(F.col("shown"), F.lit(None).cast("string"), F.lit(False)))
    g = e.groupBy("conv_id").agg(F.collect_list(F.struct(F.col("d.outcome").alias("outcome"), F.col("shown").alias("value"))).alias("entries"))
    k = g.select("conv_id", privacy.keep_clear(F.col("entries")).alias("k"))
    return k.select("conv_id", F.size("k.kept").cast("bigint").alias("n_kept"), F.col("k.withheld").cast("bigint").alias("n_withheld"))


def withheld_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", privacy.withheld_crop(F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("c"))
    return d.select(F.col("c.doc_id").alias("doc"), "c.outcome", "c.evidence", "c.pii_class", "c.decision", "c.confidence", "c.synthetic")


BINDING = "id bigint, task string, origin string, doc string, targets array<string>, operations array<string>"
_BINDINGS_FROM = {"task": "concat(task, cast(e_user as varchar(20)))"}
BINDINGS = [(1, "t", "o", "d", ["e1", "e2"], ["type"]), (2, "t", "o", "d", ["e2", "e1"], ["type"]), (3, "t", "o", "d", ["e1"], ["type"]), (4, "t", "o", "d2", ["e1", "e2"], ["type"]), (5, "t", "o", "d", ["e1", "e2"], ["type", "click"]), (6, "t", "o", "d", ["e2", "e1"], ["click", "type"])]


def binding_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest binding that allows the same as each."""
    b = dealt(table(spark, sf_dir, "events"), BINDING, BINDINGS, **_BINDINGS_FROM).withColumn("key", privacy.binding_key(*(F.col(k) for k in ("task", "origin", "doc", "targets", "operations"))))
    return b.join(b.groupBy("key").agg(F.min("id").alias("first")), "key").select("id", "first")


def _scopes(spark, sf_dir):
    """Customers as scopes of their nations' tabs, active at their last event's time; a few ended, a few tabs closed."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("scope_id"), F.col("c_nationkey").cast("string").alias("tab_id"), F.col("c_custkey").alias("k"))
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_activity"))
    scopes = c.join(e, F.col("k") == F.col("user_id")).select("scope_id", "tab_id", "k", "last_activity")
    ended = scopes.where("k % 5 = 0").select("scope_id")
    closed = table(spark, sf_dir, "nation").where("n_nationkey % 6 = 0").select(F.col("n_nationkey").cast("string").alias("tab_id"))
    newest = table(spark, sf_dir, "events").agg(F.max("ts").alias("now"))
    return scopes.join(F.broadcast(newest)), ended, closed


def live_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which scopes are live a day after activity, and what each holds: its user's different event types."""
    scopes, ended, closed = _scopes(spark, sf_dir)
    live = privacy.live_scopes(scopes, F.col("now"), "1 day", ended, closed)
    entries = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("scope_id"), "event_type").distinct()
    return privacy.entry_counts(scopes.select("scope_id"), live, entries).select("scope_id", "has_scope", "entries")


def created_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes, ended, closed = _scopes(spark, sf_dir)
    live = privacy.live_scopes(scopes, F.col("now"), "1 day", ended, closed)
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("scope_id"), F.when(F.col("c_custkey") % 7 > 0, "t").alias("task_id"), F.col("c_nationkey").cast("string").alias("tab_id"))
    return privacy.created_scopes(wanted, live).groupBy("outcome").agg(F.count("*").alias("n"))


ATTEMPT = "id bigint, webgpu boolean, wasm boolean, cpu boolean"
ATTEMPTS = [(1, True, True, True), (2, False, True, True), (3, False, False, False), (4, None, False, True)]


def first_backends(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = F.array(*(F.struct(F.lit(k).alias("name"), F.coalesce(k, F.lit(False)).alias("ok")) for k in ("webgpu", "wasm", "cpu")))
    return dealt(table(spark, sf_dir, "events"), ATTEMPT, ATTEMPTS).select("id", first_working(tried).alias("backend"))


def region_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as detector results: flags as kinds, line numbers as items."""
    kind = F.when(F.col("l_returnflag") == "R", "face").otherwise("text")
    status = F.when(F.col("l_linestatus") == "O", "ok").when(F.col("l_linenumber") > 5, "unavailable").otherwise("empty")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", kind.alias("kind"), status.alias("status"), (F.col("l_linenumber") - 1).cast("bigint").alias("items"), (F.col("l_partkey") % 11 == 0).alias("synthetic"))
    return vision.region_summary(rows, ["l_orderkey"])


def last_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views answered by the next click of the same user within a day: how many are, and how late at most."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    found = sessions.replies(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "user_id", "event_id", "ts", "1 day")
    return found.groupBy("user_id").agg(F.count("answered").alias("n_answered"), F.max(F.unix_micros(F.col("answered").cast("timestamp")) - F.unix_micros(F.col("asked").cast("timestamp"))).alias("latest"))


SEARCH = "search bigint, term string, category string, only_available boolean"
SEARCHES = [(1, "  RED ", "all", False), (2, "red", "Brand#11", True), (3, "", "all", True), (4, "no such thing", "all", False), (5, "part 1", "Brand#12", False)]


def catalog_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches over the parts by name, with brands as categories; parts larger than ten are available."""
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("category"), (F.col("p_size") > 10).alias("available"))
    return catalog.searched(p, frame(spark, SEARCH, SEARCHES))


def _json(path: str) -> str:
    return f"json_type(j, '$.{path}')"


_NUMBER = "('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')"


def _num(path: str) -> str:
    return f"coalesce({_json(path)} in {_NUMBER}, false)"


def _str(path: str) -> str:
    return f"coalesce({_json(path)} = 'VARCHAR', false)"


def _opt(path: str, rule: str) -> str:
    return f"({_json(path)} is null or {rule})"


def _in(path: str, values) -> str:
    return f"({_str(path)} and coalesce(json_extract_string(j, '$.{path}') in {tuple(values)}, false))"


def _from(path: str, least: int, op: str = ">=") -> str:
    return f"({_num(path)} and coalesce(cast(json_extract(j, '$.{path}') as double) {op} {least}, false))"


def _word(path: str) -> str:
    return f"({_str(path)} and coalesce(trim(json_extract_string(j, '$.{path}')) <> '', false))"


def _endpoint(path: str) -> str:
    ids = " and ".join(_opt(f"{path}.{k}", f"coalesce({_num(f'{path}.{k}')} and cast(json_extract(j, '$.{path}.{k}') as double) >= 0 and cast(json_extract(j, '$.{path}.{k}') as double) = floor(cast(json_extract(j, '$.{path}.{k}') as double)), false)") for k in ("tabId", "frameId"))
    return f"({_in(f'{path}.context', messages.CONTEXTS)} and {ids})"


_PARSED = "p as (select *, case when json_valid({raw}) then cast({raw} as json) end as j from r)"
_IMAGE = f"{_from('width', 0, '>')} and {_from('height', 0, '>')} and {_in('frame', ('image', 'crop'))} and (json_type(j, '$.region') is null or coalesce(json_array_length(j, '$.region') = 4 and len(list_filter(json_extract(j, '$.region[*]'), lambda x: json_type(x) in {_NUMBER})) = 4, false))"
_RESULT = f"{_in('status', messages.STATUSES)} and coalesce(json_extract_string(j, '$.synthetic') = 'true' and json_type(j, '$.synthetic') = 'BOOLEAN', false) and {_from('itemCount', 0)} and {_from('durationMs', 0)}"
_STEP_OK = f"""json_type(e) = 'OBJECT' and coalesce(json_type(e, '$.action_id') = 'VARCHAR' and regexp_full_match(json_extract_string(e, '$.action_id'), '[A-Za-z0-9][A-Za-z0-9_-]*'), false)
    and coalesce(json_type(e, '$.doc_id') = 'VARCHAR' and regexp_full_match(json_extract_string(e, '$.doc_id'), '[A-Za-z0-9][A-Za-z0-9_-]*'), false)
    and coalesce(json_type(e, '$.plan_step') in ('BIGINT', 'UBIGINT') and json_type(e, '$.seq') in ('BIGINT', 'UBIGINT') and json_type(e, '$.observation_id') in ('BIGINT', 'UBIGINT'), false)
    and coalesce(json_type(e, '$.action') = 'OBJECT' and len(list_filter(json_keys(e, '$.action'), lambda k: k not in {tuple(store.COMMAND_KEYS)})) = 0, false)
    and coalesce(json_type(e, '$.consequential') = 'BOOLEAN', false) and coalesce(json_extract_string(e, '$.risk') in ('low', 'medium', 'high'), false) and coalesce(json_type(e, '$.expect'), 'NULL') in ('NULL', 'OBJECT')
    and (coalesce(json_type(e, '$.result'), 'NULL') = 'NULL' or (coalesce(json_extract_string(e, '$.result.status') in {store.RESULTS}, false) and coalesce(json_type(e, '$.result.page_changed') = 'BOOLEAN', false)
        and (coalesce(json_type(e, '$.result.reason'), 'NULL') = 'NULL' or json_extract_string(e, '$.result.reason') in {store.REASONS})))"""
_OPERATIONS = """
    o as (select user_id, ts, event_id, case when event_type = 'view' and event_id % 5 = 0 then 'escalate' when event_type = 'error' and event_id % 2 = 0 then 'step' when event_type = 'signup' then 'create' when event_type = 'view' then 'get'
        when event_type = 'click' then 'step' when event_type = 'purchase' then 'feedback' else 'delete' end as op from events),
    n as (select *, row_number() over w as i, case when op = 'step' then event_id when op = 'feedback' and event_id % 3 > 0 then last_value(case when op = 'step' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) end as act
        from o window w as (partition by user_id order by ts, event_id))"""
_SCREEN = """
    c as (select conv_id, turn, role, substr(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g'), 1, 40) as text from conversations),
    g as (select conv_id, count(*) as n, list({'turn': turn, 'role': role, 'text': text} order by turn, role, text) as t from c group by conv_id),
    s as (select conv_id, n, t, '== SCREEN STATE ==' || chr(10) || 'protocol=1.0 session=s_' || conv_id || ' seq=' || n || ' doc=d1 obs=1 step=0 kind=' || case when conv_id % 5 = 0 then 'diff' else 'full' end || chr(10) ||
        'page url="https://a.test/' || conv_id || '" title="A page" viewport=1280,720.5,' || conv_id % 9 || ',2000' || case when conv_id % 2 = 0 then ' scroll_x=3' else '' end || chr(10) || 'redaction_scheme=v1 mode=agent suspicious=false' || chr(10) ||
        'elements (0):' || chr(10) || '(none)' || chr(10) || 'text_context (' || len(list_filter(t, lambda x: x.role = 'system')) || '):' || chr(10) ||
        coalesce(nullif(array_to_string(list_transform(list_filter(t, lambda x: x.role = 'system'), lambda x, i: '[' || (i - 1) || '] "' || x.text || '"'), chr(10)), ''), '(none)') ||
        case when n > 2 then chr(10) || 'last_action_result action_id=a_1 status=' || case when conv_id % 2 = 1 then 'ok page_changed=true' else 'failed page_changed=false reason=timeout' end else '' end ||
        case when t[-1].role = 'user' then chr(10) || 'user_turn source=typed interrupt=false text="' || t[-1].text || '"' else '' end ||
        case when conv_id % 2 = 1 then chr(10) || 'user_interaction type=click after_step=a_1' || case when n > 3 then ' target=e5' else '' end else '' end ||
        case when conv_id % 3 = 0 then chr(10) || '[tab] id=t1 title="Mail" digest="2 new"' else '' end as section from g)"""
_LIVE = """
    a as (select user_id, max(ts) as last_activity from events group by user_id), s as (select cast(c_custkey as varchar) as scope_id, c_custkey, c_nationkey, last_activity from customer join a on c_custkey = user_id),
    l as (select scope_id from s where c_custkey % 5 <> 0 and c_nationkey % 6 <> 0 and (select max(ts) from events) < last_activity + interval 1 day)"""

SQL = {
    "operation_payloads": f"""
        with {dealt_table("r", PAYLOAD, PAYLOADS)}, {_PARSED.format(raw="payload")}
        select id, case when coalesce(json_type(j), 'NULL') <> 'OBJECT' then false
            when operation = 'ping' then {_num("timestamp")} and {_opt("echo", _str("echo"))} and (direction = 'request' or {_in("context", messages.CONTEXTS)})
            when operation in {messages.INFERENCE} then case when direction = 'request' then {_IMAGE} else {_RESULT} end
            when operation = 'dom:walk' then case when direction = 'request' then {_opt("docId", _str("docId"))} else {_str("docId")} and {_from("elementCount", 0)} and {_num("timestamp")} end
            when operation = 'dom:probe' then case when direction = 'request' then coalesce(json_type(j, '$.probe') = 'BOOLEAN', false) else coalesce(json_type(j, '$.active') = 'BOOLEAN', false) and {_opt("docId", _str("docId"))} end
            when operation = 'task:status' then {_word("taskId")} and (direction = 'request' or {_in("state", messages.TASK_STATES)})
            when operation = 'host:acquire' then case when direction = 'request' then {_str("consumer")} else {_str("leaseId")} and {_num("generation")} end
            when operation = 'host:release' then case when direction = 'request' then {_str("leaseId")} else coalesce(json_type(j, '$.released') = 'BOOLEAN', false) and {_num("remainingLeases")} end
            when operation = 'host:status' then direction = 'request' or ({_str("state")} and {_num("generation")} and {_num("activeLeases")} and {_in("browser", messages.BROWSERS)})
            else true end as ok from p""",
    "envelopes": f"""
        with {dealt_table("r", MESSAGE, ENVELOPES)}, {_PARSED.format(raw="body")}
        select id, coalesce(json_type(j) = 'OBJECT' and {_word("id")} and {_word("operation")} and {_in("type", messages.TYPES)} and {_num("timestamp")} and {_endpoint("source")} and {_endpoint("destination")}
            and (json_extract_string(j, '$.type') <> 'error' or ({_in("error.code", messages.BUS_CODES)} and {_str("error.message")})), false) as ok from p""",
    "endpoint_matches": f"""
        with {common_table("r", ENDPOINT, ENDPOINTS)}, {dealt_table("e", ENDPOINT, ENDPOINTS, **_ENDPOINTS_FROM)},
        n as (select *, case when context = 'content' then coalesce(frame, 0) else frame end as f from r), m as (select *, case when context = 'content' then coalesce(frame, 0) else frame end as f from e)
        select a.context, a.tab, a.frame, count(*) as n from n a join m b on a.context = b.context and a.tab is not distinct from b.tab and a.f is not distinct from b.f group by all""",
    "error_bodies": f"""
        with {dealt_table("r", ERROR, ERROR_ROWS)}, {_PARSED.format(raw="body")},
        k as (select *, (coalesce(json_type(j, '$.session_id'), 'NULL') = 'NULL' or (json_type(j, '$.session_id') = 'VARCHAR' and regexp_full_match(json_extract_string(j, '$.session_id'), '[A-Za-z0-9][A-Za-z0-9_-]{{0,79}}')))
            and (coalesce(json_type(j, '$.task_id'), 'NULL') = 'NULL' or (json_type(j, '$.task_id') = 'VARCHAR' and regexp_full_match(json_extract_string(j, '$.task_id'), '[A-Za-z0-9][A-Za-z0-9_-]{{0,79}}')))
            and (json_type(j, '$.task_version') is null or ({_num("task_version")} and cast(json_extract(j, '$.task_version') as double) >= 1)) and (json_type(j, '$.seq') is null or coalesce({_num("seq")} and try_cast(json_extract_string(j, '$.seq') as double) >= 1, false)) as good from p)
        select id, cast(case code when 'session_expired' then 404 when 'unauthorized' then 401 when 'rate_limited' then 429 when 'unavailable' then 503 when 'resync_required' then 409 else 400 end as bigint) as status,
            '{{"protocol":"1.0"' || case when good then coalesce(',"session_id":"' || json_extract_string(j, '$.session_id') || '"', '') || coalesce(',"task_id":"' || json_extract_string(j, '$.task_id') || '"', '') || coalesce(',"task_version":' || json_extract_string(j, '$.task_version'), '')
            || coalesce(',"seq":' || json_extract_string(j, '$.seq'), '') else '' end || ',"code":"' || code || '","retryable":' || case when code in ('session_expired', 'rate_limited', 'unavailable', 'resync_required') then 'true' else 'false' end || '}}' as body from k""",
    "envelope_codes": f"""
        with {dealt_table("r", MESSAGE, VERSIONS)}, {_PARSED.format(raw="body")}
        select id, case when j is null then 'invalid_request' when {_str("protocol")} and json_extract_string(j, '$.protocol') <> '1.0' then 'unsupported_version'
            when {_str("protocol")} and {_str("session_id")} and regexp_full_match(json_extract_string(j, '$.session_id'), '[A-Za-z0-9][A-Za-z0-9_-]{{0,79}}') and {_num("seq")} and cast(json_extract(j, '$.seq') as double) = floor(cast(json_extract(j, '$.seq') as double)) then 'ok' else 'invalid_request' end as code from p""",
    "body_codes": """
        with b as (select event_id, case when event_id % 7 = 0 then props || '}' else props end as raw from events)
        select event_id, case when strlen(raw) > 9 then 'too_large' when not json_valid(raw) then 'not_json' else 'ok' end as code from b""",
    "history_decode": f"""
        with {dealt_table("r", HISTORY, HISTORIES)}, {_PARSED.format(raw="raw")}, l as (select *, raw is null or coalesce(json_type(j) = 'ARRAY', false) as is_list, case when json_type(j) = 'ARRAY' then json_extract(j, '$[*]') else [] end as es from p),
        t as (select *, is_list and len(list_filter(es, lambda e: json_type(e) = 'OBJECT')) = len(es) as listed, is_list and len(list_filter(es, lambda e: {_STEP_OK})) = len(es) as good from l), u as (select *, es[-1] as e from t)
        select id, listed, case when good then len(es) end as steps, case when good and len(es) > 0 then case when coalesce(json_type(e, '$.result'), 'NULL') = 'NULL' then 'pending' else json_extract_string(e, '$.result.status') || ' page_changed=' || json_extract_string(e, '$.result.page_changed')
            || coalesce(' reason=' || json_extract_string(e, '$.result.reason'), '') end end as outcome,
            case when good and len(es) > 0 then '[' || array_to_string(list_transform(es, lambda e: '{{"action_id":"' || json_extract_string(e, '$.action_id') || '","plan_step":' || json_extract_string(e, '$.plan_step') || ',"seq":' || json_extract_string(e, '$.seq') || ',"doc_id":"' || json_extract_string(e, '$.doc_id')
            || '","observation_id":' || json_extract_string(e, '$.observation_id') || ',"action":{{"target":"' || json_extract_string(e, '$.action.target') || '","type":"' || json_extract_string(e, '$.action.type') || '"}},"consequential":' || json_extract_string(e, '$.consequential') || ',"risk":"' || json_extract_string(e, '$.risk') || '"'
            || case when coalesce(json_type(e, '$.expect'), 'NULL') = 'OBJECT' then ',"expect":' || cast(json_extract(e, '$.expect') as varchar) else '' end
            || case when coalesce(json_type(e, '$.result'), 'NULL') = 'OBJECT' then ',"result":{{"status":"' || json_extract_string(e, '$.result.status') || '","page_changed":' || json_extract_string(e, '$.result.page_changed') || coalesce(',"reason":"' || json_extract_string(e, '$.result.reason') || '"', '') || '}}' else '' end || '}}'), ',') || ']' end as stored from u""",
    "session_records": f"""
        with {dealt_table("r", RECORD, RECORDS, **_RECORDS_FROM)}, p as (select *, case when json_valid(allowed_domains) then cast(allowed_domains as json) end as d, case when json_valid(history) then cast(history as json) end as h from r)
        select session_id, task_id, cast(task_version as bigint) as task_version, task_text, array_to_string(cast(d as varchar[]), ',') as domains, mode, read_only = '1' as read_only, coalesce(json_array_length(h), 0)::bigint as steps from p
        where task_id is not null and regexp_full_match(task_id, '[A-Za-z0-9][A-Za-z0-9_-]*') and try_cast(task_version as bigint) is not null and try_cast(created_at as double) is not null and task_text is not null and json_type(d) = 'ARRAY'
            and len(list_filter(json_extract(d, '$[*]'), lambda x: json_type(x) <> 'VARCHAR')) = 0 and mode in ('ask', 'guide', 'agent', 'background') and read_only in ('0', '1') and coalesce(regexp_full_match(doc_id, '[A-Za-z0-9][A-Za-z0-9_-]*'), true)
            and coalesce(regexp_full_match(last_action_id, '([A-Za-z0-9][A-Za-z0-9_-]*)?'), true) and coalesce(regexp_full_match(seq, '[0-9]+'), true) and coalesce(regexp_full_match(observation_id, '[0-9]+'), true) and coalesce(regexp_full_match(plan_step, '[0-9]+'), true) and (history is null or json_type(h) = 'ARRAY')""",
    "session_lifecycle": f"""
        with recursive {_OPERATIONS},
        m as (
            select distinct user_id, cast(0 as bigint) as i, false as live, cast(null as timestamp) as seen, cast(null as bigint) as last, cast(0 as bigint) as steps, cast(null as varchar) as status, cast(null as bigint) as event_id, cast(null as varchar) as op from n
            union all
            select m.user_id, n.i, case when n.op = 'create' then true when not ok then false else n.op <> 'delete' end,
                case when n.op = 'create' or (ok and (n.op = 'step' or hit)) then n.ts else m.seen end, case when n.op = 'create' then null when ok and n.op = 'step' then n.act else m.last end,
                case when n.op = 'create' then 0 when ok and n.op = 'step' then m.steps + 1 else m.steps end,
                case when n.op = 'create' then 'created' when not ok then 'session_expired' when n.op = 'step' then 'ok' when n.op = 'get' then 'found' when n.op = 'delete' then 'ended' when n.op = 'escalate' then 'unavailable' when hit then 'accepted' else 'invalid_request' end, n.event_id, n.op
            from m join n on n.user_id = m.user_id and n.i = m.i + 1, lateral (select m.live and coalesce(n.ts < m.seen + interval 2 day, false) as ok, n.op = 'feedback' and coalesce(n.act = m.last, false) as hit) x)
        select event_id, user_id, op, status, steps as plan_step, least(steps, 5) as remembered from m where i > 0""",
    "step_requests": f"""
        with {dealt_table("r", REQUEST, REQUESTS)}, {common_table("k", KNOWN, KNOWN_SESSIONS)}
        select r.id, case when not regexp_full_match(path_id, '[A-Za-z0-9][A-Za-z0-9_-]*') then 'invalid_request' when k.session_id is null then 'session_expired' when r.session_id is distinct from path_id or r.task_id <> k.task_id or r.task_version <> k.task_version then 'invalid_request'
            when kind <> 'full' then 'resync_required' else 'ok' end as code from r left join k on k.session_id = path_id""",
    "bounded_settings": """
        select p_brand, case when p_size % 3 = 0 then 'dark' else 'system' end as theme, count(*) filter (where p_size * 60 between 1 and 1800 and p_partkey > 2) as n_ok, count(*) filter (where p_partkey % 4 = 0) as n_on from part group by all""",
    "image_inputs": f"""
        with {dealt_table("r", IMAGE, IMAGES, **_IMAGES_FROM)}
        select id, case when width < 1 or height < 1 or width <> floor(width) or height <> floor(height) then 'image dimensions' when x is null then 'ok' when isinf(x) or isnan(x) then 'region not finite' when w < 1 or h < 1 then 'region without size'
            when x < 0 or y < 0 or x + w > width or y + h > height then 'region outside' else 'ok' end as code from r""",
    "command_scalars": """
        select event_id as id, case event_id % 5 when 0 then case when value = floor(value) then cast(cast(value as bigint) as varchar) else cast(value as varchar) end when 1 then '"' || event_type || ' é"' when 2 then replace(json(props)::varchar, ':', ': ')
            when 3 then '[' || user_id || ', true, null]' else '{"a": [' || user_id || ', 2], "z": "' || event_type || '"}' end as shown from events""",
    "command_lines": """
        select event_id as id, 'type="' || event_type || '" ms=' || event_id || ' on=' || case when event_id % 2 = 0 then 'true' else 'null' end || ' target="e' || user_id || '"' as line from events""",
    "command_variants": f"""
        with {dealt_table("r", SCALAR, KEYED)}, {common_table("v", "name string, fields array<string>", [(n, ["type", *f.split()]) for n, f in store.COMMANDS.items()])}, k as (select id, json_keys(raw) as ks from r), u as (select list(distinct f) as known from (select unnest(fields) as f from v))
        select id, count(name) as n_kinds, min(name) as first, any_value(list_has_all(known, ks)) as known from k cross join u left join v on list_has_all(fields, ks) group by id""",
    "command_element_ids": """
        select event_id as id, array_to_string(list_sort(list_distinct(['e' || user_id, 'e' || event_id % 9, event_type, 'v' || event_id, 'e' || event_id % 5])), ',') as ids from events""",
    "script_element_ids": "select event_id, task_id, ids from events join (values (0, 't_profile_upd', 'e_email,e_save'), (1, 't_search_demo', 'e_result,e_search')) t(k, task_id, ids) on k = event_id % 2",
    "screen_sections": f"with {_SCREEN} select conv_id, section from s",
    "prompt_messages": f"""
        with {_SCREEN}, k as (select *, t[greatest(1, n - 4):n] as kept from s),
        u as (select conv_id, '== TASK ==' || chr(10) || 'task=t_1@1' || chr(10) || 'mode=agent' || chr(10) || 'read_only=false' || chr(10) || 'allowed_domains=["a.test","b.test"]' || chr(10) || 'task_text="' || t[1].text || '"' || chr(10) || '== MEMORY (last 5 steps) ==' || chr(10) || 'steps (' || len(kept) || ' of 5)' || chr(10)
            || array_to_string(list_transform(kept, lambda x, i: i || ') ' || x.role || ' -> pending'), chr(10)) || chr(10) || section || chr(10) || '== INSTRUCTION ==' || chr(10) || 'Return exactly one next action.' as content from k)
        select conv_id, case when conv_id % 5 > 0 then 'system,user' end as roles, cast(case when conv_id % 5 > 0 then 2 end as bigint) as n, case when conv_id % 5 > 0 then content end as content from u""",
    "failure_reasons": f"""
        with {dealt_table("r", NAME, FAILURES)} select id, 'stage=prompt detail=' || case when regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*') and length(name) <= 64 then name else 'exception' end as reason from r""",
    "key_texts": """
        select p_partkey, 'd' || p_size || '/e' || p_partkey as anchor, p_brand || '@d' || p_size || '#wasm' as session, regexp_full_match(p_name, '[A-Za-z0-9][A-Za-z0-9_-]*') and length(p_name) <= 80 as opaque,
            case when regexp_full_match(p_brand, '[A-Za-z_][A-Za-z0-9_]*') then p_brand else '"' || p_brand || '"' end as token from part""",
    "redacted_elements": f"""
        with {dealt_table("r", RAW, RAWS, **_RAWS_FROM)}, g as (select *, case when coalesce(element, '') = '' or coalesce(role, '') = '' then 'missing id or role' when isnan(w) then 'non-finite bbox' end as why, has_value and value is null as broken from r)
        select id, case when why is not null then 'withheld' when broken then 'invalid' else 'ok' end as outcome, case when why is null and broken then 'no value' else why end as reason, case when why is null and not broken then case when coalesce(name, '') = '' then '' else '{{{{TEXT_WITHHELD}}}}' end end as name,
            case when why is null and has_value and value is not null then case when value = '' then 'empty' else 'redacted' end end as value_state,
            case when why is null and has_value and value is not null then case when value = '' then '' when input_type = 'password' then '{{{{SECRET}}}}' when input_type = 'email' then '{{{{EMAIL_1}}}}' when input_type = 'tel' then '{{{{PHONE_1}}}}' else '{{{{TEXT_WITHHELD}}}}' end end as value,
            case when why is null and has_value and value <> '' then case input_type when 'password' then 'secret' when 'email' then 'email' when 'tel' then 'phone' else 'other' end end as pii_class, coalesce(told, case when src = 'vision' then 'ocr' else 'dom_text' end) as evidence from g""",
    "kept_texts": "select conv_id, count(*) filter (where turn % 3 = 0 or coalesce(text, '') = '') as n_kept, count(*) filter (where turn % 3 <> 0 and coalesce(text, '') <> '') as n_withheld from conversations group by conv_id",
    "withheld_crops": "select 'd' || doc_id as doc, 'withheld' as outcome, 'ocr' as evidence, 'other' as pii_class, 'withhold' as decision, cast(1 as double) as confidence, true as synthetic from documents",
    "binding_keys": f"""
        with {dealt_table("r", BINDING, BINDINGS, **_BINDINGS_FROM)}, s as (select *, list_sort(targets) as t, list_sort(operations) as o from r) select a.id, min(b.id) as first from s a join s b on (a.task, a.origin, a.doc, a.t, a.o) = (b.task, b.origin, b.doc, b.t, b.o) group by a.id""",
    "live_scopes": f"""
        with {_LIVE}, e as (select user_id, count(distinct event_type) as n from events group by user_id) select s.scope_id, l.scope_id is not null as has_scope, cast(case when l.scope_id is null then 0 else n end as bigint) as entries from s join e on user_id = c_custkey left join l using (scope_id)""",
    "created_scopes": f"""
        with {_LIVE} select case when c_custkey % 7 = 0 then 'invalid' when l.scope_id is not null then 'scope_already_exists' else 'ok' end as outcome, count(*) as n from customer left join l on l.scope_id = cast(c_custkey as varchar) group by all""",
    "first_backends": f"with {dealt_table('r', ATTEMPT, ATTEMPTS)} select id, case when coalesce(webgpu, false) then 'webgpu' when wasm then 'wasm' when cpu then 'cpu' end as backend from r",
    "region_results": """
        with r as (select l_orderkey, l_returnflag = 'R' as face, case when l_linestatus = 'O' then 'ok' when l_linenumber > 5 then 'unavailable' else 'empty' end as status, l_linenumber - 1 as items, l_partkey % 11 = 0 as synthetic from lineitem)
        select l_orderkey, count(*) as results, cast(sum(items) as bigint) as items, bool_or(face and items > 0) as any_face, bool_and(not synthetic and status in ('ok', 'empty')) as all_covered, bool_or(status = 'unavailable') as any_restricted from r group by l_orderkey""",
    "catalog_results": f"""
        with {common_table("r", SEARCH, SEARCHES)}, f as (select search, count(p_name) as n from r left join part on contains(lower(p_name), lower(trim(term))) and (category = 'all' or p_brand = category) and (not only_available or p_size > 10) group by search)
        select search, n, n || case when n = 1 then ' result' else ' results' end as shown from f""",
    "last_replies": """
        with v as (select user_id, event_id, ts from events where event_type = 'view'), r as (select v.user_id, v.event_id, v.ts, min(c.ts) as first from v left join (select user_id, ts from events where event_type = 'click') c on c.user_id = v.user_id and c.ts > v.ts group by all)
        select user_id, count(*) filter (where first <= ts + interval 1 day) as n_answered, max(epoch_us(first) - epoch_us(ts)) filter (where first <= ts + interval 1 day) as latest from r group by user_id""",
}

QUERIES = {name: globals()[name] for name in SQL}
