"""Message contracts against a plain reading of their JSON Schemas."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import contracts as C


def fits(schema, value, top):
    """Whether a value keeps a schema (the words of it that ``json_schema`` uses)."""
    if "$ref" in schema:
        return fits(top["definitions"][schema["$ref"].rsplit("/", 1)[1]], value, top)
    if "oneOf" in schema:
        return sum(fits(x, value, top) for x in schema["oneOf"]) == 1
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    kinds = {"string": isinstance(value, str), "boolean": isinstance(value, bool), "number": number, "integer": number and value == int(value), "array": isinstance(value, list), "object": isinstance(value, dict)}
    if not kinds[schema["type"]]:
        return False
    if schema["type"] == "string":
        return schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", 1e9) and ("pattern" not in schema or bool(re.search(schema["pattern"].replace("$", r"\Z"), value))) and value in schema.get("enum", [value])
    if number:
        return schema.get("minimum", value) <= value <= schema.get("maximum", value)
    if schema["type"] == "array":
        of = schema["items"]
        return schema["minItems"] <= len(value) <= schema["maxItems"] and all(fits(of[i] if isinstance(of, list) else of, x, top) for i, x in enumerate(value))
    if schema["type"] == "object":
        return set(schema["required"]) <= set(value) <= set(schema["properties"]) and all(fits(schema["properties"][k], x, top) for k, x in value.items())
    return True


SEEN = {"protocol": "1.0", "session_id": "s_1", "task_id": "t_1", "task_version": 1, "seq": 1, "doc_id": "d_1", "observation_id": 1}
STEP = {k: SEEN[k] for k in ("protocol", "session_id", "task_id", "task_version", "seq")}
FIELD = {"id": "e1", "role": "textbox", "name": "Náme", "bbox": [0, 1, 2.5, 3], "src": "dom", "conf": 1}
SCREEN = SEEN | {
    "step": 0, "page": {"url": "https://a.example/x", "title": "", "viewport": {"w": 1, "h": 1, "scroll_y": -0.5, "page_h": 10}}, "redaction_scheme": "v1", "mode": "agent", "text_context": ["a"], "suspicious": False,
    "elements": [FIELD, FIELD | {"value_state": "empty", "value": ""}, FIELD | {"value_state": "filled", "value": "x"}, FIELD | {"value_state": "redacted", "value": "{{EMAIL_1}}", "pii_class": "email", "state": {"checked": True}}],
}
COMMANDS = [
    {"type": "click", "target": "e1"}, {"type": "type", "target": "e1", "text": "", "clear_first": True}, {"type": "select", "target": "v1", "option": ""}, {"type": "scroll", "direction": "up", "amount": 1}, {"type": "scroll", "to_element": "e1"}, {"type": "press_key", "key": "Tab"},
    {"type": "wait", "ms": 0}, {"type": "wait", "until": {"appear": "e1"}}, {"type": "navigate", "url": "http://x"}, {"type": "extract", "target": "e1", "field": "name"}, {"type": "ask_user", "question": "q", "options": ["a"]}, {"type": "escalate", "targets": ["e1"], "question": "q"}, {"type": "done", "summary": ""},
    {"type": "point", "target": "e1", "say": "go on", "style": "circle", "advance_on": "click"}, {"type": "annotate", "shapes": [{"kind": "badge", "target": "e1", "label": "x"}], "say": " here "}, {"type": "say", "text": "hi"}, {"type": "answer", "text": "", "citations": [{"tab": "t", "doc_id": "d", "element": "e1"}]}, {"type": "switch_tab", "tab": "t1"}, {"type": "report", "summary": "", "items": ["a"]},
]
RESULT = {"action_id": "a", "status": "ok", "page_changed": True, "reason": "timeout"}
CROP = {"crop_id": "c", "target": "e1", "bbox": [0, 0, 1, 1], "width": 1, "height": 512, "media_type": "image/jpeg", "data_base64": "QUI=", "regions": [{"bbox": [0, 0, 1, 1], "content_class": "map", "masked": True, "checks": ["ui"]}]}
GOOD = [
    ("SessionStartRequest", {"protocol": "1.0", "task_id": "t", "task_version": 1, "task": "do", "allowed_domains": ["a.example"], "capabilities": {"browser": "chrome", "backend": "none", "detectors": ["dom"], "crops": False}, "mode": "ask", "read_only": True, "voice": False, "granted_tabs": []}),
    ("SessionStartResponse", {k: STEP[k] for k in ("protocol", "session_id", "task_id", "task_version")} | {"expires_in_seconds": 1800}), ("SessionEndRequest", STEP), ("SessionEndResponse", STEP | {"status": "ended"}),
    ("ScreenState", SCREEN | {"kind": "full", "user_turn": {"source": "text", "text": "", "interrupt": False}, "last_action_result": RESULT}), ("ScreenState", SCREEN | {"kind": "diff", "base_observation_id": 1, "removed": ["e2"], "tabs": [{"tab": "t", "title": "", "digest": ""}], "user_interaction": {"type": "click", "after_step": "a"}}),
    *(("Action", SEEN | {"action_id": "a", "action": c, "consequential": False, "risk": "low"} | e) for c, e in zip(COMMANDS, [{"expect": {"appear": "e1"}}, {"expect": {"url_equals": "https://a"}}, {"thought": "x"}, {"progress": {"step": 0, "subgoal": "", "remaining_estimate": 0}}, {"expect": {"element": "e1", "value_equals": ""}}] * 4)),
    ("EscalateRequest", SEEN | {"question": "q", "redaction_scheme": "v1", "crops": [CROP]}), ("EscalateResponse", SEEN | {"interpretations": [{"element_id": "v1", "role": "button", "label": "", "state": {}, "confidence": 0.5, "src": "server_vlm"}]}),
    ("FeedbackRequest", SEEN | {"result": RESULT}), ("FeedbackResponse", STEP | {"status": "accepted"}), ("ProtocolError", {"protocol": "1.0", "code": "unavailable", "retryable": True, "seq": 3}),
]


def spoilt(value, rng):
    """A copy with one thing changed somewhere."""
    value = json.loads(json.dumps(value))
    spots = []

    def walk(x):
        for k in list(x) if isinstance(x, dict) else range(len(x)):
            spots.append((x, k))
            if isinstance(x[k], (dict, list)):
                walk(x[k])

    walk(value)
    holder, key = rng.choice(spots)
    how = rng.randrange(5)
    if how == 0 and isinstance(holder, dict):
        del holder[key]
    elif how == 1 and isinstance(holder, dict):
        holder[rng.choice(["html", "value", "target", "kind", "until", "removed"])] = rng.choice(["x", "e1", 1])
    elif how == 2 and isinstance(holder, list):
        holder.extend([holder[key]] * rng.choice([1, 9, 300]))
    else:
        holder[key] = rng.choice([None, True, 0, 1, -1, 1.0, 1.5, 2**53 - 1, 2**53, "", "e1", "x" * 81, "x" * 5000, "é" * 4096, "a b\n", "word " * 25, "word " * 26, "https://a b", "a\n", [], {}, [1, 2, 3, 4], ["a"], {"appear": "e1"}])
    return value


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(4)
    rows = [(m, json.dumps(v)) for m, v in GOOD]
    rows += [(m, json.dumps(spoilt(v, rng))) for m, v in GOOD for _ in range(40)]
    rows += [(rng.choice(C.MESSAGES), json.dumps(v)) for _, v in GOOD]
    return rows


def test_messages_are_judged_as_their_schemas_say(spark, cases):
    odd = [("Action", None), ("Action", ""), ("Action", "{"), ("Action", "null"), ("Action", "[]"), ("Nothing", json.dumps(STEP)), (None, json.dumps(STEP)), ("SessionEndRequest", json.dumps(STEP)[:-1] + ',"seq":1}')]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(cases + odd)], "n int, message string, body string")
    found = {r["n"]: r for r in df.select("n", C.is_any(F.col("message"), F.col("body")).alias("ok")).collect()}
    schemas = {m: C.json_schema(m) for m in C.MESSAGES}
    want = [fits(schemas[m], json.loads(b), schemas[m]) for m, b in cases]
    assert all(want[: len(GOOD)]) and 60 < sum(want) < len(want) / 2
    assert [found[i]["ok"] for i in range(len(want))] == want
    assert not any(found[i]["ok"] for i in range(len(want), len(want) + len(odd)))


def test_quarantine_holds_codes_and_no_bodies(spark):
    rows = [(1, "SessionEndRequest", json.dumps(STEP)), (2, "SessionEndRequest", json.dumps(STEP | {"protocol": "9"})), (3, "SessionEndRequest", json.dumps(STEP | {"protocol": 1})), (4, "SessionEndRequest", "secret")]
    df = spark.createDataFrame(rows, "n int, message string, body string")
    assert [r["n"] for r in C.valid_messages(df).collect()] == [1]
    assert sorted(tuple(r) for r in C.refused_messages(df).collect()) == [(2, "SessionEndRequest", "unsupported_version"), (3, "SessionEndRequest", "invalid_request"), (4, "SessionEndRequest", "invalid_request")]


def test_valid_messages_are_read_whole(spark):
    """Reading into the struct and writing JSON again gives the message back."""
    for name in ("ScreenState", "Action", "EscalateRequest"):
        own = [v for m, v in GOOD if m == name]
        df = spark.createDataFrame([(json.dumps(v),) for v in own], "body string").select(F.to_json(C.read_message(name, F.col("body"))).alias("again"))
        assert [json.loads(r["again"]) for r in df.collect()] == own
    kind = C.struct_type("Action")["action"].dataType
    assert {f.name for f in kind.fields} == {n for r in C.CONTRACTS["ActionCommand"].records for n in C.CONTRACTS[r].names} and not any(isinstance(f.dataType, T.VariantType) for f in kind.fields)


def test_unknown_names(spark):
    with pytest.raises(KeyError):
        C.json_schema("Element")
    schema = C.json_schema("Action")
    schema["definitions"].clear()
    assert C.json_schema("Action")["definitions"]
    assert len(C.MESSAGES) == 11 and not spark.range(1).select(C.is_message("Element", F.lit("{}"))).first()[0]


def test_element_ids_cost_no_more_than_their_depth(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import messages, validation

    assert len(messages.element_ids(F.col("v"), depth=6)._jc.toString()) < 20_000
    deep = '{"a":[{"target":"e1","b":{"c":{"d":{"targets":["e3",4,"e2"],"element":7,"e":{"f":{"g":{"appear":"e9"}}}}}}}]}'
    df = spark.createDataFrame([(1, deep), (2, "no json"), (3, None), (4, "5")], "id bigint, raw string").withColumn("v", validation.parsed(F.col("raw")))
    got = {r["id"]: (r["six"], r["ten"]) for r in df.select("id", messages.element_ids(F.col("v")).alias("six"), messages.element_ids(F.col("v"), depth=10).alias("ten")).collect()}
    assert got == {1: (["e1", "e2", "e3"], ["e1", "e2", "e3", "e9"]), 2: ([], []), 3: ([], []), 4: ([], [])}


def test_long_messages_keep_their_verdicts(spark):
    texts = ['{"\\' * 1300 + "é"] * 50
    screen = next(v for m, v in GOOD if m == "ScreenState")
    element = screen["elements"][0]
    long = [screen | {"text_context": texts}, screen | {"elements": [element | {"name": '{"\\"' * 200}] * 300}, screen | {"elements": [element] * 3000}, {"protocol": "9"} | screen | {"protocol": "9", "elements": [element] * 3000}]
    rows = [(i, "ScreenState", json.dumps(v)) for i, v in enumerate(long)]
    rows += [(4, "ScreenState", rows[2][2][:-1])]
    assert all(len(b) > C.HEAD for _, _, b in rows)
    df = spark.createDataFrame(rows, "n int, message string, body string")
    assert [r["n"] for r in C.valid_messages(df).orderBy("n").collect()] == [0, 1]
    assert sorted((r["n"], r["reject_code"]) for r in C.refused_messages(df).collect()) == [(2, "invalid_request"), (3, "unsupported_version"), (4, "invalid_request")]


def test_a_refused_body_is_made_once(spark, sf_dir):
    from tidemark.plans import message_queries as q

    made, refused = (df._jdf.queryExecution().optimizedPlan().toString().count("repeat(") for df in (q.messages(spark, sf_dir), q.message_rejects(spark, sf_dir)))
    assert refused == made


def test_lists_are_counted_before_they_are_parsed(spark):
    """A list's bound is met from both sides, keys in strings and after quotes are not its objects, and spaced ones are left to the parser."""
    screen = next(v for m, v in GOOD if m == "ScreenState")
    element = screen["elements"][0]
    action = next(v for m, v in GOOD if m == "Action" and v["action"]["type"] == "annotate")
    shape = action["action"]["shapes"][0]
    rows = [("ScreenState", screen | {"elements": [element] * n, "text_context": ['"bbox":' * 40] * 99}, n <= 300) for n in (299, 300, 301, 900)]
    rows += [("Action", action | {"action": action["action"] | {"shapes": [shape] * n}}, n <= 30) for n in (29, 30, 31)]
    rows += [("ScreenState", screen | {"elements": [element | {'"bbox': 1}]}, False), ("EscalateRequest", next(v for m, v in GOOD if m == "EscalateRequest") | {"crops": [CROP] * 3}, False)]
    texts = [(i, m, json.dumps(v, separators=s), ok) for i, (m, v, ok, s) in enumerate((*r, s) for r in rows for s in ((",", ":"), (" , ", " : ")))]
    df = spark.createDataFrame(texts, "n int, message string, body string, ok boolean")
    assert df.where(C.is_any(F.col("message"), F.col("body")) != F.col("ok")).count() == 0
    over = spark.createDataFrame([(t[1], t[2]) for t in texts if t[0] == 6], "message string, body string")
    assert len(over.first()["body"]) < C.HEAD and over.where(C._too_many("ScreenState", F.col("body"))).count() == 1


def test_versions_are_told_without_a_parser_where_text_shows_them(spark):
    bodies = ['{"protocol":1.0}', '{"protocol": null, "protocol":"9"}', '{"a":{"protocol":"1.0"},"protocol":"9"}', '{"a":1,"pro\\u0074ocol":"9"}', '{"props":{"protocol":"9"}}', '[{"protocol":"9"}]', '{"protocol" : "9"}', '{"protocol":"1.0"', '{"protocol":"9"', None]
    df = spark.createDataFrame(list(enumerate(bodies)), "n int, body string").withColumn("message", F.lit("SessionEndRequest"))
    assert [r["reject_code"] == "unsupported_version" for r in C.refused_messages(df).orderBy("n").collect()] == [False, False, True, True, False, False, True, False, False, False]
    assert C.refused_messages(df).count() == len(bodies)
