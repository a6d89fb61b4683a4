"""The wire messages as closed, tagged contracts, from one table of kinds.

A kind says what a JSON value may be. From the same table come the predicate that tells whether a variant keeps a
contract (``is_message``), the struct type that a valid body is read into (``struct_type``) and a self-contained
JSON Schema (``json_schema``). Records are closed: a key that they don't name is an error, an optional field may be
absent but not null, and a union wants exactly one of its records to fit.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.validation import PROTOCOL, SAFE_INTEGER


@dataclass(frozen=True)
class Text:
    most: int
    least: int = 0
    like: str | None = None  # for Java and RE2 alike


@dataclass(frozen=True)
class Word:
    values: tuple[str, ...]


@dataclass(frozen=True)
class Whole:
    least: int
    most: int = SAFE_INTEGER


@dataclass(frozen=True)
class Number:
    least: float | None = None
    most: float | None = None


@dataclass(frozen=True)
class Flag:
    pass


@dataclass(frozen=True)
class Items:
    of: Kind
    most: int
    least: int = 0


@dataclass(frozen=True)
class Row:
    """A list of fixed length, each place with a kind of its own."""

    places: tuple[Kind, ...]


@dataclass(frozen=True)
class Optional:
    kind: Kind


@dataclass(frozen=True)
class Record:
    fields: tuple[tuple[str, Kind], ...]

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.fields]

    @property
    def required(self) -> list[str]:
        return [n for n, k in self.fields if not isinstance(k, Optional)]


@dataclass(frozen=True)
class Union:
    records: tuple[str, ...]


#: A kind may also be the name of a record or union of CONTRACTS.
Kind = Text | Word | Whole | Number | Flag | Items | Row | Optional | Record | Union | str


def words(text: str) -> Word:
    return Word(tuple(text.split()))


def record(*parent: Record, **fields: Kind) -> Record:
    return Record(sum((p.fields for p in parent), ()) + tuple(fields.items()))


# Names, limits, patterns and literals of the protocol's messages.
VERSION = Word((PROTOCOL,))
ID = Text(80, 0, r"^[A-Za-z0-9][A-Za-z0-9_-]*\z")
ELEMENT_ID = Text(80, 0, r"^[ev][A-Za-z0-9_-]+\z")
URL = Text(2048, 0, r"^https?://[^\s]+\z")
ROLE = Text(64, 0, r"^[a-z][a-z0-9_-]*\z")
SPEECH = Text(1000, 0, r"^\s*(?:\S+\s+){0,24}\S+\s*\z")
DOMAIN = Text(253, 0, r"^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)*[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\z")
PLACEHOLDER = Text(100, 0, r"^\{\{(?:[A-Z][A-Z0-9_]*_[1-9][0-9]*|SECRET|TEXT_WITHHELD)\}\}\z")
BASE64 = Text(1_048_576, 4, r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z")
LONG, QUESTION = Text(4096), Text(4096, 1)
COUNT, FROM_ZERO, SIDE = Whole(1), Whole(0), Whole(1, 100_000)
SHARE = Number(0, 1)
BOX = Row((Number(), Number(), Number(0), Number(0)))
MODE = words("ask guide agent background")
DIGEST_SCHEME = words("v1")
PII = words("secret name email phone address card bank_account aadhaar pan ifsc upi iban ip dob api_key jwt face location organization amount other")
INPUTS = words("text search tel url email password number date datetime-local month week time color range checkbox radio file hidden submit reset button image")
REASONS = words("target_missing target_changed stale_observation binding_denied unsupported_control expectation_failed timeout cancelled permission_denied egress_blocked execution_error")
CONTENT = words("ui_chrome known_icon supported_text chart face avatar photo video document_image handwriting map barcode unsupported_text unclassified")
ERROR_CODES = words("resync_required invalid_request unsupported_version session_expired unauthorized rate_limited unavailable")
FLAG = Flag()

_TASK = record(protocol=VERSION, session_id=ID, task_id=ID, task_version=COUNT)
_STEP = record(_TASK, seq=COUNT)
_SEEN = record(_STEP, doc_id=ID, observation_id=COUNT)
_STATE = Record(tuple((n, Optional(FLAG)) for n in "disabled checked selected expanded required readonly focused invalid occluded".split()))
_ELEMENT = record(
    id=ELEMENT_ID, role=ROLE, name=LONG, bbox=BOX, src=words("dom vision fused server_vlm"), conf=SHARE, state=Optional("ElementState"), input_type=Optional(INPUTS),
    landmark=Optional(Text(128)), image=Optional(words("face_redacted masked")), suspicious=Optional(FLAG),
)
_SCREEN = record(
    _SEEN, step=FROM_ZERO, page="Page", redaction_scheme=DIGEST_SCHEME, mode=MODE, elements=Items("Element", 300), text_context=Items(LONG, 100), suspicious=FLAG,
    last_action_result=Optional("ActionResult"), user_turn=Optional("UserTurn"), user_interaction=Optional("UserInteraction"), tabs=Optional(Items("TabDigest", 8)),
)
_COMMANDS = {
    "Click": record(type=words("click"), target=ELEMENT_ID),
    "Type": record(type=words("type"), target=ELEMENT_ID, text=LONG, clear_first=FLAG),
    "Select": record(type=words("select"), target=ELEMENT_ID, option=LONG),
    "ScrollAmount": record(type=words("scroll"), direction=words("up down left right"), amount=SIDE),
    "ScrollTarget": record(type=words("scroll"), to_element=ELEMENT_ID),
    "PressKey": record(type=words("press_key"), key=words("Enter Tab Escape")),
    "WaitDuration": record(type=words("wait"), ms=Whole(0, 30_000)),
    "WaitUntil": record(type=words("wait"), until="Presence"),
    "Navigate": record(type=words("navigate"), url=URL),
    "Extract": record(type=words("extract"), target=ELEMENT_ID, field=words("name value text_context")),
    "AskUser": record(type=words("ask_user"), question=QUESTION, options=Optional(Items(Text(256), 10, 1))),
    "Escalate": record(type=words("escalate"), targets=Items(ELEMENT_ID, 2, 1), question=QUESTION),
    "Done": record(type=words("done"), summary=LONG),
    "Point": record(type=words("point"), target=ELEMENT_ID, say=SPEECH, style=words("pointer circle spotlight"), advance_on=words("click input navigate")),
    "Annotate": record(type=words("annotate"), shapes=Items("Annotation", 30, 1), say=SPEECH),
    "Say": record(type=words("say"), text=SPEECH),
    "Answer": record(type=words("answer"), text=Text(8192), citations=Items("Citation", 30)),
    "SwitchTab": record(type=words("switch_tab"), tab=ID),
    "Report": record(type=words("report"), summary=LONG, items=Items(LONG, 100)),
}
CONTRACTS: dict[str, Record | Union] = {
    "SessionStartRequest": record(
        protocol=VERSION, task_id=ID, task_version=COUNT, task=QUESTION, allowed_domains=Items(DOMAIN, 32, 1), capabilities="ClientCapabilities", mode=MODE,
        voice=Optional(FLAG), granted_tabs=Optional(Items(ID, 8)), read_only=FLAG,
    ),
    "SessionStartResponse": record(_TASK, expires_in_seconds=Whole(1, 1800)),
    "SessionEndRequest": _STEP,
    "SessionEndResponse": record(_STEP, status=words("ended")),
    "ScreenState": Union(("FullScreen", "DiffScreen")),
    "Action": record(
        _SEEN, action_id=ID, action="ActionCommand", expect=Optional("Expectation"), consequential=FLAG, risk=words("low medium high"), thought=Optional(Text(1024)), progress=Optional("Progress"),
    ),
    "EscalateRequest": record(_SEEN, question=QUESTION, redaction_scheme=DIGEST_SCHEME, crops=Items("RedactedCrop", 2, 1)),
    "EscalateResponse": record(_SEEN, interpretations=Items("Interpretation", 2, 1)),
    "FeedbackRequest": record(_SEEN, result="ActionResult"),
    "FeedbackResponse": record(_STEP, status=words("accepted")),
    "ProtocolError": record(protocol=VERSION, session_id=Optional(ID), task_id=Optional(ID), task_version=Optional(COUNT), seq=Optional(COUNT), code=ERROR_CODES, retryable=FLAG),
    # parts
    "ClientCapabilities": record(
        browser=words("chrome firefox"), backend=words("webgpu wasm-simd-threads wasm-simd wasm none"), detectors=Items(words("dom rules ner ocr face ui barcode script"), 8), crops=FLAG
    ),
    "ActionResult": record(action_id=ID, status=words("ok failed mismatch unknown"), page_changed=FLAG, reason=Optional(REASONS)),
    "UserTurn": record(source=words("voice text"), text=LONG, interrupt=FLAG),
    "UserInteraction": record(type=words("click input navigate"), target=Optional(ELEMENT_ID), after_step=ID),
    "TabDigest": record(tab=ID, title=Text(512), digest=LONG),
    "Viewport": record(w=SIDE, h=SIDE, scroll_x=Optional(Number()), scroll_y=Number(), page_w=Optional(Whole(1, 10_000_000)), page_h=Whole(1, 10_000_000)),
    "Page": record(url=URL, title=Text(512), viewport="Viewport"),
    "ElementState": _STATE,
    "DisplayElement": _ELEMENT,
    "EmptyElement": record(_ELEMENT, value_state=words("empty"), value=Word(("",))),
    "FilledElement": record(_ELEMENT, value_state=words("filled"), value=QUESTION),
    "RedactedElement": record(_ELEMENT, value_state=words("redacted"), value=PLACEHOLDER, pii_class=PII),
    "Element": Union(("DisplayElement", "EmptyElement", "FilledElement", "RedactedElement")),
    "FullScreen": record(_SCREEN, kind=words("full")),
    "DiffScreen": record(_SCREEN, kind=words("diff"), base_observation_id=COUNT, removed=Items(ELEMENT_ID, 300)),
    "ValueExpectation": record(element=ELEMENT_ID, value_equals=LONG),
    "AppearExpectation": record(appear=ELEMENT_ID),
    "DisappearExpectation": record(disappear=ELEMENT_ID),
    "UrlExpectation": record(url_equals=URL),
    "Expectation": Union(("ValueExpectation", "AppearExpectation", "DisappearExpectation", "UrlExpectation")),
    "Presence": Union(("AppearExpectation", "DisappearExpectation")),
    "Annotation": record(kind=words("circle arrow badge label spotlight"), target=ELEMENT_ID, label=Optional(Text(256))),
    "Citation": record(tab=ID, doc_id=ID, element=Optional(ELEMENT_ID)),
    "Progress": record(step=FROM_ZERO, subgoal=Text(512), remaining_estimate=Whole(0, 10_000)),
    "CropRegion": record(bbox=BOX, content_class=CONTENT, masked=FLAG, checks=Items(words("ui icon ocr rules ner face barcode script policy"), 9)),
    "RedactedCrop": record(crop_id=ID, target=ELEMENT_ID, bbox=BOX, width=Whole(1, 512), height=Whole(1, 512), media_type=words("image/jpeg"), data_base64=BASE64, regions=Items("CropRegion", 1000, 1)),
    "Interpretation": record(element_id=ELEMENT_ID, role=ROLE, label=LONG, state="ElementState", confidence=SHARE, src=words("server_vlm")),
    **{f"{name}Command": kind for name, kind in _COMMANDS.items()},
    "ActionCommand": Union(tuple(f"{name}Command" for name in _COMMANDS)),
}
MESSAGES = tuple(list(CONTRACTS)[:11])


def _with(value: Column, then) -> Column:
    """``then`` of a value that is evaluated once; false where it is null."""
    return F.coalesce(F.exists(F.array(value), lambda x: F.coalesce(then(x), F.lit(False))), F.lit(False))


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _between(x: Column, least: float | None, most: float | None) -> Column:
    return _all([x >= least] * (least is not None) + [x <= most] * (most is not None))


#: White space of both languages that check a message; Java's own \\s is ASCII's.
_SPACE = r"\s\x1C-\x1F\x85\p{Z}"


def _java(pattern: str) -> str:
    return pattern.replace(r"[^\s]", f"[^{_SPACE}]").replace(r"\S", f"[^{_SPACE}]").replace(r"+\s", f"+[{_SPACE}]").replace(r"^\s", f"^[{_SPACE}]")


_NUMERIC = r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL.*|DOUBLE|FLOAT)$"


def accepts(kind: Kind, value: Column) -> Column:
    """Whether a variant is of a kind; an absent or a null value is of none."""
    if isinstance(kind, str):
        return accepts(CONTRACTS[kind], value)
    sort = F.schema_of_variant(value)
    match kind:
        case Text(most, least, like):
            fits = lambda s: F.length(s).between(least, most) & (s.rlike(_java(like)) if like else F.lit(True))
            return (sort == "STRING") & _with(F.try_variant_get(value, "$", "string"), fits)
        case Word(values):
            return F.coalesce((sort == "STRING") & F.try_variant_get(value, "$", "string").isin(*values), F.lit(False))
        case Flag():
            return F.coalesce(sort == "BOOLEAN", F.lit(False))
        case Whole(least, most):
            return F.coalesce(sort.rlike(_NUMERIC), F.lit(False)) & _with(F.try_variant_get(value, "$", "double"), lambda x: (x == F.floor(x)) & _between(x, least, most))
        case Number(least, most):
            return F.coalesce(sort.rlike(_NUMERIC), F.lit(False)) & _with(F.try_variant_get(value, "$", "double"), lambda x: (F.abs(x) < float("inf")) & _between(x, least, most))
        case Items(of, most, least):
            return _with(F.try_variant_get(value, "$", "array<variant>"), lambda a: F.size(a).between(least, most) & F.forall(a, lambda x: accepts(of, x)))
        case Row(places):
            return _with(F.try_variant_get(value, "$", "array<variant>"), lambda a: (F.size(a) == len(places)) & _all([accepts(k, F.get(a, F.lit(i))) for i, k in enumerate(places)]))
        case Union(records):
            return _with(F.try_variant_get(value, "$", "map<string,variant>"), lambda m: _keeps_one([CONTRACTS[r] for r in records], m))
        case Record():
            return _with(F.try_variant_get(value, "$", "map<string,variant>"), lambda m: _keeps(kind, m))
    raise TypeError(kind)


def _bare(kind: Kind) -> Kind:
    return kind.kind if isinstance(kind, Optional) else kind


def _shaped(kind: Record, m: Column) -> Column:
    """Whether a map has the fields that it must have and no others."""
    closed = F.size(F.array_except(F.map_keys(m), F.array(*map(F.lit, kind.names)))) == 0
    return _all([closed, *(F.map_contains_key(m, F.lit(n)) for n in kind.required)])


def _given(m: Column, name: str, kind: Kind) -> Column:
    """Whether a field is of its kind, if it is there at all."""
    return ~F.map_contains_key(m, F.lit(name)) | accepts(kind, m[F.lit(name)])


def _keeps(kind: Record, m: Column) -> Column:
    return _all([_shaped(kind, m), *(_given(m, n, _bare(k)) for n, k in kind.fields)])


def _keeps_one(records: list[Record], m: Column) -> Column:
    """Whether exactly one record fits.

    A field that is of one kind in all records that have it is looked at once: if it is there and wrong, none
    fits, since those without the field are closed.
    """
    kinds: dict[str, set[Kind]] = {}
    for n, k in (f for r in records for f in r.fields):
        kinds.setdefault(n, set()).add(_bare(k))
    same = [_given(m, n, k) for n, (k, *others) in ((n, list(x)) for n, x in kinds.items()) if not others]
    each = [_all([_shaped(r, m), *(_given(m, n, _bare(k)) for n, k in r.fields if len(kinds[n]) > 1)]) for r in records]
    return _all(same) & (reduce(lambda a, b: a + b, [e.cast("int") for e in each]) == 1)


def most_objects(kind: Kind) -> int:
    """The most JSON objects, its own included, that a value of a kind can hold."""
    match kind:
        case str():
            return most_objects(CONTRACTS[kind])
        case Items(of, most):
            return most * most_objects(of)
        case Row(places):
            return sum(map(most_objects, places))
        case Optional(of):
            return most_objects(of)
        case Record(fields):
            return 1 + sum(most_objects(k) for _, k in fields)
        case Union(records):
            return max(map(most_objects, records))
    return 0


def most_keys(kind: Kind, key: str) -> int:
    """The most objects with a key of that name that a value of a kind can hold."""
    match kind:
        case str():
            return most_keys(CONTRACTS[kind], key)
        case Items(of, most):
            return most * most_keys(of, key)
        case Row(places):
            return sum(most_keys(k, key) for k in places)
        case Optional(of):
            return most_keys(of, key)
        case Record(fields):
            return (key in kind.names) + sum(most_keys(k, key) for _, k in fields)
        case Union(records):
            return max(most_keys(r, key) for r in records)
    return 0


def _lists(kind: Kind) -> set[Kind]:
    """What the lists in a value of a kind are of."""
    match kind:
        case str():
            return _lists(CONTRACTS[kind])
        case Items(of):
            return {of} | _lists(of)
        case Row(places):
            return set().union(*map(_lists, places))
        case Optional(of):
            return _lists(of)
        case Record(fields):
            return set().union(*(_lists(k) for _, k in fields))
        case Union(records):
            return set().union(*map(_lists, records))
    return set()


def _needed(kind: Kind) -> set[str]:
    """Keys that every value of a kind has."""
    match kind:
        case str():
            return _needed(CONTRACTS[kind])
        case Record():
            return set(kind.required)
        case Union(records):
            return set.intersection(*map(_needed, records))
    return set()


#: A body is first looked at without a parser, so many characters of it.
HEAD = 131_072
#: A JSON string, or the start of one that the end of the text cuts.
_STRING = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)'


def _uses(text: Column, part: str) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def _too_many(name: str, body: Column) -> Column:
    """Whether a body starts with more objects than a valid message can hold. No JSON that goes on from there keeps the contract.

    A list's objects are counted by a key that each of them has: ``"key":`` in JSON is that key, or the end of one with
    a quote in it, which no contract names. In a long body objects of any kind are counted as well.
    """
    head = F.substring(body, 1, HEAD)
    counted = {min((most_keys(name, k), k) for k in keys) for keys in map(_needed, _lists(name)) if keys}
    lists = [(F.octet_length(body) > most * len(f'"{k}":')) & (_uses(head, f'"{k}":') > most) for most, k in sorted(counted, reverse=True)]
    outside = F.regexp_replace(head, _STRING, "")
    return reduce(lambda a, b: a | b, [*lists, (F.octet_length(body) > HEAD) & (_uses(outside, "{") > most_objects(name))])


def is_message(name: str, body: Column) -> Column:
    """Whether a body (JSON text) is a valid message of that name. No JSON, repeated keys and null are not; never null."""
    if name not in MESSAGES:
        return F.lit(False)
    return F.when(_too_many(name, body), False).otherwise(F.coalesce(accepts(name, F.try_parse_json(body)), F.lit(False)))


def is_any(name: Column, body: Column) -> Column:
    """Whether each row's body is a valid message of the row's name; an unknown name has no valid message."""
    out = F.lit(False)
    for message in MESSAGES:
        out = F.when(name == message, is_message(message, body)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def reject_code(name: Column, body: Column) -> Column:
    """Null for a valid message, else a code that tells nothing of its content: another protocol version, or the rest."""
    # a body that starts with the right version, or with one that is no text, has no other: a parser refuses the key's second use
    starts_right = F.substring(body, 1, 200).rlike(rf'^\s*\{{\s*"protocol"\s*:\s*(?:"{re.escape(PROTOCOL)}"\s*[,}}]|[^"\s])')
    # nor has one without escapes in which the key has that version wherever it stands
    known = F.contains(body, F.lit("\\u")) | (_uses(body, '"protocol"') > _uses(body, f'"protocol":"{PROTOCOL}"'))
    version = lambda v: (F.schema_of_variant(v) == "STRING") & (F.try_variant_get(v, "$", "string") != PROTOCOL)
    other = ~starts_right & known & _with(F.try_variant_get(F.try_parse_json(body), "$.protocol", "variant"), version)
    return F.when(~is_any(name, body), F.when(other, "unsupported_version").otherwise("invalid_request"))


def valid_messages(rows: DataFrame, name_col: str = "message", body_col: str = "body") -> DataFrame:
    """The rows whose body is a valid message of the row's name."""
    return rows.where(is_any(F.col(name_col), F.col(body_col)))


def refused_messages(rows: DataFrame, name_col: str = "message", body_col: str = "body") -> DataFrame:
    """The quarantine: the other rows' other columns and ``reject_code``; a body never gets there."""
    # a generator's output: a filter on it is not pushed below, where it would judge, and make, each body again
    code = F.explode_outer(F.array(reject_code(F.col(name_col), F.col(body_col)))).alias("reject_code")
    told = rows.select(*(F.col(f"`{c}`") for c in rows.columns if c.lower() not in (body_col.lower(), "reject_code")), code)
    return told.where("reject_code is not null")


def struct_type(kind: Kind) -> T.DataType:
    """The type that a valid value is read into. A union's has the fields of all its records; where two of them differ, a variant."""
    if isinstance(kind, str):
        return struct_type(CONTRACTS[kind])
    match kind:
        case Text() | Word():
            return T.StringType()
        case Flag():
            return T.BooleanType()
        case Whole():
            return T.LongType()
        case Number():
            return T.DoubleType()
        case Items(of):
            return T.ArrayType(struct_type(of))
        case Row(places):
            kinds = {struct_type(p) for p in places}
            return T.ArrayType(kinds.pop() if len(kinds) == 1 else T.VariantType())
        case Optional(of):
            return struct_type(of)
        case Record(fields):
            return T.StructType([T.StructField(n, struct_type(k)) for n, k in fields])
        case Union(records):
            found: dict[str, T.DataType] = {}
            for field in (f for r in records for f in struct_type(r).fields):
                found[field.name] = field.dataType if found.get(field.name, field.dataType) == field.dataType else T.VariantType()
            return T.StructType([T.StructField(n, k) for n, k in found.items()])
    raise TypeError(kind)


def read_message(name: str, body: Column) -> Column:
    """A message that ``is_message`` accepts as a struct."""
    return F.from_json(body, struct_type(name))


def json_schema(name: str) -> dict:
    """A self-contained JSON Schema (draft 7) of a message; its own copy each time."""
    if name not in MESSAGES:
        raise KeyError(name)

    def of(kind: Kind) -> dict:
        match kind:
            case str():
                return {"$ref": f"#/definitions/{kind}"}
            case Text(most, least, like):
                return {"type": "string", "minLength": least, "maxLength": most} | ({"pattern": like.replace(r"\z", "$")} if like else {})
            case Word(values):
                return {"type": "string", "enum": list(values)}
            case Flag():
                return {"type": "boolean"}
            case Whole(least, most):
                return {"type": "integer", "minimum": least, "maximum": most}
            case Number(least, most):
                return {"type": "number"} | {k: v for k, v in (("minimum", least), ("maximum", most)) if v is not None}
            case Items(item, most, least):
                return {"type": "array", "items": of(item), "minItems": least, "maxItems": most}
            case Row(places):
                return {"type": "array", "items": [of(p) for p in places], "minItems": len(places), "maxItems": len(places)}
            case Optional(inner):
                return of(inner)
            case Record(fields):
                return {"type": "object", "properties": {n: of(k) for n, k in fields}, "required": kind.required, "additionalProperties": False}
            case Union(records):
                return {"oneOf": [of(r) for r in records]}
        raise TypeError(kind)

    return {"$schema": "http://json-schema.org/draft-07/schema#", "$ref": f"#/definitions/{name}", "definitions": {n: of(k) for n, k in CONTRACTS.items()}}
