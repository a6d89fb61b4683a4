"""Small relations given in code: the same rows as a DataFrame and as a SQL common table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def frame(spark: SparkSession, ddl: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def _literal(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_literal, value)) + "]"
    if isinstance(value, float) and (value != value or abs(value) == float("inf")):
        return f"cast('{value}' as double)"
    return repr(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def common_table(name: str, ddl: str, rows: list[tuple]) -> str:
    """``name as (...)`` for a WITH clause, each column cast to its type."""
    columns = [c.strip().split(" ", 1) for c in ddl.split(",")]
    kinds = {"string": "varchar", "array<string>": "varchar[]", "array<bigint>": "bigint[]"}
    cast = ", ".join(f"cast({c} as {kinds.get(k, k)}) as {c}" for c, k in columns)
    listed = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"{name} as (select {cast} from (values {listed}) t({', '.join(c for c, _ in columns)}))"


#: What a listed case may take from the event that it is dealt to.
_EVENT = {"e_id": "event_id", "e_user": "user_id", "e_type": "event_type", "e_value": "value"}


def _dealt(ddl: str, rows: list[tuple], columns: dict[str, str]) -> tuple[list[tuple[str, str]], list[tuple], dict[str, str]]:
    """The cases' columns and rows, numbered from 1 (by their own number, where they have one), and each column's expression."""
    kinds = [tuple(c.strip().split(" ", 1)) for c in ddl.split(",")]
    numbered = kinds[0] == ("id", "bigint")
    cases = [((r[0] if numbered else i), *r) for i, r in enumerate(rows, 1)]
    marked = lambda c: f"replace(replace({c}, '{{u}}', cast(e_user as varchar(20))), '{{t}}', e_type)"
    return kinds, cases, {c: columns.get(c, "e_id" if c == "id" and k == "bigint" else marked(c) if k == "string" else c) for c, k in kinds}


def dealt(events: DataFrame, ddl: str, rows: list[tuple], **columns: str) -> DataFrame:
    """Every event with one of the listed cases, in turn: its columns, and ``case_no``.

    ``columns`` are expressions, of both engines, for columns that take something from the event (``e_id``, ``e_user``,
    ``e_type``, ``e_value``); a column ``id`` is the event's, and in text ``{u}`` and ``{t}`` are its user and its type.
    The cases are few and fixed, and broadcast.
    """
    kinds, cases, of = _dealt(ddl, rows, columns)
    listed = events.sparkSession.createDataFrame(cases, "case_no bigint, " + ddl.replace("id bigint", "own_id bigint", 1) if kinds[0] == ("id", "bigint") else "case_no bigint, " + ddl)
    told = events.select(*(F.col(c).alias(a) for a, c in _EVENT.items()))
    both = told.join(F.broadcast(listed), F.col("e_id") % max(c[0] for c in cases) + 1 == F.col("case_no"))
    return both.select("case_no", *(F.expr(of[c]).cast(k).alias(c) for c, k in kinds))


def dealt_table(name: str, ddl: str, rows: list[tuple], **columns: str) -> str:
    """``dealt`` as common tables for a WITH clause, over the view ``events``."""
    kinds, cases, of = _dealt(ddl, rows, columns)
    own = "case_no bigint, " + (ddl.replace("id bigint", "own_id bigint", 1) if kinds[0] == ("id", "bigint") else ddl)
    told = ", ".join(f"{c} as {a}" for a, c in _EVENT.items())
    types = {"string": "varchar", "array<string>": "varchar[]", "array<bigint>": "bigint[]"}
    picked = ", ".join(f"cast({of[c]} as {types.get(k, k)}) as {c}" for c, k in kinds)
    return f"{common_table(f'{name}_cases', own, cases)}, {name} as (select case_no, {picked} from (select {told} from events) e join {name}_cases on e_id % {max(c[0] for c in cases)} + 1 = case_no)"
