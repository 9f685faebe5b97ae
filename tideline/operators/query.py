"""The structured run query: a closed set of conditions, stable order, keyset pages and a public projection."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.jsonx import json_contains, json_merge, json_present
from tideline.functions.scalars import capped

FIELDS = {"id": "id", "run_id": "id", "state": "state", "workflow": "workflow", "started_at": "started_at", "completed_at": "completed_at"}
ORDER_FIELDS = ("started_at", "completed_at", "id", "state", "workflow")
COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda a, b: a == b,
    "neq": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
}
PAYLOADS = ("input", "result", "error")
DEFAULT_PAGE, LARGEST_PAGE, LONGEST_CURSOR = 25, 100, 1024
ALL_NAMESPACES = None


class QueryError(ValueError):
    """A condition, field or cursor that the query does not know."""


@dataclass
class Page:
    entries: DataFrame
    per_page: int
    next_cursor: str | None


@dataclass
class RunQuery:
    """Conditions are (operator, field, value); a field ("attributes", key, ...) is a path into the attributes.
    Without a namespace only "default" is seen; ALL_NAMESPACES sees all."""

    where: list[tuple] = field(default_factory=list)
    namespace: str | None = "default"
    state: str | None = None
    workflow: str | None = None
    search: str | None = None
    order_by: tuple[str, str] = ("desc", "started_at")
    per_page: int = DEFAULT_PAGE
    cursor: str | None = None
    include_payloads: bool = True
    payload_cap: int | None = None
    redact: Callable[[Column], Column] | None = None

    def __post_init__(self) -> None:
        ok = isinstance(self.order_by, tuple) and len(self.order_by) == 2 and self.order_by[0] in ("asc", "desc") and self.order_by[1] in ORDER_FIELDS
        if not ok:
            self.order_by = ("desc", "started_at")
        if not isinstance(self.per_page, int) or isinstance(self.per_page, bool) or self.per_page < 1:
            self.per_page = DEFAULT_PAGE
        self.per_page = min(self.per_page, LARGEST_PAGE)

    def conditions(self) -> list[Column]:
        """All predicates; a wrong one raises before anything runs."""
        out = [_condition(c) for c in self.where]
        if self.namespace is not ALL_NAMESPACES:
            out.append(F.col("namespace") == self.namespace)
        if self.state:
            out.append(F.col("state") == str(self.state).lower())
        if self.workflow:
            out.append(F.col("workflow").ilike(f"%{self.workflow}%"))
        if self.search:
            out.append(F.col("id").ilike(f"%{self.search}%") | F.col("workflow").ilike(f"%{self.search}%"))
        return [c for c in out if c is not None]

    def filtered(self, runs: DataFrame) -> DataFrame:
        for c in self.conditions():
            runs = runs.where(c)
        return runs

    def page_frame(self, runs: DataFrame) -> DataFrame:
        """The rows of the page and one more, which tells whether another page follows. Sort and limit are one
        top-k operator, so that no more than a page of each partition is moved."""
        direction, name = self.order_by
        out = self.filtered(runs)
        if self.cursor is not None:
            out = out.where(_beyond(direction, name, *decode_cursor(self.cursor, direction, name)))
        return out.orderBy(*_order(direction, name)).limit(self.per_page + 1)

    def page(self, runs: DataFrame) -> Page:
        rows = self.page_frame(runs).select("id", self.order_by[1]).collect()  # a page of keys at most
        cursor = None
        if len(rows) > self.per_page:
            last = rows[self.per_page - 1]
            cursor = encode_cursor(*self.order_by, last[self.order_by[1]], last["id"])
        ids = [r["id"] for r in rows[: self.per_page]]
        entries = self.project(runs.where(F.col("id").isin(ids))).orderBy(*_order(*self.order_by))
        return Page(entries, self.per_page, cursor)

    def project(self, runs: DataFrame) -> DataFrame:
        """The public columns: no attributes become {}, no namespace default; a run that failed by cancellation
        in the old way is shown as cancelled. Payloads are left out before the scan, capped, or redacted."""
        state = F.col("state")
        if "error" in runs.columns:
            state = F.when((state == "failed") & (F.col("error") == '"cancelled"'), "cancelled").otherwise(state)
        changed = {"state": state, "attributes": F.coalesce("attributes", F.lit("{}")), "namespace": F.coalesce("namespace", F.lit("default"))}
        for name in PAYLOADS:
            if name not in runs.columns:
                continue
            if not self.include_payloads:
                changed[name] = F.lit(None).cast("string")
                continue
            value = capped(name, self.payload_cap) if self.payload_cap is not None else F.col(name)
            changed[name] = self.redact(value) if self.redact else value
        return runs.withColumns({k: v for k, v in changed.items() if k in runs.columns})


def _condition(condition: tuple) -> Column | None:
    if len(condition) != 3 or condition[0] not in (*COMPARE, "in"):
        raise QueryError(f"invalid condition {condition!r}")
    op, name, value = condition
    if isinstance(name, (tuple, list)):
        if not name or name[0] != "attributes" or len(name) < 2 or op not in ("eq", "neq"):
            raise QueryError(f"invalid condition {condition!r}")
        held = json_contains("attributes", name[1:], value)
        return held if op == "eq" else json_present("attributes", name[1:]) & ~held
    if name not in FIELDS:
        raise QueryError(f"invalid field {name!r}")
    column = F.col(FIELDS[name])
    if op == "in":
        return column.isin(list(value))
    if name == "state" and op == "eq":
        return None if value in (None, "") else column == str(value).lower()
    literal = F.lit(value).cast("timestamp_ntz") if name.endswith("_at") else F.lit(value)
    return COMPARE[op](column, literal)


def _order(direction: str, name: str) -> list[Column]:
    c, i = F.col(name), F.col("id")
    return [c.asc_nulls_last(), i.asc()] if direction == "asc" else [c.desc_nulls_last(), i.desc()]


def _beyond(direction: str, name: str, value: object, last: str) -> Column:
    c, i = F.col(name), F.col("id")
    further = (lambda a, b: a > b) if direction == "asc" else (lambda a, b: a < b)
    if name == "id":
        return further(i, F.lit(last))
    if value is None:
        return c.isNull() & further(i, F.lit(last))
    v = F.lit(value).cast("timestamp_ntz") if name.endswith("_at") else F.lit(value)
    return further(c, v) | c.isNull() | ((c == v) & further(i, F.lit(last)))


def encode_cursor(direction: str, name: str, value: object, last: str) -> str:
    value = value.isoformat(sep=" ") if isinstance(value, datetime) else value
    return base64.urlsafe_b64encode(json.dumps([direction, name, value, last]).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, direction: str, name: str) -> tuple[object, str]:
    """(value, id) of a cursor that was made for the same order."""
    try:
        if len(cursor) > LONGEST_CURSOR:
            raise ValueError
        made, made_for, value, last = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except (ValueError, TypeError):
        raise QueryError("invalid cursor") from None
    if (made, made_for) != (direction, name) or not isinstance(last, str):
        raise QueryError("invalid cursor")
    return value, last


def get_run(runs: DataFrame, run_id: str, namespace: str | None = ALL_NAMESPACES) -> DataFrame:
    """The run, or no row; with a namespace, a run of another one is as good as missing."""
    out = runs.where(F.col("id") == run_id)
    return out if namespace is ALL_NAMESPACES else out.where(F.coalesce("namespace", F.lit("default")) == namespace)


def set_attributes(runs: DataFrame, run_id: str, attributes: dict, namespace: str | None = ALL_NAMESPACES) -> DataFrame:
    """All runs, one with its attributes merged at the top level."""
    mine = F.col("id") == run_id
    if namespace is not ALL_NAMESPACES:
        mine &= F.coalesce("namespace", F.lit("default")) == namespace
    return runs.withColumn("attributes", F.when(mine, json_merge("attributes", F.lit(json.dumps(attributes)))).otherwise(F.col("attributes")))


def successor(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.where(F.col("continued_from_run_id") == run_id).select("id")
