"""Browsing: shorthand filters, filter builders, pages with a status line."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import functions as F

from docspan.errors import QueryError
from docspan.operators.filters import where
from docspan.operators.stages import limit, naturally, skip
from docspan.plans.syntax import DEFAULT_PAGE, filter_of, read
from docspan.relation import Relation

FIELD = re.compile(r"[\w.]+")
OPERATORS = ("equals", "not equals", ">", ">=", "<", "<=", "contains", "exists")
_COMPARE = {"equals": "$eq", "=": "$eq", "==": "$eq", "not equals": "$ne", "!=": "$ne", "<>": "$ne", ">": "$gt", ">=": "$gte", "<": "$lt", "<=": "$lte"}


def _is_number(text: str) -> bool:
    return bool(re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text))


def _token(text: str) -> str:
    """A cell's text as JSON: numbers and the three words stay, other texts are quoted."""
    t = text.strip()
    return t if t in ("true", "false", "null") or _is_number(t) else json.dumps(text, ensure_ascii=False)


def normalise(text: str | None) -> str:
    """A filter's JSON from JSON, from "field: value" or from "field = value"."""
    t = (text or "").strip()
    if not t:
        return "{}"
    if not t.startswith("{"):
        m = re.match(r"([^:=]*)[:=](.*)", t, re.S)
        name = m[1].strip() if m else ""
        if not m or not FIELD.fullmatch(name):
            raise QueryError('a filter is JSON, like { status: "paid" }, or field: value')
        value = m[2].strip()
        if not value:
            value = '""'
        elif value[0] not in '{["':
            value = _token(value)
        t = f"{{ {name}: {value} }}"
    filter_of(t)
    return t


def build(field: str, op: str = "equals", value: str = "") -> str:
    """The filter text of a field, an operator's name and a value as typed."""
    field, op, value = (field or "").strip(), (op or "").strip() or "equals", value or ""
    if not FIELD.fullmatch(field):
        raise QueryError("a field's name has letters, digits, underscores and dots")
    if op == "exists":
        return f"{{ {field}: {{ $exists: true }} }}"
    if op == "contains":
        if not value.strip():
            raise QueryError("contains needs a text")
        return f"{{ {field}: {{ $regex: {json.dumps(value.strip(), ensure_ascii=False)} }} }}"
    if op not in _COMPARE:
        raise QueryError(f"unknown filter operator {op!r}")
    if _COMPARE[op] == "$eq":
        return normalise(f"{field}: {value.strip()}")
    return f"{{ {field}: {{ {_COMPARE[op]}: {_token(value)} }} }}"


@dataclass(frozen=True)
class Page:
    relation: Relation
    page: int
    size: int
    total: int
    filtered: bool
    shown: int
    has_previous: bool
    has_next: bool
    filter: str
    status: str
    page_text: str


def page_rows(rel: Relation, filter_text: str | None, page: int, size: int) -> Relation:
    """A page, counted from 0, and one row more that tells whether there is a next one."""
    rel = where(rel, filter_of(read(normalise(filter_text))))
    rel = naturally(rel) if rel.order else rel.with_df(rel.df.orderBy(rel.id)) if rel.id is not None else rel
    return limit(skip(rel, page * size), size + 1)


def browse(rel: Relation, filter_text: str | None = None, page: int = 0, size: int = DEFAULT_PAGE) -> Page:
    """A page with its status. Without a filter a page beyond the end is the last one."""
    if size < 1:
        raise QueryError("a page has at least one row")
    text = normalise(filter_text)
    filtered = bool((filter_text or "").strip())
    total = rel.df.count()
    if not filtered and total:
        page = min(page, (total - 1) // size)
    page = max(0, page)
    rows = page_rows(rel, text, page, size)
    found = rows.df.count()
    shown, more = min(found, size), found > size
    first, last, paged = page * size + 1, page * size + shown, more or page > 0
    if filtered:
        rows_text = f"Showing {first}–{last} matching row(s)." if paged else f"{shown} matching row(s)."
        status = f"{rows_text} Collection has {total}." if shown else f"No matching rows. Collection has {total}."
        page_text = f"Page {page + 1}" if paged else ""
    elif paged and shown:
        status, page_text = f"Showing {first}–{last} of {total}.", f"Page {page + 1} of {math.ceil(total / size)}"
    else:
        status, page_text = f"{shown} record(s).", ""
    return Page(limit(rows, size), page, size, total, filtered, shown, page > 0, more, text, status, page_text)


def sort_page(rel: Relation, path: str, ascending: bool = True) -> Relation:
    """A page's rows by the text that they show."""
    text = F.coalesce(rel.resolve(path).plain() if not rel.resolve(path).missing else F.lit(""), F.lit(""))
    return rel.with_df(rel.df.orderBy(text.asc() if ascending else text.desc()))
