"""Filters as Columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspan.functions.values import Value, canonical, number_of
from docspan.plans.syntax import All, Any_, Compare, Exists, Filter, In, Regex, StartsWith
from docspan.relation import Relation

#: A pattern that only asks for a beginning.
_BEGINNING = re.compile(r"\^([A-Za-z0-9 _@#%&=:;,<>/~\"'!-]+)")


def condition(rel: Relation, f: Filter) -> Column:
    """The rows that f matches. A missing value matches nothing but $ne, $nin and $exists: false."""
    if isinstance(f, All):
        return reduce(lambda a, b: a & b, (condition(rel, p) for p in f.parts), F.lit(True)) if f.parts else F.lit(True)
    if isinstance(f, Any_):
        return reduce(lambda a, b: a | b, (condition(rel, p) for p in f.parts)) if f.parts else F.lit(False)
    v = rel.resolve(f.path)
    if isinstance(f, Exists):
        return v.present() if f.wanted else ~v.present()
    if isinstance(f, Regex):
        if m := _BEGINNING.fullmatch(f.pattern):
            return _text(v).startswith(m[1])
        return _text(v).rlike(f.pattern)
    if isinstance(f, StartsWith):
        return _text(v).startswith(f.prefix)
    if isinstance(f, In):
        hit = _in(rel, v, f)
        return ~F.coalesce(hit, F.lit(False)) if f.negated else hit
    return _compare(rel, v, f)


def _text(v: Value) -> Column:
    return v.column if v.is_text else v.text()


def _null(rel: Relation, v: Value, op: str) -> Column:
    """A comparison of a typed column with null: a NULL is missing, unless the relation says that it is a value."""
    if rel.null_is_value and op in ("$eq", "$ne", "$gte", "$lte"):
        same = ~v.present()
        return same if op == "$eq" else v.present() if op == "$ne" else same | v.compare(op, None)
    return v.compare(op, None)


def _compare(rel: Relation, v: Value, f: Compare) -> Column:
    if v.missing:
        return F.lit(f.op == "$ne")
    if f.value is None and not v.is_variant:
        hit = _null(rel, v, f.op)
        return hit | ~v.present() if f.op == "$ne" and not rel.null_is_value else hit
    if f.path == "_id" and v.is_number and isinstance(f.value, str) and number_of(f.value) is None:
        return F.lit(f.op == "$ne")
    if (exact := _identity(rel, f.path, f.value)) is not None and f.op in ("$eq", "$ne"):
        return exact if f.op == "$eq" else ~F.coalesce(exact, F.lit(False))
    hit = v.compare(f.op, f.value)
    return hit | ~v.present() if f.op == "$ne" else hit


def _identity(rel: Relation, path: str, x) -> Column | None:
    """The _id of a document is a text, and equal to the same text only; a reader can look it up."""
    if not rel.document or path != "_id" or rel.id is None:
        return None
    return rel.id == F.lit(x if isinstance(x, str) else canonical(x))


def _in(rel: Relation, v: Value, f: In) -> Column:
    if v.missing or not f.values:
        return F.lit(False)
    if _identity(rel, f.path, "") is not None:
        return rel.id.isin([x if isinstance(x, str) else canonical(x) for x in f.values])
    plain = [x for x in f.values if not isinstance(x, bool)]
    if v.is_number and len(plain) == len(f.values) and all(isinstance(number_of(x), int) and abs(number_of(x)) < 2**31 for x in f.values):
        return v.column.isin([number_of(x) for x in f.values])
    if v.is_text and all(isinstance(x, str) and number_of(x) is None for x in f.values):
        return v.column.isin(list(f.values))
    return v.once(lambda v: reduce(lambda a, b: a | b, (_null(rel, v, "$eq") if x is None and not v.is_variant else v.compare("$eq", x) for x in f.values)))


def where(rel: Relation, f: Filter) -> Relation:
    return rel if isinstance(f, All) and not f.parts else rel.with_df(rel.df.where(condition(rel, f)))
