"""Document values as Columns: kind, number, raw JSON text, and the coercing comparison over them.

Two values compare as numbers if both are numbers or numeric texts, else as texts or booleans if both are, else by their
JSON text. For typed columns nearly all of that is settled when the query is compiled, so that plain comparisons in the
column's own type remain, which Parquet readers can evaluate. A missing value is NULL; a JSON null is a VARIANT null.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that count as numbers.
NUMERIC_TEXT = r"^\s*[+-]?(\d{1,3}(,\d{3})+|\d+)?(\.\d*)?([eE][+-]?\d+)?\s*$"
_NUMERIC = re.compile(NUMERIC_TEXT)
#: The order of kinds by the first character of their JSON text.
RANK = {"string": 0, "number": 1, "array": 2, "false": 3, "null": 4, "true": 5, "object": 6}
_INT = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
NULL = object()


def number_of(value: Any) -> float | int | None:
    """A literal's number: of numbers and numeric texts."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return value
    if isinstance(value, str) and _NUMERIC.match(value) and re.search(r"\d", value) and not re.match(r"\s*[+-]?\.?[eE]", value):
        text = value.strip().replace(",", "")
        try:
            return int(text) if re.fullmatch(r"[+-]?\d+", text) else float(text)
        except ValueError:
            return None
    return None


def canonical(value: Any) -> str:
    """Compact JSON text with sorted keys; whole doubles as integers."""

    def tidy(v: Any) -> Any:
        if isinstance(v, dict):
            return {k: tidy(x) for k, x in sorted(v.items())}
        if isinstance(v, list):
            return [tidy(x) for x in v]
        return int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 2**63 else v

    return json.dumps(tidy(value), separators=(",", ":"), ensure_ascii=False)


def kind_of(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"


def let(column: Column, use: Callable[[Column], Column]) -> Column:
    """use(column), with column evaluated once a row, however often use mentions it (predicate pushdown copies projections)."""
    return F.get(F.transform(F.array(column), use), F.lit(0))


#: Texts that are read as points in time.
_TIME = re.compile(r"\s*(\d{4})(?:-(\d{1,2})(?:-(\d{1,2})(?:[T ](\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.\d+)?)?\s*(?:Z|UTC|[+-]\d{1,2}(?::?\d{2})?)?)?)?)?\s*")


def is_time_text(text: str) -> bool:
    m = _TIME.fullmatch(text)
    try:
        return m is not None and datetime(*(int(x or d) for x, d in zip(m.groups(), (1, 1, 1, 0, 0, 0), strict=True))) is not None
    except ValueError:
        return False


def by_parts(op: str, literal: Any, kind: Column, number: Column, text: Column) -> Column | None:
    """A value op a scalar literal, by the value's kind, number and text; None for other literals.

    Comparisons of number and text stand by themselves, so that Parquet readers can evaluate them if they are columns. Values
    of kinds that don't compare otherwise are in the order of their kinds.
    """
    if isinstance(literal, (list, dict)):
        return None
    own, x = kind_of(literal), number_of(literal)
    hits = [k for k, r in RANK.items() if k != own and holds(op, (r > RANK[own]) - (r < RANK[own]))]
    if own not in ("string", "number") and holds(op, 0):
        hits.append(own)
    rest = kind.isin(hits) if hits else F.lit(False)
    if isinstance(literal, str):
        rest = apply(op, text, F.lit(literal)) | (text.isNull() & rest)
    return apply(op, number, F.lit(float(x))) | (number.isNull() & rest) if x is not None else rest


def text_number(text: Column) -> Column:
    """The number of a numeric text, or NULL."""
    ok = text.rlike(NUMERIC_TEXT) & text.rlike(r"^\s*[+-]?\.?\d")
    return F.when(ok, F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double"))


def json_text(column: Column) -> Column:
    """JSON text of one value, NULL for NULL."""
    wrapped = F.to_json(F.struct(column.alias("v")))
    return F.when(column.isNotNull(), F.substring(wrapped, F.lit(6), F.length(wrapped) - 6))


def whole_as_long(number: Column) -> Column:
    """JSON text of a double, without a fraction if it has none."""
    return F.when((F.floor(number) == number) & (F.abs(number) < 2**53), number.cast("long").cast("string")).otherwise(number.cast("string"))


def apply(op: str, left: Column, right: Column) -> Column:
    return {"$eq": lambda: left == right, "$ne": lambda: left != right, "$gt": lambda: left > right, "$gte": lambda: left >= right, "$lt": lambda: left < right, "$lte": lambda: left <= right}[op]()


def holds(op: str, sign: int) -> bool:
    """Whether op holds for operands whose comparison gives sign."""
    return {"$eq": sign == 0, "$ne": sign != 0, "$gt": sign > 0, "$gte": sign >= 0, "$lt": sign < 0, "$lte": sign <= 0}[op]


@dataclass(frozen=True)
class Value:
    column: Column | None
    type: T.DataType | None
    #: Of a VARIANT: its schema_of_variant, if that has been evaluated.
    schema: Column | None = None
    #: Of a VARIANT: stored columns with its kind, number and text, if there are any.
    parts: tuple[Column, Column, Column] | None = None

    # what it is

    @property
    def missing(self) -> bool:
        return self.column is None

    @property
    def is_variant(self) -> bool:
        return isinstance(self.type, T.VariantType)

    @property
    def is_number(self) -> bool:
        return isinstance(self.type, T.NumericType)

    @property
    def is_text(self) -> bool:
        return isinstance(self.type, (T.StringType, T.CharType, T.VarcharType))

    @property
    def is_time(self) -> bool:
        return isinstance(self.type, (T.TimestampType, T.TimestampNTZType, T.DateType))

    @property
    def is_nested(self) -> bool:
        return isinstance(self.type, (T.StructType, T.ArrayType, T.MapType))

    def child(self, parts: list[str]) -> Value:
        """The value at a path below; objects only, never array indexes."""
        v = self
        for i, p in enumerate(parts):
            if v.missing:
                return MISSING
            if v.is_variant:
                path = "$" + "".join("['" + x.replace("\\", "\\\\").replace("'", "\\'") + "']" for x in parts[i:])
                return Value(F.try_variant_get(v.column, path, "variant"), T.VariantType())
            if isinstance(v.type, T.StructType) and p in v.type.names:
                v = Value(v.column.getField(p), v.type[p].dataType)
            elif isinstance(v.type, T.MapType) and isinstance(v.type.keyType, T.StringType):
                v = Value(F.try_element_at(v.column, F.lit(p)), v.type.valueType)
            else:
                return MISSING
        return v

    # its parts

    def once(self, use: Callable[[Value], Column]) -> Column:
        """use(value), with a VARIANT's path and schema evaluated once a row: for filters, where Spark doesn't share subexpressions."""
        if not self.is_variant or self.schema is not None or self.parts is not None:
            return use(self)
        return let(self.column, lambda v: let(F.schema_of_variant(v), lambda s: use(Value(v, self.type, s))))

    def _schema(self) -> Column:
        return F.schema_of_variant(self.column) if self.schema is None else self.schema

    def kind(self) -> Column:
        """string, number, array, object, true, false or null; NULL if missing."""
        if self.missing:
            return F.lit(None).cast("string")
        if self.parts is not None:
            return self.parts[0]
        c = self.column
        if self.is_variant:
            s = self._schema()
            yes = F.try_variant_get(c, "$", "boolean")
            return (
                F.when(c.isNull(), F.lit(None))
                .when(s == "STRING", "string")
                .when(s == "BOOLEAN", F.when(yes, "true").otherwise("false"))
                .when(s == "VOID", "null")
                .when(s.startswith("ARRAY"), "array")
                .when(s.startswith("OBJECT"), "object")
                .when(s.startswith("TIMESTAMP") | s.startswith("DATE") | (s == "BINARY"), "string")
                .otherwise("number")
            )
        if isinstance(self.type, T.BooleanType):
            return F.when(c, "true").when(~c, "false")
        name = "number" if self.is_number else "array" if isinstance(self.type, T.ArrayType) else "object" if self.is_nested else "string"
        return F.when(c.isNotNull(), name)

    def text(self) -> Column:
        """The text of a string, NULL for other kinds."""
        if self.missing:
            return F.lit(None).cast("string")
        if self.parts is not None:
            return self.parts[2]
        if self.is_variant:
            return F.when(self._schema() == "STRING", F.try_variant_get(self.column, "$", "string"))
        if self.is_time:
            return F.date_format(self.column, "yyyy-MM-dd'T'HH:mm:ss")
        return self.column.cast("string") if not self.is_number and not self.is_nested and not isinstance(self.type, T.BooleanType) else F.lit(None).cast("string")

    def number(self) -> Column:
        """The number of a number or a numeric text as double, else NULL."""
        if self.missing:
            return F.lit(None).cast("double")
        if self.is_number:
            return self.column.cast("double")
        if self.is_text:
            return text_number(self.column)
        if self.parts is not None:
            return self.parts[1]
        if self.is_variant:
            s = self._schema()
            own = s.isin("BIGINT", "DOUBLE", "FLOAT") | s.startswith("DECIMAL")
            return F.when(own, F.try_variant_get(self.column, "$", "double")).when(s == "STRING", text_number(F.try_variant_get(self.column, "$", "string")))
        return F.lit(None).cast("double")

    def raw(self) -> Column:
        """Compact JSON text."""
        if self.missing:
            return F.lit(None).cast("string")
        if self.is_variant:
            return F.when(self._schema() == "DOUBLE", whole_as_long(F.try_variant_get(self.column, "$", "double"))).otherwise(F.to_json(self.column))
        if isinstance(self.type, (T.DoubleType, T.FloatType)):
            return whole_as_long(self.column.cast("double"))
        if self.is_number or isinstance(self.type, T.BooleanType):
            return self.column.cast("string")
        if self.is_nested:
            return F.to_json(self.column)
        return json_text(self.text())

    def plain(self) -> Column:
        """The text to show: strings without quotes, other kinds as JSON."""
        if self.missing:
            return F.lit(None).cast("string")
        if self.is_variant:
            return F.coalesce(self.text(), self.raw())
        return self.raw() if self.is_nested else self.text() if self.is_time else self.column.cast("string")

    def variant(self) -> Column:
        """As a VARIANT; NULL if missing."""
        if self.missing:
            return F.lit(None).cast("variant")
        return self.column if self.is_variant else F.parse_json(self.raw())

    def present(self) -> Column:
        return F.lit(False) if self.missing else (self.column if self.parts is None else self.parts[0]).isNotNull()

    def equality_key(self) -> Column:
        """A text that is the same for exactly the values that are equal; NULL if missing."""
        if self.missing:
            return F.lit(None).cast("string")
        n = lambda x: F.concat(F.lit("n:"), (x + F.lit(0.0)).cast("string"))  # noqa: E731  (adding 0.0 folds -0.0)
        if self.is_number:
            return n(self.column.cast("double"))
        if self.is_text or self.is_variant:
            number = self.number()
            return F.when(number.isNotNull(), n(number)).otherwise(self.raw())
        return self.raw()

    def sort_keys(self, ascending: bool = True, strict: bool = False) -> list[Column]:
        """Ordering expressions; what is missing comes first when ascending, last when descending."""
        way = (lambda c: c.asc_nulls_first()) if ascending else (lambda c: c.desc_nulls_last())
        if self.missing:
            return []
        return [way(c) for c in self.order_columns(strict)]

    def order_columns(self, strict: bool = False) -> list[Column]:
        if self.missing:
            return []
        if strict:
            return [self.raw()]
        if self.is_variant:
            rank = F.when(self.number().isNotNull(), 1)
            for name, r in RANK.items():
                rank = rank.when(self.kind() == name, r)
            return [rank, self.number(), self.plain()]
        return [self.raw()] if isinstance(self.type, (T.MapType, T.StructType)) else [self.column]

    # comparison

    def compare(self, op: str, literal: Any) -> Column:
        """value op literal; NULL or false where the value is missing. op is one of $eq $ne $gt $gte $lt $lte."""
        if self.missing:
            return F.lit(False)
        if self.is_variant:
            return self.once(lambda v: v._compare_variant(op, literal))
        number = number_of(literal)
        if self.is_number and number is not None:
            return self._compare_number(op, number)
        if self.is_text and isinstance(literal, (str, int, float)) and not isinstance(literal, bool):
            if number is None:
                return apply(op, self.column, F.lit(literal))
            other = apply(op, self.column, F.lit(literal)) if isinstance(literal, str) else F.lit(holds(op, -1))
            own = text_number(self.column)
            return F.when(own.isNotNull(), apply(op, own, F.lit(float(number)))).when(self.column.isNotNull(), other)
        if isinstance(self.type, T.BooleanType) and isinstance(literal, bool):
            return apply(op, self.column, F.lit(literal))
        if self.is_time and isinstance(literal, str):
            if not is_time_text(literal):
                return apply(op, self.text(), F.lit(literal))
            return apply(op, self.column, F.try_to_timestamp(F.lit(literal)).cast(self.type))
        if self.is_nested and isinstance(literal, (list, dict)):
            return apply(op, self.raw(), F.lit(canonical(literal)))
        return self._by_rank(op, RANK[kind_of(literal)])

    def _by_rank(self, op: str, rank: int) -> Column:
        sign = lambda own: F.lit(holds(op, (own > rank) - (own < rank)))
        if isinstance(self.type, T.BooleanType):
            return F.when(self.column, sign(RANK["true"])).when(~self.column, sign(RANK["false"]))
        own = "number" if self.is_number else "array" if isinstance(self.type, T.ArrayType) else "object" if self.is_nested else "string"
        return F.when(self.column.isNotNull(), sign(RANK[own]))

    def _compare_number(self, op: str, number: float | int) -> Column:
        bits = _INT.get(type(self.type))
        if bits is None or (isinstance(number, float) and not math.isfinite(number)):
            return apply(op, self.column, F.lit(float(number)) if not isinstance(self.type, T.DecimalType) else F.lit(number))
        low, high = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
        if number < low or number > high:
            return F.when(self.column.isNotNull(), F.lit(holds(op, -1 if number > high else 1)))
        if float(number).is_integer():
            return apply(op, self.column, F.lit(int(number)).cast(self.type))
        if op in ("$eq", "$ne"):
            return F.when(self.column.isNotNull(), F.lit(op == "$ne"))
        # between two whole numbers
        return self.column > F.lit(math.floor(number)).cast(self.type) if op in ("$gt", "$gte") else self.column < F.lit(math.ceil(number)).cast(self.type)

    def _compare_variant(self, op: str, literal: Any) -> Column:
        if self.parts is not None:
            hit = by_parts(op, literal, *self.parts)
        else:
            hit = let(self.number(), lambda n: by_parts(op, literal, self.kind(), n, self.text())) if not isinstance(literal, (list, dict)) else None
        return apply(op, self.raw(), F.lit(canonical(literal))) if hit is None else hit


MISSING = Value(None, None)


def constant(value: Any) -> Column:
    """A literal as a Column: scalars natively, containers as VARIANT."""
    if isinstance(value, (dict, list)):
        return F.parse_json(F.lit(canonical(value)))
    return F.lit(value)
