"""Updates as column expressions: a changed copy of a relation's rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspan.errors import QueryError, UnsupportedOperator
from docspan.functions.values import Value, canonical, is_time_text, kind_of, let, number_of
from docspan.operators.filters import condition
from docspan.plans.syntax import UPDATES, Filter
from docspan.relation import DOC, Relation

MAP = "map<string,variant>"
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _literal(x: Any) -> Column:
    return F.parse_json(F.lit(canonical(x)))


def without(items: Column, x: Any) -> Column:
    """An array of VARIANTs without those whose JSON text is x's."""
    return F.filter(items, lambda i: Value(i, T.VariantType()).raw() != canonical(x))


def _object(v: Column) -> Column:
    """A VARIANT's entries; none if it is no object."""
    return F.coalesce(_entries(v), F.create_map().cast(MAP))


def _entries(v: Column) -> Column:
    """A VARIANT's entries; NULL if it is no object."""
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", MAP))


def _with(m: Column, key: str, value: Column) -> Column:
    return F.to_variant_object(F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(F.lit(key), value)))


def set_path(v: Column, path: list[str], value: Column) -> Column:
    """v with the value at the path; objects on the way are made where there are none."""
    return change_path(v, path, lambda _: value)


def change_path(v: Column, path: list[str], new: Callable[[Column], Column]) -> Column:
    """v with new(old value) at the path; every object on the way is read once."""
    key, *rest = path

    def changed(m: Column) -> Column:
        own = F.try_element_at(m, F.lit(key))
        return _with(m, key, change_path(own, rest, new) if rest else new(own))

    return let(let(v, _object), changed)


def unset_path(v: Column, path: list[str]) -> Column:
    key, *rest = path

    def changed(v: Column, m: Column) -> Column:
        if not rest:
            out = F.to_variant_object(F.map_filter(m, lambda k, _: k != key))
        else:
            out = _with(m, key, unset_path(F.try_element_at(m, F.lit(key)), rest))
        return F.when(m.isNotNull() & F.map_contains_key(m, key), out).otherwise(v)

    return let(v, lambda v: let(_entries(v), lambda m: changed(v, m)))


def _whole_number(x: Column) -> Column:
    """A double as a VARIANT, without a fraction if it has none."""
    return F.when((F.floor(x) == x) & (F.abs(x) < 2**53), F.parse_json(x.cast("long").cast("string"))).otherwise(F.try_parse_json(x.cast("string")))


def _check(op: str, args: Any) -> None:
    if op not in UPDATES:
        raise UnsupportedOperator(f"unknown update {op}")
    if not isinstance(args, dict):
        raise QueryError(f"{op} takes an object")
    for path in args:
        if path == "_id" or path.startswith("_id."):
            raise QueryError("an update can't change _id")


def _array(c: Column) -> Column:
    """A VARIANT's items; NULL if it is no array."""
    return F.when(F.schema_of_variant(c).startswith("ARRAY"), F.try_variant_get(c, "$", "array<variant>"))


def _change(op: str, arg: Any) -> Callable[[Column], Column]:
    """How $set, $inc and $push make a VARIANT's new value from the old one."""
    if op == "$set":
        return lambda _: _literal(arg)
    if op == "$inc":
        return lambda c: let(Value(c, T.VariantType()).once(lambda v: F.coalesce(F.when(v.kind() == "number", v.number()), F.lit(0.0)) + float(number_of(arg))), _whole_number)
    return lambda c: F.to_variant_object(F.array_append(F.coalesce(let(c, _array), F.array().cast("array<variant>")), _literal(arg)))


def change_document(doc: Column, changes: dict) -> Column:
    """A document with the operators applied in their order."""
    for op, args in changes.items():
        _check(op, args)
        for path, arg in args.items():
            if op == "$inc" and number_of(arg) is None:
                raise QueryError("$inc takes numbers")
            if op == "$unset":
                doc = unset_path(doc, path.split("."))
            elif op == "$pull":  # a literal top-level name
                doc = _pull(doc, path, arg)
            else:  # $push takes a literal top-level name too; what is no array is replaced
                doc = change_path(doc, [path] if op == "$push" else path.split("."), _change(op, arg))
    return doc


def _pull(doc: Column, name: str, x: Any) -> Column:
    def changed(d: Column, m: Column) -> Column:
        return let(let(F.try_element_at(m, F.lit(name)), _array), lambda items: F.when(items.isNotNull(), _with(m, name, F.to_variant_object(without(items, x)))).otherwise(d))

    return let(doc, lambda d: let(_object(d), lambda m: changed(d, m)))


def _cast(x: Any, kind: T.DataType) -> Column:
    if x is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.VariantType):
        return _literal(x)
    if isinstance(x, (dict, list)):
        return F.from_json(F.lit(canonical(x)), kind)
    if not _fits(x, kind):
        raise QueryError(f"{x!r} is no value of a column of type {kind.simpleString()}")
    return F.lit(x).try_cast(kind)


def _fits(x: Any, kind: T.DataType) -> bool:
    """Whether a scalar can be a value of a typed column, without loss."""
    if isinstance(kind, T.BooleanType) or isinstance(x, bool):
        return isinstance(x, bool) and isinstance(kind, (T.BooleanType, T.StringType))
    if isinstance(kind, INTEGRAL):
        return number_of(x) is not None and float(number_of(x)).is_integer()
    if isinstance(kind, T.NumericType):
        return number_of(x) is not None
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return isinstance(x, str) and is_time_text(x)
    return kind_of(x) in ("string", "number")


def _set_typed(c: Column, kind: T.DataType, path: list[str], new) -> Column:
    """new: gives the new column from the old one and its type."""
    if not path:
        return new(c, kind)
    if isinstance(kind, T.VariantType):
        return change_path(c, path, lambda v: new(v, T.VariantType()))
    if isinstance(kind, T.StructType) and path[0] in kind.names:
        return c.withField(f"`{path[0]}`", _set_typed(c[path[0]], kind[path[0]].dataType, path[1:], new))
    raise QueryError(f"no field {'.'.join(path)} in {kind.simpleString()}")


def change_columns(rel: Relation, changes: dict, match: Column) -> Relation:
    """A typed relation's rows, changed where match holds. A new field becomes a VARIANT column; $unset leaves NULL."""
    df = rel.df.withColumn("_match", F.coalesce(match, F.lit(False)))
    for op, args in changes.items():
        _check(op, args)
        for path, arg in args.items():
            head, *rest = [path] if path in df.columns or op in ("$push", "$pull") else path.split(".")
            if head not in df.columns:
                if op in ("$unset", "$pull"):
                    continue
                df = df.withColumn(head, F.lit(None).cast("variant"))
            kind = df.schema[head].dataType
            if op == "$inc" and not rest and isinstance(kind, INTEGRAL) and number_of(arg) is not None and not float(number_of(arg)).is_integer():
                df = df.withColumn(head, F.col(f"`{head}`").cast("double"))  # a fraction widens the column
                kind = T.DoubleType()

            def new(c: Column, k: T.DataType, op=op, arg=arg) -> Column:
                if op == "$set":
                    return _cast(arg, k)
                if op == "$unset":
                    return F.lit(None).cast(k)
                if op == "$inc":
                    if number_of(arg) is None:
                        raise QueryError("$inc takes numbers")
                    if isinstance(k, T.VariantType):
                        return _change(op, arg)(c)
                    own = Value(c, k)
                    total = F.coalesce(own.number() if own.is_number else F.lit(None).cast("double"), F.lit(0.0)) + float(number_of(arg))
                    if isinstance(k, INTEGRAL):
                        if not float(number_of(arg)).is_integer():
                            raise QueryError(f"$inc by {arg} needs a column of fractions, not {k.simpleString()}")
                        return F.coalesce(c, F.lit(0).cast(k)) + F.lit(int(number_of(arg))).cast(k)
                    return total.cast(k) if own.is_number else total.cast("string").cast(k)
                if isinstance(k, T.VariantType):
                    if op == "$push":
                        return _change(op, arg)(c)
                    return let(c, lambda c: let(_array(c), lambda items: F.when(items.isNotNull(), F.to_variant_object(without(items, arg))).otherwise(c)))
                if not isinstance(k, T.ArrayType):
                    return F.array(_cast(arg, k)).cast("string").cast(k) if op == "$push" and isinstance(k, T.StringType) else c
                item = k.elementType
                if op == "$push":
                    return F.array_append(F.coalesce(c, F.array().cast(k)), _cast(arg, item))
                return F.filter(c, lambda x: F.coalesce(Value(x, item).raw() != canonical(arg), F.lit(True)))

            df = df.withColumn(head, F.when(F.col("_match"), _set_typed(F.col(f"`{head}`"), kind, rest, new)).otherwise(F.col(f"`{head}`")))
    return rel.with_df(df.drop("_match"))


def updated(rel: Relation, f: Filter, changes: dict) -> Relation:
    """All rows, those that f matches changed."""
    match = condition(rel, f)
    if not rel.document:
        return change_columns(rel, changes, match)
    changed = change_document(F.col(DOC), changes)
    return rel.with_df(rel.df.withColumn(DOC, F.when(F.coalesce(match, F.lit(False)), changed).otherwise(F.col(DOC))))


def remaining(rel: Relation, f: Filter) -> Relation:
    """The rows that a delete leaves."""
    return rel.with_df(rel.df.where(~F.coalesce(condition(rel, f), F.lit(False))))
