"""Sort, paging, projection and the stages of aggregation pipelines."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspan.errors import DocspanError, QueryError, UnsupportedOperator
from docspan.functions.values import Value, canonical, constant, number_of
from docspan.operators.filters import where
from docspan.plans.syntax import ACCUMULATORS, Aggregate, Compare, Find, direction, filter_of, included
from docspan.relation import DOC, Relation


def _grouped_next(rest: list) -> bool:
    """Whether a $group comes next, after filters at most."""
    op = next((op for op, _ in rest if op != "$match"), None)
    return op in ("$group", "$count")


def sort(rel: Relation, keys: tuple[tuple[str, bool], ...], strict: bool = False, physically: bool = True) -> Relation:
    """By several keys; ties in the order that the rows have, or by _id."""
    values = [(rel.resolve(path), up) for path, up in keys]
    columns: list[tuple[Column, bool]] = [(c, up) for v, up in values for c in v.order_columns(strict)]
    ties = rel.order or (((rel.id, True),) if rel.id is not None else ())
    order = tuple(columns) + tuple(ties)
    if not order:
        return rel
    by = [(c.asc_nulls_first() if up else c.desc_nulls_last()) for c, up in order]
    return rel.with_df(rel.df.orderBy(*by) if physically else rel.df, order=order, ordered=physically)


def skip(rel: Relation, n: int) -> Relation:
    return rel.with_df(rel.df.offset(n)) if n > 0 else rel


def limit(rel: Relation, n: int) -> Relation:
    """The first n rows; none if n is not positive."""
    return rel.with_df(rel.df.limit(max(0, n)))


def naturally(rel: Relation) -> Relation:
    """In the relation's own order, which limits without a sort refer to."""
    if not rel.order or rel.ordered:
        return rel
    return rel.with_df(rel.df.orderBy(*(c.asc_nulls_first() if up else c.desc_nulls_last() for c, up in rel.order)), ordered=True)


def project(rel: Relation, paths: tuple[str, ...]) -> Relation:
    """_id as text, and the paths under their flat names. No paths: all fields."""
    if not paths:
        return rel
    columns, names = [], []
    if rel.id is not None or "_id" in rel.fields:
        columns.append(rel.resolve("_id").plain().alias("_id"))
        names.append("_id")
    for p in paths:
        if p == "_id" or p in names:
            continue
        v = rel.resolve(p)
        columns.append((F.lit(None).cast("string") if v.missing else v.column).alias(p))
        names.append(p)
    # the order that rows are in goes along under hidden names
    order, hidden = [], set()
    for i, (c, up) in enumerate(rel.order):
        name = f"_order{i}"
        columns.append(c.alias(name))
        order.append((F.col(name), up))
        hidden.add(name)
    df = rel.df.select(*columns)
    return Relation(df, F.col("_id") if "_id" in names else None, T.StringType() if "_id" in names else None, order=tuple(order), hidden=frozenset(hidden), ordered=rel.ordered, null_is_value=rel.null_is_value, strict=rel.strict)


def count(rel: Relation, name: Any) -> Relation:
    """One row, even over no rows."""
    name = "count" if name is None else name
    if not isinstance(name, str):
        raise QueryError("$count takes a name")
    return Relation(rel.df.agg(F.count(F.lit(1)).alias(name)), strict=rel.strict)


# groups


def _reference(x: Any) -> str | None:
    return x[1:] if isinstance(x, str) and x.startswith("$") and len(x) > 1 else None


def _key(rel: Relation, x: Any) -> tuple[Column, Column | None]:
    """(grouping column, how to get the value back from it, or None if it is the value)."""
    if x is None:
        return F.lit(None).cast("string"), None
    if (path := _reference(x)) is not None:
        v = rel.resolve(path)
        if v.missing:
            return F.lit(x if rel.strict else None).cast("string"), None
        if v.is_variant or isinstance(v.type, T.MapType):
            raw = v.raw()
            return (F.coalesce(raw, F.to_json(F.struct(F.lit(x).alias("v"))).substr(6, 10**6)) if rel.strict else raw), F.parse_json(F.col("_key"))
        return (F.coalesce(v.column.cast("string"), F.lit(x)) if rel.strict else v.column), None
    if isinstance(x, dict) and not rel.strict:
        parts = []
        for name, part in x.items():
            path = _reference(part)
            v = rel.resolve(path) if path is not None else None
            c = constant(part) if v is None else F.lit(None).cast("string") if v.missing else v.raw() if v.is_variant or isinstance(v.type, T.MapType) else v.column
            parts.append(c.alias(name))
        return (F.struct(*parts) if parts else F.lit("{}")), None
    if isinstance(x, (dict, list)):
        return F.lit(canonical(x)), F.parse_json(F.col("_key"))
    return F.lit(x), None


def _operand(rel: Relation, x: Any) -> Column:
    """A number; what is missing or no number counts as 0."""
    if (path := _reference(x)) is not None:
        return F.coalesce(rel.resolve(path).number(), F.lit(0.0))
    return F.lit(float(number_of(x) or 0))


def _first(rel: Relation, x: Any) -> Column:
    """An aggregate with partial states: the value of the row that comes first."""
    path = _reference(x)
    if path is None:
        return F.any_value(constant(x))
    v = rel.resolve(path)
    if v.missing:
        return F.any_value(F.lit(x if rel.strict else None).cast("string"))
    c = F.coalesce(v.column, F.lit(x)) if rel.strict and v.is_text else v.column
    order = rel.order or (((rel.id, True),) if rel.id is not None else ())
    if not order:
        return F.first(c)
    kinds = rel.df.select(*(k.alias(f"k{i}") for i, (k, _) in enumerate(order))).schema
    keys = [part for (k, up), f in zip(order, kinds, strict=True) for part in _rising(k, up, f.dataType)]
    # boxed, as a NULL is a value too
    return F.min_by(F.struct(c.alias("v")), F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)))).getField("v")


def _rising(k: Column, up: bool, kind: T.DataType) -> list[Column]:
    """Keys whose rising order is this one; what is missing is first in a rising order, and last in a falling one."""
    if up:
        return [k]  # structs compare NULLs as least
    if isinstance(kind, T.BooleanType):
        value = ~k
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        value = -k.cast("long")
    elif isinstance(kind, T.LongType):
        value = F.bitwise_not(k)  # the least number has no negative
    elif isinstance(kind, T.NumericType):
        value = -k
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):  # a longer array comes before its beginnings
        value = F.array_append(F.transform(k, lambda x: -x.cast("double")), F.lit(float("inf")))
    elif isinstance(kind, T.DateType):
        value = -F.unix_date(k)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        value = -F.unix_micros(k.cast("timestamp"))
    else:  # the bytes' complements, in hexadecimal; a shorter text comes after those that it begins
        value = F.concat(F.translate(F.hex(k.cast("string").cast("binary")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("Z"))
    return [k.isNull(), value]


def group(rel: Relation, spec: Any) -> Relation:
    """One row a key: _id, and the accumulators' numbers as doubles. No rows, no groups, not even for a null key."""
    if not isinstance(spec, dict) or "_id" not in spec:
        raise QueryError("$group takes an object with _id")
    key, back = _key(rel, spec["_id"])
    aggregates = []
    for name, acc in spec.items():
        if name == "_id":
            continue
        if not isinstance(acc, dict) or len(acc) != 1:
            raise QueryError(f"{name} takes one accumulator")
        op, x = next(iter(acc.items()))
        if op not in ACCUMULATORS:
            raise UnsupportedOperator(f"unknown accumulator {op}")
        if op == "$first":
            a = _first(rel, x)
        else:
            a = {"$sum": F.sum, "$avg": F.avg, "$min": F.min, "$max": F.max}[op](_operand(rel, x))
        aggregates.append(a.alias(name))
    df = rel.df.withColumn("_key", key)
    names = [n for n in spec if n != "_id"]
    grouped = df.groupBy("_key").agg(*aggregates) if aggregates else df.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    out = grouped.select((back if back is not None else F.col("_key")).alias("_id"), *(F.col(f"`{n}`") for n in names))
    return Relation(out, F.col("_id"), out.schema["_id"].dataType, null_is_value=rel.null_is_value, strict=rel.strict)


# lookup


def whole(rel: Relation) -> Column:
    """A whole row as one value: VARIANT of documents, else a struct with _id first."""
    if rel.document:
        return F.col(DOC)
    fields = [F.col(f"`{c}`") for c in rel.fields]
    return F.struct(*([rel.id_text().alias("_id")] if rel.id is not None and "_id" not in rel.fields else []), *fields)


def _join_keys(local: Value, foreign: Value) -> tuple[Column, Column]:
    whole_numbers = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if isinstance(local.type, whole_numbers) and isinstance(foreign.type, whole_numbers):
        return local.column.cast("long"), foreign.column.cast("long")
    return local.equality_key(), foreign.equality_key()


def lookup(rel: Relation, other: Relation, spec: dict, cap: int = 0, few: bool = False) -> Relation:
    """A left outer nest join on equal values: as holds the matching rows in their order. cap: the most rows other may have.

    few: rel has few rows, so other's rows are cut to those with a match before they are nested.
    """
    name, local, foreign = _sides(rel, other, spec, cap)
    if local.missing or foreign.missing:
        kind = other.df.select(F.collect_list(whole(other)).alias("x")).schema["x"].dataType
        return _with_field(rel, name, F.array().cast(kind))
    left, right = _join_keys(local, foreign)
    order = [c for c, _ in other.order] or ([other.id] if other.id is not None else [])
    rows = other.df.select(right.alias("_k"), *(c.alias(f"_o{i}") for i, c in enumerate(order)), whole(other).alias("_w")).where("_k is not null")
    if few:
        rows = rows.join(rel.df.select(left.alias("_lk")).distinct(), F.col("_k") == F.col("_lk"), "left_semi")
    if order:
        # the order columns come first in the struct; a VARIANT can't be compared, so it goes along by position
        nested = F.collect_list(F.struct(*(F.col(f"_o{i}") for i in range(len(order))), F.col("_w")))
        ways = [up for _, up in other.order] or [True]
        compare = lambda a, b: _compare_structs(a, b, len(order), ways)
        matched = F.transform(F.array_sort(nested, compare), lambda x: x["_w"])
    else:
        matched = F.collect_list("_w")
    nest = rows.groupBy("_k").agg(matched.alias("_matches"))
    joined = rel.df.withColumn("_lk", left).join(nest, F.col("_lk") == F.col("_k"), "left")
    kind = joined.schema["_matches"].dataType
    out = rel.with_df(joined)
    return _with_field(out, name, F.coalesce("_matches", F.array().cast(kind)), drop=("_lk", "_k", "_matches"))


def _compare_structs(a: Column, b: Column, n: int, ways: list[bool]) -> Column:
    case = None
    for i in range(n):
        up = ways[min(i, len(ways) - 1)]
        x, y = a[f"_o{i}"], b[f"_o{i}"]
        less, more = (-1, 1) if up else (1, -1)
        case = F.when(x < y, less) if case is None else case.when(x < y, less)
        case = case.when(x > y, more)
    return case.otherwise(0)


def _with_field(rel: Relation, name: str, column: Column, drop: tuple[str, ...] = ()) -> Relation:
    df = rel.df
    if rel.document:  # a document goes on as columns: the field is a literal top-level name
        df = df.withColumn(f"{name}", column)
        return rel.with_df(df.drop(*drop))
    return rel.with_df(df.withColumn(name, column).drop(*drop))


def _sides(rel: Relation, other: Relation, spec: Any, cap: int) -> tuple[str, Value, Value]:
    if not isinstance(spec, dict) or any(k not in spec for k in ("from", "localField", "foreignField", "as")):
        raise QueryError("$lookup takes from, localField, foreignField and as")
    if cap > 0 and other.df.limit(cap + 1).count() > cap:
        raise DocspanError(f"$lookup: {spec['from']} has more than {cap} documents")
    return spec["as"] or "joined", rel.resolve(str(spec["localField"])), other.resolve(str(spec["foreignField"]))


def lookup_exists(rel: Relation, other: Relation, spec: dict, wanted: bool, cap: int = 0) -> Relation:
    """The rows with a match, or those without one, when the matches themselves are not asked for."""
    _, local, foreign = _sides(rel, other, spec, cap)
    if local.missing or foreign.missing:
        return rel.with_df(rel.df.where(F.lit(not wanted)))
    left, right = _join_keys(local, foreign)
    keys = other.df.select(right.alias("_k")).where("_k is not null")
    return rel.with_df(rel.df.withColumn("_lk", left).join(keys, F.col("_lk") == F.col("_k"), "left_semi" if wanted else "left_anti").drop("_lk"))


def _mentions(stages: tuple, name: str) -> bool:
    """Whether the rest of a pipeline may need a field: it does if it is named, or if all fields reach the result."""
    for op, arg in stages:
        if f'"{name}' in canonical(arg) or f'"${name}' in canonical(arg):
            return True
        if op in ("$project", "$group", "$count"):
            return False
    return True


def _existence(spec: dict, after: tuple) -> bool | None:
    """For a $match of as: [] or as: {$ne: []} that follows a lookup whose matches are not needed: whether matches are wanted."""
    if not after or after[0][0] != "$match" or not isinstance(spec, dict) or not isinstance(spec.get("as"), str):
        return None
    f = filter_of(after[0][1])
    if isinstance(f, Compare) and f.path == spec["as"] and f.value == [] and f.op in ("$eq", "$ne") and not _mentions(after[1:], spec["as"]):
        return f.op == "$ne"
    return None


def run_stages(rel: Relation, stages: tuple, collections, cap: int = 0) -> Relation:
    """collections: gives the relation of a name, for $lookup."""
    i = 0
    stages = list(stages)
    while i < len(stages):
        op, arg = stages[i]
        if op == "$match":
            rel = where(rel, filter_of(arg))
        elif op == "$project":
            rel = project(rel, included(arg))
        elif op == "$sort":
            if not isinstance(arg, dict):
                raise QueryError("$sort takes an object")
            # rows that are grouped next keep the order in mind, but needn't be sorted
            rel = sort(rel, tuple((k, direction(v, True)) for k, v in arg.items()), rel.strict, physically=not _grouped_next(stages[i + 1 :]))
        elif op in ("$skip", "$limit"):
            if not isinstance(arg, (int, float)) or isinstance(arg, bool):
                raise QueryError(f"{op} takes a number")
            rel = (skip if op == "$skip" else limit)(naturally(rel) if rel.document else rel, int(arg))
        elif op == "$count":
            rel = count(rel, arg)
        elif op == "$group":
            rel = group(rel, arg)
        elif op == "$lookup":
            wanted = _existence(arg, tuple(stages[i + 1 :]))
            if wanted is not None:
                rel = lookup_exists(rel, collections(arg["from"]), arg, wanted, cap)
                i += 1
            elif i + 1 < len(stages) and stages[i + 1][0] in ("$limit", "$skip"):
                # a lookup keeps rows as they are, so it may come after the cut
                stages[i], stages[i + 1] = stages[i + 1], stages[i]
                continue
            else:
                # two readings of a limit are of the same rows only if the rows are sorted
                few = rel.ordered and any(op == "$limit" for op, _ in stages[:i])
                rel = lookup(rel, collections(arg["from"] if isinstance(arg, dict) else ""), arg, cap, few)
        else:
            raise UnsupportedOperator(f"unknown stage {op}")
        i += 1
    return rel


def run_find(rel: Relation, q: Find) -> Relation:
    """Filter, sort, skip, limit, project; a limit that is not positive means all rows."""
    rel = where(rel, q.filter)
    keys = q.sort
    if rel.strict and len(keys) > 1:
        keys = keys[-1:]
    if keys:
        rel = sort(rel, keys)
    elif (q.skip > 0 or q.limit > 0) and rel.order:
        rel = naturally(rel)
    rel = skip(rel, q.skip)
    if q.limit > 0:
        rel = limit(rel, q.limit)
    if q.project is not None and not (rel.strict and q.sort):
        rel = project(rel, q.project)
    return rel


def run_aggregate(rel: Relation, q: Aggregate, collections, cap: int = 0) -> Relation:
    return run_stages(rel, q.stages, collections, cap)

