"""A relation: a DataFrame with what document queries need to know about it.

Typed relations have native columns. Document relations have _id string, doc VARIANT and _ord long. Either way the columns
of a relation may be of any type, VARIANT included; a path is looked up as a literal column first, then part by part.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspan.functions.values import MISSING, Value

DOC, ORD = "doc", "_ord"


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    #: The native expression of the identity, or None.
    id: Column | None = None
    id_type: T.DataType | None = None
    #: Whether df has a VARIANT column doc that holds whole documents.
    document: bool = False
    #: (column, ascending) pairs of the order that rows are in, the most significant first; () if none.
    order: tuple[tuple[Column, bool], ...] = ()
    #: Columns that are no fields of the documents.
    hidden: frozenset[str] = field(default_factory=frozenset)
    #: Of documents: paths whose kind, number and text are columns of df by themselves, and those columns' names.
    keys: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    #: Whether df's rows come in that order.
    ordered: bool = False
    #: {f: null} matches nulls of typed columns.
    null_is_value: bool = False
    #: Reproduce behaviour that is documented otherwise (raw-text sort order and the like).
    strict: bool = False

    def with_df(self, df: DataFrame, **changes) -> Relation:
        return replace(self, df=df, **changes)

    @property
    def fields(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.hidden]

    def id_text(self) -> Column:
        return F.lit(None).cast("string") if self.id is None else self.id.cast("string")

    def resolve(self, path: str) -> Value:
        """The value at a dotted path; MISSING if no row can have one."""
        schema = self.df.schema
        names = {f.name: f for f in schema if f.name not in self.hidden}
        if path == "_id" and self.id is not None:
            return Value(self.id, self.id_type or T.StringType())
        if path in names and not (self.document and path == DOC):
            return Value(F.col(f"`{path}`"), names[path].dataType)
        head, *rest = path.split(".")
        if head == "_id" and self.id is not None:
            return Value(self.id, self.id_type or T.StringType()).child(rest)
        if self.document:
            v = Value(F.col(DOC), T.VariantType()).child([head, *rest])
            return replace(v, parts=tuple(F.col(c) for c in self.keys[path])) if path in self.keys else v
        # a column whose own name has dots, then the rest
        parts = path.split(".")
        for n in range(len(parts) - 1, 0, -1):
            if (name := ".".join(parts[:n])) in names:
                return Value(F.col(f"`{name}`"), names[name].dataType).child(parts[n:])
        return MISSING


def typed(df: DataFrame, id: str | Column | None = None, json: tuple[str, ...] = (), order_by: tuple[str, ...] = (), **options) -> Relation:
    """A relation of native columns. id: a column or an expression; json: text columns that hold JSON and become VARIANT."""
    for c in json:
        df = df.withColumn(c, F.try_parse_json(c))
    column = F.col(f"`{id}`") if isinstance(id, str) else id
    kind = df.schema[id].dataType if isinstance(id, str) else (df.select(id.alias("x")).schema["x"].dataType if id is not None else None)
    return Relation(df, column, kind, order=tuple((F.col(c), True) for c in order_by), **options)


def documents(df: DataFrame, **options) -> Relation:
    """A relation of documents: df has _id string, doc VARIANT and _ord long."""
    keys = options.get("keys", {})
    return Relation(df, F.col("_id"), T.StringType(), document=True, order=((F.col(ORD), True),), hidden=frozenset({ORD, "_id", *(c for k in keys.values() for c in k)}), **options)
