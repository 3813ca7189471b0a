"""Single documents as objects: dotted access, typed materialisation, cells, trees; and the same over relations."""

from __future__ import annotations

import copy
import dataclasses
import json
import types
import typing
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspan.database import Column_, declared, parse_cell
from docspan.errors import QueryError
from docspan.functions.values import Value, let
from docspan.relation import Relation
from docspan.sources.documents import camel, json_rows, plain


class Document:
    """A JSON object; doc["a.b"] reads a copy of a nested value, and setting one makes the objects on the way."""

    def __init__(self, value: Any = None):
        root = json.loads(value) if isinstance(value, str) else plain({} if value is None else value)
        if not isinstance(root, dict):
            raise QueryError("a document must be an object")
        self.root = root

    @property
    def id(self) -> str:
        own = self.root.get("_id")
        return "" if own is None else own if isinstance(own, str) else json.dumps(own)

    def __getitem__(self, path: str) -> Any:
        """None if there is no such value; objects only, never array indexes."""
        at: Any = self.root
        for p in path.split("."):
            if not isinstance(at, dict) or p not in at:
                return None
            at = at[p]
        return copy.deepcopy(at)

    def __setitem__(self, path: str, value: Any) -> None:
        *way, last = path.split(".")
        at = self.root
        for p in way:
            if not isinstance(at.get(p), dict):
                at[p] = {}
            at = at[p]
        at[last] = plain(value)

    def json(self) -> str:
        return json.dumps(self.root, ensure_ascii=False, separators=(",", ":"))

    def to(self, kind: type) -> Any:
        """An object of a dataclass; fields are looked up by their camelCase names, then by their own."""
        return _made(self.root, kind)


def _made(value: Any, kind: Any) -> Any:
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin in (typing.Union, types.UnionType):
        return None if value is None else _made(value, next(a for a in args if a is not type(None)))
    if dataclasses.is_dataclass(kind):
        if not isinstance(value, dict):
            raise QueryError(f"{kind.__name__} is made from an object")
        hints, given = typing.get_type_hints(kind), {}
        for f in dataclasses.fields(kind):
            for name in (camel(f.name), f.name):
                if name in value:
                    given[f.name] = _made(value[name], hints[f.name])
                    break
            else:
                if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
                    given[f.name] = None
        return kind(**given)
    if origin is list and isinstance(value, list):
        return [_made(v, args[0]) for v in value]
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    return value


def typed_frame(rel: Relation, schema: str | T.StructType) -> DataFrame:
    """The documents as native columns of a schema, for example "name string, age int"; what doesn't fit is NULL."""
    return json_rows(rel).select(F.from_json("json", schema).alias("d")).select("d.*")


def document_from_cells(id: str | None, cells: Mapping[str, str], columns: Iterable[Column_ | dict] = ()) -> Document:
    """A document from a grid's cells, each of its declared column's type (TEXT without one); blank names and _id are left out."""
    kinds = {c.name: c.type for c in declared(columns)}
    root: dict[str, Any] = {"_id": id} if (id or "").strip() else {}
    for name, text in cells.items():
        if name.strip() and name != "_id":
            root[name] = parse_cell(text, kinds.get(name, "TEXT"))
    return Document(root)


@dataclass(frozen=True)
class Node:
    """A line of a document's tree: objects have no text, arrays their length in brackets."""

    name: str
    value: str
    children: list[Node] = field(default_factory=list)

    @property
    def caption(self) -> str:
        return f"{self.name}: {self.value}" if self.value else self.name


def tree(text: str | None) -> list[Node]:
    """The tree of a JSON text: none for a blank one or null; a text that isn't JSON is a single line."""
    if not (text or "").strip():
        return []
    try:
        value = json.loads(text)
    except ValueError:
        return [Node("(invalid JSON)", text.strip())]

    def node(name: str, v: Any) -> Node:
        if isinstance(v, dict):
            return Node(name, "", [node(k, x) for k, x in v.items()])
        if isinstance(v, list):
            return Node(name, f"[{len(v)}]", [node(f"[{i}]", x) for i, x in enumerate(v)])
        return Node(name, v if isinstance(v, str) else json.dumps(v))

    return [] if value is None else [node("(root)", value)]


def tree_rows(rel: Relation, depth: int = 4) -> DataFrame:
    """(_id, path, name, value, level): the trees of all documents, down to a depth; a level more for each object or array."""
    base = json_rows(rel).select("_id", F.lit("").alias("path"), F.lit("(root)").alias("name"), F.try_parse_json("json").alias("v"))
    out = None
    for level in range(depth + 1):
        kind = let(F.col("v"), lambda v: Value(v, T.VariantType()).kind())
        base = base.withColumn("kind", kind)
        items = F.try_variant_get("v", "$", "array<variant>")
        value = F.when(F.col("kind") == "object", "").when(F.col("kind") == "array", F.concat(F.lit("["), F.size(items), F.lit("]"))).otherwise(Value(F.col("v"), T.VariantType()).plain())
        rows = base.select("_id", "path", "name", value.alias("value"), F.lit(level).alias("level"))
        out = rows if out is None else out.unionByName(rows)
        entry = lambda name, v: F.struct(name.alias("name"), v.alias("v"))
        fields = F.transform(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>")), lambda e: entry(e["key"], e["value"]))
        parts = F.transform(items, lambda x, i: entry(F.concat(F.lit("["), i, F.lit("]")), x))
        below = base.where(F.col("kind").isin("object", "array")).withColumn("e", F.explode(F.when(F.col("kind") == "object", fields).otherwise(parts)))
        base = below.select("_id", F.concat_ws(".", F.nullif("path", F.lit("")), "e.name").alias("path"), F.col("e.name").alias("name"), F.col("e.v").alias("v"))
    return out
