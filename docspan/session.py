"""Read-only query sessions over relations: the text language and the fluent API, without storage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspan.errors import QueryError
from docspan.operators import stages, updates
from docspan.plans import syntax
from docspan.plans.syntax import Aggregate, All, Any_, Compare, Delete, Exists, Filter, Find, In, Regex, StartsWith, Update
from docspan.relation import DOC, Relation, typed


@dataclass(frozen=True)
class Result:
    """What a statement gives: lazy rows, or how many documents a write met."""

    collection: str
    operation: str
    relation: Relation | None = None
    affected: int = 0

    @property
    def df(self) -> DataFrame | None:
        return self.relation.df if self.relation is not None else None


class Tables:
    """Collections by name; each is made when it is first asked for."""

    def __init__(self, lookup_cap: int = 0):
        self.makers: dict[str, Callable[[], Relation]] = {}
        self.lookup_cap = lookup_cap

    def add(self, name: str, relation: Relation | Callable[[], Relation]) -> None:
        self.makers[name] = relation if callable(relation) else lambda: relation

    def relation(self, name: str) -> Relation:
        if name not in self.makers:
            raise QueryError(f"no collection {name}")
        return self.makers[name]()

    def names(self) -> list[str]:
        return sorted(self.makers)

    def query(self, text: str, strict: bool = False) -> Relation:
        """The rows of a find or an aggregate; of an update the changed rows of the whole collection, of a delete what is left."""
        q = syntax.parse(text)
        rel = replace(self.relation(q.collection), strict=strict)
        if isinstance(q, Find):
            return stages.run_find(rel, q)
        if isinstance(q, Aggregate):
            return stages.run_aggregate(rel, q, self.relation, self.lookup_cap)
        if isinstance(q, Update):
            return updates.updated(rel, q.filter, q.changes)
        assert isinstance(q, Delete)
        return updates.remaining(rel, q.filter)

    def frame(self, text: str, strict: bool = False) -> DataFrame:
        return self.query(text, strict).df

    def find(self, name: str, filter: Any = None) -> Query:
        return Query(self.relation(name), syntax.filter_of(filter))


# the fluent API


class Condition:
    """A filter under construction; & and | combine."""

    def __init__(self, f: Filter):
        self.filter = f

    def __and__(self, other: Condition) -> Condition:
        return Condition(All((self.filter, other.filter)))

    def __or__(self, other: Condition) -> Condition:
        return Condition(Any_((self.filter, other.filter)))

    def __bool__(self) -> bool:
        raise QueryError("combine conditions with & and |")

    def __invert__(self) -> Condition:
        raise QueryError("a condition can't be negated")


@dataclass(frozen=True, eq=False)
class Field:
    """A dotted path whose comparisons make conditions: Field("age") >= 21."""

    path: str

    def __getattr__(self, name: str) -> Field:
        if name.startswith("__"):
            raise AttributeError(name)
        return Field(f"{self.path}.{name}")

    def __eq__(self, v: Any) -> Condition:  # type: ignore[override]
        return Condition(Compare(self.path, "$eq", v))

    def __ne__(self, v: Any) -> Condition:  # type: ignore[override]
        return Condition(Compare(self.path, "$ne", v))

    def __gt__(self, v: Any) -> Condition:
        return Condition(Compare(self.path, "$gt", v))

    def __ge__(self, v: Any) -> Condition:
        return Condition(Compare(self.path, "$gte", v))

    def __lt__(self, v: Any) -> Condition:
        return Condition(Compare(self.path, "$lt", v))

    def __le__(self, v: Any) -> Condition:
        return Condition(Compare(self.path, "$lte", v))

    __hash__ = None  # type: ignore[assignment]

    def is_in(self, *values: Any) -> Condition:
        return Condition(In(self.path, tuple(values)))

    def not_in(self, *values: Any) -> Condition:
        return Condition(In(self.path, tuple(values), True))

    def exists(self, wanted: bool = True) -> Condition:
        return Condition(Exists(self.path, wanted))

    def matches(self, pattern: str) -> Condition:
        return Condition(Regex(self.path, pattern))

    def starts_with(self, prefix: str) -> Condition:
        return Condition(StartsWith(self.path, prefix))


@dataclass(frozen=True)
class Query:
    """A find under construction. sort() may be called several times: keys add up. The last project() counts."""

    relation: Relation
    filter: Filter = field(default_factory=All)
    keys: tuple[tuple[str, bool], ...] = ()
    skipped: int = 0
    limited: int = 0
    paths: tuple[str, ...] | None = None

    def where(self, condition: Condition | Any) -> Query:
        f = condition.filter if isinstance(condition, Condition) else syntax.filter_of(condition)
        return replace(self, filter=f if isinstance(self.filter, All) and not self.filter.parts else All((self.filter, f)))

    def sort(self, path: str, ascending: bool = True) -> Query:
        return replace(self, keys=(*self.keys, (path, ascending)))

    def skip(self, n: int) -> Query:
        return replace(self, skipped=n)

    def limit(self, n: int) -> Query:
        return replace(self, limited=n)

    def page(self, number: int, size: int | None = None) -> Query:
        if number < 1 or (size is not None and size < 1):
            raise QueryError("pages count from 1, and their size must be positive")
        size = size or (self.limited if self.limited > 0 else syntax.DEFAULT_PAGE)
        return replace(self, skipped=(number - 1) * size, limited=size)

    def project(self, *paths: str) -> Query:
        return replace(self, paths=paths)

    def run(self) -> Relation:
        return stages.run_find(self.relation, Find("", self.filter, self.keys, self.skipped, self.limited, self.paths))

    @property
    def df(self) -> DataFrame:
        return self.run().df

    def count(self) -> int:
        return self.df.count()

    def documents(self) -> Iterator[dict]:
        """The rows as dictionaries, partition by partition."""
        from docspan.sources.documents import json_values

        yield from json_values(self.run(), prefetch=True)

    def to_list(self) -> list[dict]:
        return list(self.documents())


class Pipeline:
    """Builds an aggregation step by step."""

    def __init__(self, stages_: tuple = ()):
        self.stages = stages_

    def _with(self, op: str, arg: Any) -> Pipeline:
        return Pipeline((*self.stages, (op, arg)))

    def match(self, filter: dict) -> Pipeline:
        return self._with("$match", filter)

    def project(self, *paths: str) -> Pipeline:
        return self._with("$project", dict.fromkeys(paths, 1))

    def sort(self, **keys: int) -> Pipeline:
        return self._with("$sort", keys)

    def skip(self, n: int) -> Pipeline:
        return self._with("$skip", n)

    def limit(self, n: int) -> Pipeline:
        return self._with("$limit", n)

    def count(self, name: str = "count") -> Pipeline:
        return self._with("$count", name)

    def group(self, key: Any, **accumulators: dict) -> Pipeline:
        return self._with("$group", {"_id": key, **accumulators})

    def lookup(self, source: str, local: str, foreign: str, name: str) -> Pipeline:
        return self._with("$lookup", {"from": source, "localField": local, "foreignField": foreign, "as": name})

    def run(self, rel: Relation, collections: Callable[[str], Relation]) -> Relation:
        return stages.run_stages(rel, self.stages, collections)


#: The identity of each driver table; lineitem has none.
_KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id", "pages": "page_id", "benchmark": "item_id", "embeddings": "vec_id"}


def parquet_tables(spark: SparkSession, folder: str) -> Tables:
    """The Parquet tables of a folder as typed collections; events.props is read as JSON."""
    tables = Tables()
    for name in (*_KEYS, "lineitem", "conversations"):

        def make(name: str = name) -> Relation:
            df = spark.read.parquet(f"{folder}/{name}.parquet")
            id_ = F.concat_ws("-", "conv_id", "turn") if name == "conversations" else _KEYS.get(name)
            return typed(df, id_, json=("props",) if name == "events" else ())

        tables.add(name, make)
    return tables


__all__ = ["DOC", "Condition", "Field", "Pipeline", "Query", "Result", "Tables", "parquet_tables"]
