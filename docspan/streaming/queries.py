"""The query language over streams: compiled queries are Columns, so a stream takes them unchanged.

Beyond what stored collections offer: find, $match and $project run in any output mode; $group takes a watermark and an
optional time window; $lookup joins a stream with stored rows. Sorting and paging need a complete, grouped result.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspan.errors import QueryError, UnsupportedOperator
from docspan.operators import stages
from docspan.operators.filters import where
from docspan.plans import syntax
from docspan.plans.syntax import Aggregate, Find
from docspan.relation import Relation


def stream_query(rel: Relation, text: str, collections=None, watermark: tuple[str, str] | None = None, window: str | None = None) -> DataFrame:
    """The streaming result of a find or an aggregate over rel, a relation of a readStream frame.

    watermark: (time column, delay), as in ("ts", "10 minutes"). window: with $group, also groups by tumbling windows of
    that length over the watermark's column, in a column window. The relation's order is not kept; streams have none.
    """
    rel = replace(rel, order=())
    q = syntax.parse(text)
    if watermark:
        rel = rel.with_df(rel.df.withWatermark(*watermark))
    if isinstance(q, Find):
        if q.sort or q.skip > 0 or q.limit > 0:
            raise UnsupportedOperator("a stream can't be sorted or paged; group it first")
        rel = where(rel, q.filter)
        return (stages.project(rel, q.project) if q.project is not None else rel).df
    if not isinstance(q, Aggregate):
        raise QueryError("a stream takes find and aggregate")
    grouped = False
    for op, arg in q.stages:
        if op == "$group":
            if grouped:
                raise UnsupportedOperator("a stream can be grouped once")
            grouped = True
            rel = _group(rel, arg, watermark[0] if watermark and window else None, window)
        elif op in ("$sort", "$skip", "$limit") and not grouped:
            raise UnsupportedOperator(f"{op} on a stream needs a $group before it")
        elif op == "$count":
            grouped = True
            rel = stages.count(rel, arg)
        else:
            if op == "$lookup" and grouped:
                raise UnsupportedOperator("$lookup on a stream comes before $group")
            rel = stages.run_stages(rel, ((op, arg),), collections)
    return rel.df


def _group(rel: Relation, spec: dict, time: str | None, window: str | None) -> Relation:
    if any(isinstance(a, dict) and "$first" in a for a in spec.values()):
        raise UnsupportedOperator("$first needs an order, which streams don't have")
    if time is None:
        return stages.group(rel, spec)
    # the window is one more key
    key, back = stages._key(rel, spec["_id"])
    accs = [{"$sum": F.sum, "$avg": F.avg, "$min": F.min, "$max": F.max}[op](stages._operand(rel, x)).alias(name) for name, acc in spec.items() if name != "_id" for op, x in acc.items()]
    out = rel.df.groupBy(F.window(time, window).alias("window"), key.alias("_key")).agg(*(accs or [F.count(F.lit(1)).alias("_n")]))
    names = [n for n in spec if n != "_id"]
    out = out.select("window", (back if back is not None else F.col("_key")).alias("_id"), *(F.col(f"`{n}`") for n in names))
    return Relation(out, F.col("_id"), out.schema["_id"].dataType)
