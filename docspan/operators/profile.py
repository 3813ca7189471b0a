"""What is in a collection: observed fields, inferred paths, grids of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspan.functions.values import Value
from docspan.relation import DOC, Relation

MAP = "map<string,variant>"
SAMPLE_CHARS = 48


def _entries(rel: Relation) -> DataFrame:
    """(field, kind, shown): a row for each top-level field that a row has."""
    if rel.document:
        rows = rel.df.select(F.explode(F.try_variant_get(DOC, "$", MAP)).alias("field", "_v"))
        v = Value(F.col("_v"), T.VariantType())
        return rows.select("field", v.kind().alias("kind"), v.plain().alias("shown"))
    values = {c: Value(F.col(f"`{c}`"), rel.df.schema[c].dataType) for c in rel.fields}
    cells = F.array(*(F.struct(F.lit(c).alias("field"), v.kind().alias("kind"), v.plain().alias("shown")) for c, v in values.items()))
    return rel.df.select(F.explode(cells).alias("e")).select("e.*").where("kind is not null")


def profile(rel: Relation, samples: int = 3) -> DataFrame:
    """(field, types, present, missing, coverage, samples) of each top-level field, by name; coverage in per cent.

    types: kinds in order, comma-joined; samples: the first distinct texts in order, cut to 48 characters.
    """
    kind = F.when(F.col("kind").isin("true", "false"), "bool").otherwise(F.col("kind"))
    shown = F.substring("shown", 1, SAMPLE_CHARS)
    cells = _entries(rel).select("field", kind.alias("kind"), shown.alias("shown"))
    # the least texts one after another: each step is a minimum with partial states, so that cells are not shuffled
    counts = cells.groupBy("field").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("types"), F.count(F.lit(1)).alias("present"), F.min("shown").alias("_s0"))
    for n in range(1, samples):
        last = counts.select(F.col("field").alias("_f"), F.col(f"_s{n - 1}").alias("_last"))
        last = last if rel.document else F.broadcast(last)  # of typed rows there is one for each column
        step = cells.join(last, F.col("field") == F.col("_f")).where("shown > _last").groupBy("field").agg(F.min("shown").alias(f"_s{n}"))
        counts = counts.join(step, "field", "left")
    few = F.filter(F.array(*(F.col(f"_s{n}") for n in range(samples))), lambda x: x.isNotNull()) if samples > 0 else F.array().cast("array<string>")
    counts = counts.withColumn("samples", F.array_join(few, " | "))
    total = rel.df.agg(F.count(F.lit(1)).alias("_total"))
    out = counts.crossJoin(F.broadcast(total))  # one row
    return out.select("field", "types", "present", (F.col("_total") - F.col("present")).alias("missing"), F.round(F.col("present") * 100.0 / F.col("_total"), 1).alias("coverage"), F.coalesce("samples", F.lit("")).alias("samples"))


def _walk(kind: T.DataType, prefix: str, out: set[str]) -> None:
    if isinstance(kind, T.StructType):
        for f in kind:
            out.add(prefix + f.name)
            _walk(f.dataType, f"{prefix}{f.name}.", out)


def infer_fields(rel: Relation, declared: list[str] = ()) -> list[str]:
    """Sorted dotted paths of objects, together with declared ones."""
    out = set(declared)
    if not rel.document:
        for c in rel.fields:
            out.add(c)
            _walk(rel.df.schema[c].dataType, f"{c}.", out)
        variants = [c for c in rel.fields if isinstance(rel.df.schema[c].dataType, T.VariantType)]
    else:
        variants = [DOC]
    for c in variants:
        merged = rel.df.agg(F.schema_of_variant_agg(c).alias("s")).first().s or ""
        out |= {p if c == DOC else f"{c}.{p}" for p in _paths(merged)}
    return sorted(out)


def _paths(text: str) -> set[str]:
    """The object paths of a merged schema such as OBJECT<a: BIGINT, b: OBJECT<c: STRING>>."""
    out: set[str] = set()
    at = 0

    def kind(prefix: str | None) -> None:
        nonlocal at
        start = at
        while at < len(text) and text[at] not in "<>,(":
            at += 1
        name = text[start:at].strip()
        if at < len(text) and text[at] == "(":
            at = text.index(")", at) + 1
        if at < len(text) and text[at] == "<":
            at += 1
            if name.startswith("OBJECT"):
                while at < len(text) and text[at] != ">":
                    while text[at] in ", ":
                        at += 1
                    if text[at] == "`":
                        end = text.index("`", at + 1)
                        key, at = text[at + 1 : end], end + 1
                    else:
                        end = text.index(":", at)
                        key, at = text[at:end].strip(), end
                    at = text.index(":", at) + 1
                    while text[at] == " ":
                        at += 1
                    path = None if prefix is None else f"{prefix}{key}"
                    if path is not None:
                        out.add(path)
                    kind(None if path is None else f"{path}.")
            else:
                kind(None)  # objects in arrays have no paths
            if at < len(text) and text[at] == ">":
                at += 1

    kind("")
    return out


def grid(rel: Relation, paths: list[str]) -> DataFrame:
    """A text cell for each path; missing is the empty text."""
    return rel.df.select(*(F.coalesce(rel.resolve(p).plain() if not rel.resolve(p).missing else F.lit(None).cast("string"), F.lit("")).alias(p) for p in paths))


def find_in_page(rel: Relation, text: str, paths: list[str]) -> Relation:
    """The rows whose id, JSON or shown cells contain the text, in any case."""
    needle = (text or "").strip().lower()
    if not needle:
        return rel
    cells = [rel.resolve(p).plain() for p in paths if not rel.resolve(p).missing]
    raw = [F.to_json(F.col(DOC))] if rel.document else [F.to_json(F.struct(*(F.col(f"`{c}`") for c in rel.fields)))]
    hay = F.concat_ws("\n", rel.id_text(), *raw, *cells)
    return rel.with_df(rel.df.where(F.lower(hay).contains(needle)))
