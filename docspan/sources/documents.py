"""Documents from JSON and CSV, and back."""

from __future__ import annotations

import csv
import dataclasses
import io
import json
import zlib
from collections.abc import Iterable, Iterator
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspan.errors import QueryError
from docspan.functions.values import NUMERIC_TEXT, Value, json_text
from docspan.relation import DOC, ORD, Relation

MAP = "map<string,variant>"
#: Bytes of JSON that go to the driver as one deflated block; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20


def new_id() -> Column:
    """4 bytes of seconds and 8 random ones, as 24 hexadecimal digits."""
    return F.concat(F.lpad(F.lower(F.hex(F.unix_timestamp())), 8, "0"), F.substring(F.md5(F.uuid()), 1, 16))


def camel(name: str) -> str:
    """userName from user_name or UserName."""
    head, *rest = [p for p in name.split("_") if p] or [name]
    return head[:1].lower() + head[1:] + "".join(p[:1].upper() + p[1:] for p in rest)


def plain(value: Any) -> Any:
    """What JSON can hold: dataclasses become objects with camelCase names, times ISO texts."""
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return {camel(f.name): plain(getattr(value, f.name)) for f in dataclasses.fields(value)}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return value.hex() if isinstance(value, (bytes, bytearray)) else value


def ensure_ids(texts: DataFrame, doc: Column) -> DataFrame:
    """(_id, doc, _n) of a frame with _n: the id is a new one where it is missing, null or blank, and always a text."""
    own = Value(doc, T.VariantType()).child(["_id"])
    given = F.when(F.trim(own.plain()) != "", F.when(own.kind() != "null", own.plain()))
    ided = texts.withColumn(DOC, doc).withColumn("_id", F.coalesce(given, new_id()))
    m = F.try_variant_get(DOC, "$", MAP)
    identity = F.create_map(F.lit("_id"), F.parse_json(json_text(F.col("_id"))))
    whole = F.to_variant_object(F.map_concat(F.map_filter(m, lambda k, _: k != "_id"), identity))
    return ided.select("_id", whole.alias(DOC), "_n")


def from_values(spark: SparkSession, values: Iterable[Any]) -> DataFrame:
    """(_id, doc, _n): documents from objects, dataclasses or JSON texts of one object each."""
    rows = []
    for n, v in enumerate(values):
        v = json.loads(v) if isinstance(v, str) else plain(v)
        if not isinstance(v, dict):
            raise QueryError("a document must be an object")
        rows.append((n, json.dumps(v)))
    frame = spark.createDataFrame(rows, "_n long, t string")
    return ensure_ids(frame, F.parse_json("t"))


def from_frame(df: DataFrame) -> DataFrame:
    """(_id, doc, _n): documents from the rows of any frame."""
    packed = df.select(F.to_json(F.struct("*")).alias("t"), F.monotonically_increasing_id().alias("_n"))
    return ensure_ids(packed, F.parse_json("t"))


def from_json_array(spark: SparkSession, text: str) -> DataFrame:
    values = json.loads(text)
    if not isinstance(values, list):
        raise QueryError("JSON import takes an array of objects")
    return from_values(spark, values)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(_id, doc, _n) of files that hold one object a line or an array of objects each; lines split, arrays don't."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if (lines.limit(1).collect() or [[""]])[0][0].lstrip().startswith("["):
        whole = spark.read.text(path, wholetext=True)
        lines = whole.select(F.explode(F.try_variant_get(F.parse_json("value"), "$", "array<variant>")).alias("v"))
        return ensure_ids(lines.withColumn("_n", F.monotonically_increasing_id()), F.col("v"))
    return ensure_ids(lines.withColumn("_n", F.monotonically_increasing_id()), F.parse_json("value"))


# CSV


def cell(c: Column) -> Column:
    """A cell's JSON text: null for a blank, then boolean, whole number, number, JSON array or object, text."""
    t = F.trim(c)
    quoted = F.to_json(F.struct(c.alias("v")))
    text = F.substring(quoted, F.lit(6), F.length(quoted) - 6)
    whole = F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("long").cast("string"))
    number = F.when(t.rlike(NUMERIC_TEXT) & t.rlike(r"\d") & ~t.contains(","), t.try_cast("double").cast("string"))
    nested = F.when(t.rlike(r"^[\[{]") & F.try_parse_json(t).isNotNull(), t)
    return F.when(c.isNull() | (t == ""), "null").when(F.lower(t).isin("true", "false"), F.lower(t)).otherwise(F.coalesce(whole, number, nested, text))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """(_id, doc, _n) of CSV files with a header; rows of blanks only are left out."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, inferSchema=False)
    return _from_cells(df)


def from_csv_text(spark: SparkSession, text: str) -> DataFrame:
    rows = list(csv.reader(io.StringIO(text.lstrip("﻿"))))
    if not rows:
        return from_values(spark, [])
    names = rows[0]
    body = [tuple((r + [""] * len(names))[: len(names)]) for r in rows[1:]]
    return _from_cells(spark.createDataFrame(body, T.StructType([T.StructField(n, T.StringType()) for n in names])))


def _from_cells(df: DataFrame) -> DataFrame:
    filled = [F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) != "" for c in df.columns]
    some = filled[0]
    for f in filled[1:]:
        some = some | f
    pieces = [F.concat(F.lit(json.dumps(c) + ":"), cell(F.col(f"`{c}`"))) for c in df.columns]
    text = F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}"))
    return ensure_ids(df.where(some).select(text.alias("t"), F.monotonically_increasing_id().alias("_n")), F.parse_json("t"))


def json_rows(rel: Relation) -> DataFrame:
    """(_id, json): each document's compact JSON; _id first, as text, where a typed row has one."""
    if rel.document:
        extra = [c for c in rel.fields if c != DOC]
        text = F.to_json(F.col(DOC))
        if extra:
            m = F.map_concat(F.try_variant_get(DOC, "$", MAP), *(F.create_map(F.lit(c), F.parse_json(F.to_json(F.col(f"`{c}`")))) for c in extra))
            text = F.to_json(F.to_variant_object(m))
        return rel.df.select(rel.id_text().alias("_id"), text.alias("json"))
    fields = [Value(F.col(f"`{c}`"), rel.df.schema[c].dataType) for c in rel.fields]
    named = [(c, v) for c, v in zip(rel.fields, fields, strict=True) if c != "_id"]
    parts = [F.when(v.present(), F.concat(F.lit(json.dumps(c) + ":"), v.raw())) for c, v in named]
    if rel.id is not None:
        parts.insert(0, F.concat(F.lit('"_id":'), Value(rel.id_text(), T.StringType()).raw()))
    return rel.df.select(rel.id_text().alias("_id"), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("json"))


def json_blocks(rel: Relation, prefetch: bool = False) -> Iterator[str]:
    """Each document's compact JSON, in the rows' order, as texts of several with commas between.

    All documents come to the driver, one partition at a time. Their executors deflate them, by blocks, as rows of documents
    repeat names and values: the driver gets a fraction of their bytes and holds one block as text. prefetch: the next
    partition is computed meanwhile.
    """
    limit = BLOCK_BYTES

    def deflated(rows: Iterator) -> Iterator[bytes]:  # goes to the executors by value
        block, size = [], 0
        for r in rows:
            text = r[0].encode()
            if block and size + len(text) > limit:
                yield zlib.compress(b",".join(block))
                block, size = [], 0
            block.append(text)
            size += len(text) + 1
        if block:
            yield zlib.compress(b",".join(block))

    for b in json_rows(rel).select("json").rdd.mapPartitions(deflated).toLocalIterator(prefetch):
        yield zlib.decompress(b).decode()


def json_values(rel: Relation, prefetch: bool = False) -> Iterator[dict]:
    """The documents as dictionaries; see json_blocks()."""
    for block in json_blocks(rel, prefetch):
        yield from json.loads(f"[{block}]")


def to_json_array(rel: Relation) -> str:
    """A compact JSON array; for results that fit in the driver. write_json() writes any number of rows."""
    return "[" + ",".join(json_blocks(rel)) + "]"


def write_json(rel: Relation, path: str) -> None:
    json_rows(rel).select("json").write.mode("errorifexists").text(path)


def columns_of(rel: Relation) -> list[str]:
    """Top-level fields: of typed rows the columns; of documents their keys, by the first document that has them and by name. _id comes first."""
    if not rel.document:
        names = [c for c in rel.fields if c != "_id"]
    else:
        place = F.col(ORD) if ORD in rel.df.columns else F.lit(0)
        keys = rel.df.select(F.explode(F.map_keys(F.try_variant_get(DOC, "$", MAP))).alias("k"), place.alias("at")).groupBy("k").agg(F.min("at").alias("first"))
        names = [r.k for r in sorted(keys.collect(), key=lambda r: (r.first, r.k)) if r.k != "_id"] + [c for c in rel.fields if c != DOC]
    return (["_id"] if rel.id is not None else []) + names


def csv_frame(rel: Relation) -> DataFrame:
    """Text cells: nested values as JSON, nulls and missing ones NULL."""
    def shown(c: str) -> Column:
        if c == "_id":
            return rel.id_text().alias("_id")
        v = rel.resolve(c)
        return F.when(v.kind() != "null", v.plain()).alias(c)

    return rel.df.select(*(shown(c) for c in columns_of(rel)))


def to_csv_text(rel: Relation) -> str:
    df = csv_frame(rel)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    for r in df.toLocalIterator():
        writer.writerow(["" if v is None else v for v in r])
    return out.getvalue()


def write_csv(rel: Relation, path: str) -> None:
    csv_frame(rel).write.csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="")

