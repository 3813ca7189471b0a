"""Registered queries over stored databases: the driver's tables are written as documents to a shared folder and used there.

Each query builds its own database, so each shows the writes that its name says, and returns rows that SQL can check. Facts
that are no tables (names, messages, numbers of affected documents) come as rows of texts.
"""

from __future__ import annotations

import contextlib
import io
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspan import assist, cli
from docspan.database import Column_, Database, declared, open_database, parse_cell
from docspan.errors import DocspanError
from docspan.objects import Document, document_from_cells, tree, tree_rows, typed_frame
from docspan.operators.browse import sort_page
from docspan.plans import syntax
from docspan.relation import Relation
from docspan.session import parquet_tables
from docspan.sources import documents as sources
from docspan.sources.storage import scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


@dataclass
class Stage:
    """What a query works with."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return parquet_tables(self.spark, self.folder).relation(name).df

    def db(self, path: str | None = None, **options: Any) -> Database:
        return Database(self.spark, path or self.path(), **options)

    def path(self) -> str:
        return scratch_folder(self.spark, "docspan-db")

    def filled(self, table: str, id: str | None, **options: Any) -> Database:
        """A database with a collection of that table's rows; id: the column that becomes _id."""
        db = self.db(**options)
        df = self.table(table)
        db[table].insert_frame(df if id is None else df.withColumn("_id", F.col(id).cast("string")))
        return db


def add(name: str, sql: str, run: Callable[[Stage], DataFrame] | None = None):
    def register(run: Callable[[Stage], DataFrame]):
        QUERIES[name] = lambda spark, folder: run(Stage(spark, folder))
        SQL[name] = sql
        return run

    return register if run is None else register(run)


def facts(name: str, sql: str):
    """A query that gives (fact, value) pairs; sql: SELECTs of such pairs."""

    def register(run: Callable[[Stage], Iterable[tuple[str, Any]]]):
        def rows(s: Stage) -> DataFrame:
            return s.spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in run(s)], "fact string, value string")

        QUERIES[name] = lambda spark, folder: rows(Stage(spark, folder))
        SQL[name] = f"select fact, cast(value as varchar) as value from ({sql}) x(fact, value)"
        return run

    return register


def pairs(**values: Any) -> str:
    """SQL of facts that don't depend on the tables."""
    return " union all ".join(f"select '{k}', '{(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)).replace(chr(39), chr(39) * 2)}'" for k, v in values.items())


def show(rel: Relation, *specs: str) -> DataFrame:
    """Native columns of paths, given as path:type."""
    out = []
    for spec in specs:
        path, kind = spec.rsplit(":", 1)
        v = rel.resolve(path)
        c = {"text": v.text, "double": v.number, "bool": lambda v=v: F.when(v.kind() == "true", True).when(v.kind() == "false", False)}.get(kind, lambda v=v, kind=kind: v.number().cast(kind))()
        out.append(c.alias(path.replace(".", "_")))
    return rel.df.select(*out)


def refused(call: Callable[[], Any]) -> str:
    """The error's kind, or what came back."""
    try:
        return f"allowed: {call()}"
    except DocspanError as e:
        return type(e).__name__


NATION = ("n_nationkey:int", "n_name:text", "n_regionkey:int")

# inserts, replacing, removing


@add("stored_insert_frame", "select n_nationkey, n_name, n_regionkey from nation")
def _(s: Stage) -> DataFrame:
    return show(s.filled("nation", "n_nationkey")["nation"].relation(), *NATION)


@add("stored_insert_one", "select * from (values ('Ada', 24, false), ('Ben', 1, true), ('Cy', 24, false)) t(name, id_length, given)")
def _(s: Stage) -> DataFrame:
    c = s.db()["people"]
    for d in ('{"name": "Ada"}', {"_id": 7, "name": "Ben"}, {"_id": "  ", "name": "Cy"}):
        c.insert(d)
    return c.relation().df.select(c.relation().resolve("name").text().alias("name"), F.length("_id").alias("id_length"), (F.col("_id") == "7").alias("given"))


@facts("stored_insert_many", f"{pairs(first=3, clash='DuplicateId', inner='DuplicateId', after=3, made=2, all=5)}")
def _(s: Stage):
    c = s.db()["items"]
    yield "first", c.insert_many([{"_id": str(i)} for i in range(3)])
    yield "clash", refused(lambda: c.insert_many([{"_id": "9"}, {"_id": 1}]))
    yield "inner", refused(lambda: c.insert_many([{"_id": "x"}, {"_id": "x"}]))
    yield "after", c.count()
    yield "made", c.insert_many([{}, {"_id": None}])
    yield "all", c.count()


@add("stored_replace", "select n_nationkey, case when n_nationkey = 3 then 'new' else n_name end as n_name, case when n_nationkey = 3 then null else n_regionkey end as n_regionkey from nation")
def _(s: Stage) -> DataFrame:
    c = s.filled("nation", "n_nationkey")["nation"]
    c.replace({"_id": "3", "n_nationkey": 3, "n_name": "new"})
    return show(c.relation(), *NATION)


@facts("stored_replace_errors", pairs(none="NotFound", no_id="NotFound"))
def _(s: Stage):
    c = s.filled("region", "r_regionkey")["region"]
    yield "none", refused(lambda: c.replace({"_id": "99"}))
    yield "no_id", refused(lambda: c.replace({"a": 1}))


@add("stored_update", "select p_partkey, case when p_size > 40 then 'big' end as mark, case when p_size > 40 then p_size + 1 else p_size end as p_size from part")
def _(s: Stage) -> DataFrame:
    db = s.filled("part", "p_partkey")
    db.execute('db.part.update({ p_size: { $gt: 40 } }, { $set: { mark: "big" }, $inc: { p_size: 1 } })')
    return show(db["part"].relation(), "p_partkey:long", "mark:text", "p_size:int")


@add("stored_update_nested", "select n_nationkey, case when n_regionkey = 1 then n_nationkey * 2 end as at_n, case when n_regionkey = 1 then 2 else 0 end as tags from nation")
def _(s: Stage) -> DataFrame:
    c = s.filled("nation", "n_nationkey")["nation"]
    c.update({"n_regionkey": 1}, {"$set": {"at.x.y": True}, "$push": {"tags": "a"}})
    c.update({"n_regionkey": 1}, {"$push": {"tags": {"b": 1}}, "$unset": {"at.x": "", "no.such": ""}})
    rel = c.relation()
    size = F.coalesce(F.size(F.try_variant_get(rel.resolve("tags").column, "$", "array<variant>")), F.lit(0))
    emptied = F.when(rel.resolve("at").raw() == "{}", rel.resolve("n_nationkey").number().cast("int") * 2)
    return rel.df.select(rel.resolve("n_nationkey").number().cast("int").alias("n_nationkey"), emptied.alias("at_n"), F.greatest(size, F.lit(0)).alias("tags"))


@facts(
    "stored_affected",
    "select 'update', count(*) from supplier where s_nationkey = 3 union all select 'no change', count(*) from supplier union all select 'delete', count(*) from supplier where s_acctbal < 0 union all select 'left', count(*) from supplier where s_acctbal >= 0",
)
def _(s: Stage):
    db = s.filled("supplier", "s_suppkey")
    yield "update", db.execute("db.supplier.update({ s_nationkey: 3 }, { $set: { near: true } })").affected
    yield "no change", db.execute("db.supplier.update({})").affected
    yield "delete", db.execute("db.supplier.delete({ s_acctbal: { $lt: 0 } })").affected
    yield "left", db["supplier"].count()


@add("stored_delete", "select n_nationkey, n_name, n_regionkey from nation where n_regionkey <> 2")
def _(s: Stage) -> DataFrame:
    c = s.filled("nation", "n_nationkey")["nation"]
    c.delete("{ n_regionkey: 2 }")
    return show(c.relation(), *NATION)


@facts("stored_delete_by_id", f"{pairs(first=True, again=False)} union all select 'left', count(*) - 1 from region")
def _(s: Stage):
    c = s.filled("region", "r_regionkey")["region"]
    yield "first", c.delete_by_id(2)
    yield "again", c.delete_by_id("2")
    yield "left", c.count()


@facts("stored_clone", f"{pairs(new=True, name=True, missing='NotFound')} union all select 'all', count(*) + 1 from region")
def _(s: Stage):
    c = s.filled("region", "r_regionkey")["region"]
    own = c.clone("1")
    yield "new", len(own) == 24
    yield "name", c.get(own)["r_name"] == c.get(1)["r_name"]
    yield "missing", refused(lambda: c.clone("99"))
    yield "all", c.count()


# reading


@facts("stored_get", pairs(seven={"_id": "7", "k": 1}, padded={"_id": "007", "k": 2}, none=None, found=["7"], some=["007", "7"], others=["007", "x"]))
def _(s: Stage):
    c = s.db()["t"]
    c.insert_many([{"_id": "7", "k": 1}, {"_id": "007", "k": 2}, {"_id": "x", "k": 3}])
    yield "seven", c.get(7)
    yield "padded", c.get("007")
    yield "none", c.get("07")
    yield "found", [d["_id"] for d in c.find('{ _id: "7" }').to_list()]
    yield "some", sorted(d["_id"] for d in c.find({"_id": {"$in": [7, "007", "7.0"]}}).to_list())
    yield "others", sorted(d["_id"] for d in c.find({"_id": {"$ne": 7}}).to_list())


@add("stored_index_range", "select o_orderkey, o_totalprice from orders where o_totalprice >= 300000 and o_totalprice < 320000")
def _(s: Stage) -> DataFrame:
    c = s.filled("orders", "o_orderkey")["orders"]
    c.ensure_index("o_totalprice")
    return show(c.find({"o_totalprice": {"$gte": 300000, "$lt": 320000}}).run(), "o_orderkey:long", "o_totalprice:double")


@add("stored_index_compound", "select c_custkey, c_name from customer where c_mktsegment = 'BUILDING' and c_nationkey = 7")
def _(s: Stage) -> DataFrame:
    c = s.filled("customer", "c_custkey")["customer"]
    c.ensure_index(["c_mktsegment", "c_nationkey"])
    return show(c.find({"c_mktsegment": "BUILDING", "c_nationkey": 7}).run(), "c_custkey:long", "c_name:text")


@add("stored_index_prefix", "select c_custkey, c_nationkey from customer where c_mktsegment > 'FURNITURE'")
def _(s: Stage) -> DataFrame:
    c = s.filled("customer", "c_custkey")["customer"]
    c.ensure_index(["c_mktsegment", "c_nationkey"])
    return show(c.find({"c_mktsegment": {"$gt": "FURNITURE"}}).run(), "c_custkey:long", "c_nationkey:int")


@add("stored_index_kinds", "select * from (values ('a', 5.0), ('b', 7.0), ('e', null)) t(_id, v)")
def _(s: Stage) -> DataFrame:
    """An indexed path with values of all kinds compares as it does without the index."""
    c = s.db()["t"]
    c.insert_many([{"_id": "a", "v": 5}, {"_id": "b", "v": " 7 "}, {"_id": "c", "v": 50}, {"_id": "d", "v": [1]}, {"_id": "e", "v": "x"}, {"_id": "f"}, {"_id": "g", "v": None}, {"_id": "h", "v": True}])
    c.ensure_index("v")
    rel = c.find({"v": {"$lt": 10}}).run()
    return rel.df.select("_id", rel.resolve("v").number().alias("v"))


@add("stored_index_writes", "select n_nationkey from nation where n_regionkey = 3 or n_nationkey < 4")
def _(s: Stage) -> DataFrame:
    """Indexes hold after inserts, updates and deletes."""
    c = s.db()["nation"]
    c.ensure_index("n_regionkey")
    df = s.table("nation").withColumn("_id", F.col("n_nationkey").cast("string"))
    c.insert_frame(df.where("n_nationkey < 10"))
    c.insert_frame(df.where("n_nationkey >= 10"))
    c.update({"n_nationkey": {"$lt": 4}}, {"$set": {"n_regionkey": 30}})
    c.delete({"n_regionkey": 2})
    return show(c.find({"n_regionkey": {"$in": [3, 30]}}).run(), "n_nationkey:int")


@facts(
    "stored_indexes",
    pairs(
        made=["n_regionkey", "at_n_regionkey_n_name", "n_regionkey"],
        list=[["_id_", "_id", True], ["n_regionkey", "n_regionkey", False], ["at_n_regionkey_n_name", "n_regionkey,n_name", False]],
        dropped=[True, False],
        identity="DocspanError",
        left=["_id_", "at_n_regionkey_n_name"],
    ),
)
def _(s: Stage):
    c = s.filled("nation", "n_nationkey")["nation"]
    yield "made", [c.ensure_index("n_regionkey"), c.ensure_index(["n_regionkey", "n_name"], "at_n_regionkey_n_name"), c.ensure_index("n_regionkey", "other")]
    yield "list", [[i["name"], i["path"], i["unique"]] for i in c.indexes()]
    yield "dropped", [c.drop_index("n_regionkey"), c.drop_index("n_regionkey")]
    yield "identity", refused(lambda: c.drop_index("_id_"))
    yield "left", [i["name"] for i in c.indexes()]


@facts("stored_unique_index", pairs(insert="DuplicateId", update="DuplicateId", absent=True, late="DuplicateId", kept=5, indexes=1))
def _(s: Stage):
    db = s.db()
    c = db["u"]
    c.insert_many([{"e": "a"}, {"e": "b"}, {"x": 1}, {"x": 2}])
    c.ensure_index("e", unique=True)
    yield "insert", refused(lambda: c.insert({"e": "a"}))
    yield "update", refused(lambda: c.update({"x": {"$exists": True}}, {"$set": {"e": "q"}}))
    yield "absent", len(c.insert({"x": 3})) == 24
    d = db["v"]
    d.insert_many([{"e": 1}, {"e": "1.0"}])
    yield "late", refused(lambda: d.ensure_index("e", unique=True))
    yield "kept", c.count()
    yield "indexes", len(d.indexes())


@facts(
    "stored_explain",
    "select 'id', 'ID  examined=1  returned=1  index=none' union all select 'range', 'IXSCAN  examined=' || n || '  returned=' || n || '  index=p_size' from (select count(*) as n from part where p_size >= 45) "
    "union all select 'limit', 'IXSCAN  examined=5  returned=5  index=p_size' union all select 'compound', 'IXSCAN  examined=' || n || '  returned=' || n || '  index=p_brand_p_size' from (select count(*) as n from part where p_brand = 'Brand#11' and p_size = 7) "
    "union all select 'scan', 'COLLSCAN  examined=' || a || '  returned=' || b || '  index=none' from (select count(*) as a, count(*) filter (where p_retailprice > 1500) as b from part)",
)
def _(s: Stage):
    c = s.filled("part", "p_partkey")["part"]
    c.ensure_index("p_size")
    c.ensure_index(["p_brand", "p_size"])
    yield "id", c.explain({"_id": "7"}).text()
    yield "range", c.explain({"p_size": {"$gte": 45}}).text()
    yield "limit", c.explain({"p_size": {"$gte": 45}}, 0, 5).text()
    yield "compound", c.explain({"p_brand": "Brand#11", "p_size": 7}).text()
    yield "scan", c.explain({"p_retailprice": {"$gt": 1500}}).text()


@facts(
    "stored_explain_statements",
    pairs(
        aggregate="AGGREGATE  collection=region  returned=0",
        update="UPDATE  collection=region  affected=0",
        delete="DELETE  collection=region  affected=3",
        find="ID  examined=1  returned=1  index=none",
        untouched=True,
    ),
)
def _(s: Stage):
    db = s.filled("region", "r_regionkey")
    n = db["region"].count()
    yield "aggregate", db.explain('db.region.aggregate([{ $count: "n" }])').text()
    yield "update", db.explain("db.region.update({}, { $set: { a: 1 } })").text()
    yield "delete", db.explain("db.region.delete({})").text(3)
    yield "find", db.explain('db.region.find({ _id: "1" }).sort({ r_name: 1 })').text()
    yield "untouched", db["region"].count() == n


@facts("stored_counts", "select 'all', count(*) from customer union all select 'some', count(*) from customer where c_acctbal < 0 union all select 'none', 0 union all select 'unknown', 0")
def _(s: Stage):
    db = s.filled("customer", "c_custkey")
    yield "all", len(db["customer"])
    yield "some", db["customer"].count({"c_acctbal": {"$lt": 0}})
    yield "none", db["customer"].count({"nothing": 1})
    yield "unknown", db["nowhere"].count()


@facts("stored_iterate", "select 'documents', count(*) from customer union all select 'keys', sum(c_custkey)::bigint from customer union all select 'ordered', 'true'")
def _(s: Stage):
    c = s.filled("customer", "c_custkey")["customer"]
    n = keys = 0
    for d in c.iterate():
        n, keys = n + 1, keys + d["c_custkey"]
    yield "documents", n
    yield "keys", keys
    c.insert({"_id": "last", "c_custkey": -1})
    yield "ordered", [d["_id"] for d in c.find().skip(n).limit(1).to_list()] == ["last"]


@add("stored_stage_order", "select n_nationkey from nation where n_nationkey between 3 and 9")
def _(s: Stage) -> DataFrame:
    """$skip and $limit follow the order of insertion, whatever the layout of the files."""
    c = s.db()["nation"]
    c.ensure_index("n_name")
    for r in [range(0, 8), range(8, 25)]:
        c.insert_many([{"_id": f"{97 * k % 25}", "n_nationkey": k, "n_name": chr(122 - k)} for k in r])
    return show(c.db.execute("db.nation.aggregate([{ $skip: 3 }, { $limit: 7 }])").relation, "n_nationkey:int")


@add("stored_group_lookup", "select r_name as region, cast(count(n_nationkey) as double) as n from region left join nation on r_regionkey = n_regionkey group by 1")
def _(s: Stage) -> DataFrame:
    db = s.filled("nation", "n_nationkey")
    db["region"].insert_frame(s.table("region").withColumn("_id", F.col("r_regionkey").cast("string")))
    rel = db.execute('db.region.aggregate([{ $lookup: { from: "nation", localField: "r_regionkey", foreignField: "n_regionkey", as: "nations" } }])').relation
    return rel.df.select(rel.resolve("r_name").text().alias("region"), F.size("nations").cast("double").alias("n"))


@facts("stored_lookup_cap", f"{pairs(over='DocspanError')} union all select 'off', count(*) from region")
def _(s: Stage):
    db = s.filled("nation", "n_nationkey", lookup_cap=3)
    db["region"].insert_frame(s.table("region").withColumn("_id", F.col("r_regionkey").cast("string")))
    text = 'db.region.aggregate([{ $lookup: { from: "nation", localField: "r_regionkey", foreignField: "n_regionkey", as: "n" } }, { $project: { n: 1 } }])'
    yield "over", refused(lambda: db.execute(text))
    db.lookup_cap = 0
    yield "off", db.execute(text).df.count()


# import and export


@add("stored_import_json", "select * from (values ('1', 'Ada', 36), ('2', 'Ben', null), ('3', null, 41)) t(_id, name, age)")
def _(s: Stage) -> DataFrame:
    c = s.db()["people"]
    c.import_json('[{"_id": 1, "name": "Ada", "age": 36}, {"_id": "2", "name": "Ben"}, {"_id": "3", "age": 41, "name": null}]')
    rel = c.relation()
    return rel.df.select("_id", rel.resolve("name").text().alias("name"), rel.resolve("age").number().cast("int").alias("age"))


@add("stored_json_files", "select c_custkey, c_name, c_acctbal from customer")
def _(s: Stage) -> DataFrame:
    c, path = s.filled("customer", "c_custkey")["customer"], s.path()
    sources.write_json(c.relation(), path)
    d = c.db["copy"]
    d.import_json_files(path)
    return show(d.relation(), "c_custkey:long", "c_name:text", "c_acctbal:double")


@add("stored_csv_files", "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def _(s: Stage) -> DataFrame:
    c, path = s.filled("supplier", "s_suppkey")["supplier"], s.path()
    sources.write_csv(c.relation(), path)
    d = c.db["copy"]
    d.import_csv_files(path)
    return show(d.relation(), "s_suppkey:long", "s_name:text", "s_nationkey:int", "s_acctbal:double")


@facts("stored_export", pairs(json='[{"_id":"1","b":"x, y","c":[1]},{"_id":"2","a":true}]', csv='_id,b,c,a\n1,"x, y",[1],\n2,,,true\n', found='_id,a\n2,true\n', back=2))
def _(s: Stage):
    c = s.db()["t"]
    c.insert_many([{"_id": "1", "b": "x, y", "c": [1]}, {"_id": "2", "a": True}])
    yield "json", c.export_json()
    yield "csv", c.export_csv()
    yield "found", c.export_csv({"a": True})
    yield "back", c.db["u"].import_csv(c.export_csv())


@add("stored_files", "select doc_id, strlen(text) as length, md5(text) as md5 from documents where strlen(text) > 0 and doc_id % 10 = 3")
def _(s: Stage) -> DataFrame:
    """The file store: uploads of a frame, metadata and contents."""
    db = s.db()
    docs = s.table("documents").where("length(text) > 0 and doc_id % 10 = 3")
    db.files.upload_frame(docs.select(F.col("doc_id").cast("string").alias("_id"), F.concat("source", F.lit(".txt")).alias("filename"), F.col("text").cast("binary").alias("content")), 2048)
    meta = db["fs.files"].relation()
    sizes = meta.df.select(F.col("_id").alias("files_id"), meta.resolve("length").number().cast("long").alias("length"))
    return sizes.join(db.files.contents(), "files_id").select(F.col("files_id").cast("long").alias("doc_id"), "length", F.md5("content").alias("md5"))


@facts("stored_file", pairs(metadata=["a.txt", 6000, 1024, True], chunks=6, same=True, none=False, empty=[0, 0], date=True))
def _(s: Stage):
    db, data = s.db(), b"hello world!" * 500
    own = db.files.upload("a.txt", data, chunk_size=4)
    meta = db.files.metadata(own)
    yield "metadata", [meta["filename"], meta["length"], meta["chunkSize"], meta["_id"] == own]
    yield "chunks", db["fs.chunks"].count()
    out = io.BytesIO()
    db.files.download(own, out)
    yield "same", out.getvalue() == data
    yield "none", db.files.download("none", io.BytesIO())
    empty = db.files.upload("e", b"")
    yield "empty", [db.files.metadata(empty)["length"], db["fs.chunks"].count({"files_id": empty})]
    yield "date", len(meta["uploadDate"]) == 28 and meta["uploadDate"].endswith("Z")


# catalog and declared columns


@facts(
    "stored_catalog",
    pairs(empty=[], names=["a", "b"], renamed=["b", "c"], gone="NotFound", taken="DocspanError", dropped=["c"], absent=None, long="DocspanError", reserved="DocspanError", hidden="DocspanError", to_hidden="DocspanError"),
)
def _(s: Stage):
    db = s.db()
    db["nothing"].count()
    yield "empty", db.collection_names()
    db["a"].insert({"x": 1})
    db["b"].insert({"x": 2})
    yield "names", db.collection_names()
    db.rename("a", "c")
    yield "renamed", db.collection_names()
    yield "gone", refused(lambda: db.rename("a", "d"))
    yield "taken", refused(lambda: db.rename("b", "c"))
    db.drop("b")
    yield "dropped", db.collection_names()
    yield "absent", db.drop("b")
    yield "long", refused(lambda: db.collection("x" * 121))
    yield "reserved", refused(lambda: db.create("__schema"))
    yield "hidden", refused(lambda: db.drop("fs.files"))
    yield "to_hidden", refused(lambda: db.rename("c", "fs.chunks"))


@facts(
    "stored_declared",
    pairs(
        columns=[["name", "TEXT"], ["age", "INTEGER"], ["odd", "TEXT"]],
        record={"name": "", "age": 21, "odd": ""},
        defaults={"_id": "1", "age": 21, "name": "A", "odd": ""},
        added={"_id": "1", "age": 21, "name": "A", "odd": "", "on": True},
        renamed={"_id": "1", "name": "A", "odd": "", "on": True, "years": 21},
        dropped={"_id": "1", "name": "A", "on": True, "years": 21},
        applied=[["name", "TEXT"], ["born", "INTEGER"], ["extra", "REAL"]],
        document={"_id": "1", "born": 21, "extra": 0, "name": "A"},
        fields=["_id", "born", "extra", "name"],
        again="DocspanError",
    ),
)
def _(s: Stage):
    db = s.db()
    c = db.create("users", [{"name": " name "}, {"name": "age", "type": "integer", "default": "21"}, {"name": "_id"}, {"name": "age"}, {"name": "$x"}, {"name": "odd", "type": "??"}])
    yield "columns", [[x.name, x.type] for x in c.columns()]
    yield "record", c.new_record()
    c.insert({"_id": "1", "name": "A"})
    yield "defaults", c.get("1")
    c.add_column(Column_("on", "BOOLEAN", "yes"))
    yield "added", c.get("1")
    c.rename_column("age", "years")
    yield "renamed", c.get("1")
    c.drop_column("odd")
    yield "dropped", c.get("1")
    c.apply_definition([{"name": "name"}, {"name": "born", "type": "INTEGER"}, {"name": "extra", "type": "REAL"}], {"years": "born"})
    yield "applied", [[x.name, x.type] for x in c.columns()]
    yield "document", c.get("1")
    yield "fields", c.fields()
    yield "again", refused(lambda: db.create("users"))


@add("stored_add_column", "select n_nationkey, 21 as age from nation")
def _(s: Stage) -> DataFrame:
    c = s.filled("nation", "n_nationkey")["nation"]
    c.add_column({"name": "age", "type": "INTEGER", "default": "21"})
    return show(c.relation(), "n_nationkey:int", "age:int")


@add("stored_rename_column", "select n_nationkey, n_name as title, cast(null as varchar) as n_name from nation")
def _(s: Stage) -> DataFrame:
    c = s.filled("nation", "n_nationkey")["nation"]
    c.ensure_index("n_name")
    c.rename_column("n_name", "title")
    return show(c.relation(), "n_nationkey:int", "title:text", "n_name:text")


@add("stored_drop_column", "select n_nationkey, cast(null as integer) as n_regionkey, n_name from nation")
def _(s: Stage) -> DataFrame:
    c = s.filled("nation", "n_nationkey")["nation"]
    c.ensure_index("n_regionkey")
    c.drop_column("n_regionkey")
    return show(c.relation(), "n_nationkey:int", "n_regionkey:int", "n_name:text")


@facts("stored_fields", "select 'fields', '[\"_id\", \"n_name\", \"n_nationkey\", \"n_regionkey\"]' union all select 'nested', '[\"_id\", \"a\", \"a.b\", \"a.b.c\", \"d\", \"later\"]'")
def _(s: Stage):
    db = s.filled("nation", "n_nationkey")
    yield "fields", db["nation"].fields()
    c = db.create("t", [{"name": "later"}])
    c.insert_many([{"_id": "1", "a": {"b": {"c": 1}}}, {"_id": "2", "d": [{"no": 1}]}])
    yield "nested", c.fields()


@add("stored_profile", "select * from (values ('_id', 'string', 2, 0, 100.0, '1 | 2'), ('age', 'number', 1, 1, 50.0, '3'), ('on', 'bool,null', 2, 0, 100.0, 'null | true')) t(field, types, present, missing, coverage, samples)")
def _(s: Stage) -> DataFrame:
    c = s.db()["p"]
    c.insert_many([{"_id": "1", "on": True, "age": 3}, {"_id": "2", "on": None}])
    return c.profile().select("field", "types", F.col("present").cast("int").alias("present"), F.col("missing").cast("int").alias("missing"), F.col("coverage").cast("decimal(4,1)").alias("coverage"), "samples")


@facts("stored_stats", "select 'collections', 2 union all select 'documents', (select count(*) from nation) + 1 union all select 'some bytes', 'true' union all select 'tree', '[[\"nation\", ' || (select count(*) from nation) || ', [\"_id_\", \"n_name\"]], [\"one\", 1, [\"_id_\"]]]'")
def _(s: Stage):
    db = s.filled("nation", "n_nationkey")
    db["one"].insert({"_id": "1"})
    db["nation"].ensure_index("n_name")
    stats = db.stats()
    yield "collections", stats["collections"]
    yield "documents", stats["documents"]
    yield "some bytes", stats["bytes"] > 0
    yield "tree", [[t["collection"], t["count"], t["indexes"]] for t in db.tree()]


# transactions, snapshots, safety


@facts("stored_transactions", pairs(committed=["orders", "users"], inside=0, others=1, after=1, left=["orders", "users"], same=True, ended="DocspanError", kept=[2, 2]))
def _(s: Stage):
    db = s.db()
    with db.begin() as t:
        db["orders"].insert({"_id": "o"})
        db["users"].insert({"_id": "u"})
        t.commit()
    yield "committed", db.collection_names()
    t = db.begin()
    db["users"].delete()
    yield "inside", db["users"].count()
    yield "others", s.db(db.path)["users"].count()
    t.rollback()
    yield "after", db["users"].count()
    with db.begin():
        db["more"].insert({})
    yield "left", db.collection_names()
    t = db.begin()
    yield "same", db.begin() is t
    db["users"].insert({"_id": "v"})
    db.checkpoint()  # keeps what is staged
    t.commit()
    yield "ended", refused(t.commit)
    yield "kept", [db["users"].count(), s.db(db.path)["users"].count()]


@facts("stored_compact", f"{pairs(inside='DocspanError', rolled_back=True, folders=1, reader=True, indexes=['_id_', 'n_name'])} union all select 'documents', count(*) from nation where n_regionkey <> 1")
def _(s: Stage):
    db = s.filled("nation", "n_nationkey")
    c = db["nation"]
    c.ensure_index("n_name")
    n = c.count()
    reader = s.db(db.path)
    t = db.begin()
    c.insert({"_id": "staged"})
    yield "inside", refused(db.compact)
    t.rollback()
    yield "rolled_back", s.db(db.path)["nation"].count() == n == c.count()
    c.insert_many([{"_id": "x1", "n_regionkey": 1}, {"_id": "x2", "n_regionkey": 1}])
    c.delete({"n_regionkey": 1})
    db.compact()
    yield "folders", len(c.entry["folders"])
    yield "reader", reader["nation"].count() == n
    yield "indexes", [i["name"] for i in c.indexes()]
    yield "documents", c.count()


@add("stored_backup_restore", "select n_nationkey, n_name, n_regionkey from nation")
def _(s: Stage) -> DataFrame:
    db, copy, back = s.filled("nation", "n_nationkey"), s.path(), s.path()
    db.backup(copy)
    db["nation"].delete()
    return show(Database.restore(s.spark, copy, back)["nation"].relation(), *NATION)


@facts("stored_restore_errors", f"{pairs(backup='DocspanError', restore='DocspanError', missing='NotFound')} union all select 'overwritten', count(*) from region")
def _(s: Stage):
    db, copy = s.filled("region", "r_regionkey"), s.path()
    db.backup(copy)
    yield "backup", refused(lambda: db.backup(copy))
    yield "restore", refused(lambda: Database.restore(s.spark, copy, db.path))
    yield "missing", refused(lambda: Database.restore(s.spark, s.path(), s.path()))
    db["region"].delete()
    yield "overwritten", Database.restore(s.spark, copy, db.path, overwrite=True)["region"].count()


@facts("stored_opening", pairs(missing="NotFound", writer="DocspanError", retried=2, snapshot=1, read_only="DocspanError", exclusive="DocspanError", freed=2, made=0))
def _(s: Stage):
    yield "missing", refused(lambda: s.db(s.path(), create=False))
    db = s.db(exclusive=True)
    other = s.db(db.path)
    db["a"].insert({"x": 1})
    old = s.db(db.path)
    yield "writer", refused(lambda: other["a"].insert({"x": 2}))
    other.refresh()
    other["a"].insert({"x": 2})
    yield "retried", other["a"].count()
    yield "snapshot", old["a"].count()
    yield "read_only", refused(lambda: s.db(db.path, read_only=True)["a"].insert({}))
    yield "exclusive", refused(lambda: s.db(db.path, exclusive=True))
    db.close()
    with s.db(db.path, exclusive=True, verify=True) as again:
        yield "freed", again["a"].count()
    yield "made", open_database(s.spark, s.path(), create=True)["a"].count()


@facts("stored_verify", f"{pairs(changed='IntegrityError', gone='IntegrityError')} union all select 'documents', count(*) from region")
def _(s: Stage):
    db = s.filled("region", "r_regionkey")
    yield "documents", db.verify()
    folder = db["region"].entry["folders"][0]
    sums = dict(db["region"].entry["sums"])
    sums[folder] = [sums[folder][0], sums[folder][1] + 1]
    db["region"]._change(sums=sums)
    yield "changed", refused(db.verify)
    db.store.delete(folder)
    yield "gone", refused(db.verify)


@facts("stored_encrypted", f"{pairs(none='EncryptionError', wrong='EncryptionError', plain=False, rekeyed='EncryptionError', probe=True)} union all select 'read', count(*) from region where r_regionkey > 1 union all select 'new key', count(*) from region")
def _(s: Stage):
    from docspan.sources.encryption import Vault

    db = s.filled("region", "r_regionkey", passphrase="one")
    yield "none", refused(lambda: s.db(db.path))
    yield "wrong", refused(lambda: s.db(db.path, passphrase="two"))
    yield "read", s.db(db.path, passphrase="one")["region"].count({"r_regionkey": {"$gt": 1}})
    raw = s.spark.read.parquet(f"{db.store.root}/{db['region'].entry['folders'][0]}").select(F.max(F.col("doc").cast("string").contains("r_name")).alias("x")).first().x
    yield "plain", bool(raw)
    db.change_passphrase("three")
    yield "rekeyed", refused(lambda: s.db(db.path, passphrase="one"))
    yield "new key", s.db(db.path, passphrase="three")["region"].count()
    yield "probe", Vault.is_encrypted(s.spark, db.path)


# tools


@facts(
    "tools_statements",
    f"{pairs(operation=['find', 'aggregate', 'update', 'delete'], parts=[{'a': 'x,}'}, {'$set': {'b': 1}}], default={}, bad='QueryError', unknown='UnsupportedOperator')} union all select 'list', '[' || string_agg(n_nationkey, ', ' order by n_nationkey) || ']' from nation where n_regionkey = 4",
)
def _(s: Stage):
    db = s.filled("nation", "n_nationkey")
    texts = ["db.nation.find({})", 'db.nation.aggregate([{ $count: "n" }])', "db.nation.update({ n_regionkey: 9 }, {})", "db.nation.delete({ n_regionkey: 9 })"]
    yield "operation", [db.execute(t).operation for t in texts]
    two = syntax.parse('db.t.update({ a: "x,}" }, { $set: { b: 1 } })')
    yield "parts", [{two.filter.path: two.filter.value}, two.changes]
    yield "default", syntax.parse("db.t.update({ a: 1 })").changes
    yield "bad", refused(lambda: db.execute("db.nation.find({ a: )"))
    yield "unknown", refused(lambda: db.execute("db.nation.find({ a: { $near: 1 } })"))
    yield "list", [d["n_nationkey"] for d in db.query("db.nation.find({ n_regionkey: 4 }).sort({ n_nationkey: 1 })")]


@facts(
    "tools_values",
    pairs(
        integers=[36, 0, 0],
        reals=[2.5, 0.0],
        booleans=[True, True, True, False, False],
        texts=["x", ""],
        dates=["2020-01-02", None],
        columns=[["a", "TEXT"], ["b", "REAL"]],
        cells='{"_id":"7","name":"Ada","age":36,"active":true,"free":"1"}',
        moment="1996-01-02T03:04:05",
    ),
)
def _(s: Stage):
    yield "integers", [parse_cell(x, "INTEGER") for x in ("36", "x", None)]
    yield "reals", [parse_cell(x, "REAL") for x in ("2.5", "")]
    yield "booleans", [parse_cell(x, "BOOLEAN") for x in ("true", "1", "YES", "no", "")]
    yield "texts", [parse_cell(x, "TEXT") for x in ("x", None)]
    yield "dates", [parse_cell(x, "DATETIME") for x in ("2020-01-02", None)]
    yield "columns", [[c.name, c.type] for c in declared([{"name": " a "}, {"name": "b", "type": "real"}, {"name": "$c"}, {"name": ""}, {"name": "a"}, {"name": "_id"}])]
    columns = [{"name": "name"}, {"name": "age", "type": "INTEGER"}, {"name": "active", "type": "BOOLEAN"}]
    yield "cells", document_from_cells("7", {"name": "Ada", "age": "36", "active": "true", "free": "1", " ": "x", "_id": "8"}, columns).json()
    from docspan.functions.values import Value
    from docspan.relation import typed

    moment = typed(s.spark.sql("select timestamp '1996-01-02 03:04:05' as t")).resolve("t")
    assert isinstance(moment, Value)
    yield "moment", s.spark.sql("select timestamp '1996-01-02 03:04:05' as t").select(moment.text()).first()[0]


@dataclass
class Place:
    n_name: str
    n_regionkey: int
    note: str = "none"


@facts("tools_document", pairs(get="Pune", none=None, copy={"city": "Pune"}, set='{"_id":"1","addr":{"city":"Goa","geo":{"lat":1}},"n":{"x":true}}', id=["1", "5"], typed=["GERMANY", 3, "none"], odd="QueryError"))
def _(s: Stage):
    d = Document('{"_id": "1", "addr": {"city": "Pune"}, "n": 5}')
    yield "get", d["addr.city"]
    yield "none", d["addr.city.x"]
    part = d["addr"]
    yield "copy", part
    part["city"] = "elsewhere"
    d["addr.geo.lat"] = 1
    d["addr.city"] = "Goa"
    d["n.x"] = True
    yield "set", d.json()
    yield "id", [d.id, Document({"_id": 5}).id]
    p = Document({"nName": "GERMANY", "n_regionkey": 3}).to(Place)
    yield "typed", [p.n_name, p.n_regionkey, p.note]
    yield "odd", refused(lambda: Document("[1]"))


@add("tools_typed_frame", "select n_nationkey, n_name, cast(null as double) as nothing from nation")
def _(s: Stage) -> DataFrame:
    return typed_frame(s.filled("nation", "n_nationkey")["nation"].relation(), "n_nationkey int, n_name string, nothing double")


@facts("tools_tree", pairs(captions=["(root)", "name: Ada", "addr", "city: Pune", "tags: [2]", "[0]: a", "[1]: null"], bad=["(invalid JSON): {not-json"], none=[]))
def _(s: Stage):
    def captions(nodes):
        return [x for n in nodes for x in (n.caption, *captions(n.children))]

    yield "captions", captions(tree('{"name":"Ada","addr":{"city":"Pune"},"tags":["a",null]}'))
    yield "bad", captions(tree(" {not-json "))
    yield "none", captions(tree("  "))


@add(
    "tools_tree_rows",
    "select n_nationkey as k, path, name, value, level from (select n_nationkey, '' as path, '(root)' as name, '' as value, 0 as level from nation union all select n_nationkey, 'n_name', 'n_name', n_name, 1 from nation union all select n_nationkey, 'tags', 'tags', '[2]', 1 from nation union all select n_nationkey, 'tags.[1]', '[1]', 'x', 2 from nation union all select n_nationkey, 'tags.[0]', '[0]', cast(n_regionkey as varchar), 2 from nation)",
)
def _(s: Stage) -> DataFrame:
    db = s.db()
    db["t"].insert_frame(s.table("nation").select(F.col("n_nationkey").cast("string").alias("_id"), "n_name", F.array(F.col("n_regionkey").cast("string"), F.lit("x")).alias("tags")))
    rows = tree_rows(db["t"].relation())
    return rows.where("path <> '_id'").select(F.col("_id").cast("int").alias("k"), "path", "name", "value", "level")


@add("tools_page_sort", "select p_partkey, p_name from part where p_partkey <= 40 order by cast(p_partkey as varchar) limit 15")
def _(s: Stage) -> DataFrame:
    """A page sorts by the text that it shows, so 10 comes before 9."""
    rel = parquet_tables(s.spark, s.folder).relation("part")
    return sort_page(rel.with_df(rel.df.where("p_partkey <= 40").limit(40)), "p_partkey").df.limit(15).select("p_partkey", "p_name")


@add("tools_result_grid", "select 'customer' as collection, cast(c_custkey as varchar) as id, c_name as name from customer where c_acctbal < 0")
def _(s: Stage) -> DataFrame:
    db = s.filled("customer", "c_custkey")
    db.materialise("db.customer.find({})")
    grid = db.materialise("db.customer.find({ c_acctbal: { $lt: 0 } })")  # takes the place of the first
    assert list(db.grids) == ["customer"]
    return grid.select("collection", "id", F.get_json_object("json", "$.c_name").alias("name"))


@facts("tools_assist", pairs(words=["find"], operators=["$set", "$skip", "$sort", "$sum"], fields=["n_name", "n_nationkey"], most=True, samples=True, named=True))
def _(s: Stage):
    yield "words", assist.completions("db.nation.fi", 12)
    yield "operators", assist.completions("{ $s", 4)
    yield "fields", assist.completions("{ n_na", 6, fields=["n_name", "n_nationkey", "n_regionkey"])
    yield "most", len(assist.completions("", 0, fields=[f"f{i}" for i in range(100)])) == 40
    yield "samples", all(syntax.parse(t) is not None for t in assist.samples("t").values())
    yield "named", all("db.t." in t or "$lookup" in t for t in assist.samples("t").values())


@facts(
    "tools_command_line",
    pairs(
        insert={"_id": "1"}, find=[{"_id": "1", "v": 2}], query=[{"n": 1}], update={"operation": "update", "affected": 1}, replace={"replaced": 1}, browse=["1 record(s).", "COLLSCAN  examined=1  returned=1  index=none"],
        collections=["c"], tree=[["c", 1]], info=[1, 1], indexes=[["_id_", "_id"]], explain=["ID", 1], delete={"deleted": "1"}, codes=[0, 1, 2, 4], samples=True, compact=0, backup=True, restore=0,
    ),
)
def _(s: Stage):
    path, copy, back = s.path(), s.path(), s.path()

    def run(*args: str) -> Any:
        return cli.run([args[0], path, *args[1:]], s.spark)

    def code(*args: str) -> int:
        with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
            return cli.main(list(args), s.spark)

    yield "insert", run("insert", "c", '{"_id": "1", "v": 2}')
    yield "find", run("find", "c", "{ v: 2 }")
    yield "query", run("query", 'db.c.aggregate([{ $count: "n" }])')
    yield "update", run("query", "db.c.update({}, { $inc: { v: 1 } })")
    yield "replace", run("replace", "c", '{"_id": "1", "v": 5}')
    p = run("browse", "c")
    yield "browse", [p["status"], p["explain"]]
    yield "collections", run("collections")
    yield "tree", [[t["collection"], t["count"]] for t in run("tree")]
    info = run("info")
    yield "info", [info["collections"], info["documents"]]
    yield "indexes", [[i["name"], i["path"]] for i in run("indexes", "c")]
    e = run("explain", 'db.c.find({ _id: "1" })')
    yield "explain", [e["strategy"], e["returned"]]
    yield "delete", run("delete-id", "c", "1")
    yield "codes", [code("info", path), code("query", path, "nonsense"), code("changkey", path, "new", "--passphrase", "old"), code("info", s.path())]
    yield "samples", len(cli.run(["samples", "c"])) >= 5
    yield "compact", run("compact")["documents"]
    yield "backup", bool(run("backup", copy)["backup"])
    yield "restore", cli.run(["restore", copy, back], s.spark)["documents"]
