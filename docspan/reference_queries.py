"""The engine's registered queries over the driver's tables, each with equivalent DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspan.session import Field, Pipeline, Tables, parquet_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, run: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, folder: run(parquet_tables(spark, folder))
    if sql is not None:
        SQL[name] = sql


def nql(name: str, text: str, sql: str | None = None, *columns: str, strict: bool = False) -> None:
    """columns: expressions of what to return, if not all."""
    add(name, lambda t: (lambda df: df.selectExpr(*columns) if columns else df)(t.frame(text, strict)), sql)


ORDERS = "select * from orders where "
#: events with its JSON column as text again, for results that are compared.
EVENTS = ("event_id", "user_id", "event_type", "value")

# filters
nql("find_all", "db.nation.find({})", "select * from nation")
nql("find_blank", "db.region.find()", "select * from region")
nql("find_by_id", 'db.orders.find({ _id: "42" })', ORDERS + "o_orderkey = 42")
nql("find_by_id_number", "db.orders.find({ _id: 7 })", ORDERS + "o_orderkey = 7")
nql("eq_implicit", 'db.orders.find({ o_orderstatus: "F" })', ORDERS + "o_orderstatus = 'F'")
nql("eq_op", 'db.orders.find({ o_orderstatus: { $eq: "O" } })', ORDERS + "o_orderstatus = 'O'")
nql("eq_numeric_string", 'db.part.find({ p_size: "15" })', "select * from part where p_size = 15")
nql("eq_fraction", "db.part.find({ p_size: 15.5 })", "select * from part where p_size = 15.5")
nql("eq_null_typed", "db.orders.find({ o_orderstatus: null })", ORDERS + "false")
nql("ne", 'db.orders.find({ o_orderstatus: { $ne: "F" } })', ORDERS + "o_orderstatus is distinct from 'F'")
nql("ne_null_typed", "db.orders.find({ o_orderstatus: { $ne: null } })", "select * from orders")
add("ne_missing", lambda t: t.frame('db.events.find({ "props.zz": { $ne: 1 } })').select(*EVENTS), "select event_id, user_id, event_type, value from events")
nql("gt", "db.orders.find({ o_totalprice: { $gt: 300000 } })", ORDERS + "o_totalprice > 300000")
nql("gte", "db.orders.find({ o_totalprice: { $gte: 300000.5 } })", ORDERS + "o_totalprice >= 300000.5")
nql("lt", "db.lineitem.find({ l_quantity: { $lt: 5 } })", "select * from lineitem where l_quantity < 5")
nql("lte", "db.lineitem.find({ l_quantity: { $lte: 5 } })", "select * from lineitem where l_quantity <= 5")
nql("gte_fraction_on_int", "db.part.find({ p_size: { $gte: 15.5, $lt: 30.5 } })", "select * from part where p_size >= 15.5 and p_size < 30.5")
nql("range_two_sided", "db.orders.find({ o_totalprice: { $gte: 1000, $lt: 50000 } })", ORDERS + "o_totalprice >= 1000 and o_totalprice < 50000")
nql("range_string", 'db.customer.find({ c_name: { $gte: "Customer#000001000" } })', "select * from customer where c_name >= 'Customer#000001000'")
nql("range_timestamp", 'db.orders.find({ o_orderdate: { $gte: "1997-01-01T00:00:00" } })', ORDERS + "o_orderdate >= timestamp '1997-01-01 00:00:00'")
nql("range_not_a_time", 'db.orders.find({ o_orderdate: { $gt: "1997 or so" } })', ORDERS + "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') > '1997 or so'")
nql("ne_not_a_time", 'db.orders.find({ o_orderdate: { $ne: "abc" } })', "select * from orders")
nql("nin_not_a_time", 'db.orders.find({ o_orderdate: { $nin: ["abc", "1996-01-02"] } })', ORDERS + "o_orderdate <> timestamp '1996-01-02'")
nql("cross_kind_lt", "db.part.find({ p_brand: { $lt: 5 } })", "select * from part")
nql("cross_kind_gt", "db.part.find({ p_brand: { $gt: 5 } })", "select * from part where false")
nql("cross_kind_number", 'db.part.find({ p_size: { $gt: "abc" } })', "select * from part")
nql("in_str", 'db.orders.find({ o_orderpriority: { $in: ["1-URGENT", "2-HIGH"] } })', ORDERS + "o_orderpriority in ('1-URGENT', '2-HIGH')")
nql("in_num", "db.part.find({ p_size: { $in: [1, 15, 49] } })", "select * from part where p_size in (1, 15, 49)")
nql("in_mixed", 'db.part.find({ p_size: { $in: ["7", 8.0, "x", null] } })', "select * from part where p_size in (7, 8)")
nql("in_empty", "db.part.find({ p_size: { $in: [] } })", "select * from part where false")
nql("nin", 'db.orders.find({ o_orderstatus: { $nin: ["F", "P"] } })', ORDERS + "o_orderstatus not in ('F', 'P')")
add("nin_missing", lambda t: t.frame('db.events.find({ "props.zz": { $nin: [1] } })').select(*EVENTS), "select event_id, user_id, event_type, value from events")
add("exists_true", lambda t: t.frame('db.events.find({ "props.k": { $exists: true } })').select(*EVENTS), "select event_id, user_id, event_type, value from events where json_extract(props, '$.k') is not null")
add("exists_false", lambda t: t.frame('db.events.find({ "props.zz": { $exists: false } })').select(*EVENTS), "select event_id, user_id, event_type, value from events where json_extract(props, '$.zz') is null")
nql("exists_zero_is_true", "db.nation.find({ n_name: { $exists: 0 } })", "select * from nation")
nql("exists_no_column", "db.nation.find({ nothing: { $exists: false } })", "select * from nation")
add("nested_path", lambda t: t.frame('db.events.find({ "props.k": { $gte: 90 } })').select(*EVENTS), "select event_id, user_id, event_type, value from events where cast(json_extract(props, '$.k') as double) >= 90")
add("nested_string_number", lambda t: t.frame('db.events.find({ "props.k": "42" })').select(*EVENTS), "select event_id, user_id, event_type, value from events where cast(json_extract(props, '$.k') as double) = 42")
add("nested_whole_value", lambda t: t.frame("db.events.find({ props: { k: 42 } })").select(*EVENTS), "select event_id, user_id, event_type, value from events where cast(json_extract(props, '$.k') as double) = 42")
nql("regex", 'db.part.find({ p_name: { $regex: "wid" } })', "select * from part where regexp_matches(p_name, 'wid')")
nql("regex_prefix", 'db.part.find({ p_name: { $regex: "^small" } })', "select * from part where starts_with(p_name, 'small')")
nql("regex_class", 'db.customer.find({ c_name: { $regex: "0[13]5$" } })', "select * from customer where regexp_matches(c_name, '0[13]5$')")
nql("regex_on_number", 'db.part.find({ p_size: { $regex: "1" } })', "select * from part where false")
nql("and_or", 'db.orders.find({ $and: [{ $or: [{ o_orderstatus: "F" }, { o_totalprice: { $gt: 400000 } }] }, { o_custkey: { $lte: 500 } }] })', ORDERS + "(o_orderstatus = 'F' or o_totalprice > 400000) and o_custkey <= 500")
nql("and_empty", "db.nation.find({ $and: [] })", "select * from nation")
nql("or_empty", "db.nation.find({ $or: [] })", "select * from nation where false")
nql("implicit_and", 'db.customer.find({ c_mktsegment: "BUILDING", c_acctbal: { $gt: 0 }, c_nationkey: { $ne: 3 } })', "select * from customer where c_mktsegment = 'BUILDING' and c_acctbal > 0 and c_nationkey <> 3")
nql("array_whole_value", "db.embeddings.find({ embedding: [] })", "select * from embeddings where false")
add("fluent_where", lambda t: t.find("customer").where((Field("c_acctbal") >= 5000) & ((Field("c_mktsegment") == "BUILDING") | (Field("c_nationkey") < 5))).df, "select * from customer where c_acctbal >= 5000 and (c_mktsegment = 'BUILDING' or c_nationkey < 5)")
add("fluent_starts_with", lambda t: t.find("customer").where(Field("c_name").starts_with("Customer#0000000")).df, "select * from customer where starts_with(c_name, 'Customer#0000000')")

# projection, order, pages
nql("project", 'db.orders.find({ o_orderstatus: "P" }).project({ o_totalprice: 1 })', """select cast(o_orderkey as varchar) as "_id", o_totalprice from orders where o_orderstatus = 'P'""")
nql("project_zero_dropped", "db.part.find({}).project({ p_name: 1, p_brand: 0, p_size: true })", """select cast(p_partkey as varchar) as "_id", p_name, p_size from part""")
nql("project_empty", "db.region.find({}).project({})", "select * from region")
add("project_nested", lambda t: t.frame('db.events.find({ "props.k": { $lt: 10 } }).project({ "props.k": 1, value: 1 })').select("_id", F.col("`props.k`").cast("long").alias("k"), "value"), """select cast(event_id as varchar) as "_id", cast(json_extract(props, '$.k') as bigint) as k, value from events where cast(json_extract(props, '$.k') as double) < 10""")
nql("sort_asc_limit", "db.orders.find({}).sort({ o_totalprice: 1 }).limit(20)", "select * from orders order by o_totalprice, o_orderkey limit 20")
nql("sort_desc_limit", 'db.orders.find({ o_orderstatus: "F", o_totalprice: { $gte: 400000 } }).sort({ o_totalprice: -1 }).limit(20)', ORDERS + "o_orderstatus = 'F' and o_totalprice >= 400000 order by o_totalprice desc, o_orderkey limit 20")
nql("sort_multi", "db.customer.find({}).sort({ c_mktsegment: 1, c_acctbal: -1 }).limit(50)", "select * from customer order by c_mktsegment, c_acctbal desc, c_custkey limit 50")
nql("sort_strict_last_key", "db.customer.find({}).sort({ c_mktsegment: 1, c_acctbal: -1 }).limit(50)", "select * from customer order by c_acctbal desc, c_custkey limit 50", strict=True)
nql("skip_limit", "db.orders.find({}).sort({ _id: 1 }).skip(20).limit(10)", "select * from orders order by o_orderkey limit 10 offset 20")
nql("page", "db.orders.find({}).sort({ _id: 1 }).page(3, 25)", "select * from orders order by o_orderkey limit 25 offset 50")
nql("page_default", "db.orders.find({}).sort({ _id: 1 }).page(2)", "select * from orders order by o_orderkey limit 200 offset 200")
nql("page_of_limit", "db.orders.find({}).sort({ _id: 1 }).limit(50).page(2)", "select * from orders order by o_orderkey limit 50 offset 50")
nql("limit_zero_is_all", "db.nation.find({}).limit(0)", "select * from nation")
add("fluent_sort", lambda t: t.find("part", {"p_size": {"$gt": 40}}).sort("p_brand").sort("p_retailprice", False).skip(5).limit(30).project("p_brand", "p_retailprice").df.select("_id", "p_brand", "p_retailprice"), """select cast(p_partkey as varchar) as "_id", p_brand, p_retailprice from part where p_size > 40 order by p_brand, p_retailprice desc, p_partkey limit 30 offset 5""")

# pipelines
nql("match_stage", 'db.orders.aggregate([{ $match: { o_orderstatus: "P" } }])', ORDERS + "o_orderstatus = 'P'")
nql("count_stage", 'db.orders.aggregate([{ $match: { o_orderstatus: "P" } }, { $count: "n" }])', "select count(*) as n from orders where o_orderstatus = 'P'")
nql("count_empty", 'db.orders.aggregate([{ $match: { o_orderstatus: "none" } }, { $count: null }])', 'select cast(0 as bigint) as "count"')
nql("project_stage", "db.supplier.aggregate([{ $project: { s_name: 1 } }])", """select cast(s_suppkey as varchar) as "_id", s_name from supplier""")
nql("sort_stage", "db.orders.aggregate([{ $sort: { o_totalprice: -1 } }, { $skip: 5 }, { $limit: 10 }])", "select * from orders order by o_totalprice desc, o_orderkey limit 10 offset 5")
nql("sort_stage_strict", "db.part.aggregate([{ $sort: { p_size: 1 } }, { $limit: 40 }])", "select * from part order by cast(p_size as varchar), p_partkey limit 40", strict=True)
nql("limit_stage_zero", "db.orders.aggregate([{ $limit: 0 }])", ORDERS + "false")
nql("skip_stage_negative", "db.nation.aggregate([{ $skip: -3 }])", "select * from nation")
nql("group_field", 'db.orders.aggregate([{ $group: { _id: "$o_orderstatus", n: { $sum: 1 } } }])', """select o_orderstatus as "_id", cast(count(*) as double) as n from orders group by 1""")
nql("group_null", "db.orders.aggregate([{ $group: { _id: null, n: { $sum: 1 }, top: { $max: \"$o_totalprice\" } } }])", """select cast(null as varchar) as "_id", cast(count(*) as double) as n, max(o_totalprice) as top from orders""")
nql("group_null_empty", 'db.orders.aggregate([{ $match: { o_orderstatus: "none" } }, { $group: { _id: null, n: { $sum: 1 } } }])', """select cast(null as varchar) as "_id", cast(0 as double) as n where false""")
nql("group_const", 'db.orders.aggregate([{ $group: { _id: "all", n: { $sum: 1 } } }])', """select 'all' as "_id", cast(count(*) as double) as n from orders""")
add("group_nested", lambda t: t.frame('db.events.aggregate([{ $group: { _id: "$props.k", n: { $sum: 1 } } }])').select(F.col("_id").cast("long").alias("_id"), "n"), """select cast(json_extract(props, '$.k') as bigint) as "_id", cast(count(*) as double) as n from events group by 1""")
add("group_compound", lambda t: t.frame('db.orders.aggregate([{ $group: { _id: { s: "$o_orderstatus", p: "$o_orderpriority" }, n: { $sum: 1 } } }])').select(F.col("_id.s").alias("s"), F.col("_id.p").alias("p"), "n"), "select o_orderstatus as s, o_orderpriority as p, cast(count(*) as double) as n from orders group by 1, 2")
nql("group_all_accs", 'db.lineitem.aggregate([{ $group: { _id: "$l_returnflag", total: { $sum: "$l_extendedprice" }, mean: { $avg: "$l_discount" }, least: { $min: "$l_quantity" }, most: { $max: "$l_tax" }, five: { $sum: "5" } } }])', """select l_returnflag as "_id", round(sum(l_extendedprice), 2) as total, round(avg(l_discount), 6) as mean, min(l_quantity) as least, max(l_tax) as most, cast(5 * count(*) as double) as five from lineitem group by 1""", "_id", "round(total, 2) as total", "round(mean, 6) as mean", "least", "most", "five")
nql("group_missing_zero", 'db.events.aggregate([{ $group: { _id: "$event_type", a: { $avg: "$props.zz" }, k: { $avg: "$props.k" }, t: { $max: "$event_type" } } }])', """select event_type as "_id", cast(0 as double) as a, round(avg(cast(json_extract(props, '$.k') as double)), 6) as k, cast(0 as double) as t from events group by 1""", "_id", "a", "round(k, 6) as k", "t")
nql("group_first", 'db.orders.aggregate([{ $sort: { o_orderkey: 1 } }, { $group: { _id: "$o_custkey", first: { $first: "$o_totalprice" } } }])', """select o_custkey as "_id", arg_min(o_totalprice, o_orderkey) as first from orders group by 1""")
nql("group_first_desc", 'db.orders.aggregate([{ $sort: { o_totalprice: -1 } }, { $group: { _id: "$o_orderpriority", first: { $first: "$o_orderkey" }, n: { $sum: 1 } } }])', """select o_orderpriority as "_id", arg_max(o_orderkey, o_totalprice) as first, cast(count(*) as double) as n from orders group by 1""")
nql("group_first_mixed", 'db.orders.aggregate([{ $sort: { o_orderstatus: -1, o_orderkey: 1 } }, { $group: { _id: "$o_custkey", first: { $first: "$o_orderkey" } } }])', """select o_custkey as "_id", first from (select o_custkey, o_orderkey as first, row_number() over (partition by o_custkey order by o_orderstatus desc, o_orderkey) as n from orders) where n = 1""")
nql("group_first_text_desc", 'db.part.aggregate([{ $sort: { p_name: -1, p_size: 1 } }, { $group: { _id: "$p_brand", first: { $first: "$p_name" }, key: { $first: "$p_partkey" } } }])', """select p_brand as "_id", first, key from (select p_brand, p_name as first, p_partkey as key, row_number() over (partition by p_brand order by p_name desc, p_size, p_partkey) as n from part) where n = 1""")
nql("group_first_time_desc", 'db.orders.aggregate([{ $sort: { o_orderdate: -1 } }, { $match: { o_orderstatus: "F" } }, { $group: { _id: null, key: { $first: "$o_orderkey" } } }])', """select cast(null as varchar) as "_id", first(o_orderkey order by o_orderdate desc, o_orderkey) as key from orders where o_orderstatus = 'F'""")
nql("group_having", 'db.orders.aggregate([{ $group: { _id: "$o_custkey", n: { $sum: 1 } } }, { $match: { n: { $gte: 15 } } }])', """select o_custkey as "_id", cast(count(*) as double) as n from orders group by 1 having count(*) >= 15""")
nql("group_topk", 'db.orders.aggregate([{ $group: { _id: "$o_custkey", n: { $sum: 1 } } }, { $sort: { n: -1 } }, { $limit: 10 }])', """select o_custkey as "_id", cast(count(*) as double) as n from orders group by 1 order by n desc, 1 limit 10""")
nql("distinct_group", 'db.part.aggregate([{ $group: { _id: "$p_brand" } }])', 'select distinct p_brand as "_id" from part')
add("pipeline_builder", lambda t: Pipeline().match({"o_totalprice": {"$gt": 100000}}).group("$o_orderpriority", n={"$sum": 1}).sort(_id=1).run(t.relation("orders"), t.relation).df, """select o_orderpriority as "_id", cast(count(*) as double) as n from orders where o_totalprice > 100000 group by 1""")

# lookups
LABELS = '{ $lookup: { from: "labels", localField: "doc_id", foreignField: "doc_id", as: "marks" } }'
nql("lookup_nation", 'db.customer.aggregate([{ $lookup: { from: "nation", localField: "c_nationkey", foreignField: "n_nationkey", as: "nation" } }])', "select c_custkey, cast(count(n_nationkey) as integer) as matches, min(n_name) as name from customer left join nation on c_nationkey = n_nationkey group by 1", "c_custkey", "size(nation) as matches", "try_element_at(nation, 1).n_name as name")
nql("lookup_by_id", 'db.orders.aggregate([{ $match: { o_totalprice: { $gt: 450000 } } }, { $lookup: { from: "customer", localField: "o_custkey", foreignField: "_id", as: "buyer" } }])', "select o_orderkey, cast(count(c_custkey) as integer) as matches, min(c_name) as name from orders left join customer on o_custkey = c_custkey where o_totalprice > 450000 group by 1", "o_orderkey", "size(buyer) as matches", "try_element_at(buyer, 1).c_name as name")
nql("lookup_many", 'db.customer.aggregate([{ $lookup: { from: "orders", localField: "c_custkey", foreignField: "o_custkey", as: "orders" } }])', "select c_custkey, cast(count(o_orderkey) as integer) as matches, string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) as keys from customer left join orders on c_custkey = o_custkey group by 1", "c_custkey", "size(orders) as matches", "nullif(array_join(transform(orders, x -> cast(x.o_orderkey as string)), ','), '') as keys")
nql("lookup_empty", f"db.documents.aggregate([{LABELS}])", "select d.doc_id, cast(count(l.doc_id) as integer) as matches from documents d left join labels l using (doc_id) group by 1", "doc_id", "size(marks) as matches")
nql("lookup_semi", f'db.documents.aggregate([{LABELS}, {{ $match: {{ marks: {{ $ne: [] }} }} }}, {{ $project: {{ lang: 1 }} }}])', """select cast(doc_id as varchar) as "_id", lang from documents semi join labels using (doc_id)""")
nql("lookup_anti", f'db.documents.aggregate([{LABELS}, {{ $match: {{ marks: [] }} }}, {{ $project: {{ lang: 1 }} }}])', """select cast(doc_id as varchar) as "_id", lang from documents anti join labels using (doc_id)""")
nql("lookup_limit", 'db.orders.aggregate([{ $sort: { o_orderkey: 1 } }, { $lookup: { from: "customer", localField: "o_custkey", foreignField: "c_custkey", as: "buyer" } }, { $limit: 25 }])', "select o_orderkey, c_name as name from (select * from orders order by o_orderkey limit 25) join customer on o_custkey = c_custkey", "o_orderkey", "try_element_at(buyer, 1).c_name as name")
nql("lookup_no_field", 'db.nation.aggregate([{ $lookup: { from: "region", localField: "nothing", foreignField: "r_regionkey", as: "r" } }])', "select n_nationkey, cast(0 as integer) as matches from nation", "n_nationkey", "size(r) as matches")
add("lookup_then_group", lambda t: t.frame('db.orders.aggregate([{ $lookup: { from: "customer", localField: "o_custkey", foreignField: "c_custkey", as: "buyer" } }, { $project: { buyer: 1, o_totalprice: 1 } }])').groupBy(F.try_element_at("buyer", F.lit(1))["c_mktsegment"].alias("segment")).agg(F.round(F.sum("o_totalprice"), 2).alias("total")), "select c_mktsegment as segment, round(sum(o_totalprice), 2) as total from orders left join customer on o_custkey = c_custkey group by 1")
nql("lookup_raw_array", 'db.region.aggregate([{ $lookup: { from: "nation", localField: "_id", foreignField: "n_regionkey", as: "nations" } }])', "select r_regionkey, r_name, coalesce(list({'_id': cast(n_nationkey as varchar), 'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey} order by n_nationkey) filter (where n_nationkey is not null), []) as nations from region left join nation on r_regionkey = n_regionkey group by 1, 2")

# writes, as the rows that they would leave
nql("update_set", 'db.part.update({ p_size: { $gt: 40 } }, { $set: { p_brand: "Brand#X", p_size: 0 } })', "select p_partkey, p_name, case when p_size > 40 then 'Brand#X' else p_brand end as p_brand, p_type, case when p_size > 40 then 0 else p_size end as p_size, p_retailprice from part")
nql("update_inc", 'db.supplier.update({ s_nationkey: 3 }, { $inc: { s_acctbal: 10.5, s_nationkey: 1 } })', "select s_suppkey, s_name, case when s_nationkey = 3 then s_nationkey + 1 else s_nationkey end as s_nationkey, case when s_nationkey = 3 then s_acctbal + 10.5 else s_acctbal end as s_acctbal from supplier")
nql("update_inc_fraction", "db.part.update({ p_size: { $lt: 10 } }, { $inc: { p_size: 1.5 } })", "select p_partkey, p_name, p_brand, p_type, case when p_size < 10 then p_size + 1.5 else p_size end::double as p_size, p_retailprice from part")
nql("update_unset", 'db.nation.update({ n_regionkey: 1 }, { $unset: { n_name: "" } })', "select n_nationkey, case when n_regionkey = 1 then null else n_name end as n_name, n_regionkey from nation")
add("update_nested", lambda t: t.frame('db.events.update({ "props.k": { $gte: 50 } }, { $set: { "props.flag.on": true }, $inc: { "props.k": 1 } })').select("event_id", F.try_variant_get("props", "$.k", "long").alias("k"), F.coalesce(F.try_variant_get("props", "$.flag.on", "boolean"), F.lit(False)).alias("flag")), "select event_id, cast(json_extract(props, '$.k') as bigint) + case when cast(json_extract(props, '$.k') as double) >= 50 then 1 else 0 end as k, cast(json_extract(props, '$.k') as double) >= 50 as flag from events")
add("update_push", lambda t: t.frame("db.embeddings.update({ label: 1 }, { $push: { embedding: 2 } })").select("vec_id", F.size("embedding").alias("n"), F.element_at("embedding", -1).cast("double").alias("last")), "select vec_id, cast(len(embedding) + case when label = 1 then 1 else 0 end as integer) as n, case when label = 1 then cast(2 as double) else cast(embedding[-1] as double) end as last from embeddings")
add("update_pull", lambda t: t.frame('db.tagged.update({}, { $pull: { tags: "b" } })').select("k", F.array_join("tags", ",").alias("tags")) if "tagged" in t.makers else _tagged(t).frame('db.tagged.update({}, { $pull: { tags: "o" } })').select("k", F.array_join("tags", ",").alias("tags")), "select o_orderkey as k, array_to_string(list_filter([lower(o_orderstatus), 'x', lower(o_orderstatus)], lambda v: v <> 'o'), ',') as tags from orders")
nql("delete_rest", "db.orders.delete({ o_totalprice: { $lt: 100000 } })", ORDERS + "not (o_totalprice < 100000)")
nql("delete_all", "db.nation.delete()", "select * from nation where false")


# tooling: profiles, files, pages, import and export


def _profile(t: Tables) -> DataFrame:
    from docspan.operators.profile import profile

    return profile(t.relation("documents"), 2).select("field", "types", "present", "missing", "coverage", F.when(F.col("field").isin("lang", "source"), F.col("samples")).alias("samples"))


add(
    "profile_fields",
    _profile,
    "select field, types, cast((select count(*) from documents) as bigint) as present, cast(0 as bigint) as missing, cast(100.0 as double) as coverage, case field when 'lang' then (select string_agg(x, ' | ' order by x) from (select distinct lang as x from documents order by x limit 2)) when 'source' then (select string_agg(x, ' | ' order by x) from (select distinct source as x from documents order by x limit 2)) end as samples from (values ('doc_id', 'number'), ('text', 'string'), ('lang', 'string'), ('source', 'string'), ('n_chars', 'number')) v(field, types)",
)


def _coverage(t: Tables) -> DataFrame:
    """A profile with gaps: labels as they stand next to documents."""
    from docspan.operators.profile import profile
    from docspan.relation import typed

    marks = t.relation("labels").df.withColumnRenamed("doc_id", "own")
    return profile(typed(t.relation("documents").df.select("doc_id").join(marks, F.col("doc_id") == F.col("own"), "left").drop("own"), "doc_id")).select("field", "present", "missing")


add("profile_coverage", _coverage, "select field, cast(count(x) as bigint) as present, cast(count(*) - count(x) as bigint) as missing from (select d.doc_id, unnest(['doc_id', 'quality', 'toxic']) as field, unnest([d.doc_id, l.quality, l.toxic]) as x from documents d left join labels l using (doc_id)) group by 1")


def _files(t: Tables) -> DataFrame:
    from docspan.sources import filestore

    files = t.relation("documents").df.select(F.col("doc_id").alias("_id"), F.col("text").cast("binary").alias("content"))
    return filestore.assembled(filestore.chunked(files, 1024)).select(F.col("files_id").cast("long").alias("doc_id"), F.md5("content").alias("md5"))


add("filestore_roundtrip", _files, "select doc_id, md5(text) as md5 from documents where strlen(text) > 0")


def _chunks(t: Tables) -> DataFrame:
    from docspan.sources import filestore

    files = t.relation("documents").df.select(F.col("doc_id").alias("_id"), F.col("text").cast("binary").alias("content"))
    return filestore.chunked(files, 4).groupBy(F.col("files_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("chunks"))


add("filestore_chunks", _chunks, "select doc_id, cast(ceil(strlen(text) / 1024.0) as bigint) as chunks from documents where strlen(text) > 0")


def _page(t: Tables) -> DataFrame:
    from docspan.operators.browse import page_rows

    return page_rows(t.relation("orders"), "o_orderstatus: F", 2, 50).df


add("browse_page", _page, "select * from orders where o_orderstatus = 'F' order by o_orderkey limit 51 offset 100")


def _built_filter(t: Tables) -> DataFrame:
    from docspan.operators.browse import build

    return t.find("part", build("p_name", "contains", "small")).df


add("browse_built_filter", _built_filter, "select * from part where contains(p_name, 'small')")


def _search(t: Tables) -> DataFrame:
    from docspan.operators.profile import find_in_page

    return find_in_page(t.relation("nation"), "nation_1", ["n_name"]).df


add("find_in_page", _search, "select * from nation where contains(lower(n_name), 'nation_1')")


def _grid(t: Tables) -> DataFrame:
    from docspan.operators.profile import grid

    return grid(t.relation("customer"), ["c_custkey", "c_name", "nothing.here"]).withColumnRenamed("nothing.here", "gap")


add("grid_cells", _grid, "select cast(c_custkey as varchar) as c_custkey, c_name, '' as gap from customer")


def _json_round_trip(t: Tables) -> DataFrame:
    from docspan.relation import documents
    from docspan.sources.documents import ensure_ids, json_rows

    texts = json_rows(t.relation("part")).select(F.col("json"), F.lit(0).cast("long").alias("_n"))
    rel = documents(ensure_ids(texts, F.parse_json("json")).withColumnRenamed("_n", "_ord"))
    return rel.df.select("_id", rel.resolve("p_name").text().alias("p_name"), rel.resolve("p_size").number().cast("int").alias("p_size"), rel.resolve("p_retailprice").number().alias("p_retailprice"))


add("json_roundtrip", _json_round_trip, 'select cast(p_partkey as varchar) as "_id", p_name, p_size, p_retailprice from part')


def _csv_round_trip(t: Tables) -> DataFrame:
    from docspan.relation import documents
    from docspan.sources.documents import _from_cells, csv_frame

    rel = documents(_from_cells(csv_frame(t.relation("supplier"))).withColumnRenamed("_n", "_ord"))
    return rel.df.select("_id", rel.resolve("s_name").text().alias("s_name"), rel.resolve("s_acctbal").number().alias("s_acctbal"))


add("csv_roundtrip", _csv_round_trip, 'select cast(s_suppkey as varchar) as "_id", s_name, s_acctbal from supplier')


def _documents(t: Tables) -> DataFrame:
    """Document mode end to end: typed rows packed as documents, then filtered, sorted and projected."""
    from docspan.operators.stages import run_find
    from docspan.plans.syntax import parse
    from docspan.relation import documents
    from docspan.sources.documents import ensure_ids, json_rows

    texts = json_rows(t.relation("orders")).select("json", F.lit(0).cast("long").alias("_n"))
    rel = documents(ensure_ids(texts, F.parse_json("json")).withColumnRenamed("_n", "_ord"))
    out = run_find(rel, parse('db.orders.find({ o_orderstatus: "F", o_totalprice: { $gte: 300000 } }).sort({ o_totalprice: -1 }).limit(40).project({ o_totalprice: 1 })'))
    return out.df.select("_id", F.col("o_totalprice").cast("double").alias("o_totalprice"))


add("document_mode_find", _documents, """select cast(o_orderkey as varchar) as "_id", o_totalprice from orders where o_orderstatus = 'F' and o_totalprice >= 300000 order by o_totalprice desc limit 40""")


def _tagged(t: Tables) -> Tables:
    from docspan.relation import typed

    low = F.lower("o_orderstatus")
    t.add("tagged", typed(t.relation("orders").df.select(F.col("o_orderkey").alias("k"), F.array(low, F.lit("x"), low).alias("tags")), "k"))
    return t
