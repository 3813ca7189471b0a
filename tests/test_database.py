import io
import json

import pytest

from docspan.database import Column_, Database
from docspan.errors import DocspanError, DuplicateId, NotFound, QueryError, UnsupportedOperator
from docspan.session import Field


@pytest.fixture()
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}/db")


def names(rows):
    return [r["name"] for r in rows]


def test_golden_cases(db):
    users = db["users"]
    users.insert_many([{"name": "Ada", "age": 36, "city": "Pune"}, {"name": "Ben", "age": 22, "city": "Goa"}, {"name": "Cara", "age": 41, "city": "Goa"}])
    users.ensure_index("age")
    users.ensure_index("city")
    assert names(db.query("db.users.find({ age: { $gte: 30 } }).sort({ age: 1 }).limit(20)")) == ["Ada", "Cara"]
    assert names(db.query("db.users.find({}).sort({ age: 1 }).page(1, 1)")) == ["Ben"]
    assert names(db.query('db.users.find({ city: "Goa" }).sort({ age: 1 })')) == ["Ben", "Cara"]
    assert names(users.find().where((Field("age") >= 21) & (Field("city") == "Goa")).sort("name", False).to_list()) == ["Cara", "Ben"]


def test_ids_and_duplicates(db):
    c = db["items"]
    new = c.insert({"sku": "a"})
    assert len(new) == 24 and int(new, 16) >= 0
    assert c.insert({"_id": 1, "sku": "b"}) == "1"
    with pytest.raises(DuplicateId):
        c.insert({"_id": "1"})
    with pytest.raises(DuplicateId):
        c.insert_many([{"_id": "x"}, {"_id": "x"}])
    assert c.count() == 2
    assert c.get(1) == {"_id": "1", "sku": "b"}
    assert c.get("none") is None
    assert len(c.insert({"_id": "  ", "sku": "blank"})) == 24
    assert c.clone("1") != "1"


def test_update_and_delete(db):
    c = db["items"]
    c.insert_many([{"_id": "a", "qty": 1, "city": "Pune", "tags": ["x", "y", "x"]}, {"_id": "b", "qty": "7", "city": "Pune"}, {"_id": "c", "city": "Goa", "o": {"p": 1, "q": 2}}])
    r = db.execute('db.items.update({ city: "Pune" }, { $inc: { qty: 5 }, $set: { "a.b": "n" }, $push: { tags: [1] } })')
    assert (r.operation, r.affected) == ("update", 2)
    assert c.get("a") == {"_id": "a", "a": {"b": "n"}, "city": "Pune", "qty": 6, "tags": ["x", "y", "x", [1]]}
    assert c.get("b") == {"_id": "b", "a": {"b": "n"}, "city": "Pune", "qty": 5, "tags": [[1]]}
    assert c.update({"_id": "a"}, {"$pull": {"tags": "x"}, "$unset": {"a.b": ""}}) == 1
    assert c.get("a")["tags"] == ["y", [1]] and c.get("a")["a"] == {}
    assert c.update({"_id": "c"}, {"$unset": {"o.p": "", "none.x": ""}}) == 1
    assert c.get("c")["o"] == {"q": 2}
    assert c.update({}, {}) == 3
    with pytest.raises(QueryError):
        c.update({}, {"$set": {"_id": "z"}})
    with pytest.raises(UnsupportedOperator):
        c.update({}, {"$rename": {"a": "b"}})
    c.replace({"_id": "c", "fresh": True})
    assert c.get("c") == {"_id": "c", "fresh": True}
    with pytest.raises(NotFound):
        c.replace({"_id": "none"})
    assert db.execute('db.items.delete({ city: "Pune" })').affected == 2
    assert c.delete_by_id("c") and not c.delete_by_id("c")
    assert c.count() == 0


def test_insertion_order_and_pages(db):
    c = db["docs"]
    c.insert_many([{"n": i} for i in range(40)])
    c.insert_many([{"n": i} for i in range(40, 60)])
    assert [d["n"] for d in c.find().limit(5).to_list()] == [0, 1, 2, 3, 4]
    assert [d["n"] for d in c.find().skip(38).limit(4).to_list()] == [38, 39, 40, 41]
    p = c.browse(page=2, size=25)
    assert (p.status, p.page_text, p.has_next, p.has_previous) == ("Showing 51–60 of 60.", "Page 3 of 3", False, True)
    p = c.browse("n: 3")
    assert p.status == "1 matching row(s). Collection has 60."
    assert c.browse("n = 99").status == "No matching rows. Collection has 60."
    assert c.browse(page=9, size=50).page == 1


def test_explain(db):
    c = db["people"]
    c.insert_many([{"_id": str(i), "n": i, "city": "Pune" if i % 2 else "Goa"} for i in range(20)])
    c.ensure_index("n")
    c.ensure_index(["city", "n"])
    assert c.explain({"_id": "3"}).text() == "ID  examined=1  returned=1  index=none"
    assert c.explain({"n": {"$gte": 15}}).text() == "IXSCAN  examined=5  returned=5  index=n"
    assert c.explain({"city": "Goa", "n": 4}).index == "city_n"
    assert c.explain({"x": 1}).text() == "COLLSCAN  examined=20  returned=0  index=none"
    assert db.explain("db.people.aggregate([])").strategy == "AGGREGATE"
    assert [i["name"] for i in c.indexes()] == ["_id_", "n", "city_n"]
    assert c.drop_index("n") and not c.drop_index("n")
    with pytest.raises(DocspanError):
        c.drop_index("_id_")


def test_unique_index(db):
    c = db["u"]
    c.insert_many([{"e": "a"}, {"e": "b"}, {"x": 1}, {"x": 2}])
    c.ensure_index("e", unique=True)
    with pytest.raises(DuplicateId):
        c.insert({"e": "a"})
    with pytest.raises(DuplicateId):
        c.update({"x": {"$exists": True}}, {"$set": {"e": "q"}})
    assert c.count() == 4
    d = db["v"]
    d.insert_many([{"e": 1}, {"e": 1.0}])
    with pytest.raises(DuplicateId):
        d.ensure_index("e", unique=True)
    assert len(d.indexes()) == 1


def test_transactions_span_collections(db, spark):
    with db.begin() as t:
        db["orders"].insert({"_id": "o"})
        db["users"].insert({"_id": "u"})
        t.commit()
    assert db.collection_names() == ["orders", "users"]
    t = db.begin()
    db["users"].delete()
    assert db["users"].count() == 0
    assert Database(spark, db.path)["users"].count() == 1  # others read the last snapshot
    t.rollback()
    assert db["users"].count() == 1
    with db.begin():
        db["more"].insert({})
    assert "more" not in db.collection_names()


def test_single_writer(db, spark):
    other = Database(spark, db.path)
    db["a"].insert({"x": 1})
    with pytest.raises(DocspanError):
        other["a"].insert({"x": 2})
    other.refresh()
    other["a"].insert({"x": 2})
    assert other["a"].count() == 2 and db["a"].count() == 1
    ro = Database(spark, db.path, read_only=True)
    with pytest.raises(DocspanError):
        ro["a"].insert({})


def test_catalog(db):
    assert db["nothing"].count() == 0 and db.collection_names() == []
    db["a"].insert({"x": 1})
    db.rename("a", "b")
    with pytest.raises(NotFound):
        db.rename("a", "c")
    db["c"].insert({})
    with pytest.raises(DocspanError):
        db.rename("b", "c")
    db.drop("none")
    db.drop("c")
    assert db.collection_names() == ["b"]
    with pytest.raises(DocspanError):
        db.collection("x" * 121)
    assert db.stats()["documents"] == 1


def test_declared_columns(db):
    c = db.create("users", [{"name": "name"}, {"name": "age", "type": "integer", "default": "21"}, {"name": "_id"}, {"name": "age"}, {"name": "odd", "type": "??"}])
    assert [(x.name, x.type) for x in c.columns()] == [("name", "TEXT"), ("age", "INTEGER"), ("odd", "TEXT")]
    assert c.new_record() == {"name": "", "age": 21, "odd": ""}
    c.insert({"_id": "1", "name": "A"})
    assert c.get("1")["age"] == 21
    c.add_column(Column_("on", "BOOLEAN", "yes"))
    assert c.get("1")["on"] is True
    c.rename_column("age", "years")
    assert c.get("1")["years"] == 21 and "age" not in c.get("1")
    c.drop_column("odd")
    assert c.fields() == ["_id", "name", "on", "years"]
    c.apply_definition([{"name": "name"}, {"name": "extra", "type": "REAL"}])
    assert [x.name for x in c.columns()] == ["name", "extra"]
    assert c.get("1") == {"_id": "1", "name": "A", "extra": 0}
    with pytest.raises(DocspanError):
        db.create("__schema")


def test_backup_restore_compact(db, spark, tmp_path):
    db["a"].insert_many([{"_id": "1"}, {"_id": "2"}])
    db["a"].ensure_index("x")
    db.backup(f"file://{tmp_path}/copy")
    db["a"].delete({"_id": "1"})
    db.compact(keep=0, grace_seconds=0)
    assert db["a"].count() == 1 and len(db.store.names("data")) == 1 and len(db["a"].indexes()) == 2
    back = Database.restore(spark, f"file://{tmp_path}/copy", f"file://{tmp_path}/back")
    assert back["a"].count() == 2 and back.verify() == 2
    with pytest.raises(DocspanError):
        Database.restore(spark, f"file://{tmp_path}/copy", f"file://{tmp_path}/back")
    Database.restore(spark, f"file://{tmp_path}/copy", f"file://{tmp_path}/back", overwrite=True)
    with pytest.raises(NotFound):
        Database(spark, f"file://{tmp_path}/none", create=False)


def test_files(db):
    data = b"hello world!" * 500
    id = db.files.upload("a.txt", data, chunk_size=4)
    assert db.files.metadata(id)["chunkSize"] == 1024 and db.files.metadata(id)["length"] == 6000
    assert db["fs.chunks"].count() == 6
    out = io.BytesIO()
    assert db.files.download(id, out) and out.getvalue() == data
    assert not db.files.download("none", out)
    empty = db.files.upload("e", b"")
    out = io.BytesIO()
    assert db.files.download(empty, out) and out.getvalue() == b""
    assert bytes(db.files.contents().where(f"files_id = '{id}'").first().content) == data


def test_csv_and_json(db, spark, tmp_path):
    c = db["t"]
    assert c.import_csv('_id,status,age,note\n1,paid,36,"a, b"\n2,,2.5,\n,,,\n3,true,"[1, 2]",1e3\n') == 3
    assert c.get("1") == {"_id": "1", "status": "paid", "age": 36, "note": "a, b"}
    assert c.get("2") == {"_id": "2", "status": None, "age": 2.5, "note": None}
    assert c.get("3") == {"_id": "3", "status": True, "age": [1, 2], "note": 1000}
    text = c.export_csv()
    assert text.splitlines()[0] == "_id,age,note,status" and '1,36,"a, b",paid' in text
    d = db["u"]
    assert d.import_json(c.export_json()) == 3
    assert d.get("3") == c.get("3")
    (tmp_path / "x.jsonl").write_text('{"_id": "a", "v": 1}\n\n{"v": {"w": [1]}}\n')
    assert db["v"].import_json_files(f"file://{tmp_path}/x.jsonl") == 2
    (tmp_path / "x.json").write_text('[{"_id": "q"}, {"_id": "r"}]')
    assert db["v"].import_json_files(f"file://{tmp_path}/x.json") == 2
    assert db["v"].count() == 4
    with pytest.raises(QueryError):
        d.import_json("{}")


def test_profile_and_fields(db):
    c = db["p"]
    c.insert_many([{"_id": "1", "status": "a", "age": 3, "o": {"x": {"y": 1}}}, {"_id": "2", "status": "b"}])
    got = {r.field: (r.types, r.present, r.missing, r.coverage, r.samples) for r in c.profile().collect()}
    assert got["status"] == ("string", 2, 0, 100.0, "a | b")
    assert got["age"] == ("number", 1, 1, 50.0, "3")
    assert c.fields() == ["_id", "age", "o", "o.x", "o.x.y", "status"]


def test_group_and_lookup_of_documents(db):
    db["orders"].insert_many([{"city": "Pune", "total": 10, "userId": "u1"}, {"city": "Pune", "total": "5", "userId": "u2"}, {"city": "Goa", "total": 3}, {"total": None}])
    db["users"].insert_many([{"_id": "u1", "name": "Ada"}])
    got = {r.get("_id"): r for r in db.query('db.orders.aggregate([{ $group: { _id: "$city", n: { $sum: 1 }, total: { $sum: "$total" } } }])')}
    assert (got["Pune"]["n"], got["Pune"]["total"], got["Goa"]["total"], got[None]["n"]) == (2, 15, 3, 1)
    rows = db.query('db.orders.aggregate([{ $match: { userId: { $exists: true } } }, { $lookup: { from: "users", localField: "userId", foreignField: "_id", as: "user" } }, { $sort: { userId: 1 } }])')
    assert [[u["name"] for u in r["user"]] for r in rows] == [["Ada"], []]
    assert db.query('db.orders.aggregate([{ $count: "n" }])') == [{"n": 4}]
    first = db.query('db.orders.aggregate([{ $group: { _id: null, f: { $first: "$city" } } }])')
    assert first[0]["f"] == "Pune"
    db.lookup_cap = 1
    db["users"].insert({"_id": "u9"})
    with pytest.raises(DocspanError):
        db.query('db.orders.aggregate([{ $lookup: { from: "users", localField: "userId", foreignField: "_id", as: "user" } }])')


def test_json_text_is_json(db):
    db["j"].insert({"_id": "é\"\n", "s": "ü😀\t", "n": -0.0, "big": 2**60, "f": 1.5})
    assert json.loads(db["j"].export_json())[0] == {"_id": "é\"\n", "s": "ü😀\t", "n": 0, "big": 2**60, "f": 1.5}


def sent(spark):
    """Bytes of all task results so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    gateway = spark.sparkContext._gateway
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).resultSize() for i in range(stages.size()))


def test_documents_go_to_the_driver_deflated(db, spark):
    c = db["docs"]
    c.insert_frame(spark.range(20000).selectExpr("cast(id as string) as _id", "id as key", "concat('Customer#', lpad(id, 9, '0')) as name", "'BUILDING' as segment"))
    for read in (c.iterate, lambda: db.query("db.docs.find({})"), lambda: json.loads(c.export_json())):
        before = sent(spark)
        docs = list(read())
        size = len(json.dumps(docs, separators=(",", ":")))
        assert size > 1500000 and sent(spark) - before < size / 4
        assert sorted(d["key"] for d in docs) == list(range(20000))
        assert all(d == {"_id": str(d["key"]), "key": d["key"], "name": f"Customer#{d['key']:09}", "segment": "BUILDING"} for d in docs)


@pytest.mark.parametrize("limit", [1, 40, 1 << 20])
def test_blocks_of_documents_keep_values_and_order(db, monkeypatch, limit):
    monkeypatch.setattr("docspan.sources.documents.BLOCK_BYTES", limit)
    c = db["odd"]
    assert list(c.iterate()) == db.query("db.odd.find({})") == [] and c.export_json() == "[]"
    values = ["a,b", "]\n[", '"}', " é\U0001f600", "\0", "", None, [1, [2]], {"x": {}}, 10**15, 0.5, True, "long " * 300]
    docs = [{"_id": f"{7 * i % 13:02}", "v": v} for i, v in enumerate(values)]
    c.insert_many(docs)
    assert sorted(c.iterate(), key=lambda d: d["_id"]) == sorted(docs, key=lambda d: d["_id"])
    assert c.find().skip(2).limit(9).to_list() == docs[2:11]
    falling = sorted(docs, key=lambda d: d["_id"], reverse=True)
    assert c.find().sort("_id", False).to_list() == db.query("db.odd.find({}).sort({ _id: -1 })") == falling
    assert sorted(json.loads(c.export_json()), key=lambda d: d["_id"], reverse=True) == falling
