import pytest

from docspan.errors import QueryError, UnsupportedOperator
from docspan.operators import browse
from docspan import assist
from docspan.plans.syntax import All, Any_, Compare, Delete, Exists, Find, In, Update, parse, read
from docspan.functions.values import canonical, number_of


def test_relaxed_json():
    assert read("{ a: 1, 'b': [true, null, -1.5e2], \"c\\u00e9\": { $x.y: \"\\ud83d\\ude00\" } }") == {"a": 1, "b": [True, None, -150.0], "cé": {"$x.y": "😀"}}
    for bad in ("{a 1}", "{a: }", "[1,]", "{a: 1", "{a: 1} x", "{a: nope}", '"abc'):
        with pytest.raises(QueryError):
            read(bad)


def test_find():
    q = parse('db.users.find({ age: { $gte: 21, $lt: 30 }, "a.b": "x)" }).sort({ a: 1, b: -1, c: "x" }).skip(3).limit(7).project({ a: 1, b: 0, c: false });')
    assert q.filter == All((Compare("age", "$gte", 21), Compare("age", "$lt", 30), Compare("a.b", "$eq", "x)")))
    assert q.sort == (("a", True), ("b", False), ("c", False)) and (q.skip, q.limit, q.project) == (3, 7, ("a", "c"))
    assert parse("db.users.find()") == Find("users") == parse(" db.users.find({ }) ")
    assert parse("db.`fs.files`.find()").collection == "fs.files"
    assert parse("db.u.find({}).limit(50).page(2)").skip == 50
    assert (parse("db.u.find({}).page(3)").skip, parse("db.u.find({}).page(3, 25)").skip) == (400, 50)
    assert parse("db.u.find({ $or: [] })").filter == Any_(())
    assert parse("db.u.find({ a: { $exists: 0 } })").filter == Exists("a", True)
    assert parse("db.u.find({ a: { $nin: [1] } })").filter == In("a", (1,), True)


@pytest.mark.parametrize("text", ["", "select 1", "db.u.find({}).nope()", "db.u.find({}) x", "db.u.find({}).page(0)", "db.u.find({}).page(1, 0)", "db.u.find({}).limit(\"x\")", "db.u.find(1)", "db.u.aggregate({})", "db.u.aggregate([]) x", "db.u.find({ a: { $in: 3 } })"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


def test_unsupported():
    for text in ("db.u.find({ $nor: [] })", "db.u.find({ a: { $gt: 1, b: 2 } })", "db.u.aggregate([{ $unwind: 1 }])"):
        with pytest.raises(UnsupportedOperator):
            parse(text)


def test_writes():
    assert parse("db.u.update({ a: 1 }, { $set: { b: [1, 2] } })") == Update("u", Compare("a", "$eq", 1), {"$set": {"b": [1, 2]}})
    assert parse("db.u.update({ a: 1 })").changes == {}
    assert parse("db.u.delete()") == Delete("u")


def test_numbers():
    assert [number_of(x) for x in ("36", "1,234", " -5.5 ", "1e3", ".5", "5d", "", "abc", True, None, 7)] == [36, 1234, -5.5, 1000.0, 0.5, None, None, None, None, None, 7]
    assert canonical({"b": 1.0, "a": [None, "é"]}) == '{"a":[null,"é"],"b":1}'


def test_browse_filters():
    assert browse.normalise("status: paid") == '{ status: "paid" }'
    assert browse.normalise("age = 36") == "{ age: 36 }"
    assert browse.normalise('{ a: "x" }') == '{ a: "x" }' and browse.normalise("  ") == "{}"
    assert browse.build("a", "contains", "x.y") == '{ a: { $regex: "x.y" } }'
    assert browse.build("a", ">=", "5") == "{ a: { $gte: 5 } }"
    assert browse.build("a", "<>", "b") == '{ a: { $ne: "b" } }'
    assert browse.build("a", "equals", "") == '{ a: "" }'
    for bad in (("", "=", "x"), ("a b", "=", "x"), ("a", "like", "x"), ("a", "contains", " ")):
        with pytest.raises(QueryError):
            browse.build(*bad)
    with pytest.raises(QueryError):
        browse.normalise("nothing here")


def test_assist():
    assert assist.completions("db.users.fi", 11) == ["find"]
    assert assist.completions("{ $g", 4) == ["$group", "$gt", "$gte"]
    assert len(assist.completions("", 0, [f"c{i}" for i in range(50)])) == 40
    assert assist.samples("part")["Everything"] == "db.part.find().limit(20)"
