import json

import pytest

from docspan.cli import main
from docspan.database import Database
from docspan.errors import EncryptionError, UnsupportedOperator
from docspan.operators.profile import find_in_page, grid
from docspan.relation import typed
from docspan.sources.encryption import Vault
from docspan.streaming.queries import stream_query


def stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "2024-01-01 00:01:00"), (2, "b", "2024-01-01 00:02:00"), (3, "a", "2024-01-01 00:12:00")], "k int, g string, t string").selectExpr("k", "g", "cast(t as timestamp) as t")
    df.write.mode("overwrite").parquet(f"{tmp_path}/in")
    return typed(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "k")


def results(df, name, mode, spark, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_stream_find_and_group(spark, tmp_path):
    rel = stream(spark, tmp_path)
    rows = results(stream_query(rel, 'db.s.find({ g: "a" }).project({ k: 1 })'), "found", "append", spark, tmp_path)
    assert sorted(r.k for r in rows) == [1, 3]
    df = stream_query(rel, 'db.s.aggregate([{ $match: { k: { $gt: 0 } } }, { $group: { _id: "$g", n: { $sum: 1 } } }])', watermark=("t", "1 minute"), window="10 minutes")
    rows = results(df, "grouped", "complete", spark, tmp_path)
    assert sorted((r["window"].start.minute, r["_id"], r.n) for r in rows) == [(0, "a", 1), (0, "b", 1), (10, "a", 1)]
    for text in ("db.s.find({}).limit(1)", "db.s.aggregate([{ $sort: { k: 1 } }])", 'db.s.aggregate([{ $group: { _id: null, f: { $first: "$k" } } }])'):
        with pytest.raises(UnsupportedOperator):
            stream_query(rel, text)


def test_command_line(spark, tmp_path, capsys):
    db = f"file://{tmp_path}/db"

    def run(*args, code=0):
        assert main(list(args), spark) == code
        out = capsys.readouterr().out
        return json.loads(out) if out else None

    assert run("insert", db, "users", '{"_id": "1", "name": "Ada", "age": 36}') == {"_id": "1"}
    assert run("query", db, 'db.users.update({}, { $inc: { age: 1 } })') == {"operation": "update", "affected": 1}
    assert run("find", db, "users", "{ age: 37 }")[0]["name"] == "Ada"
    assert run("browse", db, "users", "name: Ada")["status"] == "1 matching row(s). Collection has 1."
    assert run("collections", db) == ["users"] and run("info", db)["documents"] == 1
    assert run("tree", db)[0]["columns"] == ["_id", "age", "name"]
    assert run("explain", db, 'db.users.find({ _id: "1" })')["strategy"] == "ID"
    assert run("explain", db, "users", "{ age: 1 }")["strategy"] == "COLLSCAN"
    assert run("indexes", db, "users")[0]["name"] == "_id_"
    run("replace", db, "users", '{"_id": "1", "name": "Eve"}')
    run("backup", db, f"{db}-copy")
    run("delete-id", db, "users", "1")
    run("delete-id", db, "users", "1", code=4)
    assert run("restore", f"{db}-copy", f"{db}-back")["documents"] == 1
    run("compact", db)
    run("info", f"{db}-none", code=4)
    assert "Everything" in run("samples")


def test_encryption(spark, tmp_path):
    path = f"file://{tmp_path}/vault"
    v = Vault(spark, path, "one")
    sealed = v.seal(spark.createDataFrame([("secret",), (None,)], "s string"), "s").cache()
    assert Vault.is_encrypted(spark, path) and b"secret" not in bytes(sealed.first().s)
    v.change_passphrase("two")
    assert [r.s for r in Vault(spark, path, "two").open(sealed, "s").collect()] == ["secret", None]
    with pytest.raises(EncryptionError):
        Vault(spark, path, "one")


def test_encrypted_database(spark, tmp_path, capsys):
    path = f"file://{tmp_path}/locked"
    db = Database(spark, path, passphrase="one")
    db["a"].insert_many([{"_id": "1", "v": 5}, {"_id": "2", "v": "needle"}])
    assert db["a"].update({"_id": "1"}, {"$inc": {"v": 1}}) == 1 and db["a"].get("1") == {"_id": "1", "v": 6}
    stored = b"".join(p.read_bytes() for p in (tmp_path / "locked").rglob("*.parquet"))
    assert b"needle" not in stored
    assert main(["info", path], spark) == 2 and main(["info", path, "--passphrase", "two"], spark) == 2
    assert main(["changkey", path, "two", "--passphrase", "one"], spark) == 0
    again = Database(spark, path, passphrase="two")
    assert [d["v"] for d in again["a"].find({"v": {"$ne": 7}}).sort("_id").to_list()] == [6, "needle"]
    Database(spark, f"file://{tmp_path}/plain")
    with pytest.raises(EncryptionError):
        Database(spark, f"file://{tmp_path}/plain", passphrase="x")


def test_grid_and_find_in_page(spark):
    rel = typed(spark.createDataFrame([(1, "Apple", 2.5), (2, None, 3.0)], "k int, s string, v double"), "k")
    assert [tuple(r) for r in grid(rel, ["k", "s", "zz"]).collect()] == [("1", "Apple", ""), ("2", "", "")]
    assert [r.k for r in find_in_page(rel, "aPP", ["s"]).df.collect()] == [1]
    assert find_in_page(rel, " ", ["s"]).df.count() == 2
