"""The command line: python -m docspan <verb> <database> ..."""

from __future__ import annotations

import argparse
import json
import sys
from typing import Any

from docspan import assist
from docspan.database import Database
from docspan.errors import DocspanError, NotFound


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docspan", description="Document queries on Spark.")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args: str, **options: dict) -> argparse.ArgumentParser:
        v = verbs.add_parser(name)
        for a in args:
            v.add_argument(a.rstrip("?"), nargs="?" if a.endswith("?") else None)
        for o, kw in options.items():
            v.add_argument(f"--{o}", **kw)
        v.add_argument("--passphrase")
        return v

    number = {"type": int}
    verb("info", "database")
    verb("collections", "database")
    verb("tree", "database")
    verb("compact", "database")
    verb("backup", "database", "target")
    verb("restore", "source", "database", overwrite={"action": "store_true"})
    verb("indexes", "database", "collection")
    verb("find", "database", "collection", "filter?", filter={"dest": "option"}, limit=number | {"default": 200}, page=number | {"default": 0})
    verb("browse", "database", "collection", "filter?", filter={"dest": "option"}, limit=number | {"default": 200}, page=number | {"default": 0})
    verb("query", "database", "text")
    verb("insert", "database", "collection", "json")
    verb("replace", "database", "collection", "json")
    verb("delete-id", "database", "collection", "id")
    verb("explain", "database", "text", "filter?")
    verb("samples", "collection?")
    verb("changkey", "database", "new")
    return p


def run(args: list[str], spark: Any = None) -> Any:
    """What a command prints, as a value."""
    a = _parser().parse_args(args)
    if a.verb == "samples":
        return assist.samples(a.collection or "orders")
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("docspan").getOrCreate()
    if a.verb == "restore":
        return Database.restore(spark, a.source, a.database, a.overwrite, a.passphrase).stats()
    db = Database(spark, a.database, create=a.verb in ("insert", "query"), passphrase=a.passphrase)
    if a.verb == "info":
        return db.stats()
    if a.verb == "collections":
        return db.collection_names()
    if a.verb == "tree":
        return db.tree()
    if a.verb == "compact":
        db.compact()
        return db.stats()
    if a.verb == "changkey":
        db.change_passphrase(a.new)
        return {"changed": a.database}
    if a.verb == "backup":
        db.backup(a.target)
        return {"backup": a.target}
    if a.verb == "query":
        r = db.execute(a.text)
        return {"operation": r.operation, "affected": r.affected} if r.relation is None else db.query(a.text)
    if a.verb == "explain":
        if a.filter is None and a.text.lstrip().startswith("db."):
            return db.explain(a.text).__dict__
        return db[a.text].explain(a.filter or "{}").__dict__
    c = db[a.collection]
    if a.verb == "indexes":
        return c.indexes()
    if a.verb == "find":
        return c.find(a.option or a.filter or "{}").skip(max(0, a.page) * a.limit).limit(a.limit).to_list()
    if a.verb == "browse":
        from docspan.sources.documents import json_rows

        p = c.browse(a.option or a.filter, a.page, a.limit)
        return {"documents": [json.loads(r.json) for r in json_rows(p.relation).toLocalIterator()], "status": p.status, "page": p.page_text, "explain": c.explain(p.filter).text(p.shown)}
    if a.verb == "insert":
        return {"_id": c.insert(a.json)}
    if a.verb == "replace":
        c.replace(a.json)
        return {"replaced": 1}
    if not c.delete_by_id(a.id):
        raise NotFound(f"{c.name} has no _id {a.id}")
    return {"deleted": a.id}


def main(args: list[str] | None = None, spark: Any = None) -> int:
    try:
        print(json.dumps(run(sys.argv[1:] if args is None else args, spark), indent=2, ensure_ascii=False, default=str))
        return 0
    except DocspanError as e:
        print(f"error: {e}", file=sys.stderr)
        return e.exit_code
