"""Databases: stored collections of documents with snapshots, transactions, indexes as layout, and declared schemas.

A database is a folder. Each commit is a new manifest, manifests/<version>.json, that lists the Parquet folders of every
collection; data folders are never changed. A commit succeeds if its version is still free, so there is one writer, and
readers keep the snapshot that they opened. Inserts add a folder; updates and deletes write anew the folders they meet.

The paths of an index are stored as columns of their own next to the documents (kind, number and text of the value). Rows
are range-partitioned and sorted by the first index, or by _id, whose Bloom filters serve look-ups. Filters on such paths
compile to comparisons of these columns, so Parquet's statistics decide which row groups are read at all.
"""

from __future__ import annotations

import copy
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspan.errors import DocspanError, DuplicateId, EncryptionError, IntegrityError, NotFound, QueryError
from docspan.functions.values import Value, let
from docspan.operators import browse, profile, stages, updates
from docspan.operators.filters import where
from docspan.plans import syntax
from docspan.plans.syntax import Aggregate, All, Any_, Compare, Delete, Filter, Find, Update
from docspan.relation import DOC, ORD, Relation, documents
from docspan.session import Query, Result
from docspan.sources import documents as io
from docspan.sources import filestore
from docspan.sources.encryption import Vault
from docspan.sources.storage import Store

LONGEST_NAME = 120
ID_INDEX = "_id_"
LOCK = "lock.json"
HIDDEN = "__schema"
RESERVED = (HIDDEN, "fs.files", "fs.chunks")
SCHEMA = "_id string, doc variant, _ord long"
SEALED = "_id string, doc binary, _ord long"
#: Declared types and their defaults.
TYPES = {"TEXT": "", "INTEGER": 0, "REAL": 0.0, "BOOLEAN": False, "DATETIME": None}


@dataclass(frozen=True)
class Plan:
    """How a find gets its rows."""

    collection: str
    strategy: str
    index: str | None = None
    #: Documents within the index's bounds, and documents of the result.
    examined: int = 0
    returned: int = 0
    #: What the scan did: documents and files that it read, all files, and the filters that reached it.
    scanned: int = 0
    files: int = 0
    files_total: int = 0
    pushed: str = ""

    def text(self, returned: int | None = None) -> str:
        n = self.returned if returned is None else returned
        if self.strategy == "AGGREGATE":
            return f"AGGREGATE  collection={self.collection}  returned={n}"
        if self.strategy in ("UPDATE", "DELETE"):
            return f"{self.strategy}  collection={self.collection}  affected={n}"
        return f"{self.strategy}  examined={self.examined}  returned={n}  index={self.index or 'none'}"


@dataclass(frozen=True)
class Column_:
    """A declared column."""

    name: str
    type: str = "TEXT"
    default: Any = None
    unique: bool = False

    def value(self) -> Any:
        return TYPES[self.type] if self.default is None else parse_cell(self.default, self.type)


def parse_cell(value: Any, kind: str) -> Any:
    """A cell's value of a declared type; what can't be read becomes the type's default."""
    if value is None:
        return TYPES[kind]
    text = str(value).strip()
    try:
        if kind == "INTEGER":
            return int(text)
        if kind == "REAL":
            return float(text)
    except ValueError:
        return TYPES[kind]
    if kind == "BOOLEAN":
        return value if isinstance(value, bool) else text.lower() in ("true", "1", "yes")
    return str(value)


def declared(columns: Iterable[Column_ | dict]) -> list[Column_]:
    """Trimmed columns; _id, names with $ or none, and repeated names go; an unknown type is TEXT."""
    out: dict[str, Column_] = {}
    for c in columns:
        c = Column_(**c) if isinstance(c, dict) else c
        name, kind = c.name.strip(), c.type.strip().upper()
        if name and name != "_id" and not name.startswith("$") and name not in out:
            out[name] = Column_(name, kind if kind in TYPES else "TEXT", c.default, c.unique)
    return list(out.values())


class Database:
    def __init__(self, spark: SparkSession, path: str, *, create: bool = True, read_only: bool = False, lookup_cap: int = 0, passphrase: str | None = None, exclusive: bool = False, verify: bool = False):
        """passphrase: documents of a new database are encrypted, those of an old one are opened; ids stay plain.

        exclusive: a second exclusive opening fails until close(). verify: all documents are checked against the manifest.
        """
        self.spark, self.path, self.read_only, self.lookup_cap = spark, path, read_only, lookup_cap
        self.store = Store(spark, path)
        self.vault: Vault | None = None
        self.grids: dict[str, DataFrame] = {}
        self.locked = False
        if self.store.exists("manifests"):
            locked = Vault.is_encrypted(spark, path)
            if locked != (passphrase is not None):
                raise EncryptionError(f"{path} needs a passphrase" if locked else f"{path} is not encrypted")
        if passphrase is not None and (create or self.store.exists("manifests")):
            self.vault = Vault(spark, path, passphrase)
        if not self.store.exists("manifests"):
            if not create or read_only:
                raise NotFound(f"no database at {path}")
            self.store.write("manifests/00000000.json", {"collections": {}})
        if exclusive:
            if not self.store.write(LOCK, {"owner": uuid.uuid4().hex}):
                raise DocspanError(f"{path} is already open; if its owner is gone, remove {LOCK}")
            self.locked = True
        self.transaction_: Transaction | None = None
        self.refresh()
        if verify:
            self.verify()

    # snapshots

    def refresh(self) -> None:
        """Opens the last snapshot. The writes of an open transaction stay as they are."""
        if self.transaction_ is not None:
            return
        names = [n for n in self.store.names("manifests") if n.endswith(".json")]
        if not names:
            raise IntegrityError(f"no manifest in {self.path}")
        self.version = int(names[-1][:-5])
        self.manifest = self.store.read(f"manifests/{names[-1]}")

    def _commit(self, manifest: dict) -> None:
        if self.read_only:
            raise DocspanError("the database was opened for reading only")
        if self.transaction_ is not None:
            self.manifest = manifest
            return
        if not self.store.write(f"manifests/{self.version + 1:08d}.json", manifest):
            raise DocspanError("another writer has committed; refresh() and try again")
        self.version, self.manifest = self.version + 1, manifest

    def begin(self) -> Transaction:
        """A transaction over all collections; a second begin() gives the same one."""
        if self.read_only:
            raise DocspanError("the database was opened for reading only")
        self.transaction_ = self.transaction_ or Transaction(self, copy.deepcopy(self.manifest))
        return self.transaction_

    def close(self) -> None:
        if self.transaction_ is not None:
            self.transaction_.rollback()
        for name in list(self.grids):
            self.forget(name)
        if self.locked:
            self.store.delete(LOCK)
            self.locked = False

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()

    # catalog

    def collection_names(self, hidden: bool = False) -> list[str]:
        return sorted(n for n in self.manifest["collections"] if hidden or n not in RESERVED)

    def collection(self, name: str) -> Collection:
        if not name or len(name) > LONGEST_NAME:
            raise DocspanError(f"a collection's name has 1 to {LONGEST_NAME} characters")
        return Collection(self, name)

    __getitem__ = collection

    def drop(self, name: str) -> None:
        """No error if there is none. The engine's own collections can't be dropped."""
        if name in RESERVED or name.startswith("__"):
            raise DocspanError(f"the name {name} is reserved")
        if name in self.manifest["collections"]:
            m = copy.deepcopy(self.manifest)
            del m["collections"][name]
            self._commit(m)

    def rename(self, name: str, new: str) -> None:
        if name not in self.manifest["collections"]:
            raise NotFound(f"no collection {name}")
        if new in self.manifest["collections"] or any(n in RESERVED or n.startswith("__") for n in (name, new)):
            raise DocspanError(f"{name} can't become {new}: the name is taken or reserved")
        self.collection(new)
        m = copy.deepcopy(self.manifest)
        m["collections"][new] = m["collections"].pop(name)
        self._commit(m)

    def create(self, name: str, columns: Iterable[Column_ | dict] = ()) -> Collection:
        """A collection with declared columns; the schema is advisory, but defaults and uniqueness hold."""
        if name in RESERVED or name.startswith("__"):
            raise DocspanError(f"the name {name} is reserved")
        c = self.collection(name)
        if name in self.manifest["collections"]:
            raise DocspanError(f"the collection {name} is there already")
        own = declared(columns)
        c._change(columns=[x.__dict__ for x in own])
        for x in own:
            if x.unique:
                c.ensure_index(x.name, unique=True)
        return c

    def tree(self) -> list[dict]:
        return [{"collection": n, "count": self[n].count(), "columns": self[n].fields(), "indexes": [i["name"] for i in self[n].indexes()]} for n in self.collection_names()]

    def stats(self) -> dict:
        names = self.collection_names()
        return {"path": self.path, "bytes": self.store.bytes(), "version": self.version, "collections": len(names), "documents": sum(self[n].count() for n in names)}

    # statements

    def relation(self, name: str) -> Relation:
        return self.collection(name).relation()

    def execute(self, text: str, strict: bool = False) -> Result:
        q = syntax.parse(text)
        c = self.collection(q.collection)
        if isinstance(q, Update):
            return Result(q.collection, "update", affected=c.update(q.filter, q.changes))
        if isinstance(q, Delete):
            return Result(q.collection, "delete", affected=c.delete(q.filter))
        from dataclasses import replace

        rel = replace(c.relation(), strict=strict)
        if isinstance(q, Aggregate):
            return Result(q.collection, "aggregate", stages.run_aggregate(rel, q, self.relation, self.lookup_cap))
        return Result(q.collection, "find", stages.run_find(rel, q))

    def materialise(self, text: str) -> DataFrame:
        """A statement's rows as (collection, id, json), kept on the executors' disks, for paging; a new result replaces the old one."""
        r = self.execute(text)
        if r.relation is None:
            raise QueryError("only a find or an aggregate has rows")
        rows = io.json_rows(r.relation).select(F.lit(r.collection).alias("collection"), F.col("_id").alias("id"), "json")
        self.forget(r.collection)
        self.grids[r.collection] = rows.persist(StorageLevel.DISK_ONLY)
        return self.grids[r.collection]

    def forget(self, collection: str) -> None:
        """Drops a materialised result."""
        if (old := self.grids.pop(collection, None)) is not None:
            old.unpersist()

    def query(self, text: str) -> list[dict]:
        """The documents of a find or an aggregate."""
        r = self.execute(text)
        return [] if r.relation is None else list(io.json_values(r.relation))

    def explain(self, text: str) -> Plan:
        """The plan of any statement; writes and aggregates are not run."""
        q = syntax.parse(text)
        if not isinstance(q, Find):
            return Plan(q.collection, type(q).__name__.upper())
        return self.collection(q.collection).explain(q.filter, q.skip, q.limit)

    # whole database

    def backup(self, target: str) -> None:
        """The current snapshot's folder, copied."""
        other = Store(self.spark, target)
        if other.exists("manifests"):
            raise DocspanError(f"{target} is there already")
        self.store.copy_to(other)

    @staticmethod
    def restore(spark: SparkSession, source: str, target: str, overwrite: bool = False, passphrase: str | None = None) -> Database:
        old, new = Store(spark, source), Store(spark, target)
        if not old.exists("manifests"):
            raise NotFound(f"no database at {source}")
        if new.exists():
            if not overwrite:
                raise DocspanError(f"{target} is there already")
            new.delete("")
        old.copy_to(new)
        return Database(spark, target, create=False, passphrase=passphrase)

    def change_passphrase(self, new: str) -> None:
        """Wraps the data key anew; documents stay as they are."""
        if self.vault is None:
            raise EncryptionError(f"{self.path} is not encrypted")
        self.vault.change_passphrase(new)

    def compact(self, keep: int = 2, grace_seconds: float = 900.0) -> None:
        """Writes every collection anew as one folder, with its layout, and drops what is out of use.

        Folders of the last keep manifests before this one stay, for readers that have them open, and so does what is younger
        than grace_seconds, which another writer may be about to commit. Not allowed while a transaction is open.
        """
        if self.transaction_ is not None:
            raise DocspanError("commit or roll back the transaction before compact()")
        with self.begin() as t:
            for n in self.collection_names(hidden=True):
                c = self.collection(n)
                if len(c.entry["folders"]) > 1:
                    c._replace(c.entry["folders"], c._read(c.entry["folders"]))
            t.commit()
        manifests = [n for n in self.store.names("manifests") if n.endswith(".json")]
        kept = manifests[-(keep + 1) :]
        used = {f for n in kept for e in self.store.read(f"manifests/{n}")["collections"].values() for f in e["folders"]}
        for n in self.store.names("data"):
            if f"data/{n}" not in used and self.store.age(f"data/{n}") >= grace_seconds:
                self.store.delete(f"data/{n}")
        for n in manifests[: len(manifests) - len(kept)]:
            self.store.delete(f"manifests/{n}")

    checkpoint = refresh

    def verify(self) -> int:
        """Reads every collection and compares each folder's rows and checksum with the manifest; how many documents there are."""
        total = 0
        for n in self.collection_names(hidden=True):
            c = self.collection(n)
            for f in c.entry["folders"]:
                try:
                    found = c._sums(f)
                except Exception as e:
                    raise IntegrityError(f"{n}: {f} can't be read: {str(e)[:300]}") from e
                if (known := c.entry.get("sums", {}).get(f)) is not None and list(known) != found:
                    raise IntegrityError(f"{n}: {f} has changed")
                total += found[0]
        return total

    @property
    def files(self) -> Files:
        return Files(self)


class Transaction:
    """Writes of all collections until commit(); leaving a with block without it drops them."""

    def __init__(self, db: Database, before: dict):
        self.db, self.before = db, before

    def commit(self) -> None:
        self._end()
        staged, self.db.manifest = self.db.manifest, self.before
        if staged != self.before:
            self.db._commit(staged)

    def rollback(self) -> None:
        if self.db.transaction_ is self:
            self._end()
            self.db.manifest = self.before

    def _end(self) -> None:
        if self.db.transaction_ is not self:
            raise DocspanError("the transaction has ended")
        self.db.transaction_ = None

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, *_: Any) -> None:
        self.rollback()


def _paths_of(f: Filter) -> list[str]:
    return [p for x in f.parts for p in _paths_of(x)] if isinstance(f, All) else [f.path] if isinstance(f, Compare) else []


def _scanned(df: DataFrame) -> tuple[int, dict]:
    """How many rows a filtered scan gives, and its scan's figures: of the plan that has run."""
    run = df.select("_id")._jdf.queryExecution()
    n = run.toRdd().count()
    leaves = run.executedPlan().collectLeaves()
    out = {"scanned": 0, "files": 0, "files_total": 0, "pushed": ""}
    for i in range(leaves.size()):
        scan = leaves.apply(i)
        if "FileScan" in scan.simpleString(1000) or scan.nodeName().startswith("Scan parquet"):
            metric = lambda name: scan.metrics().get(name).get().value() if scan.metrics().contains(name) else 0  # noqa: B023, E731
            out |= {"scanned": metric("numOutputRows"), "files": metric("numFiles"), "files_total": len(df.inputFiles())}
            if scan.metadata().contains("PushedFilters"):
                out["pushed"] = scan.metadata().get("PushedFilters").get()
    return n, out


class Collection:
    def __init__(self, db: Database, name: str):
        self.db, self.name = db, name

    @property
    def entry(self) -> dict:
        return self.db.manifest["collections"].get(self.name) or {"folders": [], "next": 0, "indexes": [], "columns": []}

    def _change(self, **values: Any) -> None:
        m = copy.deepcopy(self.db.manifest)
        m["collections"][self.name] = {**self.entry, **values}
        self.db._commit(m)

    # reading

    @property
    def keys(self) -> dict[str, tuple[str, str, str]]:
        """The columns of each indexed path: kind, number and text. Encrypted collections have none."""
        paths = dict.fromkeys(p for i in self.entry["indexes"] for p in i["paths"] if p != "_id")
        return {} if self.db.vault is not None else {p: tuple(f"_key{zlib.crc32(p.encode()):08x}_{x}" for x in "knt") for p in paths}

    def _read(self, folders: list[str], with_folder: bool = False) -> DataFrame:
        """_id, doc and _ord, with the columns of keys; with_folder: _folder too."""
        spark, vault = self.db.spark, self.db.vault
        own = "".join(f", {k} string, {n} double, {t} string" for k, n, t in self.keys.values())
        if not folders:
            return spark.createDataFrame([], SCHEMA + own + ", _folder string" * with_folder)
        df = spark.read.schema((SCHEMA if vault is None else SEALED) + own).parquet(*(f"{self.db.store.root}/{f}" for f in folders))
        if with_folder:
            df = df.withColumn("_folder", F.concat(F.lit("data/"), F.regexp_extract("_metadata.file_path", "/data/([0-9a-f]{32})/[^/]*$", 1)))
        return df if vault is None else vault.open(df, DOC).withColumn(DOC, F.parse_json(DOC))

    def relation(self) -> Relation:
        """All documents; an unknown collection is empty, and stays unknown."""
        return self._relation(self._read(self.entry["folders"]))

    def _relation(self, df: DataFrame) -> Relation:
        return documents(df, keys=self.keys)

    @property
    def df(self) -> DataFrame:
        return self.relation().df

    def find(self, filter: Any = None) -> Query:
        return Query(self.relation(), syntax.filter_of(filter))

    def get(self, id: Any) -> dict | None:
        rows = self.relation().df.where(F.col("_id") == str(id)).select(F.to_json(DOC).alias("j")).limit(1).collect()
        return json.loads(rows[0].j) if rows else None

    def count(self, filter: Any = None) -> int:
        rel = self.relation()
        return (where(rel, syntax.filter_of(filter)) if filter else rel).df.count()

    def __len__(self) -> int:
        return self.count()

    def iterate(self) -> Iterator[dict]:
        return self.find().documents()

    def browse(self, filter: str | None = None, page: int = 0, size: int = syntax.DEFAULT_PAGE) -> browse.Page:
        return browse.browse(self.relation(), filter, page, size)

    def fields(self) -> list[str]:
        return profile.infer_fields(self.relation(), [c["name"] for c in self.entry["columns"]])

    def profile(self, samples: int = 3) -> DataFrame:
        return profile.profile(self.relation(), samples)

    def explain(self, filter: Any = None, skip: int = 0, limit: int = 0) -> Plan:
        """ID for an _id equality, IXSCAN where an index path is bound, else COLLSCAN; with counted rows.

        The strategy stands for a filter that has reached the Parquet scan; if the physical plan doesn't show it, the answer is
        COLLSCAN. scanned and files are the scan's own figures.
        """
        f = syntax.filter_of(filter)
        rel = self.relation()
        strategy, index, bound = "COLLSCAN", None, All()
        if isinstance(f, Compare) and f.path == "_id" and f.op == "$eq":
            strategy, bound = "ID", f
        elif (best := self._index_for(f)) is not None:
            strategy, (index, bound) = "IXSCAN", best
        examined, scan = _scanned(where(rel, bound).df)
        if strategy == "IXSCAN" and not any(c in scan["pushed"] for p in _paths_of(bound) for c in self.keys.get(p, ("\0",))):
            strategy, index = "COLLSCAN", None
            examined, scan = _scanned(rel.df)
        found = examined if f == bound else where(rel, f).df.count()
        returned = max(0, found - max(0, skip))
        if limit > 0:
            returned = min(returned, limit)
            if strategy == "IXSCAN":
                examined = min(examined, max(0, skip) + limit)
        return Plan(self.name, strategy, index, examined, returned, **scan)

    def _index_for(self, f: Filter) -> tuple[str, Filter] | None:
        parts = [p for p in (f.parts if isinstance(f, All) else (f,)) if isinstance(p, Compare) and p.op in ("$eq", "$gt", "$gte", "$lt", "$lte")]
        equal = {p.path: p for p in parts if p.op == "$eq"}
        for i in self.entry["indexes"]:  # a compound index that is bound as a whole comes first
            if len(i["paths"]) > 1 and all(p in equal for p in i["paths"]):
                return i["name"], All(tuple(equal[p] for p in i["paths"]))
        for p in sorted(parts, key=lambda p: p.op != "$eq"):
            for i in sorted(self.entry["indexes"], key=lambda i: len(i["paths"])):
                if i["paths"][0] == p.path:
                    return i["name"], p
        return None

    # writing

    def _layout(self, df: DataFrame, spread: bool) -> DataFrame:
        """Rows with the columns of keys, sorted by the first index or by _id; spread: dealt to files by ranges of it."""
        for path, names in self.keys.items():
            v = Value(F.col(DOC), T.VariantType()).child(path.split("."))
            parts = let(v.column, lambda x: let(F.schema_of_variant(x), lambda s: _parts(Value(x, T.VariantType(), s))))
            df = df.withColumn("_parts", parts).select(*df.columns, *(F.col("_parts")[k].alias(n) for k, n in zip("knt", names, strict=True)))
        first = next((i["paths"] for i in self.entry["indexes"]), [])
        by = [F.col(c) for p in first if p in self.keys for c in self.keys[p][1:]] or [F.col("_id")]
        return (df.repartitionByRange(*by) if spread else df).sortWithinPartitions(*by)

    def _save(self, df: DataFrame, spread: bool = True) -> str:
        """Writes rows to a new folder."""
        folder = f"data/{uuid.uuid4().hex}"
        rows = self._layout(df.select("_id", DOC, ORD), spread)
        if self.db.vault is not None:
            rows = self.db.vault.seal(rows.withColumn(DOC, F.to_json(DOC)), DOC)
        rows.write.option("parquet.bloom.filter.enabled#_id", "true").parquet(f"{self.db.store.root}/{folder}")
        return folder

    def _sums(self, folder: str) -> list[int]:
        """[documents, checksum] of a folder's rows."""
        return list(self._read([folder]).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.crc32(F.concat_ws("\0", "_id", F.to_json(DOC)).cast("binary"))), F.lit(0))).first())

    def _check_unique(self, df: DataFrame, undo: str | None = None) -> None:
        for i in self.entry["indexes"]:
            if i["unique"]:
                keys = [Value(F.col(DOC), T.VariantType()).child(p.split(".")).equality_key().alias(f"k{n}") for n, p in enumerate(i["paths"])]
                rows = df.select(*keys)
                present = rows.where(" and ".join(f"k{n} is not null" for n in range(len(keys))))
                if present.groupBy(*present.columns).count().where("count > 1").limit(1).count():
                    if undo:
                        self.db.store.delete(undo)
                    raise DuplicateId(f"index {i['name']} of {self.name} is unique")

    def _replace(self, folders: list[str], df: DataFrame) -> None:
        """Puts df's rows, written to a folder, in the place of these folders."""
        folder = self._save(df)
        rest = [f for f in self.entry["folders"] if f not in folders]
        if any(i["unique"] for i in self.entry["indexes"]):
            self._check_unique(self._read([*rest, folder]), folder)
        sums = self._sums(folder)
        kept = {f: s for f, s in self.entry.get("sums", {}).items() if f in rest}
        if not sums[0]:
            self.db.store.delete(folder)
            self._change(folders=rest, sums=kept)
            return
        self._change(folders=[*rest, folder], sums=kept | {folder: sums})

    def _met(self, f: Filter) -> dict[str, int]:
        """How many documents of each folder a filter matches; folders without any are left out."""
        rows = where(self._relation(self._read(self.entry["folders"], with_folder=True)), f).df
        return {r["_folder"]: r["count"] for r in rows.groupBy("_folder").count().collect()}  # a row a folder

    def _append(self, rows: DataFrame, few: list[str] | None = None) -> int:
        """rows: (_id, doc, _n). They are written first, so that generated ids and counts are of the same rows.

        few: the ids, if they are known and few; then they are looked up, else joined with the collection's.
        """
        start = self.entry["next"]
        defaults = {c["name"]: Column_(**c).value() for c in self.entry["columns"]}
        for name, value in defaults.items():
            if value is not None:
                missing = Value(F.col(DOC), T.VariantType()).child([name]).column.isNull()
                rows = rows.withColumn(DOC, F.when(missing, updates.set_path(F.col(DOC), [name], F.parse_json(F.lit(json.dumps(value))))).otherwise(F.col(DOC)))
        folder = self._save(rows.select("_id", DOC, (F.col("_n") + start).alias(ORD)), spread=few is None)
        new = self._read([folder])
        size = new.agg(F.count(F.lit(1)).alias("n"), F.max(ORD).alias("last")).first()
        if size.n:
            twice = new.groupBy("_id").count().where("count > 1").select("_id").limit(1).collect()
            if not twice and self.entry["folders"]:
                old = self._read(self.entry["folders"]).select("_id")
                twice = (old.where(F.col("_id").isin(few)) if few is not None else new.select("_id").join(old, "_id", "left_semi")).limit(1).collect()
            if twice:
                self.db.store.delete(folder)
                raise DuplicateId(f"{self.name} has _id {twice[0][0]} already")
            if any(i["unique"] for i in self.entry["indexes"]):
                self._check_unique(self.df.unionByName(new), folder)
            self._change(folders=[*self.entry["folders"], folder], next=size.last + 1, sums=self.entry.get("sums", {}) | {folder: self._sums(folder)})
        else:
            self.db.store.delete(folder)
        return size.n

    def insert(self, doc: Any) -> str:
        """The new document's _id."""
        value = json.loads(doc) if isinstance(doc, str) else io.plain(doc)
        if not isinstance(value, dict):
            raise QueryError("a document must be an object")
        if value.get("_id") is None or not str(value["_id"]).strip():
            value["_id"] = self.db.spark.range(1).select(io.new_id()).first()[0]
        own = value["_id"] if isinstance(value["_id"], str) else json.dumps(value["_id"])
        self._append(io.from_values(self.db.spark, [value]), [own])
        return own

    def insert_many(self, docs: Iterable[Any]) -> int:
        return self._append(io.from_values(self.db.spark, docs))

    def insert_frame(self, df: DataFrame) -> int:
        """The rows of any frame as documents, without a stop at the driver."""
        return self._append(io.from_frame(df))

    def import_json(self, text: str) -> int:
        return self._append(io.from_json_array(self.db.spark, text))

    def import_json_files(self, path: str) -> int:
        return self._append(io.read_json(self.db.spark, path))

    def import_csv(self, text: str) -> int:
        return self._append(io.from_csv_text(self.db.spark, text))

    def import_csv_files(self, path: str) -> int:
        return self._append(io.read_csv(self.db.spark, path))

    def export_json(self, filter: Any = None) -> str:
        return io.to_json_array(self.find(filter).run())

    def export_csv(self, filter: Any = None) -> str:
        return io.to_csv_text(self.find(filter).run())

    def replace(self, doc: Any) -> None:
        value = json.loads(doc) if isinstance(doc, str) else io.plain(doc)
        own = value.get("_id")
        if own is None or self.get(own) is None:
            raise NotFound(f"{self.name} has no _id {own}")
        new = io.from_values(self.db.spark, [value]).select("_id", F.to_json(DOC).alias("j")).first()
        doc = F.when(F.col("_id") == new._id, F.parse_json(F.lit(new.j))).otherwise(F.col(DOC))
        folders = list(self._met(Compare("_id", "$eq", new._id)))
        self._replace(folders, self._read(folders).withColumn(DOC, doc))

    def clone(self, id: Any) -> str:
        """A copy of a document under a new _id."""
        doc = self.get(id)
        if doc is None:
            raise NotFound(f"{self.name} has no _id {id}")
        return self.insert({k: v for k, v in doc.items() if k != "_id"})

    def delete_by_id(self, id: Any) -> bool:
        return bool(self.delete(Compare("_id", "$eq", str(id))))

    def delete(self, filter: Any = None) -> int:
        f = syntax.filter_of(filter)
        met = self._met(f)
        if met:
            self._replace(list(met), updates.remaining(self._relation(self._read(list(met))), f).df)
        return sum(met.values())

    def update(self, filter: Any, changes: dict | str) -> int:
        """How many documents matched."""
        f = syntax.filter_of(filter)
        changes = syntax.read(changes) if isinstance(changes, str) else changes
        updates.updated(self._relation(self._read([])), f, changes)  # errors come before any job
        met = self._met(f)
        if met and changes:
            self._replace(list(met), updates.updated(self._relation(self._read(list(met))), f, changes).df)
        return sum(met.values())

    # indexes

    def indexes(self) -> list[dict]:
        return [{"name": ID_INDEX, "path": "_id", "unique": True}, *({"name": i["name"], "path": ",".join(i["paths"]), "unique": i["unique"]} for i in self.entry["indexes"])]

    def ensure_index(self, paths: str | list[str], name: str | None = None, unique: bool = False) -> str:
        """Stores the paths' keys as columns; nothing happens if the name or the paths are there.

        The collection's folders are written anew with the keys. A unique index is checked now and on writes.
        """
        paths = [paths] if isinstance(paths, str) else list(paths)
        name = name or "_".join(paths)
        for i in self.entry["indexes"]:
            if i["name"] == name or i["paths"] == paths:
                return i["name"]
        with _whole(self.db):
            self._change(indexes=[*self.entry["indexes"], {"name": name, "paths": paths, "unique": unique}])
            if self.entry["folders"]:
                self._replace(self.entry["folders"], self._read(self.entry["folders"]).select("_id", DOC, ORD))
        return name

    def drop_index(self, name: str) -> bool:
        if name == ID_INDEX:
            raise DocspanError("the index of _id can't be dropped")
        rest = [i for i in self.entry["indexes"] if i["name"] != name]
        dropped = len(rest) < len(self.entry["indexes"])
        if dropped:
            self._change(indexes=rest)
        return dropped

    # declared columns

    def columns(self) -> list[Column_]:
        return [Column_(**c) for c in self.entry["columns"]]

    def add_column(self, column: Column_ | dict) -> None:
        """Declares a column and sets its default in every document."""
        new = declared([*self.columns(), column])
        if len(new) == len(self.columns()):
            raise DocspanError("the column's name is taken or not allowed")
        with _whole(self.db):
            self.update({}, {"$set": {new[-1].name: new[-1].value()}})
            self._change(columns=[c.__dict__ for c in new])
            if new[-1].unique:
                self.ensure_index(new[-1].name, unique=True)

    def drop_column(self, name: str) -> None:
        with _whole(self.db):
            self._change(columns=[c.__dict__ for c in self.columns() if c.name != name], indexes=[i for i in self.entry["indexes"] if name not in i["paths"]])
            self.update({}, {"$unset": {name: ""}})

    def rename_column(self, name: str, new: str) -> None:
        doc = F.col(DOC)
        old = Value(doc, T.VariantType()).child([name]).column
        moved = F.when(old.isNotNull(), updates.unset_path(updates.set_path(doc, [new], old), [name])).otherwise(doc)
        changed = self.df.select("_id", moved.alias(DOC), ORD)
        own = [Column_(new, c.type, c.default, c.unique) if c.name == name else c for c in self.columns()]
        paths = [{**i, "paths": [new if p == name else p for p in i["paths"]]} for i in self.entry["indexes"]]
        with _whole(self.db):
            self._change(columns=[c.__dict__ for c in own], indexes=paths)
            if self.entry["folders"]:
                self._replace(self.entry["folders"], changed)

    def apply_definition(self, columns: Iterable[Column_ | dict], renames: dict[str, str] | None = None) -> None:
        """Drops, renames (renames: new names by old ones), changes and adds declared columns so that they are these.

        One commit, and one change of the documents for all the drops and additions.
        """
        new = declared(columns)
        names = {c.name for c in new}
        with _whole(self.db):
            for old, name in (renames or {}).items():
                if old in {c.name for c in self.columns()} and name in names:
                    self.rename_column(old, name)
            gone = [c.name for c in self.columns() if c.name not in names]
            old = {c.name for c in self.columns()}
            added = [c for c in new if c.name not in old]
            self._change(columns=[c.__dict__ for c in new], indexes=[i for i in self.entry["indexes"] if not set(gone) & set(i["paths"])])
            changes = {"$unset": dict.fromkeys(gone, "")} if gone else {}
            if added:
                changes["$set"] = {c.name: c.value() for c in added}
            if changes:
                self.update({}, changes)
            for c in added:
                if c.unique:
                    self.ensure_index(c.name, unique=True)

    def new_record(self) -> dict:
        return {c.name: c.value() for c in self.columns()}


class _whole:
    """Several changes as one commit; those of a transaction that is open already stay in it. After an error none of them counts."""

    def __init__(self, db: Database):
        self.db = db

    def __enter__(self) -> None:
        self.own = self.db.transaction_ is None
        self.before = copy.deepcopy(self.db.manifest)
        self.transaction = self.db.begin()

    def __exit__(self, kind: Any, *_: Any) -> None:
        if kind is not None:
            self.db.manifest = self.before
            if self.own:
                self.transaction.rollback()
        elif self.own:
            self.transaction.commit()


def _parts(v: Value) -> Column:
    return F.struct(v.kind().alias("k"), v.number().alias("n"), v.text().alias("t"))


class Files:
    """The file store of a database: fs.files and fs.chunks."""

    def __init__(self, db: Database):
        self.db = db
        self.meta, self.chunks = db.collection("fs.files"), db.collection("fs.chunks")

    def upload(self, name: str, data: bytes | BinaryIO, chunk_size: int = filestore.CHUNK) -> str:
        data = data if isinstance(data, (bytes, bytearray)) else data.read()
        id = self.db.spark.range(1).select(io.new_id()).first()[0]
        self.upload_frame(self.db.spark.createDataFrame([(id, name, bytearray(data))], "_id string, filename string, content binary"), chunk_size)
        return id

    def upload_frame(self, files: DataFrame, chunk_size: int = filestore.CHUNK) -> int:
        """Files of a frame (_id, filename, content), such as the binaryFile source gives; how many."""
        own = self.db.transaction_ is None
        t = self.db.begin()
        try:
            self.chunks.insert_frame(filestore.chunked(files, chunk_size))
            n = self.meta.insert_frame(filestore.metadata(files, chunk_size))
        except BaseException:
            if own:
                t.rollback()
            raise
        if own:
            t.commit()
        return n

    def metadata(self, id: str) -> dict | None:
        return self.meta.get(id)

    def _chunks(self) -> DataFrame:
        rel = self.chunks.relation()
        return rel.df.select(rel.resolve("files_id").text().alias("files_id"), rel.resolve("n").number().cast("int").alias("n"), rel.resolve("data").text().alias("data"))

    def download(self, id: str, out: BinaryIO) -> bool:
        """False if there is no such file."""
        if self.metadata(id) is None:
            return False
        filestore.download(self._chunks(), id, out)
        return True

    def contents(self) -> DataFrame:
        """(files_id, content) of all files with a chunk."""
        return filestore.assembled(self._chunks())


def open_database(spark: SparkSession, path: str, **options: Any) -> Database:
    return Database(spark, path, **options)


__all__ = ["All", "Any_", "Collection", "Column_", "Database", "Files", "Plan", "Transaction", "declared", "open_database", "parse_cell"]
