"""Files of a database through Hadoop's file system, so that any store that Spark reaches will do."""

from __future__ import annotations

import json
import os
import tempfile
import time
import uuid
from typing import Any

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession, name: str = "docspan") -> str:
    """A new folder's path under spark.checkpoint.dir, which driver and executors share; a temporary one in local sessions without it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/docspan-scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> Any:
        stream = self.fs.open(self.path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, name: str, value: Any) -> bool:
        """Writes a new file, whole or not at all; False if the name is taken.

        Of two writers one succeeds on local file systems (a hard link fails if its name is taken) and on HDFS (a rename
        does not overwrite). Object stores without conditional writes need a lock, such as exclusive opening.
        """
        draft = self.path(f"{name}.draft-{self.jvm.java.util.UUID.randomUUID().toString()}")
        stream = self.fs.create(draft, True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        try:
            if self.fs.getScheme() == "file":
                os.link(draft.toUri().getPath(), self.path(name).toUri().getPath())
                return True
            return not self.exists(name) and bool(self.fs.rename(draft, self.path(name)))
        except FileExistsError:
            return False
        finally:
            if self.fs.exists(draft):
                self.fs.delete(draft, False)

    def age(self, name: str) -> float:
        """Seconds since a file or folder was changed."""
        return time.time() - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def bytes(self, name: str = "") -> int:
        return self.fs.getContentSummary(self.path(name)).getLength() if self.exists(name) else 0

    def copy_to(self, other: Store) -> None:
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self.path(""), other.fs, other.path(""), False, True, self.conf)
