"""Helpers shared by the corpus operators: Arrow batching, checkpoints and connected components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds at once, and of the Arrow batches that it is sent.
CHUNK_BYTES = 4 << 20
#: Links that one task joins by itself, 16 MB; more go through distributed rounds.
FEW_LINKS = 1 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names, as a full URI; the folder that the context has where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    root = named or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="docspan-checkpoint-")  # one machine, as in tests
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return full.replace("file:/", "file:///") if re.match("file:/[^/]", full) else full


def shared_folder(spark: SparkSession) -> str:
    """A new folder's URI under the checkpoint folder, which all executors share."""
    return f"{checkpoint_root(spark).rstrip('/')}/docspan-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder, so that no executor's loss repeats the work."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Has the driver collect its garbage, upon which Spark deletes the shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _give_back() -> None:
    """Hands memory that a task has freed back to the system, as workers live on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of about CHUNK_BYTES, unless the session has set their size itself."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES) == f"{64 << 20}b":  # the default, for which a worker holds hundreds of MB
        conf.set(BATCH_BYTES, str(CHUNK_BYTES))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(whole, schema)


def fresh_name(base: str, taken: Iterable[str]) -> str:
    """base, or base with underscores in front, so that it differs from each of taken."""
    low = {t.lower() for t in taken}
    while base.lower() in low:
        base = "_" + base
    return base


def small_batches(batches: Iterator[pa.RecordBatch], column: int | str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, each with at most limit bytes in that text column, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        lengths = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def split_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each range, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total, dtype=np.int64)


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the graph of the edges (a, b): each node, and the least node of its component (vectorised hooking and pointer jumping)."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        ru, rv = root[u], root[v]
        low, high = np.minimum(ru, rv), np.maximum(ru, rv)
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(root, high[open_], low[open_])
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return nodes, nodes[root]


def _forest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def stars() -> tuple[np.ndarray, np.ndarray]:
        node, root = local_forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        keep = node != root
        return node[keep], root[keep]

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size > 2_000_000:
            star = stars()
            if len(star[0]) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(star[0]), pa.array(star[1])], names=["node", "root"])
                held, size = [], 0
            else:
                held, size = [star], len(star[0])
    if held:
        star = stars()
        yield pa.RecordBatch.from_arrays([pa.array(star[0]), pa.array(star[1])], names=["node", "root"])


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Distributed union-find: (node, component) for every node with an edge; component is the least node reachable.

    Each partition first reduces its edges to stars (a spanning forest keeps all links). If no more than FEW_LINKS are left,
    a task on an executor finishes them. Else large-star and small-star rounds run until no star changes. Every round groups
    by a minimum, with partial sums, and joins that back, so a hub with any number of links is never gathered in one task.
    Self-links are ignored; null ends are dropped.
    """
    e = edges.select(F.col(left).cast("long").alias("node"), F.col(right).cast("long").alias("root")).where("node is not null and root is not null and node <> root")
    e = cut(map_arrow(e, _forest_batches, "node long, root long"))
    few = e.count() <= FEW_LINKS
    new = cut(map_arrow(e.coalesce(1), _forest_batches, "node long, root long")) if few else e
    while not few:
        both = e.unionByName(e.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("m")).select(F.col("node").alias("n"), F.least("node", "m").alias("m"))
        # large star: larger neighbours go to the least one
        large = both.where("root > node").join(least, F.col("node") == F.col("n")).select(F.col("root").alias("node"), F.col("m").alias("root")).where("node <> root").distinct()
        low = large.groupBy("node").agg(F.min("root").alias("m")).select(F.col("node").alias("n"), "m")
        # small star: smaller neighbours, and the node itself, go to the least one
        small = large.join(low, F.col("node") == F.col("n"))
        small = small.select(F.col("root").alias("node"), F.col("m").alias("root")).unionByName(low.select(F.col("n").alias("node"), F.col("m").alias("root"))).where("node <> root").distinct()
        new = cut(small)
        # done when each node has one parent and no parent has a parent
        parents = new.select(F.col("root").alias("p")).distinct()
        state = new.join(parents, F.col("node") == F.col("p"), "left_semi").limit(1).count()
        if not state and not new.groupBy("node").count().where("count > 1").limit(1).count():
            break
        e = new
    roots = new.select(F.col("root").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return new.select("node", F.col("root").alias("component")).unionByName(roots)
