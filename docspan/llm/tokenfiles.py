"""Token counts of flat, unindexed token files: vectorised searches for the end-of-document id, and a prefix scan.

A file is split into blocks of bytes that are searched independently. Per block only a summary goes on: how many separators
it has, the tokens before the first and after the last one, and the lengths in between. A prefix scan over the summaries of
a file gives each block the number of documents before it and the tokens of a document that began earlier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspan.llm.bpe import WORD_PATTERN, Encoder, ranks_at
from docspan.llm.common import cut, map_arrow, small_batches

#: Bytes that a task searches at once.
BLOCK_BYTES = 4 << 20


def vocabulary_size(ranks_path: str) -> int:
    return ranks_at(ranks_path).size


def write_tokens(docs: DataFrame, folder: str, ranks_path: str, separator: int, pattern: str = WORD_PATTERN, text: str = "text", id: str = "doc_id", width: int = 2) -> DataFrame:
    """(file, ordinal, id): writes the texts' ids to a flat file a partition, each text followed by the separator.

    Ids are unsigned, little-endian, width bytes each. folder is a URI that executors can reach. A file appears under its
    name once it is whole, so a task that runs again replaces its own file only. The rows are checkpointed. A null or empty
    text is a separator alone; repeated rows, and rows without an id, are documents of their own; an empty table: no rows.
    """
    kind = docs.schema[id].dataType.simpleString()
    if max(separator, vocabulary_size(ranks_path) - 1) >= 1 << (8 * width):
        raise ValueError(f"ids of this vocabulary, or the separator {separator}, need more than {width} bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = pafs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}.tokens"
        draft = f"{root}/.{name}.{context.taskAttemptId()}"
        where.create_dir(root, recursive=True)
        encoder, n = Encoder(ranks_path, pattern), 0
        with where.open_output_stream(draft) as out:
            for batch in small_batches(batches, 1):
                for ids in encoder.encode([t or "" for t in batch.column(1).to_pylist()]):
                    out.write(np.append(ids, separator).astype(f"<u{width}").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows), pa.array(np.arange(n, n + batch.num_rows)), batch.column(0)], names=["file", "ordinal", "id"])
                n += batch.num_rows
        where.move(draft, f"{root}/{name}")

    return cut(map_arrow(docs.select(F.col(id).alias("id"), F.col(text).alias("_text")), run, f"file string, ordinal long, id {kind}"))


def count_tokens(spark: SparkSession, folder: str, separator: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal from 0, n_tokens, closed boolean): every document of the folder's *.tokens files.

    n_tokens leaves out the separator. What follows a file's last separator is a document that is not closed; if nothing
    does, there is none. Two separators in a row enclose a document of no tokens. A file whose size is no multiple of width
    is an error. No files, or empty ones: no rows.
    """
    where, root = pafs.FileSystem.from_uri(folder)
    found = where.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    files = [(f.base_name, f.size) for f in found if f.is_file and f.base_name.endswith(".tokens") and not f.base_name.startswith(".")]
    if odd := [f for f, n in files if n % width]:
        raise ValueError(f"no whole number of {width}-byte ids: {odd[:3]}")
    block_bytes -= block_bytes % width

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, top = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, block, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with at.open_input_file(f"{top}/{file}") as f:
                    raw = f.read_at(min(block_bytes, size - block * block_bytes), block * block_bytes)
                hits = np.flatnonzero(np.frombuffer(raw, dtype=f"<u{width}") == separator)
                n = len(raw) // width
                head, tail = (int(hits[0]), n - 1 - int(hits[-1])) if len(hits) else (n, n)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([len(hits)]), pa.array([head]), pa.array([tail]), pa.array([np.diff(hits) - 1], pa.list_(pa.int64()))], names=["file", "block", "n", "head", "tail", "inner"])

    blocks = spark.createDataFrame(files, "file string, size long").where("size > 0").select("file", "size", F.explode(F.expr(f"sequence(0L, (size - 1) div {block_bytes}L)")).alias("block"))
    slots = max(1, min(10_000, sum(-(-n // block_bytes) for _, n in files)))
    summaries = map_arrow(blocks.select("file", "block", "size").repartition(slots, "file", "block"), search, "file string, block long, n long, head long, tail long, inner array<long>")
    summaries = cut(summaries)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scan = summaries.select("file", "block", "n", "tail").withColumn("ordinal", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("tails", F.coalesce(F.sum("tail").over(before), F.lit(0)))
    # tokens since the last separator: tails from the block that holds it on
    scan = scan.withColumn("since", F.coalesce(F.max(F.when(F.col("n") > 0, F.col("tails"))).over(before), F.lit(0)))
    scan = scan.select("file", "block", "ordinal", (F.col("tails") - F.col("since")).alias("carry"))
    both = summaries.join(scan, ["file", "block"])
    closed = both.where("n > 0").select("file", "ordinal", F.posexplode(F.concat(F.array(F.col("carry") + F.col("head")), "inner")).alias("k", "n_tokens"))
    closed = closed.select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed"))
    last = both.groupBy("file").agg(F.max_by(F.struct((F.col("ordinal") + F.col("n")).alias("ordinal"), F.when(F.col("n") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail")).alias("n_tokens")), "block").alias("x"))
    return closed.unionByName(last.where("x.n_tokens > 0").select("file", "x.ordinal", "x.n_tokens", F.lit(False).alias("closed")))
