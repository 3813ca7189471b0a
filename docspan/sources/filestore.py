"""The file store: bytes in base64 chunks, and a metadata row for each file."""

from __future__ import annotations

from typing import BinaryIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a chunk: the default, the least and the most.
CHUNK, LEAST, MOST = 255 * 1024, 1024, 8 * 1024 * 1024


def clamp(chunk_size: int) -> int:
    return max(LEAST, min(MOST, chunk_size))


def chunked(files: DataFrame, chunk_size: int = CHUNK, id: str = "_id", content: str = "content") -> DataFrame:
    """(files_id, n, data): base64 chunks of each file's bytes. An empty file has no chunk; null content counts as empty."""
    size = clamp(chunk_size)
    data = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    length = F.octet_length(data)
    pieces = F.when(length > 0, F.sequence(F.lit(0), F.floor((length - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = files.select(F.col(id).cast("string").alias("files_id"), data.alias("_d"), F.explode(pieces).alias("n"))
    return rows.select("files_id", "n", F.base64(F.substring("_d", F.col("n") * size + 1, F.lit(size))).alias("data"))


def metadata(files: DataFrame, chunk_size: int = CHUNK, id: str = "_id", name: str = "filename", content: str = "content") -> DataFrame:
    """(_id, filename, length, chunkSize, uploadDate)."""
    data = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    when = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSS'Z'")
    return files.select(F.col(id).cast("string").alias("_id"), F.col(name).alias("filename"), F.octet_length(data).cast("long").alias("length"), F.lit(clamp(chunk_size)).alias("chunkSize"), when.alias("uploadDate"))


def assembled(chunks: DataFrame) -> DataFrame:
    """(files_id, content): each file's bytes, from its chunks in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", "data"))), lambda x: F.hex(F.unbase64(x["data"])))
    return chunks.groupBy("files_id").agg(F.unhex(F.array_join(parts, "")).alias("content"))


def download(chunks: DataFrame, files_id: str, out: BinaryIO) -> int:
    """Writes one file's bytes to a stream, a chunk at a time; how many bytes."""
    total = 0
    for r in chunks.where(F.col("files_id") == files_id).orderBy("n").select(F.unbase64("data").alias("d")).toLocalIterator():
        total += out.write(bytes(r.d))
    return total
