"""Exact top-k search by inner product with MaxScore over shards.

A dimension is a query term; what a candidate adds in it, less the least that any candidate of the shard adds, is never
negative and has an upper bound. Terms in order of bounds split into non-essential ones, whose bounds together stay under
the k-th best score so far, and essential ones. Essential postings are traversed; the other terms are probed, the largest
first, for candidates that can still reach the k-th best. The shards' best rows are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspan.llm.common import map_arrow

#: Candidates in a shard and queries in a block, at most about, and components of a shard's vectors (32 bits each, stored twice).
SHARD_ROWS, BLOCK_ROWS, SHARD_VALUES = 32_768, 2048, 8 << 20
#: Candidates whose postings are traversed before the threshold is raised again.
STEP_ROWS = 4096


class Shard:
    """An index of vectors (rows in order of ids): the postings of each term, from the least and from the greatest value."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        x = x[order]
        self.low, self.high = x.min(axis=0), x.max(axis=0)
        self.blocks = []
        for a in range(0, len(x), STEP_ROWS):
            part = x[a : a + STEP_ROWS]
            kind = np.int64 if int((self.high - self.low).max(initial=0)) >= 2**31 else np.int32
            up = np.ascontiguousarray((part - self.low).T, dtype=kind)
            down = np.ascontiguousarray((self.high - part).T, dtype=kind)
            # a posting list of few rows is kept by row numbers
            rows = [[np.flatnonzero(c) if np.count_nonzero(c) * 4 < len(c) else None for c in side] for side in (up, down)]
            self.blocks.append((a, (up, down), rows))

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but those with the id own; ties to smaller ids."""
        terms = np.flatnonzero(query)
        weight = np.abs(query)
        side = (query < 0).astype(int)
        base = int((np.where(query > 0, self.low, self.high) * query).sum())
        bound = weight * (self.high - self.low)
        terms = terms[np.argsort(bound[terms], kind="stable")]
        total = np.append(0, np.cumsum(bound[terms]))  # total[i]: the bound of the first i terms together
        best_ids, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        least = None  # the k-th best score, less base
        for start, columns, rows in self.blocks:
            n = len(columns[0][0]) if len(columns[0]) else min(STEP_ROWS, len(self.ids) - start)
            acc = np.zeros(n, dtype=np.int64)
            # terms before split are non-essential: together they stay under the threshold
            split = 0 if least is None else max(0, int(np.searchsorted(total, least, side="left")) - 1)
            seen = None
            for t in terms[split:][::-1]:
                listed = rows[side[t]][t]
                column = columns[side[t]][t]
                if listed is None:
                    acc += weight[t] * column
                    seen = True
                else:
                    acc[listed] += weight[t] * column[listed]
            if split and seen is None:
                alive = np.flatnonzero(acc)  # rows of no essential posting can't reach the threshold
            else:
                alive = np.arange(n)
            for i in range(split, 0, -1):
                alive = alive[acc[alive] + total[i] >= least]
                if not len(alive):
                    break
                t = terms[i - 1]
                acc[alive] += weight[t] * columns[side[t]][t][alive]
            if least is not None:
                alive = alive[acc[alive] >= least]
            alive = alive[self.ids[start + alive] != own]
            if len(alive):
                score = acc[alive]
                if len(score) > k:
                    alive = alive[score >= np.partition(score, len(score) - k)[len(score) - k]]
                    score = acc[alive]
                ids, scores = np.append(best_ids, self.ids[start + alive]), np.append(best, score)
                first = np.lexsort((ids, -scores))[:k]
                best_ids, best = ids[first], scores[first]
                if len(best) == k:
                    least = int(best[-1])
        return best_ids, best + base


def _search(k: int):
    def answers(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        ids = t.column("id").to_numpy()
        asks = t.column("ask").to_numpy(zero_copy_only=False)
        vectors = t.column("v").combine_chunks()
        width = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
        x = np.zeros((len(ids), int(width.max(initial=0))), dtype=np.int64)
        x[np.arange(x.shape[1]) < width[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
        if asks.all() or not asks.any():
            return
        shard = Shard(ids[~asks], x[~asks])
        out = [[], [], []]
        for q, v in zip(ids[asks].tolist(), x[asks], strict=True):
            found, score = shard.top(v, q, k)
            out[0].append(np.full(len(found), q))
            out[1].append(found)
            out[2].append(score)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = batch.column("shard").to_numpy(), batch.column("block").to_numpy()
            cuts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(a)], strict=True):
                if held and key != (a[lo], b[lo]):
                    yield from answers(held)
                    held = []
                key = (a[lo], b[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from answers(held)

    return run


def top_k(vectors: DataFrame, asks, k: int = 20, id: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k best rows of each query row, by inner product of floor(scale * x).

    asks: the condition for a query row. A query's own id is no candidate of its own; ties go to smaller ids. Rows with a
    null id or vector, or a null or non-finite component, take no part; an empty vector does, with score 0; components that
    a shorter vector lacks count as 0. Repeated candidate rows appear as often as they stand in the table; repeated query
    rows give one answer. Fewer than k candidates: all. An empty table: no rows. Components must stay within 32 bits.
    """
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id).isNotNull() & F.col(vector).isNotNull() & finite).select(F.col(id).cast("long").alias("id"), v.alias("v"), asks.alias("ask"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("ask").cast("int")), F.lit(0)).alias("q"), F.max(F.size("v")).alias("w")).first()
    rows_each = max(1, min(SHARD_ROWS, SHARD_VALUES // max(1, size.w or 1)))
    shards = max(-(-size.n // rows_each), min(-(-size.n // STEP_ROWS), 12), 1)
    blocks = max(-(-size.q // BLOCK_ROWS), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = rows.where("ask").dropDuplicates(["id"]).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))
    held = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(shards)).cast("int")).withColumn("block", every(blocks)).withColumn("ask", F.lit(False))
    both = asked.select("shard", "block", "ask", "id", "v").unionByName(held.select("shard", "block", "ask", "id", "v"))
    found = map_arrow(both.repartition(shards * blocks, "shard", "block").sortWithinPartitions("shard", "block"), _search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
