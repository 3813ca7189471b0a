"""SimHash near-duplicates: fingerprints of word shingles, candidates by pigeonring filtering, components of the links.

A fingerprint's 64 bits are dealt to a ring of segments. If two fingerprints differ in at most d bits, some chain of
consecutive segments keeps within its share at every length: its first l segments differ in at most l * d / segments bits.
Such a chain is looked up by keys: of the l-th segment, which may differ in b bits by then, one of b + 1 slices is equal.
Pairs that share a key go through the chain's cumulative test and then the full Hamming test.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspan.llm.common import components, cut, fresh_name, local_forest, map_arrow, small_batches

BITS, WORDS, SEED = 64, 4, 42
#: Fingerprints of one key that are compared with each other at once; larger groups are dealt out as pairs of blocks.
BLOCK = 512
#: Bytes of a text that are hashed at once, up to the end of a word.
SEGMENT = 1 << 18
#: What stands between words.
SPACE = re.compile(rb"[\x20\x09-\x0d]")


def shingle_hashes(text: bytes, words: int = WORDS, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of the lower-cased words, repeats included; a SEGMENT of the text at a time."""
    digest = xxhash.xxh64_intdigest
    carry: list[bytes] = []
    at, some = 0, False
    while at < len(text):
        end = SPACE.search(text, at + SEGMENT)
        to = end.start() if end else len(text)
        parts = carry + text[at:to].lower().split()
        at = to
        if len(parts) >= words:
            joined = b" ".join(parts)
            ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
            starts = np.append(0, ends[:-words])
            stops = ends[words - 1 :] - 1
            yield np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), np.uint64, len(starts))
            some = True
            parts = parts[len(parts) - words + 1 :]
        carry = parts
    if carry and not some:
        yield np.array([digest(b" ".join(carry), seed)], dtype=np.uint64)


def fingerprints(texts: list[str | None], words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Unsigned 64-bit fingerprints; zero for a text without words or a null."""
    out = np.zeros(len(texts), dtype=np.uint64)
    weight = np.left_shift(np.uint64(1), np.arange(BITS, dtype=np.uint64))
    for i, t in enumerate(texts):
        counts, n = np.zeros(BITS, dtype=np.int64), 0
        for h in shingle_hashes(t.encode(), words, seed) if t else ():
            counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(h)
        if n:
            out[i] = weight[counts * 2 > n].sum(dtype=np.uint64)
    return out


def with_fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keep columns and _fp long (the fingerprint's bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text"):
            fp = fingerprints(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp.view(np.int64))], names=[*keep, "_fp"])

    src = docs.select(*(docs[k].alias(f"_k{i}") for i, k in enumerate(keep)), docs[text].alias("_text"))
    return map_arrow(src, run, ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep) + ", _fp long")


def chain_masks(distance: int, segments: int, chain: int) -> list[tuple[int, int]]:
    """(first segment, mask of bits that are equal) of every key."""
    cuts = [round(i * BITS / segments) for i in range(segments + 1)]
    out = []
    for first in range(segments):
        slices = []
        for k in range(chain):
            a, b = cuts[(first + k) % segments], cuts[(first + k) % segments + 1]
            parts = (k + 1) * distance // segments + 1
            edge = [a + round(i * (b - a) / parts) for i in range(parts + 1)]
            slices.append([((1 << y) - 1) ^ ((1 << x) - 1) for x, y in zip(edge, edge[1:], strict=False)])
        out += [(first, sum(p)) for p in product(*slices)]
    return out


def chain_passes(x: np.ndarray, first: np.ndarray, distance: int, segments: int) -> np.ndarray:
    """Whether, from that segment on, the differing bits x keep within the budget at every length; the last is the Hamming test."""
    cuts = [round(i * BITS / segments) for i in range(segments + 1)]
    masks = np.array([((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)], dtype=np.uint64)
    ok, total = np.ones(len(x), dtype=bool), np.zeros(len(x), dtype=np.int64)
    for k in range(segments):
        total += np.bitwise_count(x & masks[(first + k) % segments])
        ok &= total <= (k + 1) * distance // segments
    return ok


def close_pairs(run: np.ndarray, fp: np.ndarray, first: np.ndarray, distance: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of linked fingerprints within equal, adjacent values of run."""
    left, right = [], []
    i = np.arange(len(run))
    d = 1
    while True:
        i = i[i + d < len(run)]
        i = i[run[i] == run[i + d]]
        if not len(i):
            break
        for a in range(0, len(i), 1 << 20):
            part = i[a : a + (1 << 20)]
            hit = part[chain_passes(fp[part] ^ fp[part + d], first[part], distance, segments)]
            left.append(hit)
            right.append(hit + d)
        d += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (i, i)


def _linked(distance: int, segments: int):
    """Over rows (key, bits, x, y, node, fp) sorted by the first four: a spanning forest of the links within equal ones."""

    def stars(held: list[pa.RecordBatch], last: bool) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
        t = pa.Table.from_batches(held).combine_chunks()
        key, bits, x, y, node, fp = (t.column(i).to_numpy() for i in range(6))
        new = (key[1:] != key[:-1]) | (bits[1:] != bits[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        run = np.append(0, np.cumsum(new))
        # the last group may go on in the next batch
        whole = len(run) if last else int(np.searchsorted(run, run[-1]))
        i, j = close_pairs(run[:whole], fp[:whole].view(np.uint64), key[:whole], distance, segments)
        out = None
        if len(i):
            child, root = local_forest(node[i], node[j])
            keep = child != root
            out = pa.RecordBatch.from_arrays([pa.array(child[keep]), pa.array(root[keep])], names=["a", "b"])
        return out, t.slice(whole).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                out, held = stars(held, False)
                if out is not None:
                    yield out
        if held:
            out, _ = stars(held, True)
            if out is not None:
                yield out

    return run


def links(nodes: DataFrame, distance: int = 4, segments: int = 5, chain: int = 2) -> DataFrame:
    """Edges (a, b) that connect whatever fingerprints of nodes (node long, _fp long; each _fp once) link at up to distance bits."""
    masks = chain_masks(distance, segments, chain)
    keys = F.array(*(F.struct(F.lit(n).alias("mask"), F.lit(first).alias("key"), F.col("_fp").bitwiseAND(F.lit(mask - (mask >> 63 << 64))).alias("bits")) for n, (first, mask) in enumerate(masks)))
    dealt = nodes.select("node", "_fp", F.explode(keys).alias("k")).select("node", "_fp", "k.*")
    sizes = dealt.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = dealt.join(sizes, ["mask", "bits"])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("_fp"), blocks.cast("long")).cast("int")
    pairs = shared.withColumn("own", own).withColumn("blocks", blocks).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    ready = pairs.repartition("mask", "bits", "x", "y").sortWithinPartitions("mask", "bits", "x", "y")
    return map_arrow(ready.select("key", "bits", (F.col("mask") * (1 << 31) + F.col("x")).alias("x"), "y", "node", "_fp"), _linked(distance, segments), "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 4, segments: int = 5, chain: int = 2, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, fingerprint 16 hex digits, component_id): one row for each row of docs.

    Documents link whose fingerprints differ in at most distance bits; component_id is the least id reachable. A null or
    blank text has fingerprint zero and links like any other. Repeated rows each give a row; rows of one id are judged
    row by row. A row with a null id has its fingerprint's component, or null where no row with an id has that one.
    """
    fps = cut(with_fingerprints(docs, text, (id,)))
    nodes = cut(fps.where(F.col(id).isNotNull()).groupBy("_fp").agg(F.min(id).cast("long").alias("node")))
    found = components(links(nodes, distance, segments, chain))
    named = nodes.join(found, "node", "left").select(F.col("_fp").alias("_f"), F.coalesce("component", "node").alias("component_id"))
    out = fps.join(named, F.col("_fp") == F.col("_f"), "left")
    return out.select(id, F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")



def keep_one(docs: DataFrame, distance: int = 4, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is the least of their component; one row of each id. Rows with a null id stay."""
    found = near_duplicates(docs, distance, text=text, id=id)
    own = fresh_name("_gone", docs.columns)
    gone = found.where(F.col(id).isNotNull() & (F.col(id).cast("long") != F.col("component_id"))).select(F.col(id).alias(own)).distinct()
    kept = docs.join(gone, F.col(id) == F.col(own), "left_anti")
    # repeated ids are rare; only then are whole rows compared
    if docs.where(F.col(id).isNotNull()).groupBy(id).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").limit(1).count():
        kept = kept.where(F.col(id).isNull()).unionByName(kept.where(F.col(id).isNotNull()).dropDuplicates([id]))
    return kept
