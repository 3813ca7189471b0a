"""Exact removal of repeated 200-byte strings by sparse, range-partitioned suffix sorting.

Every window of LENGTH bytes elects an anchor: the place in it whose GRAM bytes have the least hash (the first of equals).
Equal windows elect the same place, so windows can only be equal if their anchors' suffixes are, and the suffixes that
have to be sorted are those at anchors, about one byte in 70.

1. Count the anchors' grams over the corpus. Those that repeat go into a filter of fixed size; sampled ones of them are the
   splitters of a range partition of suffixes by leading bytes.
2. Anchors that pass the filter send what their windows cover, with the suffix's bucket. A bucket is sorted by multikey
   quicksort, by words of 8 bytes, both to the right of the anchor and to the left; neighbours are compared. Windows are
   equal if they lie in one class on either side. Suffixes that share GRAM bytes share their leading bytes, so no equal
   pair spans two buckets, and groups that span batches of a bucket are carried over.
3. Anchors whose gram is very frequent do not go to a bucket; their windows are counted by 128-bit hashes, with partial
   sums, so that a passage in a third of all texts is no hot group.
4. The intervals that repeated windows cover are merged for each text and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspan.llm.common import cut, fresh_name, map_arrow, small_batches

LENGTH, GRAM = 200, 64
LEFT = LENGTH - GRAM
#: Contexts of a bucket that a task sorts together, about 6 MB; a gram that stands more often than that is very frequent.
FREQUENT = 20_000
#: Bits of the filters of repeated and of very frequent grams; fixed sizes, whatever the corpus.
REPEATED_BITS, FREQUENT_BITS = 1 << 28, 1 << 24
#: Splitters at most, and bytes of a text that are hashed at once.
SPLITTERS, SEGMENT = 1 << 14, 4 << 20
LEAD = 16


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, gram hash) for each elected place of a text; empty if it is shorter than LENGTH."""
    parts = []
    for start in range(0, max(0, len(data) - LENGTH + 1), SEGMENT):
        x = np.frombuffer(data, dtype=np.uint8, offset=start, count=min(SEGMENT + LENGTH - 1, len(data) - start)).astype(np.uint64)
        h = x + np.uint64(1)
        span = 1
        while span < GRAM:
            h = h[:-span] * np.uint64(0x9E3779B97F4A7C15 + 2 * span) + h[span:]
            h ^= h >> np.uint64(29)
            span *= 2
        h *= np.uint64(0xBF58476D1CE4E5B9)
        place = np.arange(len(h), dtype=np.uint64)
        low = (h & ~np.uint64((1 << 24) - 1)) | place  # equal hashes: the first place is the least
        span, wide = 1, LEFT + 1
        while span * 2 <= wide:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < wide:
            low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
        at = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        last = np.append(first[1:], len(at)) - 1
        parts.append((at[first] + start, first + start, last + start, h[at[first]].view(np.int64)))
    if not parts:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(4))


def has_bit(bits: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    p = values % size
    return ((bits[p >> 3] >> (p & 7)) & 1).astype(bool)


def _filter(grams: DataFrame, size: int) -> np.ndarray:
    """The bits of the column gram, as many as size."""
    bits = np.zeros(size // 8, dtype=np.uint8)
    place = F.pmod("gram", F.lit(size))
    words = grams.select(F.floor(place / 32768).cast("long").alias("b"), F.pmod(place, F.lit(32768)).alias("p"))
    for r in words.groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).toLocalIterator():
        part = np.frombuffer(r.m, dtype=np.uint8)
        bits[r.b * 4096 : r.b * 4096 + len(part)] = part
    return bits


#: Ranges of no more rows are sorted whole by a quicksort's last step.
SMALL_RANGE = 1024


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """The order of equal-length byte rows by multikey quicksort, on words of 8 bytes.

    A range is split three ways by the word at its depth: less, equal and more than a pivot. Only the equal part goes on to
    the next word; small ranges are sorted by the words that are left.
    """
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), dtype=np.uint8)
    padded[:, : rows.shape[1]] = rows
    words = padded.view(">u8").astype(np.uint64)
    order = np.arange(len(rows))
    todo = [(0, len(rows), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth == words.shape[1]:
            continue
        own = order[lo:hi]
        if hi - lo <= SMALL_RANGE:
            order[lo:hi] = own[np.lexsort(words[own, depth:].T[::-1])]
            continue
        word = words[own, depth]
        pivot = np.sort(word[[0, len(word) // 4, len(word) // 2, -(len(word) // 4) - 1, -1]])[2]
        less, more = word < pivot, word > pivot
        a, b = lo + int(less.sum()), hi - int(more.sum())
        order[lo:hi] = np.concatenate([own[less], own[~(less | more)], own[more]])
        todo += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def _common(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix with the row before, in order; -1 for the first."""
    out = np.full(len(order), -1, dtype=np.int64)
    for a in range(1, len(order), 1 << 16):
        b = min(len(order), a + (1 << 16))
        differ = rows[order[a:b]] != rows[order[a - 1 : b - 1]]
        out[a:b] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def repeated(contexts: list[bytes], anchor: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For contexts (bytes, the anchor's place in them, how often they stand): begin and end of what repeated windows cover; -1: nothing."""
    n = len(contexts)
    size = np.fromiter(map(len, contexts), np.int64, n)
    flat = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    start = np.cumsum(size) - size
    right, left = np.zeros((n, LENGTH), dtype=np.uint8), np.zeros((n, LEFT), dtype=np.uint8)
    most_left, most_right = anchor, size - anchor
    for d in range(LENGTH):
        ok = most_right > d
        right[ok, d] = flat[(start + anchor + d)[ok]]
    for d in range(LEFT):
        ok = most_left > d
        left[ok, d] = flat[(start + anchor - 1 - d)[ok]]
    order_r, order_l = multikey_order(right), multikey_order(left)
    common_r, common_l = _common(right, order_r), _common(left, order_l)
    lowest, highest = np.full(n, LENGTH, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    many = copies > 1
    lowest[many], highest[many] = (LENGTH - most_right)[many], most_left[many]
    class_r, class_l = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for d in range(LEFT + 1):  # windows that begin d bytes before the anchor
        own = np.flatnonzero((most_left >= d) & (most_right >= LENGTH - d))
        if len(own) < 2:
            continue
        class_r[order_r] = np.cumsum(common_r < LENGTH - d)
        class_l[order_l] = np.cumsum(common_l < d)
        key = class_r[own] * (n + 1) + class_l[own]
        o = np.argsort(key, kind="stable")
        same = key[o[1:]] == key[o[:-1]]
        hit = np.zeros(len(own), dtype=bool)
        hit[o[1:][same]] = True
        hit[o[:-1][same]] = True
        hit = own[hit]
        lowest[hit], highest[hit] = np.minimum(lowest[hit], d), np.maximum(highest[hit], d)
    none = highest < 0
    return np.where(none, -1, anchor - highest), np.where(none, -1, anchor - lowest + LENGTH)


def text_key(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by bucket and gram: the intervals of each text."""

    def solve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        grams = t.column("gram").to_numpy()
        new = np.append(True, grams[1:] != grams[:-1])
        alone = new & np.append(new[1:], True)
        owners = t.column("owners").to_pylist()
        copies = np.fromiter(map(len, owners), np.int64, len(owners))
        some = np.flatnonzero(~alone | (copies > 1))
        if not len(some):
            return
        contexts = t.column("context").to_pylist()
        begin, end = repeated([contexts[i] for i in some], t.column("anchor").to_numpy()[some].astype(np.int64), copies[some])
        out: list[list] = [[], [], []]
        for i, a, b in zip(some.tolist(), begin.tolist(), end.tolist(), strict=True):
            if a >= 0:
                for key, at in {(o["key"], o["at"]) for o in owners[i]}:
                    out[0].append(key)
                    out[1].append(at + a)
                    out[2].append(at + b)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["key", "begin", "end"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if rows > FREQUENT:  # all groups but the last are complete
            t = pa.Table.from_batches(held).combine_chunks()
            grams = t.column("gram").to_numpy()
            whole = int(np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))[-1])
            if whole:
                yield from solve(t.slice(0, whole).to_batches())
                held = t.slice(whole).to_batches()
                rows = t.num_rows - whole
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield from solve(held)


def intervals(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key binary, begin long, end long): bytes to remove from the texts whose SHA-256 is key; intervals may overlap or repeat."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text).alias("_t")).where(F.octet_length("_t") >= LENGTH)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 0, 4 << 20):
            found, leads = [], {}
            for t in batch.column(0).to_pylist():
                data = t.encode()
                at, _, _, gram = anchors(data)
                found.append(gram)
                for g, a in zip(gram.tolist(), at.tolist(), strict=True):
                    if g & 63 == 0:
                        leads[g] = int.from_bytes(data[a : a + 8]) - (1 << 63), int.from_bytes(data[a + 8 : a + LEAD]) - (1 << 63)
            gram, n = np.unique(np.concatenate(found), return_counts=True)
            own = [leads.get(g, (None, None)) for g in gram.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n), *(pa.array([o[k] for o in own], pa.int64()) for k in (0, 1))], names=["gram", "n", "hi", "lo"])

    # the leading bytes of one gram are the same in all its rows
    counts = map_arrow(texts, count, "gram long, n long, hi long, lo long").groupBy("gram").agg(F.sum("n").alias("n"), F.min("hi").alias("hi"), F.min("lo").alias("lo")).where("n > 1")
    counts = cut(counts)
    size = counts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("m")).first()
    buckets = max(16, min(SPLITTERS, size.m // 4000))
    # a bounded sample of leading bytes, of grams with the least hashes
    sample = sorted((r.hi + (1 << 63)).to_bytes(8) + (r.lo + (1 << 63)).to_bytes(8) for r in counts.where("hi is not null").orderBy(F.xxhash64("gram")).select("hi", "lo").limit(4 * SPLITTERS).collect())
    splitters = sample[:: max(1, len(sample) // buckets)]
    sent = spark.sparkContext.broadcast((_filter(counts, REPEATED_BITS), _filter(counts.where(F.col("n") > FREQUENT), FREQUENT_BITS), np.array(splitters or [b"~"], dtype=f"S{LEAD}")))

    def scan(frequent: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, hot, split = sent.value
            for batch in small_batches(batches, 0, 4 << 20):
                held: dict[tuple, list] = {}
                for t in batch.column(0).to_pylist():
                    data = t.encode()
                    at, first, last, gram = anchors(data)
                    keep = has_bit(known, gram, REPEATED_BITS)
                    keep &= has_bit(hot, gram, FREQUENT_BITS) == frequent
                    if not keep.any():
                        continue
                    own = {"key": text_key(data)}
                    for a, p, q, g in zip(at[keep].tolist(), first[keep].tolist(), last[keep].tolist(), gram[keep].tolist(), strict=True):
                        if frequent:
                            for w in range(p, q + 1):
                                held.setdefault(xxhash.xxh3_128_digest(data[w : w + LENGTH]), []).append(own | {"at": w})
                        else:
                            held.setdefault((g, a - p, data[p : q + LENGTH]), []).append(own | {"at": p})
                kind = pa.list_(pa.struct([("key", pa.binary()), ("at", pa.int64())]))
                if frequent:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(held.values(), kind)], names=["window", "owners"])
                else:
                    lead = np.array([c[a : a + LEAD] for _, a, c in held], dtype=f"S{LEAD}")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.searchsorted(split, lead, side="right") if held else [], pa.int64()), pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.int64()), pa.array([k[2] for k in held], pa.binary()), pa.array(held.values(), kind)],
                        names=["bucket", "gram", "anchor", "context", "owners"],
                    )

        return run

    owners = "owners array<struct<key:binary,at:long>>"
    rare = map_arrow(texts, scan(False), f"bucket long, gram long, anchor long, context binary, {owners}")
    out = map_arrow(rare.repartition("bucket").sortWithinPartitions("bucket", "gram"), _sorted_buckets, "key binary, begin long, end long")
    if counts.where(F.col("n") > FREQUENT).limit(1).count():
        windows = map_arrow(texts, scan(True), f"window binary, {owners}")
        twice = cut(windows.groupBy("window").agg(F.sum(F.size("owners")).alias("n")).where("n > 1").select("window"))
        hit = windows.join(twice, "window").select(F.explode("owners").alias("o"))
        spans = hit.select("o.key", F.col("o.at").alias("begin"), (F.col("o.at") + LENGTH).alias("end"))
        out = out.unionByName(spans)
    return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges what a batch has for each key, to send less."""
    for batch in batches:
        spans: dict[bytes, list] = {}
        for k, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            spans.setdefault(k, []).append((a, b))
        rows = [(k, a, b) for k, s in spans.items() for a, b in merge(s)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["key", "begin", "end"])


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, with columns more: _n_bytes long, _removed array of (begin, end) bytes, in order and apart, and _kept binary.

    A byte goes if it is covered by a string of LENGTH bytes that also starts anywhere else, in the same text or another;
    overlaps count, and no copy is spared. Matches never cross texts. A null text counts as empty. Equal texts have equal
    results; repeated rows are copies of each other. An empty table gives no rows.
    """
    names = docs.columns
    add = [fresh_name(x, names) for x in ("_n_bytes", "_removed", "_kept")]
    spans = map_arrow(intervals(docs, text), _unions, "key binary, begin long, end long")
    own, other, found = (fresh_name(x, names) for x in ("_text_key", "_key", "_spans"))
    # written, so that the join is of plain shuffles, in which Spark can split the copies of one text
    spans = cut(spans.groupBy(F.col("key").alias(other)).agg(F.collect_set(F.struct("begin", "end")).alias(found)))
    keyed = docs.withColumn(own, F.unhex(F.sha2(F.col(text).cast("binary"), 256)))
    joined = keyed.join(spans, F.col(f"`{own}`") == F.col(f"`{other}`"), "left").select(*(F.col(f"`{c}`") for c in names), f"`{found}`")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in small_batches(batches, names.index(text)):
            size, gone, kept = [], [], []
            last: tuple = (None, None)
            for t, s in zip(batch.column(names.index(text)).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                data = (t or "").encode()
                # copies of one text follow each other after the join
                cuts = last[1] if t == last[0] and t is not None else merge([(x["begin"], x["end"]) for x in s or []])
                last = (t, cuts)
                edges = [0, *(e for c in cuts for e in c), len(data)]
                size.append(len(data))
                gone.append([{"begin": a, "end": b} for a, b in cuts])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(size, pa.int64()), pa.array(gone, kind), pa.array(kept, pa.binary())], names=[*names, *add])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_arrow(joined, run, f"{kinds}, `{add[0]}` long, `{add[1]}` array<struct<begin:long,end:long>>, `{add[2]}` binary")
