"""Fuzzy line dedup: MinHash of character shingles, banding, exact Jaccard verification, distributed union-find.

1. Tasks split texts into lines and emit, for each distinct line, its band keys, each with two bits of all the line's
   MinHashes; lines travel as 64-bit hashes, keys packed, by ranges.
2. Lines that share a band key are linked if those bits agree as often as a similar pair's do (see LEAST_EQUAL); union-find
   makes candidate groups. The number of pairs that share a key by chance grows with the square of the table; without the
   test they chain most lines of a large table up, and all their texts are sent.
3. The text of each candidate line is sent once, to its group. Groups of many lines are split there by links between lines that
   share a key and whose sketches allow the similarity (an exact bound); what is still large is dealt out as pairs of blocks.
   The exact Jaccard similarity decides for pairs that share a key, unless they are connected already.
4. Union-find over the verified links; of each component, and of each repeated line, the first occurrence stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspan.llm.common import components, cut, fresh_name, let_go, local_forest, map_arrow, small_batches, split_ranges

#: Characters in a shingle; bands and rows of the signature; the least Jaccard similarity of a link.
SHINGLE, BANDS, ROWS, SIMILARITY = 8, 12, 4, 0.8
#: Lines of a candidate group, and bytes of their text, that are verified together; larger groups are dealt out as pairs of blocks.
BLOCK, BLOCK_BYTES = 1000, 1 << 20
#: Bytes of text that a task works on at once, lines that it remembers having sent, and keys that it packs at once.
CHUNK, SEEN, PACKED = 1 << 20, 300_000, 1 << 20
#: Lines of a candidate group beyond which it is split by sketches, words of a sketch, and lines of a key that are compared all with all.
SPLIT, WORDS, FEW_LINES = 100, 4, 32
#: Words of the parities by which pairs are ruled out before their shingles are compared.
PARITIES = 16
#: A line at one of its keys: two bits of each MinHash. Two lines are linked if as many of these pairs of bits are equal; of two
#: lines of similarity SIMILARITY that share a key fewer are with probability 2e-10, of more similar ones with a smaller one.
KEYED = np.dtype([("key", "<u8"), ("line", "<i8"), ("brief", "<u4", (BANDS * ROWS // 16,))])
LEAST_EQUAL = 24
#: The same as it is sent: within a range of keys, the low half of a key stands for it; what is verified has the whole keys.
SENT = np.dtype([("key", "<u4"), *((name, KEYED[name]) for name in ("line", "brief"))])
#: Lines of a key beyond which they are all linked, without a look at the bits; the exact test comes later, as for all.
MANY_LINES = 1 << 15
#: What is known of a line at one of its keys: the number of its different shingles, and the parities of their hashes' counts.
SKETCH = np.dtype([("key", "<u8"), ("line", "<i8"), ("size", "<u4"), ("bits", "<u8", (WORDS,))])
#: Bits of the filter of candidate lines, by their number; beyond the most there is no filter, and a join alone finds them.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
_RNG = np.random.default_rng(20)
MULTIPLY = (_RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
ADD = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
LINE_END = "\n"


def line_id(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8"), 1) - (1 << 63)


def shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each line's shingles, one line after another, and how many each has. A shorter line is one shingle."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    cp = np.frombuffer("".join(lines).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    h = cp + np.uint64(1)
    span = 1
    while span < SHINGLE:  # hashes of twice as many characters, from two that are next to each other
        m = np.uint64(0x9E3779B97F4A7C15 + 2 * span)
        h = h[:-span] * m + h[span:] if len(h) > span else h[:0]
        h ^= h >> np.uint64(31)
        span *= 2
    count = np.maximum(size - SHINGLE + 1, 1)
    first = np.cumsum(size) - size
    at = np.repeat(first, count) + split_ranges(np.zeros(len(lines), dtype=np.int64), count)
    short = np.flatnonzero(size < SHINGLE)
    out = np.zeros(len(at), dtype=np.uint64)
    begin = np.cumsum(count) - count
    whole = np.ones(len(at), dtype=bool)
    whole[begin[short]] = False
    out[whole] = h[at[whole]]
    out[begin[short]] = [xxhash.xxh64_intdigest(lines[i].encode(), 2) for i in short]
    return out, count


def signatures(lines: list[str]) -> np.ndarray:
    """(line, permutation) MinHashes."""
    h, count = shingles(lines)
    # the high half of another mix, as the permutations are linear
    x = ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    sign = np.empty((len(lines), BANDS * ROWS), dtype=np.uint32)
    ends = np.cumsum(count)
    at = 0
    while at < len(lines):  # pieces that stay in the cache
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + (1 << 15), side="right")))
        part, starts = x[base : ends[to - 1]], (ends[at:to] - count[at:to] - base)
        for p in range(BANDS * ROWS):
            sign[at:to, p] = np.minimum.reduceat(part * MULTIPLY[p] + ADD[p], starts)
        at = to
    return sign


def band_keys(lines: list[str]) -> np.ndarray:
    """(line, band) keys as unsigned 64-bit numbers."""
    return _keys(signatures(lines))


def _keys(sign: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(sign), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        keys = (keys ^ sign[:, r::ROWS].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    keys = keys * np.uint64(2 * BANDS + 1) + np.arange(BANDS, dtype=np.uint64)
    return keys ^ (keys >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)


def lines_of(text: str | None) -> list[str]:
    """The lines that take part: those with more than white space."""
    return [x for x in (text or "").split(LINE_END) if x.strip()]


def keyed(lines: list[str], ids: np.ndarray) -> np.ndarray:
    """A KEYED row for each line and band."""
    sign = signatures(lines)
    two = (sign * np.uint32(0x9E3779B1) >> np.uint32(30)).reshape(len(lines), -1, 16)
    out = np.empty((len(lines), BANDS), dtype=KEYED)
    out["key"], out["line"] = _keys(sign), ids[:, None]
    out["brief"] = np.bitwise_or.reduce(two << np.arange(0, 32, 2, dtype=np.uint32), axis=2)[:, None]
    return out.ravel()


def _brief_near(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether LEAST_EQUAL of the pairs of bits, or more, are equal for the rows a and b."""
    out = np.empty(len(a), dtype=bool)
    for k in range(0, len(a), 1 << 16):
        x = rows["brief"][a[k : k + (1 << 16)]] ^ rows["brief"][b[k : k + (1 << 16)]]
        differ = np.bitwise_count((x | x >> np.uint32(1)) & np.uint32(0x55555555)).sum(axis=1, dtype=np.int64)
        out[k : k + (1 << 16)] = differ <= BANDS * ROWS - LEAST_EQUAL
    return out


def _packed(held: list[np.ndarray], buckets: int, kind: np.dtype) -> pa.RecordBatch:
    """(bucket, rows): the rows by ranges of their keys, as kind."""
    rows = np.concatenate(held)
    rows = rows[np.argsort(rows["key"])]
    cuts = np.searchsorted((rows["key"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
    rows = rows.astype(kind, copy=False)
    at = np.flatnonzero(cuts[1:] > cuts[:-1])
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([rows[cuts[i] : cuts[i + 1]].tobytes() for i in at], pa.binary())], names=["bucket", "rows"])


def _emit_keys(buckets: int):
    """(bucket, rows): KEYED rows of the lines, most of them once a task, by ranges of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for ids, lines in _let_through(batches, None):
            if len(ids):
                held.append(keyed(lines, ids))
            if sum(map(len, held)) > PACKED:
                yield _packed(held, buckets, SENT)
                held = []
        if held:
            yield _packed(held, buckets, SENT)

    return run


def _bucket_links(kind: np.dtype, near):
    """Over (bucket, rows) in order of buckets: links between lines of a bucket, a forest, that connect what key_links does."""

    def links(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        a, b = key_links(np.frombuffer(b"".join(held), dtype=kind), near)
        if len(a):
            node, root = local_forest(a, b)
            own = node != root
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(root[own])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        last = None
        for batch in batches:
            for bucket, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != last and held:
                    yield from links(held)
                    held = []
                last = bucket
                held.append(rows)
        if held:
            yield from links(held)

    return run


def shingle_codes(lines: list[str]) -> np.ndarray:
    """Each line's set of shingles, in order; a code is the line's number and the high 44 bits of the shingle's hash, mixed."""
    h, count = shingles(lines)
    # np.unique hashes such numbers, which takes many times as long as sorting them
    codes = np.sort(np.repeat(np.arange(len(lines), dtype=np.uint64) << np.uint64(44), count) | h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20))
    return codes[np.append(True, codes[1:] != codes[:-1])[: len(codes)]]


def parities(codes: np.ndarray, n: int) -> np.ndarray:
    """For n lines' sets of shingles, 64 PARITIES bits each: whether the number of members with that remainder is odd."""
    out = np.zeros(n * PARITIES, dtype=np.uint64)
    place = (codes >> np.uint64(44)) * np.uint64(PARITIES) + (codes >> np.uint64(6)) % np.uint64(PARITIES)
    np.bitwise_xor.at(out, place.astype(np.int64), np.uint64(1) << (codes & np.uint64(63)))
    return out.reshape(n, PARITIES)


def _differ_little(bits: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the lines a and b may be similar enough, by their parities, which differ in no more places than the sets do."""
    out = np.empty(len(a), dtype=bool)
    for k in range(0, len(a), 1 << 13):
        x, y = a[k : k + (1 << 13)], b[k : k + (1 << 13)]
        differ = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
        out[k : k + (1 << 13)] = differ * (1 + SIMILARITY) <= (size[x] + size[y]) * (1 - SIMILARITY) + 1e-6
    return out


def sketches(lines: list[str], ids: np.ndarray) -> np.ndarray:
    """A SKETCH for each line and band. Two lines' bits differ in no more places than their sets of shingles differ in members."""
    codes = shingle_codes(lines)
    at, width = (codes >> np.uint64(44)).astype(np.int64), 64 * WORDS
    odd = np.bincount(at * width + (codes % np.uint64(width)).astype(np.int64), minlength=len(lines) * width) & 1
    out = np.empty((len(lines), BANDS), dtype=SKETCH)
    out["key"], out["line"] = band_keys(lines), ids[:, None]
    out["size"] = np.bincount(at, minlength=len(lines))[:, None]
    out["bits"] = np.packbits(odd.astype(np.uint8)).view("<u8").reshape(-1, 1, WORDS)
    return out.ravel()


def _may_link(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the rows a and b may be as similar as a link needs: of two sets with s members in all, if no more than
    s (1 - SIMILARITY) / (1 + SIMILARITY) members are in only one of them."""
    out = np.empty(len(a), dtype=bool)
    for k in range(0, len(a), 1 << 16):
        x, y = rows[a[k : k + (1 << 16)]], rows[b[k : k + (1 << 16)]]
        differ = np.bitwise_count(x["bits"] ^ y["bits"]).sum(axis=1, dtype=np.int64)
        size = x["size"].astype(np.int64), y["size"].astype(np.int64)
        differ = np.maximum(differ, np.abs(size[0] - size[1]))
        out[k : k + (1 << 16)] = differ * (1 + SIMILARITY) <= (size[0] + size[1]) * (1 - SIMILARITY) + 1e-6
    return out


def sketch_links(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of lines that connect, for each key, all those that may be similar enough."""
    return key_links(rows, _may_link)


def key_links(rows: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of lines that connect, for each key of the rows, at least all pairs that near(rows, a, b) lets pass."""
    rows = rows[np.argsort(rows["key"])]
    same = rows["key"][1:] == rows["key"][:-1]
    rows = rows[np.append(same, False) | np.append(False, same)] if len(rows) else rows
    rows = rows[np.lexsort((rows["line"], rows["key"]))]
    rows = rows[np.append(True, (rows["key"][1:] != rows["key"][:-1]) | (rows["line"][1:] != rows["line"][:-1]))[: len(rows)]]
    begins = np.flatnonzero(np.append(True, rows["key"][1:] != rows["key"][:-1])[: len(rows)])
    sizes = np.diff(np.append(begins, len(rows)))
    left, right = [], []
    few = sizes <= FEW_LINES
    for turn in range(1, int(sizes[few].max(initial=0))):
        some = few & (sizes > turn)
        a = split_ranges(begins[some], sizes[some] - turn)
        ok = near(rows, a, a + turn)
        left.append(a[ok])
        right.append(a[ok] + turn)
    for begin, n in zip(begins[~few].tolist(), sizes[~few].tolist(), strict=True):
        if n > MANY_LINES:
            left.append(np.full(n - 1, begin))
            right.append(np.arange(begin + 1, begin + n))
            continue
        root = np.arange(n)
        for pivot in range(n - 1):
            other = pivot + 1 + np.flatnonzero(root[pivot + 1 :] != root[pivot])
            other = other[near(rows, np.full(len(other), begin + pivot), begin + other)]
            if len(other):
                left.append(np.full(len(other), begin + pivot))
                right.append(begin + other)
                to = np.arange(n)
                to[root[other]] = root[pivot]
                root = to[root]
                if (root == root[0]).all():
                    break
    none = np.zeros(0, dtype=np.int64)
    a, b = (rows["line"][np.concatenate([none, *x])] for x in (left, right))
    return a, b


def _emit_sketches(buckets: int):
    """(bucket, rows) over (line, words) rows: the lines' sketches, by ranges of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in small_batches(batches, 1, CHUNK):
            held.append(sketches(batch.column(1).to_pylist(), batch.column(0).to_numpy()))
            if sum(map(len, held)) > PACKED // 4:
                yield _packed(held, buckets, SKETCH)
                held = []
        if held:
            yield _packed(held, buckets, SKETCH)

    return run


def _let_through(batches: Iterator[pa.RecordBatch], sent) -> Iterator[tuple[np.ndarray, list[str]]]:
    """The lines that the broadcast filter, if there is one, lets through, with their hashes, most of them once a task."""
    seen: set[int] = set()
    for batch in small_batches(batches, 0, CHUNK):
        if len(seen) > SEEN:
            seen.clear()
        lines = list({x for t in batch.column(0).to_pylist() for x in lines_of(t)})
        if not lines:
            continue
        ids = np.fromiter(map(line_id, lines), np.int64, len(lines))
        hit = np.flatnonzero(has_bit(sent.value if sent else None, ids))
        hit = [i for i, x in zip(hit.tolist(), ids[hit].tolist(), strict=True) if x not in seen]
        seen.update(ids[hit].tolist())
        yield ids[hit], [lines[i] for i in hit]


def verified(group: np.ndarray, lines: list[str], ids: np.ndarray, pairs_only: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect, within each group, all the lines that share a key and whose similarity is SIMILARITY or more.

    group: numbers in order. pairs_only: whether the line's group is a whole candidate group of two, which share a key.
    In round r the r-th line of every group, the longest first, is compared with the later ones that it isn't connected with.
    Pairs whose parities (as in a sketch, but more) rule the similarity out are not compared shingle by shingle.
    """
    n = len(lines)
    codes = shingle_codes(lines)
    size = np.bincount((codes >> np.uint64(44)).astype(np.int64), minlength=n)
    start = np.cumsum(size) - size
    bits = parities(codes, n)
    keys = np.zeros((n, BANDS), dtype=np.uint64)
    if (some := np.flatnonzero(~pairs_only)).size:
        keys[some] = band_keys([lines[i] for i in some])
    order = np.lexsort((ids, -size, group))
    begins = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))
    sizes = np.diff(np.append(begins, n))
    root = np.arange(n)
    left, right = [], []
    turn = 0
    while True:
        open_ = sizes > turn + 1
        begins, sizes = begins[open_], sizes[open_]
        if not len(begins):
            break
        rest = sizes - turn - 1
        a, b = np.repeat(order[begins + turn], rest), order[split_ranges(begins + turn + 1, rest)]
        near = (root[a] != root[b]) & (size[b] >= SIMILARITY * size[a])
        a, b = a[near], b[near]
        near = pairs_only[a] | (keys[a] == keys[b]).any(axis=1)
        a, b = a[near], b[near]
        near = _differ_little(bits, size, a, b)
        a, b = a[near], b[near]
        turn += 1
        for k in range(0, len(a), 4096):
            x, y = a[k : k + 4096], b[k : k + 4096]
            ask = codes[split_ranges(start[y], size[y])] & np.uint64((1 << 44) - 1) | np.repeat(x.astype(np.uint64) << np.uint64(44), size[y])
            both = np.add.reduceat((codes[np.minimum(np.searchsorted(codes, ask), len(codes) - 1)] == ask).astype(np.int64), np.cumsum(size[y]) - size[y])
            hit = both / (size[x] + size[y] - both) >= SIMILARITY
            if hit.any():
                x, y = x[hit], y[hit]
                left.append(x)
                right.append(y)
                to = np.arange(n)
                to[root[y]] = root[x]  # all the lines that a pivot meets go to its component
                root = to[root]
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (component, x, y, line, words) rows with equal ones of the first three together (x, y: blocks; -1: a whole group): the verified links."""

    def links(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        ids, texts = t.column("line").to_numpy(), t.column("words").to_pylist()
        parts = [t.column(c).to_numpy() for c in ("component", "x", "y")]
        group = np.append(0, np.cumsum(np.any([p[1:] != p[:-1] for p in parts], axis=0)))
        once = np.sort(np.unique(np.stack([group, ids], axis=1), axis=0, return_index=True)[1])
        group, ids = group[once], ids[once]
        two = (parts[1][once] < 0) & (np.bincount(group)[group] == 2)
        i, j = verified(group, [texts[k] for k in once], ids, two)
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    size, key = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = [batch.column(c).to_numpy() for c in ("component", "x", "y")]
        new = np.any([p[1:] != p[:-1] for p in parts], axis=0)
        bytes_ = np.cumsum(pc.binary_length(batch.column("words")).to_numpy(zero_copy_only=False))
        starts = np.append(0, np.flatnonzero(new) + 1)
        at = 0
        for start in starts.tolist():
            now = tuple(p[start] for p in parts)
            here = int(bytes_[start - 1]) if start else 0
            if size + here - (int(bytes_[at - 1]) if at else 0) > CHUNK and now != key:
                if start > at:
                    held.append(batch.slice(at, start - at))
                if held:
                    yield from links(held)
                held, size, at = [], 0, start
            key = now
        held.append(batch.slice(at))
        size += int(bytes_[-1]) - (int(bytes_[at - 1]) if at else 0)
    if held:
        yield from links(held)


def similar_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(node, component): lines (by hash) that are near-duplicates of another, and the least hash of their component."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text).alias("_t"))
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = cut(bucket_components(map_arrow(texts, _emit_keys(buckets), "bucket int, rows binary"), SENT, _brief_near))
    let_go(spark)  # the keys are the most that is written
    sent = spark.sparkContext.broadcast(line_filter(groups, "node"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lines in _let_through(batches, sent):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lines, pa.string())], names=["line", "words"])

    rows = map_arrow(texts, candidates, "line long, words string").dropDuplicates(["line"])
    rows = split_groups(cut(rows.join(groups, F.col("line") == F.col("node")).select("component", "line", "words")), buckets)
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.octet_length("words")) / BLOCK_BYTES)).cast("int")
    rows = rows.join(cut(rows.groupBy("component").agg(blocks.alias("blocks"))), "component")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("line"), F.col("blocks").cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    whole = lambda c: F.when(F.col("blocks") == 1, -1).otherwise(c)
    rows = rows.select("component", whole(F.least("own", "other")).alias("x"), whole(F.greatest("own", "other")).alias("y"), "line", "words")
    ready = rows.repartition("component", "x", "y").sortWithinPartitions("component", "x", "y")
    return components(map_arrow(ready, _verify, "a long, b long"))


def bucket_components(rows: DataFrame, kind: np.dtype, near) -> DataFrame:
    """components of the links that near lets pass between lines of a key, of (bucket, rows) rows."""
    return components(map_arrow(rows.repartition("bucket").sortWithinPartitions("bucket"), _bucket_links(kind, near), "a long, b long"))


def split_groups(rows: DataFrame, buckets: int) -> DataFrame:
    """(component, line, words) rows, of which groups of more than SPLIT lines are split by sketches; lines left alone go."""
    size = cut(rows.groupBy("component").count().where(F.col("count") > SPLIT).select("component"))
    if size.isEmpty():
        return rows
    large = rows.join(size, "component", "left_semi").select("line", "words")
    found = bucket_components(map_arrow(large, _emit_sketches(buckets), "bucket int, rows binary"), SKETCH, _may_link)
    parted = large.join(found, F.col("line") == F.col("node")).select("component", "line", "words")
    return cut(rows.join(size, "component", "left_anti").unionByName(parted))


def line_filter(lines: DataFrame, column: str) -> np.ndarray | None:
    """A bit for each line (by its hash), 16 times as many as lines; None if that is more than MOST_BITS."""
    n = lines.count()
    if n * 16 > MOST_BITS:
        return None
    size = max(LEAST_BITS, 1 << (n * 16).bit_length())
    bits = np.zeros(size // 8, dtype=np.uint8)
    place = F.pmod(column, F.lit(size))
    found = lines.select(F.floor(place / 32768).cast("long").alias("b"), F.pmod(place, F.lit(32768)).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
    for r in found.toLocalIterator():
        part = np.frombuffer(r.m, dtype=np.uint8)
        bits[r.b * 4096 : r.b * 4096 + len(part)] = part
    return bits


def has_bit(bits: np.ndarray | None, ids: np.ndarray) -> np.ndarray:
    """Whether the filter lets these ids through (numpy's % is never negative here, like pmod)."""
    if bits is None:
        return np.ones(len(ids), dtype=bool)
    p = ids % (8 * len(bits))
    return ((bits[p >> 3] >> (p & 7)) & 1).astype(bool)


def dropped_lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, drop array of line numbers from 0, in order): the lines that go, for rows that lose any.

    Of each component of near-duplicate lines, and of each repeated line, the first one stays: by id, then by place.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1, 4 << 20):
            ids, lines, at = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for k, x in enumerate((t or "").split(LINE_END)):
                    if x.strip():
                        ids.append(i)
                        lines.append(line_id(x))
                        at.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(lines, pa.int64()), pa.array(at, pa.int64())], names=["id", "line", "at"])

    kind = docs.schema[id].dataType.simpleString()
    found = similar_lines(docs, text)
    spots = map_arrow(docs.select(F.col(id).alias("id"), F.col(text).alias("_t")).where("id is not null"), places, f"id {kind}, line long, at long")
    # written, as are the first ones: both sides of these joins are then plain shuffles, whose hot keys Spark can split
    spots = cut(spots.join(found, F.col("line") == F.col("node"), "left").select("id", "at", F.coalesce("component", "line").alias("part")))
    first = spots.groupBy("part").agg(F.min(F.struct("id", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = spots.join(cut(first), "part").where(F.struct("id", "at") != F.col("first"))
    return gone.groupBy("id").agg(F.sort_array(F.collect_set("at")).alias("drop"))


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, with the lines that go cut out of the text, and two columns more: _lines long and _dropped array of line numbers.

    Every row stays, even if no line does (its text is then empty). Blank lines never go. A null text stays null. Rows of
    one id are copies of one document and get one result; rows with a null id stay as they are. Empty tables stay empty.
    """
    own, drop, size = (fresh_name(x, docs.columns) for x in ("_gone_id", "_dropped", "_lines"))
    gone = dropped_lines(docs, id, text).select(F.col("id").alias(own), F.col("drop").alias(drop))
    out = docs.join(gone, F.col(f"`{id}`") == F.col(f"`{own}`"), "left").drop(own)
    lines = F.split(F.col(text), LINE_END, -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(drop, i.cast("long"))), LINE_END)
    out = out.withColumn(size, F.coalesce(F.size(lines), F.lit(0)).cast("long"))
    out = out.withColumn(text, F.when(F.col(drop).isNull(), F.col(text)).otherwise(kept))
    return out.select(*(f"`{c}`" for c in docs.columns), size, drop)
