"""Benchmark decontamination by a prefix-filtered set join.

A window is 10 consecutive words of a benchmark item (a shorter item is one window). Its tokens are its word shingles.
To contain a window is to contain all its tokens, so one necessary token is enough as a prefix: the rarest, by counts over
the whole corpus. Documents join the prefix tokens only; a match must leave room for the window on both sides (length and
position bounds), and the window is then verified word by word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspan.llm.common import cut, fresh_name, map_arrow, small_batches, split_ranges

WINDOW, SHINGLE = 10, 5
#: Bytes of benchmark text whose index is broadcast; a larger benchmark is joined block by block.
BLOCK_BYTES = 16 << 20
#: Bytes of words, [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z; others become blanks.
WORD_BYTES = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
MIX = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


def rolling(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where size known words (ids from 0; -1: unknown) follow each other, and a hash of them."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    known = ids >= 0
    ok = known[:n].copy()
    for k in range(1, size):
        ok &= known[k : k + n]
    at = np.flatnonzero(ok)
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        h = (h + ids[at + k].astype(np.uint64) + np.uint64(1)) * np.uint64(MIX)
        h ^= h >> np.uint64(29)
    return at, h


class Index:
    """Windows of a block of items, and their shingles; after prune(), the prefix shingle of each window."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW, shingle: int = SHINGLE):
        self.word: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            w = [self.word.setdefault(x, len(self.word)) for x in words_of(text)]
            size = min(window, len(w))
            for i in range(len(w) - size + 1 if size else 0):
                owners[tuple(w[i : i + size])].add(item)
        self.windows = sorted(owners)
        self.items = [sorted(owners[w]) for w in self.windows]
        self.length = np.array([len(w) for w in self.windows], dtype=np.int64)
        self.words = np.full((len(self.windows), window), -1, dtype=np.int64)
        for i, w in enumerate(self.windows):
            self.words[i, : len(w)] = w
        # shingles by size: every one of a window is necessary
        self.shingles: dict[int, np.ndarray] = {}
        self.places: dict[int, list[tuple[int, int, int]]] = {}
        for size in sorted({min(shingle, n) for n in self.length.tolist()}):
            places = [(int(h), i, k) for i, w in enumerate(self.windows) if min(shingle, len(w)) == size for k, h in zip(*map(np.ndarray.tolist, rolling(np.array(w), size)), strict=True)]
            self.shingles[size] = np.unique(np.array([p[0] for p in places], dtype=np.uint64))
            self.places[size] = places

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.word.get, words, repeat(-1)), np.int64, len(words))

    def chunk(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of the texts, with one unknown word between them; where each text begins, with the end."""
        words: list[bytes] = []
        starts = [0]
        for t in texts:
            words += words_of(t)
            words.append(b" ")
            starts.append(len(words))
        return self.ids(words), np.array(starts, dtype=np.int64)

    def count(self, ids: np.ndarray) -> dict[int, np.ndarray]:
        out = {}
        for size, known in self.shingles.items():
            _, h = rolling(ids, size)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            out[size] = np.bincount(at[known[at] == h], minlength=len(known))
        return out

    def prune(self, counts: dict[int, np.ndarray]) -> None:
        """Keeps, of each window that may occur, its rarest shingle."""
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, known in self.shingles.items():
            best: dict[int, tuple[int, int, int]] = {}
            for h, window, offset in self.places[size]:
                rare = (int(counts[size][np.searchsorted(known, np.uint64(h))]), offset, h)
                best[window] = min(best.get(window, rare), rare)
            rows = sorted((h, window, offset) for window, (n, offset, h) in best.items() if n)
            keys = np.array([r[0] for r in rows], dtype=np.uint64)
            uniq, first = np.unique(keys, return_index=True)
            self.prefix[size] = uniq, np.append(first, len(rows)), np.array([r[1] for r in rows], dtype=np.int64), np.array([r[2] for r in rows], dtype=np.int64)
        del self.places, self.shingles

    def occurrences(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, window) of every window that occurs."""
        found = []
        for size, (keys, first, window, offset) in self.prefix.items():
            if not len(keys):
                continue
            at, h = rolling(ids, size)
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[k] == h
            at, k = at[hit], k[hit]
            lengths = first[k + 1] - first[k]
            rows = split_ranges(first[k], lengths)
            w = window[rows]
            begin = np.repeat(at, lengths) - offset[rows]
            doc = np.searchsorted(starts, np.repeat(at, lengths), side="right") - 1
            fits = (begin >= starts[doc]) & (begin + self.length[w] < starts[doc + 1])
            begin, w = begin[fits], w[fits]
            same = np.ones(len(w), dtype=bool)
            for i in range(self.words.shape[1]):
                want = self.words[w, i]
                same &= (want < 0) | (ids[np.minimum(begin + i, len(ids) - 1)] == want)
            found.append((begin[same], w[same]))
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def item_blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[str, str]]]:
    """The items with an id and a text, at most about BLOCK_BYTES at a time."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("item is not null and text is not null").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item")), F.lit(0)).alias("n")).first().n
    blocks = size // BLOCK_BYTES + 1
    for k in range(blocks):
        yield [(r.item, r.text) for r in rows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()]


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs, with three columns more: _n_words long, _spans array of (begin, end) word positions that are hit, _items array of item ids as strings.

    Lower-cases A-Z; a null text has no words and no hits. Items without an id, a text or a word match nothing; repeated
    items count once. Every row is judged by itself, so repeated rows repeat their result. Empty tables: no rows, or no hits.
    """
    spark = docs.sparkSession
    names = docs.columns
    add = [fresh_name(x, names) for x in ("_n_words", "_spans", "_items")]
    texts = docs.select(F.col(text).alias("_text"))
    out, last = None, None
    for block in item_blocks(benchmark, item, item_text):
        index = Index(block)
        if not index.windows:
            continue
        if out is not None:  # a further block adds to what is written; the index before it goes
            out = cut(out)
            last.unpersist()
        sent = spark.sparkContext.broadcast(index)

        def tally(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in small_batches(batches, 0):
                for size, n in sent.value.count(sent.value.chunk(batch.column(0).to_pylist())[0]).items():
                    total[size] = total.get(size, 0) + n
            for size, n in total.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size)), pa.array(at), pa.array(n[at])], names=["size", "at", "n"])

        counts = {size: np.zeros(len(k), dtype=np.int64) for size, k in index.shingles.items()}
        # one row at most for each shingle of the block
        for r in map_arrow(texts, tally, "size long, at long, n long").groupBy("size", "at").agg(F.sum("n").alias("n")).collect():
            counts[r["size"]][r["at"]] = r.n
        index.prune(counts)
        sent.unpersist()
        last = spark.sparkContext.broadcast(index)
        out = _scanned(docs if out is None else out, names, add, text, last)
    return _scanned(docs, names, add, text, None) if out is None else out


def _scanned(docs: DataFrame, names: list[str], add: list[str], text: str, index) -> DataFrame:
    """docs with the columns add, as scan() says; if docs has them already, what this index finds is added to them."""
    before = add[0] in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, names.index(text)):
            texts = batch.column(names.index(text)).to_pylist()
            hits: list[list[tuple[int, int, list[str]]]] = [[] for _ in texts]
            if before:
                for h, spans, items in zip(hits, batch.column(add[1]).to_pylist(), batch.column(add[2]).to_pylist(), strict=True):
                    h += [(x["begin"], x["end"], items) for x in spans]
            starts = None
            if index is not None:
                own = index.value
                ids, starts = own.chunk(texts)
                at, w = own.occurrences(ids, starts)
                doc = np.searchsorted(starts, at, side="right") - 1
                for d, a, n, k in zip(doc.tolist(), (at - starts[doc]).tolist(), own.length[w].tolist(), w.tolist(), strict=True):
                    hits[d].append((a, a + n, own.items[k]))
            counts = np.diff(starts) - 1 if starts is not None else np.array([len(words_of(t)) for t in texts], dtype=np.int64)
            spans, items = [], []
            for h in hits:
                merged: list[dict[str, int]] = []
                for a, b, _ in sorted(h):
                    if merged and a <= merged[-1]["begin"] + merged[-1]["n"]:
                        merged[-1]["n"] = max(merged[-1]["n"], b - merged[-1]["begin"])
                    else:
                        merged.append({"begin": a, "n": b - a})
                spans.append([{"begin": m["begin"], "end": m["begin"] + m["n"]} for m in merged])
                items.append(sorted({i for x in h for i in x[2]}))
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], names=[*names, *add])

    kinds = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    return map_arrow(docs, run, f"{kinds}, `{add[0]}` long, `{add[1]}` array<struct<begin:long,end:long>>, `{add[2]}` array<string>")


def report(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items array of ids as strings in order, spans, contaminated) for each row of docs."""
    out = scan(docs.select(F.col(id).alias("_id"), F.col(text).alias("text")), benchmark)
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return out.select(F.col("_id").alias(id), F.col("_n_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.array_sort("_items").alias("items"), F.col("_spans").alias("spans"), (F.size("_spans") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs in which no window occurs, with docs' columns."""
    out = scan(docs, benchmark, text)
    return out.where(F.size(out.columns[-2]) == 0).select(*(out[f"`{c}`"] for c in docs.columns))
