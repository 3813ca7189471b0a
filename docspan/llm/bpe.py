"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct words of the texts that a task holds form one flat array of symbols. An inverted index leads from the rank
of a token pair to the positions where such a pair stands; the merges are replayed in rank order over all words at once,
and a merge touches its two neighbours only. No text is shuffled; memory is bounded by the chunk of texts in hand and a
word cache of bounded size.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from docspan.llm.common import map_arrow, small_batches, split_ranges

#: The split pattern that split_starts() carries out on arrays. Other patterns go through the regex library.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Unicode's white space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE = range(4)
NONE = np.int32(2**31 - 1)
#: Words that a task remembers between chunks.
WORD_CACHE = 300_000


@lru_cache(1)
def char_classes() -> np.ndarray:
    out = np.zeros(0x110000, dtype=np.uint8)
    for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
        text = "".join(map(chr, range(lo, hi)))
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
            for m in regex.finditer(pattern, text):
                out[lo + m.start() : lo + m.end()] = kind
    out[WHITE_SPACE] = SPACE
    return out


def split_starts(cp: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where WORD_PATTERN's matches begin in code points cp; texts begin at doc_starts and matches don't cross them."""
    n = len(cp)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = char_classes()[cp]
    change = np.empty(n, dtype=bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change[doc_starts] = True
    first = np.zeros(n + 1, dtype=bool)
    first[doc_starts] = True
    first[n] = True
    start = np.flatnonzero(change)
    end = np.append(start[1:], n)
    run = kind[start]
    # white space before other text: its last character stands alone, or with the next run if it is a blank
    ends = end[(run == SPACE) & ~first[end]]
    change[ends - 1] = True
    change[ends[cp[ends - 1] == 0x20]] = False
    # an apostrophe that begins a match takes s, t, re, ve, m, ll or d
    at = np.flatnonzero((run[:-1] == OTHER) & (end[:-1] - start[:-1] == 1) & (run[1:] == LETTER))
    at = at[(cp[start[at]] == 0x27) & change[start[at]] & ~first[end[at]]]
    if len(at):
        begin = end[at]
        letters = end[at + 1] - begin
        one, two = cp[begin], np.where(letters > 1, cp[np.minimum(begin + 1, n - 1)], 0)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        size = np.where((two == ord("e")) & ((one == ord("r")) | (one == ord("v"))) | (two == ord("l")) & (one == ord("l")), 2, size)
        hit = size > 0
        change[begin[hit]] = False
        more = hit & (letters > size)
        change[(begin + size)[more]] = True
    return np.flatnonzero(change)


class Ranks:
    """A vocabulary of byte strings with ranks; ids are ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.rank.values()) + 1
        self.token = [b""] * self.size
        for t, r in self.rank.items():
            self.token[r] = t
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {}
        get = self.rank.get
        for t, r in self.rank.items():
            for i in range(1, len(t)):
                a = get(t[:i])
                if a is not None and (b := get(t[i:])) is not None:
                    pairs[a * self.size + b] = r
        # open addressing; at most a third full
        bits = max(10, int(3 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, NONE, dtype=np.int32)
        key, value = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] == -1
            uniq, at = np.unique(slot[free], return_index=True)
            at = np.flatnonzero(free)[at]
            self.keys[uniq], self.values[uniq] = key[at], value[at]
            rest = np.ones(len(key), dtype=bool)
            rest[at] = False
            key, value, slot = key[rest], value[rest], (slot[rest] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of a + b, or NONE. An id of size stands for the end of a word."""
        key = a.astype(np.int64) * self.size + b
        key[(a >= self.size) | (b >= self.size)] = -2
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def slow(self, word: bytes) -> list[int]:
        """One word by itself: the leftmost pair of the least rank merges, again and again."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            r, i = min((self.rank.get(x + y, NONE), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)))
            if r == NONE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def replay(self, words: list[bytes], block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the words, one after another, and how many each word has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        n = int(ends[-1]) if len(words) else 0
        if not n:
            return np.zeros(0, dtype=np.int32), size
        sym = np.empty(n + 1, dtype=np.int32)
        sym[:n] = self.byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        sym[n] = self.size
        nxt, prv = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        filled = size > 0
        nxt[ends[filled] - 1] = n
        prv[(ends - size)[filled]] = n
        alive = np.ones(n + 1, dtype=bool)
        alive[n] = False
        rank = np.full(n + 1, NONE, dtype=np.int32)
        rank[:n] = self.pair(sym[:n], sym[nxt[:n]])
        at = np.flatnonzero(rank != NONE).astype(np.int32)
        order = np.argsort(rank[at], kind="stable")
        chunks = [(rank[at][order], at[order])]
        odd: set[int] = set()
        for low in range(0, self.size, block):
            # the index from rank to positions, for the ranks of this block
            index: dict[int, list[np.ndarray]] = {}
            later: list[np.ndarray] = []

            def put(ranks: np.ndarray, places: np.ndarray, index=index) -> list[int]:
                cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                new = []
                for r, p in zip(ranks[np.append(0, cuts)].tolist(), np.split(places, cuts) if len(cuts) else [places], strict=True):
                    if r not in index:
                        index[r] = []
                        new.append(r)
                    index[r].append(p)
                return new

            for ranks, places in chunks:
                a, b = np.searchsorted(ranks, (low, low + block))
                if b > a:
                    put(ranks[a:b], places[a:b])
            todo = list(index)
            heapq.heapify(todo)
            while todo:
                r = heapq.heappop(todo)
                lists = index.pop(r)
                p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
                p = p[rank[p] == r]
                if not len(p):
                    continue
                q = nxt[p]
                if len(p) > 1:
                    clash = np.flatnonzero(q[:-1] == p[1:])
                    if len(clash):  # as in "aaa": every other one of such a row, from the left
                        i = np.arange(len(p))
                        head = np.ones(len(p), dtype=bool)
                        head[clash + 1] = False
                        keep = (i - np.maximum.accumulate(np.where(head, i, 0))) % 2 == 0
                        p, q = p[keep], q[keep]
                after = nxt[q]
                sym[p] = r
                nxt[p] = after
                prv[after] = p
                rank[q] = NONE
                alive[q] = False
                touched = np.concatenate([prv[p], p])
                touched = touched[touched != n]
                new = self.pair(sym[touched], sym[nxt[touched]])
                rank[touched] = new
                hit = np.flatnonzero(new != NONE)
                if not len(hit):
                    continue
                touched, new = touched[hit], new[hit]
                if (early := new < r).any():  # such words would have gone back to an earlier rank
                    odd.update(np.searchsorted(ends, touched[early], side="right").tolist())
                if (far := new >= low + block).all():
                    later += [new, touched]
                    continue
                later += [new[far], touched[far]]
                near = np.flatnonzero(~far & (new > r))
                if len(near):
                    o = near[np.argsort(new[near], kind="stable")]
                    for x in put(new[o], touched[o]):
                        heapq.heappush(todo, x)
            if later:
                ranks, places = np.concatenate(later[::2]), np.concatenate(later[1::2])
                o = np.argsort(ranks, kind="stable")
                chunks.append((ranks[o], places[o]))
        ids = sym[:n][alive[:n]]
        counts = np.add.reduceat(np.append(alive[:n], False).astype(np.int64), np.minimum(ends - size, n)) * filled
        if odd:
            firsts, parts, last = np.cumsum(counts) - counts, [], 0
            for w in sorted(odd):
                own = np.array(self.slow(words[w]), dtype=np.int32)
                parts += [ids[last : firsts[w]], own]
                last, counts[w] = firsts[w] + counts[w], len(own)
            ids = np.concatenate([*parts, ids[last:]])
        return ids, counts


@lru_cache(2)
def ranks_at(path: str) -> Ranks:
    return Ranks(path)


class Encoder:
    """Encodes texts; remembers the words it has seen, up to WORD_CACHE."""

    def __init__(self, path: str, pattern: str = WORD_PATTERN):
        self.ranks, self.pattern = ranks_at(path), pattern
        self.forget()

    def forget(self) -> None:
        self.word: dict[bytes, int] = {}
        self.ids = np.zeros(0, dtype=np.int32)
        self.start, self.count = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def words(self, texts: list[str]) -> tuple[list[bytes], np.ndarray]:
        """Their words, one after another, and how many each text has."""
        if self.pattern != WORD_PATTERN:
            split = regex.compile(self.pattern).findall
            found = [[w.encode() for w in split(t)] for t in texts]
            return [w for f in found for w in f], np.array([len(f) for f in found], dtype=np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        text = "".join(texts)
        cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        starts = split_starts(cp, (ends - sizes)[sizes > 0])
        per = np.diff(np.searchsorted(starts, np.append(0, ends)))
        data = text.encode()
        if len(data) != len(cp):
            width = np.ones(len(cp), dtype=np.int8)
            for least in (0x80, 0x800, 0x10000):
                width += cp >= least
            starts = (np.cumsum(width, dtype=np.int64) - width)[starts]
        return list(map(data.__getitem__, map(slice, starts.tolist(), [*starts[1:].tolist(), len(data)]))), per

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Each text's ids."""
        if len(self.word) > WORD_CACHE:
            self.forget()
        known, places, per = self.word, [], []
        at = 0
        while at < len(texts):  # the words of a few MB of text at a time
            to, held = at, 0
            while to < len(texts) and (to == at or held + len(texts[to]) <= 4 << 20):
                held += len(texts[to])
                to += 1
            words, counts = self.words(texts[at:to])
            for w in set(words).difference(known):
                known[w] = len(known)
            places.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            per.append(counts)
            at = to
        new = list(known)[len(self.start) :]
        whole = self.ranks.rank
        direct = [w in whole for w in new]
        ids, counts = self.ranks.replay([b"" if d else w for w, d in zip(new, direct, strict=True)])
        direct = np.array(direct, dtype=bool)
        if direct.any():
            total = np.where(direct, 1, counts)
            begins = np.cumsum(total) - total
            out = np.empty(int(total.sum()), dtype=np.int32)
            out[begins[direct]] = [whole[w] for w in new if w in whole]
            out[split_ranges(begins[~direct], counts[~direct])] = ids
            ids, counts = out, total
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.ids = np.concatenate([self.ids, ids])
        place = np.concatenate(places) if places else np.zeros(0, dtype=np.int32)
        end = np.cumsum(np.concatenate(per)) if per else np.zeros(0, dtype=np.int64)
        for a, b in zip([0, *end[:-1].tolist()], end.tolist(), strict=True):
            w = place[a:b]
            yield self.ids[split_ranges(self.start[w], self.count[w])]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.ranks.token.__getitem__, ids.tolist()))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str = WORD_PATTERN, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keep columns and, per row: n_tokens long, ids binary (unsigned 32-bit, little-endian), decoded binary (from the ids).

    A null text counts as empty: no ids, nothing decoded. Rows are independent: repeated rows give repeated results; an
    empty table gives none. Text of any length is encoded whole. ranks_path must be readable on every executor.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    src = docs.select(*(docs[k].alias(n) for k, n in zip(keep, names, strict=True)), docs[text].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks_path, pattern)
        for batch in small_batches(batches, "_text"):
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            n, ids, out = [], [], []
            for x in encoder.encode(texts):
                n.append(len(x))
                ids.append(x.astype("<u4").tobytes())
                out.append(encoder.decode(x))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(out, pa.binary())], names=[*keep, "n_tokens", "ids", "decoded"])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return map_arrow(src, run, f"{kinds}, n_tokens long, ids binary, decoded binary")
