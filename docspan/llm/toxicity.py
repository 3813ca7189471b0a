"""Toxicity scores by a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word enters as its own embedding and the sum of embeddings of its character n-grams. Every text is cut into overlapping
windows of words; all windows are scored, and a text's score is its highest. The network is trained in numpy on the driver,
on a bounded sample of labelled rows: the label says only that some window is toxic, so each round learns from the window
that now scores highest (all windows in the first rounds).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspan.llm.common import fresh_name, map_arrow, small_batches, split_ranges
from docspan.llm.decontaminate import words_of

WINDOW, STRIDE = 24, 12
EMBED, HIDDEN, ATTEND = 8, 8, 8
GRAMS, BUCKETS = (3, 4, 5), 1 << 14
VOCABULARY = 4_000
#: The score from which a text counts as toxic.
THRESHOLD = 0.7
#: The sample for training: at most so many rows of each class, of texts of up to so many bytes.
SAMPLE_ROWS, SAMPLE_BYTES = {1: 1000, 0: 3000}, 12_288
ROUNDS, WARM_ROUNDS = 9, 3
#: Where classes overlap, the threshold lies at this quantile of the clean rows held back from training.
CLEAN_QUANTILE = 0.995


def gram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' character n-grams, with marks for begin and end, and how many each word has."""
    flat = np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in words), dtype=np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(size) - size
    counts = np.stack([np.maximum(size - n + 1, 0) for n in GRAMS], axis=1)
    out = np.empty(int(counts.sum()), dtype=np.int32)
    begins = (np.cumsum(counts.ravel()) - counts.ravel()).reshape(counts.shape)
    for k, n in enumerate(GRAMS):
        at = split_ranges(starts, counts[:, k])
        h = np.full(len(at), n, dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(1_000_003) + flat[at + j]
        out[split_ranges(begins[:, k], counts[:, k])] = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)
    return out, counts.sum(axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * 0.5) * 0.5 + 0.5


def summed(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places, and the sum of the rows of each."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[first], np.add.reduceat(rows[order], first, axis=0)


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of so many words: positions (in the texts' words, one after another; -1: none) of each window, and its text."""
    per = np.maximum((counts - (WINDOW - STRIDE) + STRIDE - 1) // STRIDE, 1)
    doc = np.repeat(np.arange(len(counts)), per)
    start = split_ranges(np.zeros(len(counts), dtype=np.int64), per) * STRIDE
    inside = start[:, None] + np.arange(WINDOW)
    first = np.cumsum(counts) - counts
    return np.where(inside < counts[doc][:, None], inside + first[doc][:, None], -1), doc


class Network:
    def __init__(self, vocabulary: dict[bytes, int], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary

        def near(*shape: int, scale: float | None = None) -> np.ndarray:
            return (rng.standard_normal(shape) * (scale or 1 / np.sqrt(shape[0]))).astype(np.float32)

        p = {"word": near(len(vocabulary) + 1, EMBED, scale=0.1), "gram": near(BUCKETS, EMBED, scale=0.1)}
        for d in "fb":
            p |= {f"{d}x": near(2 * EMBED, 3 * HIDDEN), f"{d}0": np.zeros(3 * HIDDEN, np.float32), f"{d}g": near(HIDDEN, 2 * HIDDEN), f"{d}n": near(HIDDEN, HIDDEN)}
        p |= {"ax": near(2 * HIDDEN, ATTEND), "av": near(ATTEND), "ox": near(2 * HIDDEN), "o0": np.zeros(1, np.float32)}
        self.p = p

    def inputs(self, words: list[bytes], drop: np.ndarray | None = None):
        ids = np.fromiter((self.vocabulary.get(w, -1) for w in words), np.int64, len(words)) + 1
        if drop is not None:
            ids = np.where(drop, 0, ids)
        grams, counts = gram_buckets(words)
        x = np.empty((len(words), 2 * EMBED), dtype=np.float32)
        x[:, :EMBED] = self.p["word"][ids]
        x[:, EMBED:] = np.add.reduceat(self.p["gram"][grams], np.cumsum(counts) - counts, axis=0) if len(words) else 0
        x[:, EMBED:] /= np.sqrt(counts)[:, None]
        return x, (ids, grams, counts)

    def tables(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What each word adds at a step; the last row stands for no word."""
        return {d: np.concatenate([x @ self.p[f"{d}x"] + self.p[f"{d}0"], np.zeros((1, 3 * HIDDEN), np.float32)]) for d in "fb"}

    def forward(self, at: np.ndarray, tables: dict[str, np.ndarray], keep: list | None = None) -> np.ndarray:
        """Logits of windows at (window, step) of rows of the tables; -1: none."""
        w, p, n = len(at), self.p, HIDDEN
        mask = (at >= 0).astype(np.float32)
        states = np.empty((WINDOW, w, 2 * n), dtype=np.float32)
        for d, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            h = np.zeros((w, n), dtype=np.float32)
            part = slice(0, n) if d == "f" else slice(n, 2 * n)
            for t in order:
                g = tables[d][at[:, t]]
                gate = sigmoid(g[:, : 2 * n] + h @ p[f"{d}g"])
                z, r = gate[:, :n], gate[:, n:]
                q = h @ p[f"{d}n"]
                new = np.tanh(g[:, 2 * n :] + r * q)
                m = mask[:, t, None]
                if keep is not None:
                    keep.append((d, t, h, z, r, q, new, m))
                h = h + m * (1 - z) * (new - h)
                states[t, :, part] = h
        s = np.tanh(states @ p["ax"])
        e = (s @ p["av"]).T
        e = np.where(mask > 0, e, -1e9)
        a = np.exp(e - e.max(axis=1, keepdims=True)) * np.maximum(mask, 1e-9)
        a /= a.sum(axis=1, keepdims=True)
        c = np.einsum("wt,twh->wh", a, states)
        if keep is not None:
            keep.append((states, s, a, c))
        return c @ p["ox"] + p["o0"][0]

    def backward(self, d_logit: np.ndarray, at: np.ndarray, x: np.ndarray, fed, keep: list) -> dict[str, np.ndarray]:
        p, n = self.p, HIDDEN
        states, s, a, c = keep.pop()
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "gram")}
        g["o0"][0], g["ox"] = d_logit.sum(), c.T @ d_logit
        dc = d_logit[:, None] * p["ox"]
        da = np.einsum("wh,twh->wt", dc, states)
        ds = a.T[:, :, None] * dc[None]
        de = (a * (da - (a * da).sum(axis=1, keepdims=True))).T
        g["av"] = np.einsum("tw,twk->k", de, s)
        dpre = de[:, :, None] * p["av"] * (1 - s * s)
        g["ax"] = np.einsum("twh,twk->hk", states, dpre)
        ds = ds + dpre @ p["ax"].T
        dx = np.zeros_like(x)
        for d in "fb":
            part = slice(0, n) if d == "f" else slice(n, 2 * n)
            dtable = np.zeros((len(x) + 1, 3 * n), dtype=np.float32)
            dh = np.zeros((len(at), n), dtype=np.float32)
            for _, t, h, z, r, q, new, m in [k for k in keep if k[0] == d][::-1]:
                dh = dh + ds[t, :, part]
                dn = dh * m * (1 - z) * (1 - new * new)
                dq, dr, dz = dn * r, dn * q, dh * m * (h - new)
                dgate = np.concatenate([dz * z * (1 - z), dr * r * (1 - r)], axis=1)
                g[f"{d}n"] += h.T @ dq
                g[f"{d}g"] += h.T @ dgate
                place, total = summed(at[:, t], np.concatenate([dgate, dn], axis=1))
                dtable[place] += total
                dh = dh * (1 - m * (1 - z)) + dq @ p[f"{d}n"].T + dgate @ p[f"{d}g"].T
            dtable = dtable[:-1]
            g[f"{d}x"], g[f"{d}0"] = x.T @ dtable, dtable.sum(axis=0)
            dx += dtable @ p[f"{d}x"].T
        ids, grams, counts = fed
        g["word"] = summed(ids, dx[:, :EMBED])
        g["gram"] = summed(grams, np.repeat(dx[:, EMBED:] / np.sqrt(counts)[:, None], counts, axis=0))
        return g

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The highest logit of each text's windows; a text without words has -inf."""
        words = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        out = np.full(len(texts), -np.inf)
        flat = [w for ws in words for w in ws]
        if flat:
            distinct = {w: i for i, w in enumerate(dict.fromkeys(flat))}
            place = np.fromiter(map(distinct.__getitem__, flat), np.int32, len(flat))
            del words, flat
            tables = self.tables(self.inputs(list(distinct))[0])
            some = np.flatnonzero(counts)
            # a million words at a time, so that the windows' arrays stay small
            ends = np.cumsum(counts[some])
            at = 0
            while at < len(some):
                before = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + (1 << 20), side="right")))
                at_words, doc = windows_of(counts[some[at:to]])
                for k in range(0, len(doc), 4096):
                    rows = at_words[k : k + 4096]
                    rows = np.where(rows < 0, -1, place[rows + before])
                    np.maximum.at(out, some[at + doc[k : k + 4096]], self.forward(rows, tables))
                at = to
        return out


def calibrate(net: Network, held: list[tuple[str, int]], quantile: float | None = None) -> None:
    """Moves the bias so that a score of THRESHOLD lies between the classes of the rows held back; nothing if one is missing."""
    logits, toxic = net.logits([t for t, _ in held]), np.array([v == 1 for _, v in held], dtype=bool)
    if toxic.any() and not toxic.all():
        low, high = float(np.quantile(logits[toxic], 0.02)), float(np.quantile(logits[~toxic], quantile or CLEAN_QUANTILE))
        middle = (low + high) / 2 if low > high else high
        net.p["o0"] += np.float32(np.log(THRESHOLD / (1 - THRESHOLD)) - middle)


def train(texts: list[str], labels: list[int], seed: int = 7) -> Network | None:
    """None if the rows are all of one class. Every fifth row is held back to set the bias."""
    held = [(t, v) for i, (t, v) in enumerate(zip(texts, labels, strict=True)) if i % 5 == 4 and words_of(t)]
    if len({v for _, v in held}) == 2:
        texts, labels = [t for i, t in enumerate(texts) if i % 5 != 4], [v for i, v in enumerate(labels) if i % 5 != 4]
    words = [words_of(t) for t in texts]
    y = np.array([lab for lab, w in zip(labels, words, strict=True) if w], dtype=np.float32)
    words = [w for w in words if w]
    if not len(y) or y.min() == y.max():
        return None
    seen = Counter(w for ws in words for w in dict.fromkeys(ws))
    vocabulary = {w: i for i, (w, n) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY]) if n >= 5}
    net = Network(vocabulary, seed)
    rng = np.random.default_rng(seed)
    distinct = list(seen)
    place = {w: i for i, w in enumerate(distinct)}
    flat = np.array([place[w] for ws in words for w in ws])
    windows, doc = windows_of(np.array([len(w) for w in words]))
    windows = np.where(windows < 0, -1, flat[windows])
    label = y[doc]
    grams = gram_buckets(distinct)
    gram_at = np.cumsum(grams[1]) - grams[1]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for turn in range(ROUNDS):
        if turn < WARM_ROUNDS:
            chosen = np.concatenate([rng.permutation(np.flatnonzero(label == v))[:6000] for v in (0, 1)])
        else:
            tables = net.tables(net.inputs(distinct)[0])
            score = np.concatenate([net.forward(windows[k : k + 4096], tables) for k in range(0, len(windows), 4096)])
            order = np.lexsort((-score, doc))
            first = order[np.append(True, doc[order][1:] != doc[order][:-1])]
            hard = np.flatnonzero((label == 0) & (score > -4))
            easy = np.flatnonzero(label == 0)
            chosen = np.concatenate([first, rng.permutation(hard)[:3000], rng.permutation(easy)[:3000]])
            positives = first[label[first] == 1]
            chosen = np.concatenate([chosen, np.repeat(positives, max(1, int((len(chosen) - len(positives)) / max(1, len(positives)) / 2)))])
        chosen = rng.permutation(chosen)
        rate = 0.01 if turn < ROUNDS - 4 else 0.003
        for k in range(0, len(chosen), 256):
            rows = chosen[k : k + 256]
            own, at = np.unique(windows[rows], return_inverse=True)
            at = at.reshape(len(rows), WINDOW)
            if own[0] == -1:
                own, at = own[1:], at - 1
            drop = rng.random(len(own)) < 0.4  # a word that is not in the vocabulary is known by its characters
            ids = np.array([vocabulary.get(distinct[i], -1) for i in own]) + 1
            ids = np.where(drop, 0, ids)
            counts = grams[1][own]
            own_grams = grams[0][split_ranges(gram_at[own], counts)]
            x = np.empty((len(own), 2 * EMBED), dtype=np.float32)
            x[:, :EMBED] = net.p["word"][ids]
            x[:, EMBED:] = np.add.reduceat(net.p["gram"][own_grams], np.cumsum(counts) - counts, axis=0) / np.sqrt(counts)[:, None]
            keep: list = []
            logit = net.forward(at, net.tables(x), keep)
            d = (sigmoid(logit) - label[rows]).astype(np.float32) / len(rows)
            grad = net.backward(d, at, x, (ids, own_grams, counts), keep)
            step += 1
            for name, v in net.p.items():
                a, b = moment[name]
                at, change = grad[name] if isinstance(grad[name], tuple) else (slice(None), grad[name])
                a[at] += 0.1 * (change - a[at])  # of the embeddings, only those in use move
                b[at] += 0.01 * (change**2 - b[at])
                v[at] -= rate * (a[at] / (1 - 0.9**step)) / (np.sqrt(b[at] / (1 - 0.99**step)) + 1e-7)
    calibrate(net, held)
    return net


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", allowed=None) -> Network | None:
    """A network trained on at most SAMPLE_ROWS labelled rows of either class (those with the least hash of their id).

    allowed: a condition on the labels' rows. Rows with a null id, label or text, or a longer text than SAMPLE_BYTES, are
    not learned from; an id with several labels counts as toxic if one says so, of an id with several texts the least is
    taken. None if the sample has one class only.
    """
    rows = labels.where(allowed) if allowed is not None else labels
    rows = rows.select(F.col(id).alias("_i"), F.col(label).cast("int").alias("_y")).where("_i is not null and _y in (0, 1)").groupBy("_i").agg(F.max("_y").alias("_y"))
    few = None
    for v in (0, 1):  # twice as many ids, as some texts are missing or long; a bounded list
        part = rows.where(F.col("_y") == v).orderBy(F.xxhash64("_i"), "_i").limit(2 * SAMPLE_ROWS[v])
        few = part if few is None else few.unionByName(part)
    own = docs.select(F.col(id).alias("_i"), F.col(text).alias("_t")).where(F.octet_length("_t") <= SAMPLE_BYTES).join(F.broadcast(few), "_i")
    own = own.groupBy("_i").agg(F.min("_t").alias("_t"), F.min("_y").alias("_y"))  # a row of each id at most, and few is bounded
    got = sorted((hash_key, r) for r in own.select("_i", "_t", "_y", F.xxhash64("_i").alias("_h")).collect() for hash_key in [(r._h, str(r._i), r._t)])
    taken: Counter = Counter()
    texts, ys = [], []
    for _, r in got:
        if taken[r._y] < SAMPLE_ROWS[r._y]:
            taken[r._y] += 1
            texts.append(r._t)
            ys.append(r._y)
    return train(texts, ys)


def score(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """docs, with a column more: _score double from 0 to 1.

    A text that is null or has no words scores 0, and so does every text if there is no network. Whole texts are scored,
    however long. Rows are independent; repeated rows repeat their score; an empty table stays empty.
    """
    names = docs.columns
    add = fresh_name("_score", names)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, names.index(text)):
            x = np.zeros(batch.num_rows)
            if sent.value is not None:
                x = 1 / (1 + np.exp(-np.clip(sent.value.logits(batch.column(names.index(text)).to_pylist()), -700, 700)))
                x[x < 1e-300] = 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x)], names=[*names, add])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_arrow(docs, run, f"{kinds}, `{add}` double")
