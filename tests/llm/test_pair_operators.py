"""Operators that compare rows: line dedup, sharding, suffix dedup, SimHash, search, components, the pipeline."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docspan.llm import common, kdshard, linededup, maxscore, simhash, suffixdedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, component string, key string, drop string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, 7, "c", "k", "d") for i, t in enumerate(texts)], SCHEMA)


def groups(n, links):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def words(rng, n):
    return " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 5) for _ in range(n))


@pytest.mark.parametrize("few", [0, 100_000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_LINKS", few)
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    df = spark.createDataFrame(links + [(None, 3)], "a long, b long").repartition(5)
    want = groups(300, links)
    met = {x for e in links for x in e if e[0] != e[1]}
    assert {r.node: r.component for r in common.components(df).collect()} == {x: want[x] for x in met}
    assert common.components(df.where("false")).count() == 0


# SimHash


def fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    base = [words(rng, 300) for _ in range(8)]
    texts = [None, "", "  ", "One", "one", "a b", base[0].upper()]
    for b in base:
        for _ in range(12):
            w = b.split()
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = "zz"
            texts.append("\t".join(w))
    docs = frame(spark, texts)
    fps = [fingerprint(t) for t in texts]
    want = groups(len(texts), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    rows = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert rows == {i: (f"{f:016x}", want[i]) for i, f in enumerate(fps)}
    monkeypatch.setattr(simhash, "BLOCK", 3)  # groups dealt out as pairs of blocks
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == dict(enumerate(want))
    kept = simhash.keep_one(docs.unionByName(docs).unionByName(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))))
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(set(want)) and got.count(None) == 1
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_every_near_pair_shares_a_key():
    rng = random.Random(3)
    for segments, chain in ((5, 2), (5, 3), (8, 3)):
        masks = simhash.chain_masks(4, segments, chain)
        for _ in range(500):
            a = rng.getrandbits(64)
            b = a
            for _ in range(rng.randint(0, 4)):
                b ^= 1 << rng.randrange(64)
            shared = [first for first, m in masks if a & m == b & m]
            x = np.array([a ^ b] * len(shared), dtype=np.uint64)
            assert shared and simhash.chain_passes(x, np.array(shared), 4, segments).any()


# lines


def test_lines_match_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    base = [words(rng, rng.choice([4, 30, 60])) for _ in range(25)]
    texts = []
    for _ in range(40):
        lines = []
        for _ in range(rng.randint(0, 6)):
            x = rng.choice(base)
            if rng.random() < 0.5:
                at = rng.randrange(len(x))
                x = x[:at] + "Q" + x[at + rng.randint(0, 2) :]
            lines.append(x)
        texts.append("\n".join(lines + [""] * rng.randint(0, 2)))
    texts += [None, "", "\n\n", "ab", "ab\nab", "é" * 40, "é" * 40 + "!"]
    docs = frame(spark, texts)
    spots = [(i, k, x) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if x.strip()]
    distinct = list(dict.fromkeys(x for _, _, x in spots))
    sets = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in distinct]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    part = groups(len(sets), near)
    where = {x: part[i] for i, x in enumerate(distinct)}
    first = {}
    for i, k, x in spots:
        first.setdefault(where[x], (i, k))
    want = {}
    for i, k, x in spots:
        if first[where[x]] != (i, k):
            want.setdefault(i, []).append(k)
    assert near
    got = {r.id: r["drop"] for r in linededup.dropped_lines(docs).collect()}
    assert got == want
    out = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    for i, t in enumerate(texts):
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get(i, []))
        assert out[i].text == kept
    monkeypatch.setattr(linededup, "BLOCK", 4)
    assert {r.id: r["drop"] for r in linededup.dropped_lines(docs).collect()} == want
    assert linededup.dedup_lines(docs.where("false")).count() == 0


def test_lines_chained_by_chance_are_sent_once(spark, monkeypatch):
    """Each line shares keys with the next ones, but is similar to none: they are no group whose pairs of blocks get its text."""
    monkeypatch.setattr(linededup, "BLOCK", 4)
    monkeypatch.setattr(linededup, "SPLIT", 10, raising=False)
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(2000))
    lines = [text[8 * i : 8 * i + 60] for i in range(200)]
    copies = [x + "!" for x in lines[::20]]
    dealt, real = [], linededup.map_arrow

    def spy(df, run, schema):
        if run is linededup._verify:
            dealt.append(df.count())
        return real(df, run, schema)

    monkeypatch.setattr(linededup, "map_arrow", spy)
    got = {r.id: r["drop"] for r in linededup.dropped_lines(frame(spark, lines + copies)).collect()}
    assert got == {200 + k: [0] for k in range(len(copies))}
    assert sum(dealt) <= len(lines) + len(copies)


def test_pipeline_lines_chained_by_chance_are_sent_once(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(linededup, "BLOCK", 4)
    monkeypatch.setattr(linededup, "SPLIT", 10, raising=False)
    rng = random.Random(11)
    text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(1000))
    lines = [text[8 * i : 8 * i + 60] for i in range(100)]
    dealt, real = [], linededup.map_arrow

    def spy(df, run, schema):
        if run is linededup._verify:
            dealt.append(df.count())
        return real(df, run, schema)

    monkeypatch.setattr(linededup, "map_arrow", spy)
    out = corpus_pipeline.cut_lines(spark, frame(spark, [*lines, lines[50] + "!"]), "")
    assert {r.doc_id: r.text for r in out.collect()} == dict(enumerate([*lines, ""]))
    assert sum(dealt) <= len(lines) + 1


def test_pipeline_lines_that_share_a_key_by_chance_are_not_sent(spark, monkeypatch):
    import corpus_pipeline

    rng = random.Random(12)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    lines = [common + some(70) for common in (some(30) for _ in range(30)) for _ in range(60)]
    rows = linededup.keyed(lines, np.arange(len(lines)))
    chance = set(np.concatenate(linededup.key_links(rows, lambda r, a, b: np.ones(len(a), dtype=bool))).tolist())
    assert len(chance) > 50
    dealt, real = [], linededup.map_arrow

    def spy(df, run, schema):
        if run is linededup._verify:
            dealt.extend(r.words for r in df.collect())
        return real(df, run, schema)

    monkeypatch.setattr(linededup, "map_arrow", spy)
    out = corpus_pipeline.cut_lines(spark, frame(spark, [*lines, lines[50] + "!"]), "")
    assert {r.doc_id: r.text for r in out.collect()} == dict(enumerate([*lines, ""]))
    assert {lines[50], lines[50] + "!"} <= set(dealt)
    assert len(dealt) < len(chance) / 2


@pytest.mark.parametrize("few,many", [(1, 1 << 15), (32, 1 << 15), (1, 2)])
def test_bits_of_minhashes_lose_no_similar_pair(monkeypatch, few, many):
    monkeypatch.setattr(linededup, "FEW_LINES", few)
    monkeypatch.setattr(linededup, "MANY_LINES", many)
    rng = random.Random(13)
    lines = ["", " ", "ab"]
    for _ in range(40):
        x = words(rng, rng.choice([3, 20, 60, 300]))
        for _ in range(8):
            at = rng.randrange(len(x))
            lines.append(x := x[:at] + "Q" + x[at + rng.randint(0, 2) :])
    lines = list(dict.fromkeys(lines[1:]))
    rows = linededup.keyed(lines, np.arange(len(lines)))
    assert (rows["key"].reshape(len(lines), -1) == linededup.band_keys(lines)).all()
    part = groups(len(lines), list(zip(*(x.tolist() for x in linededup.key_links(np.concatenate([rows, rows[::3]]), linededup._brief_near)), strict=True)))
    sets = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in lines]
    keys = linededup.band_keys(lines)
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and (keys[i] == keys[j]).any()]
    assert near and len(set(part)) > 1
    assert all(part[i] == part[j] for i, j in near)
    assert not len(linededup.key_links(rows[:0], linededup._brief_near)[0])


@pytest.mark.parametrize("few", [1, 32])
def test_sketches_lose_no_similar_pair(monkeypatch, few):
    monkeypatch.setattr(linededup, "FEW_LINES", few)
    rng = random.Random(10)
    lines = ["", " ", "ab"]
    for _ in range(30):
        x = words(rng, rng.choice([3, 20, 60, 300]))
        for _ in range(6):
            at = rng.randrange(len(x))
            lines.append(x := x[:at] + "Q" + x[at + rng.randint(0, 2) :])
    lines = list(dict.fromkeys(lines[1:]))
    ids = np.array([linededup.line_id(x) for x in lines])
    rows = linededup.sketches(lines, ids)
    at = {x: i for i, x in enumerate(ids.tolist())}
    part = groups(len(lines), [(at[a], at[b]) for a, b in zip(*(x.tolist() for x in linededup.sketch_links(np.concatenate([rows, rows[::3]]))), strict=True)])
    sets = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in lines]
    keys = linededup.band_keys(lines)
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and (keys[i] == keys[j]).any()]
    assert near and len(set(part)) > 1
    assert all(part[i] == part[j] for i, j in near)


def test_lines_are_compared_by_shingles_only_if_their_parities_allow_it(monkeypatch):
    rng = random.Random(14)
    lines, group = [], []
    for g in range(20):
        x = words(rng, rng.choice([20, 60, 200]))
        for _ in range(12):
            y = x
            for _ in range(rng.choice([1, 6, 10])):
                at = rng.randrange(len(y))
                y = y[:at] + rng.choice("QXZ") + y[at + 1 :]
            lines.append(y)
            group.append(g)
    sets = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in lines]
    keys = linededup.band_keys(lines)
    near = [(i, j) for i in range(len(lines)) for j in range(i) if group[i] == group[j] and (keys[i] == keys[j]).any() and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    asked, real = [], np.searchsorted

    def spy(codes, ask, *rest, **named):
        if len(codes) == sum(map(len, sets)):
            asked.append(len(ask))
        return real(codes, ask, *rest, **named)

    def run():
        asked.clear()
        i, j = linededup.verified(np.array(group), lines, np.arange(len(lines)), np.zeros(len(lines), dtype=bool))
        return groups(len(lines), list(zip(i.tolist(), j.tolist(), strict=True))), sum(asked)

    monkeypatch.setattr(np, "searchsorted", spy)
    part, some = run()
    monkeypatch.setattr(linededup, "_differ_little", lambda bits, size, a, b: np.ones(len(a), dtype=bool))
    every, most = run()
    assert part == every == groups(len(lines), near)
    assert near and some < most / 2


# suffixes


def brute_removed(texts):
    seen = Counter(d[p : p + 200] for d in texts for p in range(len(d) - 199))
    out = []
    for d in texts:
        gone = np.zeros(len(d), dtype=bool)
        for p in range(len(d) - 199):
            if seen[d[p : p + 200]] > 1:
                gone[p : p + 200] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("frequent", [20_000, 2])
def test_suffixes_match_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(suffixdedup, "FREQUENT", frequent)
    rng = random.Random(6)
    passage = words(rng, 70)
    texts = [words(rng, 120) for _ in range(6)]
    for n in (199, 200, 201, 230, 260):
        texts += [words(rng, 20) + passage[:n] + words(rng, 30), passage[40 : 40 + n]]
    texts += [texts[0], texts[0], texts[1][30:], "a" * 900, "é" * 180, "ab" * 300, None, "", "x" * 199, words(rng, 40) + texts[2][:350] + texts[2][100:420]]
    docs = frame(spark, texts)
    raw = [(t or "").encode() for t in texts]
    want = brute_removed(raw)
    out = suffixdedup.remove_repeats(docs.select("doc_id", "text", "key"))
    for r in out.collect():
        gone, d = want[r.doc_id], raw[r.doc_id]
        assert bytes(r._kept) == np.frombuffer(d, np.uint8)[~gone].tobytes(), r.doc_id
        assert r._n_bytes == len(d) and sum(s.end - s.begin for s in r._removed) == gone.sum()
        assert len(r._removed) == int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
    assert suffixdedup.remove_repeats(docs.where("false")).count() == 0


def test_multikey_order_and_anchors():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 2, (300, 19), dtype=np.uint8)
    order = suffixdedup.multikey_order(rows)
    assert [bytes(rows[i]) for i in order] == sorted(bytes(r) for r in rows)
    data = bytes(rng.integers(97, 100, 3000, dtype=np.uint8))
    at, first, last, _ = suffixdedup.anchors(data)
    assert np.array_equal(np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)]), np.arange(2801))
    at2, first2, _, _ = suffixdedup.anchors(b"xyz" * 9 + data[500:1500])
    moved = {(a - 27 + 500) for a in at2 if 27 <= a}
    assert len(moved & set(at.tolist())) >= len(moved) - 3
    assert len(suffixdedup.anchors(b"a" * 199)[0]) == 0


# shards


def test_shards(spark):
    rng = random.Random(8)
    texts = [words(rng, rng.randint(0, 60)) for _ in range(900)] + ["same text here"] * 400 + [None, "", "é😀"]
    docs = frame(spark, texts)
    docs = docs.unionByName(docs.where("doc_id < 20")).unionByName(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    rows = kdshard.shard_documents(docs, 24).collect()
    assert len(rows) == len(texts) + 21
    total = Counter()
    slots = {}
    for r in rows:
        total[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
        if r.doc_id is not None:
            t = (texts[r.doc_id] or "").encode()
            assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(t) + 8, zlib.crc32(t), "bytes", None)
    assert sorted(total) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(total.values()) / 24
    assert max(abs(v - mean) for v in total.values()) < 0.12 * mean
    assert kdshard.shard_documents(docs.where("false"), 24).count() == 0
    by_target = kdshard.shard_documents(docs, target_bytes=int(mean * 4)).agg(F.max("shard")).first()[0]
    assert by_target in (5, 6)


# search


def test_search_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=16).astype(np.float32).tolist() for _ in range(300)]
    vectors[5:9] = [vectors[4]] * 4
    sparse = [[0.0] * 16 for _ in range(40)]
    for i, v in enumerate(sparse):
        v[i % 16] = 1.0
    vectors += sparse
    rows = list(enumerate(vectors)) + [(1000, None), (1001, [1.0, None] * 8), (1002, [float("nan")] * 16), (1003, [float("inf")] * 16), (1020, []), (1021, [0.5, -0.5]), (None, vectors[0]), (20, vectors[20])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    whole = [(i, np.floor(64 * np.array(v, dtype=np.float64)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    dot = lambda a, b: int((a[: min(len(a), len(b))] * b[: min(len(a), len(b))]).sum())
    want = {}
    for q in {i for i, _ in whole if i % 20 == 0}:
        v = next(x for i, x in whole if i == q)
        best = sorted((-dot(v, x), i) for i, x in whole if i != q)[:20]
        want[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    monkeypatch.setattr(maxscore, "STEP_ROWS", 32)
    for r in range(2):
        found = {}
        for x in maxscore.top_k(df, F.col("vec_id") % 20 == 0).collect():
            found.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
        assert {k: sorted(v) for k, v in found.items()} == want, r
        monkeypatch.setattr(maxscore, "BLOCK_ROWS", 5)
    assert maxscore.top_k(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    few = {x.vec_id for x in maxscore.top_k(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()}
    assert few == {1, 2}


def test_pipeline_keeps_clean_rows(spark):
    import corpus_pipeline
    from docspan.llm.simhash import fingerprints

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = common.cut(stage(spark, docs, folder))
        if name == "near_dedup":
            fps = fingerprints([r.text for r in out.collect()])
            assert not any((np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4).any() for i in range(len(fps)))
        if name != "bpe":
            assert out.columns == columns
            docs = out
    ids = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in out.collect()} == ids and 0.5 * before < len(ids) < before
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
