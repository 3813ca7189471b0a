"""Operators that judge rows one by one: BPE, toxicity, language, decontamination, token files."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from docspan.llm import bpe, decontaminate, langid, tokenfiles, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, decoded string, _score string, _lang string, _items string, key string"
ODD = [None, "", " ", "a", "'s 'select don't 'LL", "a  b\n\n c \t", "é😀日本 ١٢ ½", "x" * 3000, " " * 500, "ab" * 5000, "THE idiot!!", "\x00\x1c\x85 end"]


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def frame(spark, texts, **columns):
    rows = [(i, t, None, None, None, *["clash"] * 6) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def test_words_and_ids_are_tiktokens(tik):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aab'' sstrevemld  \n\té1٣ß日😀!?.-\x1c\x85") for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += [t for t in ODD if t is not None]
    got = list(bpe.Encoder(RANKS, public_tokenizers.PATTERN).encode(texts))
    assert [g.tolist() for g in got] == [tik.encode_ordinary(t) for t in texts]
    other = r"\w+|\W+"
    enc = tiktoken.Encoding("o", pat_str=other, mergeable_ranks=bpe.ranks_at(RANKS).rank, special_tokens={})
    assert [g.tolist() for g in bpe.Encoder(RANKS, other).encode(texts[:50])] == [enc.encode_ordinary(t) for t in texts[:50]]


def test_early_ranks_go_back(tmp_path):
    # "ab" (rank 259) is made late, and with "c" gives a token of an earlier rank
    tokens = [bytes([b]) for b in range(256)] + [b"cd", b"abcd", b"bcd", b"ab"]
    (tmp_path / "r").write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    ranks = bpe.Ranks(str(tmp_path / "r"))
    words = [b"abcd", b"xabcdab", b"ababab", b"", b"cdcdcd"]
    ids, counts = ranks.replay(words)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert [p.tolist() for p in parts] == [ranks.slow(w) for w in words]


def test_bpe_rows(spark, tik):
    docs = frame(spark, ODD + ODD)
    rows = bpe.encode_decode(docs, RANKS).collect()
    assert len(rows) == len(ODD) * 2
    for r in rows:
        text = ODD[r.doc_id % len(ODD)] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == tik.encode_ordinary(text) and bytes(r.decoded) == text.encode() and r.n_tokens == len(r.ids) // 4
    assert bpe.encode_decode(docs.where("false"), RANKS).count() == 0


def brute_hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    hit, found = set(), set()
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            for p in range(len(words) - size + 1):
                if words[p : p + size] == w[i : i + size]:
                    hit.update(range(p, p + size))
                    found.add(str(item))
    return len(words), len(hit), ",".join(sorted(found))


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "é", "12", "dd"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, sentence(rng.choice([3, 9, 10, 11, 30]))) for i in range(25)] + [(100, ""), (101, None), (7, "zz " * 3), (7, "zz zz zz"), (102, "one")]
    texts = [sentence(60) + " " + rng.choice(items[:25])[1].upper() if i % 2 else sentence(40) for i in range(30)]
    texts += [None, "", "One, two", items[4][1], "zz-zz.zz", "..."]
    docs = frame(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.report(docs, bench).collect():
        n, hit, found = brute_hits(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) == (n, hit, found, hit > 0)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(texts) if not brute_hits(t, items)[1]}
    assert decontaminate.report(docs, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.report(docs.where("false"), bench).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    items = [(i, f"w{i} " + " ".join(f"x{i}y{k}" for k in range(11))) for i in range(8)]
    docs = frame(spark, [t for _, t in items] + ["nothing here"])
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 150)
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.report(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: (12, [str(i)]) for i in range(8)} | {8: (0, [])}


def labelled(n, seed):
    rng = random.Random(seed)
    plain = ["und", "the", "onre", "that", "eau", "tion", "heit", "asco"]
    out = []
    for i in range(n):
        w = [rng.choice(plain) + rng.choice(plain) for _ in range(rng.randint(5, 120))]
        if toxic := i % 3 == 0:
            for _ in range(1 + len(w) // 40):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "vequ" + rng.choice(plain)])
        out.append((" ".join(w), int(toxic)))
    return out


def test_toxicity_finds_held_out_texts(spark):
    rows = labelled(900, 1)
    net = toxicity.train([t for t, _ in rows], [y for _, y in rows])
    test = labelled(300, 2)
    p = 1 / (1 + np.exp(-net.logits([t for t, _ in test])))
    y = np.array([y for _, y in test])
    assert ((p >= toxicity.THRESHOLD) == (y == 1)).mean() > 0.97
    docs = frame(spark, [*ODD, test[0][0]])
    out = toxicity.score(docs, net)
    got = {r.doc_id: r[out.columns[-1]] for r in out.collect()}
    assert got[0] == got[1] == got[2] == 0.0 and all(0 <= v <= 1 for v in got.values()) and got[len(ODD)] > 0.5
    assert toxicity.score(docs.where("false"), net).count() == 0
    assert {r[out.columns[-1]] for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.train(["a"], [1]) is None


def test_windows_cover_and_gradients_are_right():
    for n in (0, 1, 23, 24, 25, 36, 37, 100):
        at, doc = toxicity.windows_of(np.array([n]))
        assert set(at[at >= 0].tolist()) == set(range(n)) and (doc == 0).all() and len(at) >= 1
    net = toxicity.Network({b"a": 0, b"bb": 1}, 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = [b"a", b"bb", b"ccc"]
    at = np.full((2, toxicity.WINDOW), -1)
    at[0, :5], at[1, :3] = [0, 1, 2, 1, 0], [2, 2, 0]

    def loss():
        x, _ = net.inputs(words)
        return float(net.forward(at, net.tables(x)) @ np.array([1.0, -2.0]))

    x, fed = net.inputs(words)
    keep = []
    net.forward(at, net.tables(x), keep)
    grad = net.backward(np.array([1.0, -2.0]), at, x, fed, keep)
    for name in ("fx", "bg", "fn", "ax", "av", "ox", "o0"):
        flat, g = net.p[name].reshape(-1), np.asarray(grad[name]).reshape(-1)
        for i in (0, len(flat) // 2):
            old = flat[i]
            flat[i] = old + 1e-2
            up = loss()
            flat[i] = old - 1e-2
            down = loss()
            flat[i] = old
            assert g[i] == pytest.approx((up - down) / 2e-2, abs=2e-2)


def test_learning_respects_the_condition(spark):
    rows = labelled(120, 4)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + [(None, "x"), (500, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)] + [(None, 1), (500, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.learn(docs, labels, allowed=F.lit(False)) is None
    assert toxicity.learn(docs, labels, allowed=F.col("doc_id") % 3 == 1) is None
    assert toxicity.learn(docs, labels) is not None


def test_language(spark):
    rng = random.Random(9)
    kinds = {"aa": ["kalo", "mira", "tasu"], "bb": ["zwex", "drunk", "flitz"], "cc": ["ñaó", "çoê", "éüi"]}
    text = lambda k, n: " ".join(rng.choice(kinds[k]) + rng.choice(kinds[k]) for _ in range(n))
    rows = [(i, text(k, 60), k) for i, k in enumerate(sorted(kinds) * 40)] + [(None, "x", "aa"), (900, None, "aa"), (901, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    c = langid.learn(docs, allowed=F.col("doc_id") % 4 != 2)
    test = [(text(k, n), k) for k in kinds for n in (3, 40, 3000)]
    assert [c.classify(t)[0] for t, _ in test] == [k for _, k in test]
    assert c.classify(None) == c.classify("") == c.classify("12 !? 3") == ("und", 0.0, True)
    assert langid.Classifier({}).classify("word")[0] == "und"
    out = langid.predict(frame(spark, ODD), c)
    assert out.count() == len(ODD) and set(out.columns[:11]) == set(frame(spark, ODD).columns)
    assert langid.predict(frame(spark, ODD).where("false"), c).count() == 0


def test_token_files(spark, tmp_path, tik):
    folder = f"file://{tmp_path}/t"
    texts = [t for t in ODD] * 3
    written = tokenfiles.write_tokens(frame(spark, texts).repartition(3), folder, RANKS, 50256)
    for block in (2, 64, 4 << 20):
        counted = tokenfiles.count_tokens(spark, folder, 50256, block_bytes=block) if block > 2 else tokenfiles.count_tokens(spark, folder, 50256, block_bytes=1000)
        got = {r.id: r.n_tokens for r in written.join(counted, ["file", "ordinal"]).collect()}
        assert got == {i: len(tik.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    other = tmp_path / "o"
    other.mkdir()
    np.array([9, 9, 1, 2, 9, 3], "<u4").tofile(other / "a.tokens")
    np.array([4, 4, 4], "<u4").tofile(other / "b.tokens")
    (other / "c.tokens").write_bytes(b"")
    for block in (4, 8, 12, 100):
        rows = {tuple(r) for r in tokenfiles.count_tokens(spark, f"file://{other}", 9, 4, block).collect()}
        assert rows == {("a.tokens", 0, 0, True), ("a.tokens", 1, 0, True), ("a.tokens", 2, 2, True), ("a.tokens", 3, 1, False), ("b.tokens", 0, 3, False)}
    (other / "d.tokens").write_bytes(b"123")
    with pytest.raises(ValueError):
        tokenfiles.count_tokens(spark, f"file://{other}", 9, 4)
    assert tokenfiles.count_tokens(spark, f"file://{tmp_path}/none", 9).count() == 0


def test_digests(spark, tik):
    rows = bpe.encode_decode(frame(spark, ["hello world"]), RANKS).select(F.sha2("ids", 256).alias("h")).first()
    assert rows.h == hashlib.sha256(np.array(tik.encode_ordinary("hello world"), "<u4").tobytes()).hexdigest()
