"""The registered queries and the pipeline on small tables with nulls, empties, repeats, long texts and clashing names."""

import hashlib
import zlib

import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from docspan.llm import queries

COMMON = "the quick brown fox jumps over the lazy dog while the small cat sleeps near the warm stove "
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = {
    "op1_linededup": "doc_id n_lines dropped_lines n_dropped",
    "op2_kdshard": "doc_id size text_crc32 law shard slot grown_shard",
    "op3_toxicity": "doc_id held_out score predicted",
    "op4_suffixdedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op5_langid": "doc_id held_out lang_pred score",
    "op6_tokencount": "doc_id n_tokens",
    "op7_simhash": "doc_id fingerprint component_id",
    "op8_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op9_maxscore": "query_id rank vec_id score",
    "op10_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
}


def rows():
    texts = [COMMON * 4 + f"tail number {i}" for i in range(6)]
    texts += [None, "", " \n\t\n", "½ ² Ⅷ 42", "a", "ein kleiner Hund läuft über die Straße", "un petit chien traverse la rue", COMMON * 4 + "tail number 0", COMMON * 4 + "tail number 0", "\n".join(f"line {i} of a long text" for i in range(30_000)), "plain words that nobody repeats anywhere else"]
    out = [(i, t, ("en", "de", "fr", None)[i % 4], ("web", None)[i % 2], None if t is None else len(t)) for i, t in enumerate(texts)]
    return out + [out[0], (None, "a row without an id", "en", "web", 3), (3, "another text of the same id", "en", "web", 3)]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    found = {}
    for name, few in (("full", False), ("empty", True)):
        top = tmp_path_factory.mktemp(name)
        docs = spark.createDataFrame([] if few else rows(), SCHEMA)
        # names that the operators use themselves
        for c in ("node", "component", "key", "drop", "id", "line", "at", "_score", "_fp", "_lang", "_spans", "hash", "bucket"):
            docs = docs.withColumn(c, F.lit("x"))
        tables = {
            "documents": docs,
            "labels": spark.createDataFrame([] if few else [(i, None, int(i % 5 == 0)) for i in range(14)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int"),
            "benchmark": spark.createDataFrame([] if few else [(1, COMMON), (2, None), (3, "plain words"), (None, "x"), (3, "plain words")], "item_id long, text string"),
            "embeddings": spark.createDataFrame([] if few else [(i, [float(i), 1.0, -0.5]) for i in range(45)] + [(None, [1.0]), (50, None), (51, [None, 1.0]), (52, [float("nan")]), (20, [20.0, 1.0, -0.5])], "vec_id long, embedding array<float>"),
        }
        for t, df in tables.items():
            df.write.parquet(f"{top}/{t}.parquet")
        found[name] = str(top)
    return found


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, folders, name):
    out = queries.QUERIES[name](spark, folders["full"])
    assert set(COLUMNS[name].split()) <= set(out.columns)
    got = out.collect()
    if name == "op9_maxscore":
        assert {r.query_id for r in got} == {0, 20, 40} and all(1 <= r["rank"] <= 20 and r.vec_id != r.query_id for r in got)
        assert len(got) == 60
    else:
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows())
    if name == "op2_kdshard":
        assert {(r.doc_id, r["size"], r.text_crc32) for r in got} == {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows()}
        for shard in {r.shard for r in got}:
            own = sorted(r.slot for r in got if r.shard == shard)
            assert own == list(range(len(own))) and 0 <= shard < 24
    if name == "op5_langid":
        assert {r.doc_id for r in got if r.lang_pred == "und"} == {6, 7, 8, 9}
    if name in ("op6_tokencount", "op10_bpe"):
        with open(public_tokenizers.path("byte_bpe_50k.tiktoken")) as f:
            import base64

            ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
        enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        want = sorted((str(i), len(enc.encode_ordinary(t or ""))) for i, t, *_ in rows())
        assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want
    if name == "op10_bpe":
        assert {(r.doc_id, r.decoded_sha256) for r in got} == {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows()}
    if name == "op8_decontaminate":
        assert {r.doc_id for r in got if r.contaminated} == {0, 1, 2, 3, 4, 5, 13, 14, 16}
    if name == "op3_toxicity":
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert queries.QUERIES[name](spark, folders["empty"]).count() == 0


def test_pipeline(spark, folders):
    docs = spark.read.parquet(f"{folders['full']}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "bpe"]
    assert corpus_pipeline.cut_lines(spark, docs, folders["full"]).columns == docs.columns
    got = corpus_pipeline.run(spark, folders["full"])
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    left = {r.doc_id for r in got.collect()}
    assert None in left and not {0, 16} & left and {11, 12} <= left  # 0 and 16 hold benchmark windows
    assert corpus_pipeline.run(spark, folders["empty"]).count() == 0


def test_toxicity_is_the_same_in_every_driver():
    """Scores don't depend on the order of hashed sets."""
    import os
    import subprocess
    import sys

    code = "from docspan.llm import toxicity as t; n = t.train(['bad awful word here ' * 3, 'nice calm text here ' * 3] * 20, [1, 0] * 20); print(n.logits(['an awful text', 'calm text']).tolist())"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    said = {subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONHASHSEED": seed, "PYTHONPATH": root + os.pathsep + os.environ.get("PYTHONPATH", "")}, capture_output=True, text=True, check=True).stdout for seed in ("0", "1")}
    assert len(said) == 1


def test_multikey_order():
    import numpy as np

    from docspan.llm.suffixdedup import multikey_order

    rng = np.random.default_rng(3)
    for n, wide, most in ((0, 20, 256), (1, 20, 256), (5000, 24, 2), (4000, 13, 256), (6000, 16, 1)):
        x = rng.integers(0, most, (n, wide), dtype=np.uint8)
        x[: n // 2, :12] = x[:1, :12]
        got = x[multikey_order(x)]
        assert [r.tobytes() for r in got] == sorted(r.tobytes() for r in x)
