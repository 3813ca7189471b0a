"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language has a raw-content zstandard dictionary of sample texts. A text is cut into pieces, so that the dictionary
counts all along a long text; every piece is compressed, in lower case, with every dictionary and the sizes add up.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspan.llm.common import fresh_name, map_arrow, small_batches

#: The sample for the dictionaries: so many texts a language (those with the least hash of id and text), so many bytes in all;
#: and so many languages, the most frequent ones.
SAMPLE_TEXTS, DICTIONARY_BYTES, LANGUAGES = 400, 96 << 10, 500
PIECE_BYTES, LEVEL = 2048, 6
#: A best size that is not smaller than the next by this share is too close to call.
LEAST_MARGIN = 0.01
LETTER = regex.compile(r"\p{L}")


class Classifier:
    def __init__(self, samples: dict[str, list[str]]):
        """samples: texts of each language, the most telling last."""
        self.langs = sorted(samples, key=lambda k: (-len(samples[k]), k))  # ties go to the language with more samples
        self.data = {}
        # a line that several languages share (a licence, an address) tells nothing
        where: dict[str, set[str]] = defaultdict(set)
        for lang in self.langs:
            for t in samples[lang]:
                for line in (t or "").lower().split("\n"):
                    where[line].add(lang)
        for lang in self.langs:
            own = ("\n".join(x for x in (t or "").lower().split("\n") if len(where[x]) == 1) for t in samples[lang])
            texts = [t.encode() for t in own if t]
            share = max(64, DICTIONARY_BYTES // max(1, len(texts)))
            self.data[lang] = b"\n".join(t[(len(t) - share) // 2 : (len(t) + share) // 2] if len(t) > share else t for t in texts)[-DICTIONARY_BYTES:] or b"\n"
        self.made = None

    def __getstate__(self):
        return self.__dict__ | {"made": None}

    def sizes(self, text: str) -> np.ndarray:
        """Compressed bytes with each language's dictionary."""
        if self.made is None:
            self.made = []
            for lang in self.langs:
                d = zstandard.ZstdCompressionDict(self.data[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self.made.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False).compress)
        raw = text.lower().encode()
        pieces = [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
        return np.array([sum(map(len, map(press, pieces))) for press in self.made], dtype=np.int64)

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """(language or und, score from 0 to 1, whether the margin is too narrow)."""
        if not self.langs or not text or not LETTER.search(text):
            return "und", 0.0, True
        size = self.sizes(text)
        best = int(size.argmin())
        if len(size) == 1:
            return self.langs[0], 1.0, False
        rest = int(np.delete(size, best).min())
        margin = (rest - size[best]) / rest
        return self.langs[best], float(min(1.0, 0.5 + margin * 5)), bool(margin < LEAST_MARGIN)


def learn(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", allowed=None) -> Classifier:
    """From at most SAMPLE_TEXTS different texts of each language; rows with a null id, text or language teach nothing.

    allowed: a condition on the rows. A table without such rows gives a classifier that answers und. Repeated rows count
    once. Of a text that is longer than half a dictionary, the middle is learned from.
    """
    rows = docs.where(allowed) if allowed is not None else docs
    rows = rows.select(F.col(lang).alias("_l"), F.col(text).alias("_t"), F.xxhash64(id, text).alias("_h")).where(F.col(id).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r["_l"]: r["count"] for r in rows.groupBy("_l").count().orderBy(F.desc("count"), "_l").limit(LANGUAGES).collect()}
    # hashes are even, so that about twice the sample lies below a share of their range; no row moves for it
    below = [F.when(F.col("_l") == k, F.col("_h") < int(min(2**63 - 1, -(2**63) + 2**64 * 2 * SAMPLE_TEXTS / n))) for k, n in sizes.items()]
    half = DICTIONARY_BYTES // 2
    middle = F.when(F.length("_t") > half, F.substring("_t", ((F.length("_t") - half) / 2 + 1).cast("int"), F.lit(half))).otherwise(F.col("_t"))
    few = rows.where(F.coalesce(*below, F.lit(False))) if below else rows.limit(0)
    few = few.select("_l", "_h", middle.alias("_t")).groupBy("_l", "_h").agg(F.min("_t").alias("_t"))
    samples = defaultdict(list)
    for r in sorted(few.orderBy("_h", "_l").limit(3 * SAMPLE_TEXTS * max(1, len(sizes))).collect(), key=lambda r: (r._h, r._l)):
        if len(samples[r._l]) < SAMPLE_TEXTS:
            samples[r._l].append(r._t)
    return Classifier(dict(samples))


def predict(docs: DataFrame, classifier: Classifier, text: str = "text") -> DataFrame:
    """docs, with columns more: _lang string, _score double, _narrow boolean.

    _lang is und, with score 0, for a null text or one without letters, or if nothing was learned. Whole texts count,
    however long. Rows are independent: repeated rows repeat their result, an empty table stays empty.
    """
    names = docs.columns
    add = [fresh_name(x, names) for x in ("_lang", "_score", "_narrow")]
    sent = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, names.index(text)):
            found = [sent.value.classify(t) for t in batch.column(names.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())], names=[*names, *add])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_arrow(docs, run, f"{kinds}, `{add[0]}` string, `{add[1]}` double, `{add[2]}` boolean")
