"""Corpus preparation: every stage takes (spark, docs, sf_dir), is written as Parquet and read again as the next one's docs.

toxicity drops rows that score as toxic; line_dedup cuts repeated and near-repeated lines out of the texts; near_dedup keeps
one document of each group of near-duplicates; decontaminate drops documents that hold a benchmark window; bpe encodes.

For every stage: docs has doc_id and text, and may have any other columns, which are kept; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspan.llm import bpe, decontaminate, linededup, simhash, toxicity
from docspan.llm import queries
from docspan.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose score is under the threshold. Null and empty texts stay; rows of one id are judged by their texts."""
    net = toxicity.learn(docs, table(spark, sf_dir, "labels"), allowed=queries.id_hash() % 3 != 1)
    scored = toxicity.score(docs, net)
    return scored.where(F.col(f"`{scored.columns[-1]}`") < toxicity.THRESHOLD).select(*(f"`{c}`" for c in docs.columns))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with repeated lines cut out, and n_chars, where docs has it, of the text that is left.

    Null texts stay null and null ids are left alone; rows of one id are copies of one document; a text may become empty.
    """
    out = linededup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        changed = F.col(f"`{out.columns[-1]}`").isNotNull()
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*(f"`{c}`" for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of each group of near-duplicates; null and empty texts are one group. Null ids stay."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without a benchmark window; null and empty texts have none. Repeated rows are judged alike."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; a null text counts as empty."""
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]
#: A network scores the first stage, so SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
