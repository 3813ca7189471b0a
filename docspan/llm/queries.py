"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspan.llm import bpe, decontaminate, kdshard, langid, linededup, maxscore, simhash, suffixdedup, tokenfiles, toxicity
from docspan.llm.common import shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]


def id_hash(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def op1_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = linededup.dropped_lines(docs).select(F.col("id").alias("doc_id"), "drop")
    lines = docs.select("doc_id", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    none = F.array().cast("array<bigint>")
    return lines.join(gone, "doc_id", "left").select("doc_id", "n_lines", F.coalesce("drop", none).alias("dropped_lines"), F.size(F.coalesce("drop", none)).cast("long").alias("n_dropped"))


def op2_kdshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdshard.shard_documents(table(spark, sf_dir, "documents"), 24)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.learn(docs, table(spark, sf_dir, "labels"), allowed=id_hash() % 3 != 1)
    scored = toxicity.score(docs, net)
    return scored.select("doc_id", (id_hash() % 3 == 1).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixdedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("_removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return out.select("doc_id", F.col("_n_bytes").alias("n_bytes"), removed.alias("n_removed"), F.size("_removed").cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    classifier = langid.learn(docs, allowed=id_hash() % 4 != 2)
    found = langid.predict(docs.select("doc_id", "text"), classifier)
    return found.select("doc_id", (id_hash() % 4 == 2).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_narrow").alias("narrow"))


def op6_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    written = tokenfiles.write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.tiktoken"), 50256, public_tokenizers.PATTERN)
    counted = tokenfiles.count_tokens(spark, folder, 50256)
    # a document without a count would mean that its file is not where the driver looks for it
    n = F.coalesce("n_tokens", F.raise_error(F.concat(F.lit("no count of "), "file", F.lit(", document "), "ordinal")).cast("long"))
    return written.join(counted, ["file", "ordinal"], "left").select(F.col("id").alias("doc_id"), n.alias("n_tokens"), "file", "ordinal")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
with split as (
  select doc_id, row_number() over () as row_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
item as (
  select item_id, w, least(10, len(w)) as size from (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null and text is not null) where len(w) > 0),
item_window as (
  select distinct item_id, size, array_to_string(w[i:i + size - 1], ' ') as words from (select item_id, w, size, unnest(range(1, len(w) - size + 2)) as i from item)),
doc_window as (
  select row_id, size, i, array_to_string(w[i:i + size - 1], ' ') as words from (select row_id, w, size, unnest(range(1, len(w) - size + 2)) as i from split, (select distinct size from item_window))),
hit as (select row_id, i, size, item_id from doc_window join item_window using (size, words)),
covered as (select row_id, count(distinct p) as n from (select row_id, unnest(range(i, i + size)) as p from (select distinct row_id, i, size from hit)) group by row_id),
named as (select row_id, count(*) as n, string_agg(item, ',' order by item) as items from (select distinct row_id, cast(item_id as varchar) as item from hit) group by row_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(c.n, 0) as bigint) as n_hit, cast(coalesce(m.n, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(c.n, 0) > 0 as contaminated
from split left join covered c using (row_id) left join named m using (row_id)
"""


def op9_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP9_SQL = """
with v as (
  select vec_id, row_number() over () as row_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum([z[1] * z[2] for z in list_zip(q.e, c.e)]) as bigint) as score from v q, v c where q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 20
"""


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Query] = {"op1_linededup": op1_linededup, "op2_kdshard": op2_kdshard, "op3_toxicity": op3_toxicity, "op4_suffixdedup": op4_suffixdedup, "op5_langid": op5_langid, "op6_tokencount": op6_tokencount, "op7_simhash": op7_simhash, "op8_decontaminate": op8_decontaminate, "op9_maxscore": op9_maxscore, "op10_bpe": op10_bpe}
ORACLE_SQL: dict[str, str] = {"op8_decontaminate": OP8_SQL, "op9_maxscore": OP9_SQL}
