"""The queries of the subpackage: each operator on its whole table, with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlens.llm import (
    byte_bpe, decontaminate, filter_audit, hmm_lm, importance, minhash_dedup, multi_index, passages, pii_labels,
    quality, secret_scan, spans, token_machine, toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op7_byte_bpe(spark, folder):
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, with_offsets=False).drop("text")
    back = byte_bpe.decode(coded, ranks)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        byte_bpe.ids_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded_bytes", 256).alias("decoded_sha256"),
    )


@query
def op2_minhash_dedup(spark, folder):
    return minhash_dedup.near_duplicates(table(spark, folder, "documents"), size=3, percent=85)


@query
def op9_secret_scan(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secret_scan.find_secrets(docs).drop("text")
    kinds = [spans.counted(F.col("base_secrets"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select(
        "doc_id", *kinds, spans.digest(F.col("base_secrets")).alias("base_sha256"),
        spans.joined(F.col("secrets")).alias("spans"),
    )


@query
def op5_decontaminate(spark, folder):
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLE["op5_decontaminate"] = r"""
WITH item_words AS (
  SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
doc_words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
item_set AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3),
    lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM item_words WHERE len(w) >= 5),
doc_set AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3),
    lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM doc_words WHERE len(w) >= 5),
sizes AS (SELECT item_id, count(*) AS n_item FROM item_set GROUP BY item_id),
shared AS (
  SELECT d.doc_id, i.item_id, count(*) AS n_shared FROM doc_set d JOIN item_set i USING (s) GROUP BY d.doc_id, i.item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM shared JOIN sizes USING (item_id) WHERE 100 * n_shared >= 80 * n_item
"""


@query
def op6_quality(spark, folder):
    scored = quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.drop("row_key")


@query
def op1_hmm_lm(spark, folder):
    return hmm_lm.score(table(spark, folder, "documents"))


@query
def op4_multi_index(spark, folder):
    return multi_index.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op3_pii_labels(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pii_labels.find_personal_data(docs, keep_text=False)
    kinds = [spans.counted(F.col("base_personal"), kind).alias(f"n_{kind}") for kind in pii_labels.KINDS]
    return found.select(
        "doc_id", *kinds, spans.digest(F.col("base_personal")).alias("base_sha256"),
        spans.joined(F.col("personal")).alias("spans"),
    )


@query
def op8_passages(spark, folder):
    return passages.shared_passages(table(spark, folder, "documents"))


@query
def op10_toxicity(spark, folder):
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op11_filter_audit(spark, folder):
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


ORACLE["op11_filter_audit"] = r"""
WITH split AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
bits AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS b
  FROM split),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
  max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
sets AS (
  SELECT part, b, count(*) AS docs, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM bits LEFT JOIN marks USING (doc_id) GROUP BY part, b),
f(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bs
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (
  SELECT filter_order, step, bs[step] AS this, coalesce(list_sum(bs[1:step - 1]), 0)::INT AS before
  FROM (SELECT filter_order, bs, unnest(range(1, 6))::INT AS step FROM orders)),
figures AS (
  SELECT part, filter_order, step, this,
    sum(CASE WHEN (b & (this | before)) = 0 THEN docs ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN (b & this) <> 0 AND (b & before) = 0 THEN docs ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN (b & this) <> 0 AND (b & before) <> 0 THEN docs ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN b = this THEN docs ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN (b & this) <> 0 AND (b & before) = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN (b & this) <> 0 AND (b & before) = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM sets, steps GROUP BY part, filter_order, step, this)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, this)::BIGINT AS shapley
FROM figures
"""


@query
def op12_token_machine(spark, folder):
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = token_machine.count_tokens(
        docs.withColumn("n_bytes", token_machine.utf8_bytes(F.col("text"))), public_tokenizers.path("word_bpe_49k.json")
    )
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@query
def op13_importance(spark, folder):
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
