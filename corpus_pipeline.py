"""From raw documents to token ids: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, folder of the tables) and returns a DataFrame; all but the last return the columns of
``docs``. Between stages the documents are written to the shared folder and read again.

The same holds for every stage: NULL and empty texts pass, except that the quality model may reject an empty one as it
does any other; rows with a NULL doc_id are never near copies of others and are judged by their text; rows that repeat
id and text are judged alike (of rows that repeat an id, near-copy removal keeps the one with the smallest text);
texts may be of any length; an empty table stays empty; extra columns of any name and of orderable types pass
unchanged. The last stage replaces columns called ids, n_tokens and round_trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlens.llm import byte_bpe, decontaminate, minhash_dedup, quality, secret_scan, spans
from partlens.llm.common import bounded_batches, free_name, set_aside, stored, with_keys

#: What stands for a secret in a kept text.
MASK = "[SECRET]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _without_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Drop the rows whose hash of id and text is in ``keys`` (row_key)."""
    key = free_name(docs, "_row")
    gone = stored(keys.select(F.col("row_key").alias(key)).distinct(), "dropped")
    return with_keys(docs.withColumn(key, F.xxhash64("doc_id", "text")), gone, key, "left_anti").select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the model of trusted text finds too improbable."""
    scored = quality.classify(docs, _table(spark, sf_dir, "labels"))
    return _without_rows(docs, scored.where("NOT kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    bounded_batches(spark)
    return minhash_dedup.one_of_each(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a test item of the benchmark."""
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "text")
    found = decontaminate.contaminated(keyed, _table(spark, sf_dir, "benchmark"), doc_id="row_key")
    return _without_rows(docs, found.withColumnRenamed("doc_id", "row_key"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; ``n_chars`` follows where a text changed."""
    aside, back = set_aside(docs, ["secrets", "base_secrets", "_more"])
    found = secret_scan.find_secrets(aside)
    changed = F.size("secrets") > 0
    new = found.withColumn("text", F.when(changed, spans.masked(F.col("text"), F.col("secrets"), MASK)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        new = new.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars")))
    return new.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in aside.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the token ids, their number, and whether decoding them gives the text back."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    bounded_batches(spark)
    aside, back = set_aside(docs, ["decoded", "decoded_bytes"])
    # Written between the two, as a task that does both has two Python workers, and the executor's memory follows them.
    coded = stored(byte_bpe.encode(aside, ranks, public_tokenizers.PATTERN, with_offsets=False), "encoded")
    coded = byte_bpe.decode(coded, ranks)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    new = coded.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("round_trip", same)
    return new.drop("decoded", "decoded_bytes").withColumnsRenamed(back)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("byte_bpe", tokenize),
]

#: SQL can't express the quality model; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
