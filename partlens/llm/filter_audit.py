"""How filters overlap: for every order of them, what each one removes, and what it alone would remove.

Each filter gives the ids that fail it. The ids of all filters are united, each with the filter's bit, and a group-by
gives every document the set of filters it fails. No order is replayed over documents: at most 2**n combinations per
part hold all that the report needs.

The repeat filter is an existential self-join: a document fails if a document with a smaller id has the same hash and
the same text. Of the right side only the smallest id per text can matter, so copies are reduced to it on the map side,
and only texts whose hash occurs with two ids take part. The left side stays whole; the engine splits a hot text,
because both sides are shuffled for the join.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlens.llm.common import GAPS, constant, stored, with_keys

#: Texts of fewer words are short; a text is repetitive below this share of distinct words (in hundredths), loud
#: above this share of capital letters.
LEAST_WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 200, 50, 2
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = "[#$%&*|]"


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions that need only the text: A short, B repetitive, C loud, D marked."""
    words = F.array_remove(F.split(text, GAPS), "")
    capitals = F.char_length(text) - F.char_length(F.translate(text, CAPITALS, ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_SHARE * F.size(words),
        "C": 100 * capitals > CAPITAL_SHARE * F.char_length(text),
        "D": text.rlike(MARKS),
    }


def repeats(docs: DataFrame, text: Column, carried: list[str], doc_id: str = "doc_id") -> DataFrame:
    """``carried`` columns of the rows that have a row with a smaller id and the same text.

    Rows of one id do not count as each other's repeats. A NULL id is neither smaller nor larger than any.
    """
    rows = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_h"), text.alias("_t"), *carried)
    hashes = rows.groupBy("_h").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi")).where("lo < hi").select("_h")
    rows = with_keys(rows, stored(hashes, "repeated"), "_h", "left_semi")
    # The hash under a second name: the join is then shuffled on other columns than the group-by, and can be split.
    first = rows.groupBy("_h", "_t").agg(F.min("_id").alias("first")).select(
        F.col("_h").alias("h2"), F.col("_t").alias("t2"), F.xxhash64("_h", "_t").alias("salt2"), "first"
    )
    same = (F.col("salt") == F.col("salt2")) & (F.col("_h") == F.col("h2")) & (F.col("_t") == F.col("t2"))
    found = rows.withColumn("salt", F.xxhash64("_h", "_t")).join(first, same & (F.col("first") < F.col("_id")), "left_semi")
    return found.select(*carried)


def combinations(
    docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], repeat: str | None, part: Column,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per part and set of failed filters: part, bits, docs, good, toxic.

    Bit ``i`` stands for the i-th name of ``filters`` in order, the last one for ``repeat``. ``good`` and ``toxic``
    count documents that some row of ``labels`` marks so.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    whole = docs.select(F.col(f"`{doc_id}`").alias("id"), body.alias("body"), part.alias("part"), *[
        F.coalesce(fails, F.lit(False)).alias(f"f{i}") for i, fails in enumerate(filters.values())
    ])
    # Rows of one id with different texts are different documents: the id is the id with the text's hash and length.
    key = ["id", "part", "hash", "size"]
    rows = whole.withColumn("hash", F.xxhash64("body")).withColumn("size", F.char_length("body"))
    bits = sum((F.col(f"f{i}").cast("int") * (1 << i) for i in range(len(filters))), F.lit(0))
    ids = rows.select(*key, bits.alias("bits"), F.lit(1).alias("docs"))
    if repeat is not None:
        texts = docs.select(F.col(f"`{doc_id}`").alias("id"), body.alias("body"), part.alias("part"))
        texts = texts.withColumn("hash", F.xxhash64("body")).withColumn("size", F.char_length("body"))
        again = repeats(texts, F.col("body"), key, "id")
        ids = ids.unionByName(again.select(*key, F.lit(1 << len(filters)).alias("bits"), F.lit(0).alias("docs")))
    failed = ids.groupBy(*key).agg(F.bit_or("bits").alias("bits"), F.sum("docs").alias("docs"))
    # Repeated rows of a document weigh as many as they are; labels meet each document once.
    marks = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    ).select(F.col("doc_id").alias("label_id"), F.xxhash64("doc_id").alias("label_hash"), "good", "toxic")
    marked = failed.withColumn("id_hash", F.xxhash64("id")).join(
        marks, (F.col("id_hash") == F.col("label_hash")) & (F.col("id") == F.col("label_id")), "left"
    )
    return marked.groupBy("part", "bits").agg(
        F.sum("docs").alias("docs"),
        F.sum(F.col("docs") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("docs") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )


def report(combined: DataFrame, names: str) -> DataFrame:
    """The figures of every order and step from the combinations: one row per part, order and step.

    ``names`` holds one letter per bit. ``shapley`` is what the step's filter removes, summed over all orders: among
    the k filters that a document fails, each comes first in orders!/k of them.
    """
    n = len(names)
    orders = list(permutations(names))
    bit = {name: 1 << i for i, name in enumerate(names)}
    steps = [
        {"filter_order": "".join(order), "step": at + 1, "this": bit[order[at]], "before": sum(bit[b] for b in order[:at])}
        for order in orders for at in range(n)
    ]
    per_part = combined.groupBy("part").agg(F.collect_list(F.struct("bits", "docs", "good", "toxic")).alias("sets"))
    listed = constant(steps, "array<struct<filter_order:string,step:int,this:int,before:int>>")
    rows = per_part.select("part", "sets", F.explode(listed).alias("s")).select("part", "sets", "s.*")
    this, before = F.col("this"), F.col("before")

    def total(value, condition) -> Column:
        zero = F.lit(0).cast("long")
        return F.aggregate("sets", zero, lambda sum_, x: sum_ + F.when(condition(x["bits"]), value(x)).otherwise(zero))

    def removed(bits):
        return (bits.bitwiseAND(before) == 0) & (bits.bitwiseAND(this) != 0)

    shares = F.array(*[F.lit(0), *[F.lit(len(orders) // k) for k in range(1, n + 1)]])
    return rows.select(
        "part", "filter_order", "step",
        total(lambda x: x["docs"], lambda b: b.bitwiseAND(before.bitwiseOR(this)) == 0).alias("kept"),
        total(lambda x: x["docs"], removed).alias("removed"),
        total(lambda x: x["docs"], lambda b: (b.bitwiseAND(before) != 0) & (b.bitwiseAND(this) != 0)).alias("redundant"),
        total(lambda x: x["docs"], lambda b: b == this).alias("unique_fails"),
        total(lambda x: x["good"], removed).alias("good_lost"),
        total(lambda x: x["toxic"], removed).alias("toxic_lost"),
        total(
            lambda x: x["docs"] * F.element_at(shares, F.bit_count(x["bits"]) + 1), lambda b: b.bitwiseAND(this) != 0
        ).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The audit of the five filters A to E, where E is the repeat filter; 600 rows per part, zeros included.

    Parts are the values of ``source``, NULL as the empty string. A NULL text is empty, so all empty texts are repeats
    of the one with the smallest id. A row without an id is never a repeat, has no repeats and no labels. Repeated rows
    are counted each; rows of one id do not repeat each other. Texts may be of any length; an empty table gives no
    rows. Other columns of ``docs`` and ``labels`` are not read, whatever their names.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    part = F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(""))
    found = combinations(docs, labels, text_filters(body), "E", part, doc_id, text)
    return report(found, "ABCDE")
