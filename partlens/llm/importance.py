"""Draw the documents closest to a target distribution, with exact ranks from a distributed radix sort.

Features are runs of one to three words, hashed into a fixed number of buckets. The bucket counts of all documents and
of the target give an array of gains; a document's weight is the sum of the gains of its features. Random keys from
the ids turn weights into a weighted draw without replacement: the highest scores are drawn.

Ranks come from a least-significant-digit radix sort. One pass is a stable counting sort by one digit of the composite
key (score, id): every block of positions counts its digits, prefix sums over digits and blocks say where a block's
share of a digit begins, and a row's place among the equal digits of its block is added to it. After the last pass the
place is the rank. Each pass is written to the shared folder, so a lost executor costs its tasks only, and no task ever
holds more than one block of one digit.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partlens.llm.common import constant, small_batches, stored

BUCKETS = 10_000
LONGEST_RUN = 3
#: Bits of one digit: 2**11 totals are all that the driver sees of a pass.
DIGIT_BITS = 11
#: Positions of a block at most; smaller tables have smaller blocks, so that every task has some.
BLOCK_ROWS = 1 << 18


# Features ---------------------------------------------------------------------


def _zero_bytes(count: int) -> np.ndarray:
    """What ``count`` more bytes do to a CRC-32, as a table per byte of the checksum (the step is linear)."""

    def times(matrix, vector):
        total = 0
        for bit in range(32):
            if vector >> bit & 1:
                total ^= matrix[bit]
        return total

    # The matrix of one zero byte: the checksum's table step without new data.
    unit = [zlib.crc32(b"\0", 1 << bit) ^ zlib.crc32(b"\0") for bit in range(32)]
    power = [1 << bit for bit in range(32)]
    while count:
        if count & 1:
            power = [times(unit, column) for column in power]
        unit = [times(unit, column) for column in unit]
        count >>= 1
    table = np.zeros((4, 256), np.uint32)
    for bit, column in enumerate(power):
        values = np.arange(256)
        table[bit // 8] ^= np.where(values >> (bit % 8) & 1, np.uint32(column), np.uint32(0))
    return table


class Hasher:
    """Buckets of all word runs of a block of texts; keeps the tables of the word lengths it has met."""

    def __init__(self, buckets: int):
        self.buckets, self.at, self.tables = buckets, {}, []

    def table_of(self, sizes: np.ndarray) -> np.ndarray:
        distinct, inverse = np.unique(sizes, return_inverse=True)
        for size in distinct.tolist():
            if size not in self.at:
                self.at[size] = len(self.tables)
                self.tables.append(_zero_bytes(size))
        return np.array([self.at[size] for size in distinct.tolist()], np.int64)[inverse]

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket of each feature, its text, words of each text); features of one length come together."""
        import re

        # The words: neither a control or punctuation character nor a capital, once A-Z are small.
        found = [re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) for text in texts]
        sizes = np.array([len(words) for words in found], np.int64)
        number: dict[bytes, int] = {}
        index = np.array([number.setdefault(w, len(number)) for words in found for w in words], np.int64)
        own = np.array([zlib.crc32(w) for w in number], np.uint32)
        spaced = np.array([zlib.crc32(b" " + w) for w in number], np.uint32)
        tail = self.table_of(np.array([len(w) + 1 for w in number], np.int64))
        tables = np.array(self.tables, np.uint32).reshape(-1, 4, 256)
        text_of = np.repeat(np.arange(len(sizes)), sizes)
        run, owners, out = own[index], text_of, []
        owner_list = []
        for length in range(1, LONGEST_RUN + 1):
            if length > 1:
                # Longer by the next word, where it belongs to the same text.
                same = owners[: len(run) - 1] == text_of[length - 1 :]
                last = index[length - 1 :]
                head = run[: len(last)]
                shifted = np.zeros(len(last), np.uint32)
                for byte in range(4):
                    shifted ^= tables[tail[last], byte, (head >> np.uint32(8 * byte)) & np.uint32(255)]
                run, owners = shifted ^ spaced[last], np.where(same, owners[: len(last)], -1)
            real = owners >= 0
            out.append((run[real] % np.uint32(self.buckets)).astype(np.int64))
            owner_list.append(owners[real])
        return np.concatenate(out), np.concatenate(owner_list), sizes


def _texts(column, limit: int = 1_000_000):
    """Runs of an Arrow text column of about ``limit`` bytes, as lists of UTF-8 bytes; NULL is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from partlens.llm.shingles import slices

    for part in slices(column, limit):
        yield pc.fill_null(part, "").cast(pa.binary()).to_pylist()


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how often each bucket occurs among the features of all texts."""
    import pyarrow as pa

    def run(batches):
        hasher, total = Hasher(buckets), np.zeros(buckets, np.int64)
        for batch in small_batches(batches):
            for texts in _texts(batch.column(0)):
                total += np.bincount(hasher(texts)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    parts = docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(run, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket floor(1000 ln of the target's smoothed share over the documents'); ``buckets`` numbers in all."""

    def counted(df, column):
        out = np.zeros(buckets)
        for row in bucket_counts(df, column, buckets).collect():
            out[row["bucket"]] = row["n"]
        return out

    s, t = counted(docs, text), counted(target, target_text)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(gain)
    id_type = docs.select(F.col(f"`{doc_id}`").alias("doc_id")).schema[0]
    schema = T.StructType([id_type, *[T.StructField(n, T.LongType(), False) for n in ("n_words", "n_features", "weight")]])

    def run(batches):
        gain = shared.value
        hasher = Hasher(len(gain))
        for batch in small_batches(batches):
            columns = [[], [], []]
            for texts in _texts(batch.column(1)):
                buckets, owner, sizes = hasher(texts)
                # Whole numbers far below 2**53 add up exactly as doubles.
                columns[0].append(sizes)
                columns[1].append(np.bincount(owner, minlength=len(texts)))
                columns[2].append(np.bincount(owner, gain[buckets], minlength=len(texts)))
            merged = [pa.array(np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64)) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), *merged], names=schema.names)

    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("t")).mapInArrow(run, schema)


def keyed_score(weight: Column, doc_id: Column, seed: int) -> Column:
    """The weight plus a Gumbel draw (in thousandths) that depends on the seed and the id alone."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    share = (F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return weight + F.floor(-1000 * F.ln(-F.ln(share))).cast("long")


# Radix sort -------------------------------------------------------------------


def _varying(rows: DataFrame, names: list[str]) -> dict[str, int]:
    """For each key column the bits that are not the same in all rows."""
    found = rows.agg(*[f(name).alias(f"{f.__name__}_{name}") for name in names for f in (F.bit_or, F.bit_and)]).first()
    mask = (1 << 64) - 1
    return {name: ((found[f"bit_or_{name}"] or 0) ^ (found[f"bit_and_{name}"] or 0)) & mask for name in names}


def counting_pass(rows: DataFrame, digit: Column, block_rows: int, digits: int) -> DataFrame:
    """One stable counting sort: ``place`` becomes the row's place in the order by ``digit``, then by old place.

    The driver sums the totals of the ``digits`` possible digits; the prefix sums over blocks stay in Spark, one
    window per digit. A row's place inside its block and digit is a window over at most ``block_rows`` rows.
    """
    placed = rows.withColumn("digit", digit.cast("int")).withColumn("block", F.floor(F.col("place") / block_rows))
    counts = placed.groupBy("digit", "block").agg(F.count("*").alias("n"))
    per_digit = {row["digit"]: row["n"] for row in placed.groupBy("digit").count().withColumnRenamed("count", "n").collect()}
    totals = [per_digit.get(d, 0) for d in range(digits)]
    begins = constant(np.concatenate([[0], np.cumsum(totals)[:-1]]).astype(int).tolist(), "array<bigint>")
    before = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "digit", "block",
        (F.element_at(begins, F.col("digit") + 1) + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("offset"),
    )
    inside = Window.partitionBy("block", "digit").orderBy("place")
    moved = placed.withColumn("within", F.row_number().over(inside)).join(offsets, ["block", "digit"])
    return moved.withColumn("place", F.col("offset") + F.col("within") - 1).select(*rows.columns)


def radix_ranked(rows: DataFrame, keys: list[str], digit_bits: int = DIGIT_BITS, block_rows: int | None = None) -> DataFrame:
    """Add ``rank`` (1, 2, 3...) by the long columns ``keys``, most significant first, each as an unsigned number.

    Rows with equal keys get consecutive ranks in some order. Digits that are the same in all rows need no pass.
    """
    spark = rows.sparkSession
    # The first places: any numbering will do, and equal keys may come in any order. Rows are numbered per part of a
    # hash, with the parts one behind the other.
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = 4 * shuffles
    part = F.pmod(F.xxhash64(*keys, F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    dealt = stored(rows.withColumn("_part", part), "dealt")
    sizes = {row["_part"]: row["n"] for row in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    begins = np.concatenate([[0], np.cumsum([sizes.get(p, 0) for p in range(parts)])[:-1]]).astype(int).tolist()
    first = F.element_at(constant(begins, "array<bigint>"), F.col("_part") + 1)
    numbered = F.row_number().over(Window.partitionBy("_part").orderBy(*reversed(keys)))
    current = stored(dealt.withColumn("place", first + numbered - 1).drop("_part"), "places")
    block_rows = block_rows or max(1, min(BLOCK_ROWS, -(-total // parts)))
    varying, mask = _varying(dealt, keys), (1 << digit_bits) - 1
    for key in reversed(keys):
        for shift in range(0, 64, digit_bits):
            if varying[key] >> shift & mask:
                digit = F.shiftrightunsigned(F.col(key), shift).bitwiseAND(F.lit(mask))
                current = stored(counting_pass(current, digit, block_rows, mask + 1), "sorted")
    return current.withColumn("rank", F.col("place") + 1).drop("place")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42,
    doc_id: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; NULL ranks were not drawn.

    Of the N rows with ``least_words`` words or more, floor(percent * N / 100) are drawn, highest score first, ties to
    the smaller id. A NULL text has no words; without features the weight is 0. A NULL id counts as the empty text in
    the random key and comes after all ids among ties. Repeated rows are drawn each, in any order among themselves.
    An empty target or empty documents are smoothed like any counts; an empty table gives no rows. Texts may be of any
    length; other columns are not read, whatever their names. Ids must be whole numbers of at most 64 bits.
    """
    gain = gains(docs, target, text, target_text, buckets)
    base = weighed(docs, gain, doc_id, text)
    scored = stored(base.withColumn("score", keyed_score(F.col("weight"), F.col("doc_id"), seed)), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    size, top = able.agg(F.count("*"), F.max("score")).first()
    names = ["doc_id", "n_features", "weight", "score"]
    # Ascending keys: how far a score is below the best one, a missing id behind the others, the id with its sign
    # bit turned (so that unsigned order is its order).
    flipped = F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)).cast("long"))
    keyed = able.select(
        *names, (F.lit(top or 0).cast("long") - F.col("score")).alias("below"),
        F.col("doc_id").isNull().cast("long").alias("missing"), F.coalesce(flipped, F.lit(0).cast("long")).alias("turned"),
    )
    ranked = radix_ranked(keyed, ["below", "missing", "turned"])
    drawn = percent * (size or 0) // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).cast("long")
    rest = scored.where(F.col("n_words") < least_words)
    return ranked.select(*names, rank.alias("rank")).unionByName(
        rest.select(*names, F.lit(None).cast("long").alias("rank"))
    )
