"""Benchmark passages inside documents, by SQL expressions only: size-partitioned MinHash search, then exact check.

Test items fall into partitions by the number of their shingles: partition S holds those with up to S and more than
the next smaller one. For each partition every document is read as windows of 2 * S shingles that begin every S
shingles, so any run of S shingles lies whole in one window however long the document is, and the window is never
much larger than the items looked for. A window's MinHash sketch is its ``SKETCH`` smallest shingle hashes. A window
that contains an item to the wanted degree shares a known part of its shingles with it, which fixes how unlikely an
empty meeting of sketch and item is. Documents that meet an item are checked on their full shingle sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlens.llm.common import GAPS, lower_ascii, stored

#: The first partitions, then powers of two. The first is so small that its windows are taken whole.
FIRST_PARTITIONS = (8, 32, 64)
#: Hashes in a window's sketch. At containment 0.8 an item of partition 32 shares at least 7 of a window's 64
#: shingles, one of partition 64 at least 26 of 128: the sketch holds none of them with a chance below 0.001.
SKETCH = {32: 40, 64: 28}
LARGE_SKETCH = 32
#: The item side is broadcast up to this many shingles (20 bytes each), joined by a shuffle beyond.
BROADCAST_SHINGLES = 200_000


def with_shingles(df: DataFrame, text: str, size: int, name: str) -> DataFrame:
    """Add ``name``: hashes of each distinct run of ``size`` words (two at least), in order of first occurrence.

    Fewer words give none. Arrays that are read more than once are columns of a step of their own, or each reading
    would compute them anew.
    """
    body = F.btrim(lower_ascii(F.coalesce(F.col(text), F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    out = df.withColumn("_run1", F.transform(F.split(body, GAPS), lambda w: F.xxhash64(w)))
    words = F.greatest(F.size("_run1"), F.lit(1))

    def longer(first: int, second: int) -> DataFrame:
        """Runs of ``first`` words joined with the runs of ``second`` words behind them."""
        ahead = F.slice(f"_run{second}", F.lit(first + 1), words)
        return out.withColumn(f"_run{first + second}", F.zip_with(f"_run{first}", ahead, lambda a, b: F.xxhash64(a, b)))

    made = 1
    while made * 2 <= size:
        out = longer(made, made)
        made *= 2
    for part in (1 << k for k in range(size.bit_length() - 2, -1, -1)):
        if (size - made) & part:
            out = longer(made, part)
            made += part
    runs = F.slice(f"_run{size}", F.lit(1), F.greatest(F.size("_run1") - (size - 1), F.lit(0)))
    return out.withColumn(name, F.array_distinct(runs)).drop(*[c for c in out.columns if c.startswith("_run")])


def item_shingles(items: DataFrame, size: int, item_id: str, text: str) -> DataFrame:
    """Per item: item_id, its distinct shingles, their number and its partition. Items under ``size`` words have no row."""
    named = items.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text"))
    sets = with_shingles(named, "text", size, "item").drop("text").where("item_id IS NOT NULL AND size(item) > 0").withColumn("n_item", F.size("item").cast("bigint"))
    large = F.pow(F.lit(2), F.ceil(F.log2(F.col("n_item").cast("double")))).cast("int")
    for part in reversed(FIRST_PARTITIONS):
        large = F.when(F.col("n_item") <= part, part).otherwise(large)
    return sets.withColumn("part", large.cast("int"))


def window_sketches(hashes: Column, part: int) -> Column:
    """The hashes in the sketches of all windows of one partition."""
    if part == FIRST_PARTITIONS[0]:
        return hashes
    sketch = SKETCH.get(part, LARGE_SKETCH)
    starts = F.sequence(F.lit(1), F.greatest(F.size(hashes) - part, F.lit(1)), F.lit(part))
    return F.flatten(F.transform(starts, lambda s: F.slice(F.sort_array(F.slice(hashes, s, F.lit(2 * part))), 1, sketch)))


def contaminated(
    docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id",
    text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document and item whose shingles it holds: doc_id, item_id, n_shared, n_item, containment.

    ``percent`` of an item's distinct shingles of ``size`` words must occur in the document, anywhere. Texts are
    lower-cased A-Z. Items with fewer words or a NULL id are not searched; NULL and short documents hold nothing.
    Rows that repeat a doc_id count as one document, which holds what its fullest row holds; likewise items. A NULL
    doc_id is an id like others. Extra columns are ignored, empty tables give no rows.
    """
    wanted = stored(item_shingles(items, size, item_id, item_text), "items")
    parts = sorted(row["part"] for row in wanted.select("part").distinct().collect())  # powers of two: a few dozen
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    keyed = wanted.select("item_id", F.explode("item").alias("hash"))
    total = keyed.count()
    if not parts:
        return wanted.where("false").join(named.limit(0), F.lit(False)).select(
            "doc_id", "item_id", F.col("n_item").alias("n_shared"), "n_item", F.lit(0.0).alias("containment")
        )
    # Each shingle once, where the document first has it.
    hashed = with_shingles(named, "text", size, "hashes")
    probes = hashed.select("doc_id", F.explode(F.concat(*[window_sketches(F.col("hashes"), p) for p in parts])).alias("hash"))
    found = probes.join(F.broadcast(keyed) if total <= BROADCAST_SHINGLES else keyed, "hash")
    candidates = stored(found.select("doc_id", "item_id").distinct(), "meetings")
    ids = candidates.select(F.col("doc_id").alias("found_id")).distinct()
    holders = named.join(ids, F.col("doc_id").eqNullSafe(F.col("found_id")), "left_semi")
    full = with_shingles(holders, "text", size, "set").select("doc_id", "set")
    checked = (
        candidates.withColumnRenamed("doc_id", "found_id")
        .join(full, F.col("doc_id").eqNullSafe(F.col("found_id")))
        .join(wanted.select("item_id", "item", "n_item"), "item_id")
        .select("doc_id", "item_id", F.size(F.array_intersect("set", "item")).cast("bigint").alias("n_shared"), "n_item")
        .where(100 * F.col("n_shared") >= percent * F.col("n_item"))
    )
    best = checked.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_shared", "n_item")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_shared", "m.n_item", F.col("m.col1").alias("containment"))
