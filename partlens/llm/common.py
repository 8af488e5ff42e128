"""Helpers shared by the operators: words, task-side functions, stored intermediate tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partlens.session import scratch_path

#: White space between words: the space and the characters 09 to 0D.
GAPS = r"[\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words of a text in order; NULL and blank texts give an empty array."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAPS)
    return F.filter(parts, lambda w: w != "")


def stored(df: DataFrame, label: str, records: int = 0) -> DataFrame:
    """Write to the folder that all executors share and read back: lineage ends here and survives lost executors.

    ``records`` limits the rows of a file, for tables of large rows that readers take in whole batches.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("maxRecordsPerFile", records).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A list of ids or row keys (8 bytes each) is broadcast up to this many, joined by a shuffle beyond.
BROADCAST_KEYS = 500_000


def with_keys(df: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """Semi or anti join of ``df`` to a stored list of distinct keys."""
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if few else keys, on, how)


def constant(values, kind: str) -> Column:
    """A list known to the driver as one literal of type ``kind``; short to plan however many items it has."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it where a column of ``df`` is called so, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_aside(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns of these names (whatever their case) under free ones, and the names to give back."""
    wanted, back = {name.lower() for name in names}, {}
    for name in [c for c in df.columns if c.lower() in wanted]:
        other = free_name(df, f"{name}_")
        df, back[other] = df.withColumnRenamed(name, other), name
    return df, back


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns that an operator is about to add, whatever their case."""
    taken = {name.lower() for name in names}
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*keep)


def small_batches(batches, limit: int = 2_000_000):
    """Cut Arrow batches into pieces of about ``limit`` bytes by their average row; bounds memory per step."""
    for batch in batches:
        rows = max(1, batch.num_rows * limit // max(1, batch.nbytes))
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Let a task take its rows in Arrow batches of at most ``size``, however long their texts are.

    The engine's own bound is 10,000 rows, which with whole texts is tens of megabytes on both sides of each worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def add_columns(
    df: DataFrame, fields: Sequence[T.StructField], inputs: Sequence[str], fn: Callable[[Callable, Sequence], list]
) -> DataFrame:
    """Add ``fields`` computed per Arrow batch, or part of one of a few megabytes, from ``inputs``.

    ``fn()`` is called once per task and gives the function from the input arrays to the new ones.
    All other columns pass through; columns with the new names are replaced.
    """
    import pyarrow as pa

    wanted = [f"_in{i}" for i in range(len(inputs))]
    base = without(df.select("*", *[F.col(f"`{c}`").alias(w) for c, w in zip(inputs, wanted)]), [f.name for f in fields])
    kept = [c for c in base.columns if c not in wanted]
    schema = T.StructType([base.schema[c] for c in kept] + list(fields))

    def run(batches):
        compute = fn()
        for batch in small_batches(batches):
            new = compute(*[batch.column(batch.schema.get_field_index(w)) for w in wanted])
            old = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*old, *new], names=[*kept, *[f.name for f in fields]])

    return base.mapInArrow(run, schema)
