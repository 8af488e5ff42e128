"""One row, or the tied newest rows, per key.

A plain window sorts a whole key in one task, so a key holding a third of all
rows would stall the job. Single rows are picked with ``max``/``min`` over a
struct, which Spark combines on the map side: every task ships at most one row
per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def largest_null_first(column: str) -> list[Column]:
    """Order terms under which NULL beats every value, then larger beats smaller."""
    return [F.col(column).isNull(), F.col(column)]


def smallest_null_last(column: str) -> list[Column]:
    """Order terms for ``keep_first``: smaller first, NULL after every value."""
    return [F.col(column).isNull(), F.col(column)]


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str]
) -> DataFrame:
    """The row with the largest ``order`` per key; ties go to the largest ``keep`` values."""
    return _pick(df, keys, order, keep, F.max)


def keep_first(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str]
) -> DataFrame:
    """The row with the smallest ``order`` per key; ties go to the smallest ``keep`` values."""
    return _pick(df, keys, order, keep, F.min)


def _pick(df, keys, order, keep, extreme):
    ranked = F.struct(
        *[term.alias(f"o{i}") for i, term in enumerate(order)],
        *[F.col(name).alias(f"k{i}") for i, name in enumerate(keep)],
    )
    best = df.groupBy(*keys).agg(extreme(ranked).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.k{i}").alias(name) for i, name in enumerate(keep)])


def newest_values(
    df: DataFrame, keys: Sequence[str], moment: str, value: str | None, into: str
) -> DataFrame:
    """Per key the newest ``moment`` (NULL is newest) and the distinct ``value`` entries tied on it.

    Equal rows are removed first, spread by all their columns. Spark pushes the
    rank limit below the shuffle (WindowGroupLimit), so each task ships only
    its own newest rows of a key, however many rows the key has.
    """
    if value is None:
        return df.groupBy(*keys).agg(
            F.bool_or(F.col(moment).isNull()).alias("_missing"), F.max(moment).alias("_newest")
        ).select(*keys, F.when(~F.col("_missing"), F.col("_newest")).alias(moment))
    entries = df.select(*keys, moment, F.coalesce(F.col(value), F.lit("")).alias("_value")).distinct()
    newest_first = Window.partitionBy(*keys).orderBy(F.col(moment).desc_nulls_first())
    newest = entries.withColumn("_rank", F.rank().over(newest_first)).where(F.col("_rank") == 1)
    return newest.groupBy(*keys).agg(
        F.max(moment).alias(moment), F.sort_array(F.collect_list("_value")).alias(into)
    )
