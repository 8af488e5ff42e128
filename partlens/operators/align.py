"""Full outer join with provenance, for any number of sides, in one shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def align_sides(
    sides: Mapping[str, tuple[DataFrame, Mapping[str, Column]]], keys: Sequence[str]
) -> DataFrame:
    """Rows of all sides brought together by key, one output row per key.

    Each side gives named values; duplicates of a key inside a side keep the
    smallest value. The result has the keys, a flag ``in_<side>`` per side and
    the values. It equals de-duplicating every side and full-outer-joining them
    on null-safe keys, but it is a union and one group-by: the de-duplication
    happens before the shuffle, NULL keys meet each other as grouping does, and
    a key repeated in a third of all rows reaches the reducer once per task.
    """
    values = {name: column for _, cols in sides.values() for name, column in cols.items()}
    pieces = []
    for side, (df, own) in sides.items():
        pieces.append(
            df.select(
                *keys,
                *[F.lit(True if other == side else None).cast("boolean").alias(f"in_{other}") for other in sides],
                *[own[name].alias(name) for name in values if name in own],
            )
        )
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pieces)
    return rows.groupBy(*keys).agg(
        *[F.coalesce(F.max(f"in_{side}"), F.lit(False)).alias(f"in_{side}") for side in sides],
        *[F.min(name).alias(name) for name in values],
    )


def provenance(in_left: Column, in_right: Column) -> Column:
    return (
        F.when(in_left & in_right, "both")
        .when(in_left, "left_only")
        .when(in_right, "right_only")
    )
