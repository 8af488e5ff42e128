"""The next record of a key in time order, without sorting a key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_next(
    df: DataFrame, keys: Sequence[str], time: str, tie: Sequence[Column], keep: Sequence[str],
    slot: str = "minute", into: str = "next",
) -> DataFrame:
    """Adds struct ``into`` holding ``keep`` of the next record of the same key.

    The window runs inside a (key, time slot), so a key holding a third of all
    rows spreads over its slots. The last record of a slot takes the head of
    the key's next non-empty slot; heads are one row per slot. Count equal
    records together first when one moment may repeat without bound.
    """
    record = F.struct(*[F.col(name) for name in keep])
    order = [F.col(time), *tie]
    slotted = df.withColumn("_slot", F.date_trunc(slot, F.col(time)))
    inside = Window.partitionBy(*keys, "_slot").orderBy(*order)
    here = slotted.withColumn("_here", F.lead(record).over(inside))
    ranked = F.struct(*[term.alias(f"o{i}") for i, term in enumerate(order)], record.alias("rec"))
    heads = slotted.groupBy(*keys, "_slot").agg(F.min(ranked)["rec"].alias("_head"))
    across = Window.partitionBy(*keys).orderBy("_slot")
    following = heads.select(*keys, "_slot", F.lead("_head").over(across).alias("_ahead"))
    return (
        here.join(following, [*keys, "_slot"], "left")
        .withColumn(into, F.coalesce("_here", "_ahead"))
        .drop("_slot", "_here", "_ahead")
    )
