"""MERGE and UPDATE expressed as joins and projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_update(
    target: DataFrame, source: DataFrame, on: Sequence[str], rules: Mapping[str, Column]
) -> DataFrame:
    """``MERGE INTO target USING source ON keys WHEN MATCHED THEN UPDATE SET rules``.

    Rules read the two sides as ``t.<column>`` and ``s.<column>``. ``source``
    must hold at most one row per key, as MERGE itself demands. Every target
    row comes out exactly once, in the target's column order.
    """
    marked = source.withColumn("_matched", F.lit(True)).alias("s")
    condition = [F.col(f"t.{key}") == F.col(f"s.{key}") for key in on]
    joined = target.alias("t").join(marked, condition, "left")
    columns = [
        F.when(F.col("s._matched"), rules[name]).otherwise(F.col(f"t.{name}")).alias(name)
        if name in rules
        else F.col(f"t.{name}")
        for name in target.columns
    ]
    return joined.select(*columns)


def update_where(target: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    """``UPDATE target SET values WHERE condition``; a NULL condition leaves the row alone."""
    return target.select(
        *[
            F.when(condition, values[name]).otherwise(F.col(name)).alias(name)
            if name in values
            else F.col(name)
            for name in target.columns
        ]
    )


def delete_cascade(
    parent: DataFrame, child: DataFrame, doomed: Column, parent_key: str, child_key: str
) -> tuple[DataFrame, DataFrame]:
    """Both tables without the doomed parents and the children that point at them."""
    gone = parent.where(doomed).select(F.col(parent_key).alias(child_key))
    kept_parent = parent.where(~F.coalesce(doomed, F.lit(False)))
    return kept_parent, child.join(gone, child_key, "left_anti")
