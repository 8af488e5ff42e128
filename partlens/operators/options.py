"""Distinct values of many columns at once: what the filters of a page can be set to."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_options(
    df: DataFrame, groups: Sequence[Mapping[str, Column]], split: Mapping[str, Callable[[Column], Column]] | None = None
) -> DataFrame:
    """Every value each option takes, as ``(option, value)``; NULL is no value.

    ``groups`` holds columns that vary together (text columns by option name). Each group becomes one grouping set, so
    a row is copied once per group, not once per option, and tasks ship only the distinct combinations of a group.
    Those few are then spread over their options. ``split`` turns an option's distinct texts into their values, so a
    text that many rows share is split once.
    """
    split = split or {}
    columns = {name: column for group in groups for name, column in group.items()}
    cells = df.select(*[column.alias(name) for name, column in columns.items()]).groupingSets(
        [[F.col(name) for name in group] for group in groups], *columns
    ).agg(F.grouping_id().alias("_set"))

    def values(name: str) -> Column:
        many = split[name](F.col(name)) if name in split else F.array(F.col(name))
        return F.transform(many, lambda value: F.struct(F.lit(name).alias("option"), value.alias("value")))

    # A column that is not in a cell's set is NULL there, and NULL is left out.
    spread = F.flatten(F.array(*[F.coalesce(values(name), F.array().cast(KIND)) for name in columns]))
    return cells.select(F.inline(spread)).where(F.col("value").isNotNull()).distinct()


KIND = "array<struct<option:string,value:string>>"
