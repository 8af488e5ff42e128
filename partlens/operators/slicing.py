"""Rows ``start..end`` (inclusive, from 0) of a declared order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from partlens.operators.pages import store_pages
from partlens.session import scratch_path


def positional_slice(df: DataFrame, start: int, end: int, order: Sequence[str]) -> DataFrame:
    """The slice in order, or everything when ``start < 0`` or ``start > end``.

    ``order`` must be a total order. The order is stored for this one slice; where several pages of one order are
    wanted, keep the ``store_pages`` result and ask it for each.
    """
    if start < 0 or start > end:
        return df
    return store_pages(df, order, scratch_path(df.sparkSession, "slice")).page(start, end)
