"""Filter requests as folds of predicates. An empty list never filters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlens.functions import classify, text


def all_of(conditions: Sequence[Column | None]) -> Column:
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def _one_of(column: str | Column, values: Sequence | None) -> Column | None:
    if not values:
        return None
    column = F.col(column) if isinstance(column, str) else column
    return column.isin(*values)


def _truths(values: Sequence[str | bool]) -> list[bool]:
    return [str(value).lower() == "true" for value in values]


@dataclass(frozen=True)
class WatchFilter:
    """Filter request of the watch-list views."""

    module: Sequence[str] = ()
    file_name: Sequence[str] = ()
    man: Sequence[str] = ()
    status: Sequence[str] = ()
    prty: Sequence[str] = ()
    is_expired: Sequence[str] = ()
    table_name: Sequence[str] = ()
    start_date: date | None = None
    end_date: date | None = None
    done: Sequence[int] = ()
    running_status: Sequence[str] = ()
    direct_feed: Sequence[int] = ()

    def condition(self, status: Column) -> Column:
        """Everything but the direct-feed part, which needs the supplier list."""
        dated = None
        if self.start_date and self.end_date:
            dated = F.col("last_run_date").between(self.start_date, self.end_date)
        return all_of([
            _one_of("module", self.module),
            _one_of("file_name", self.file_name),
            _one_of("man", self.man),
            _one_of(status, self.status),
            _one_of("prty", self.prty),
            _one_of("is_expired", _truths(self.is_expired)),
            _one_of("table_name", self.table_name),
            dated,
            _one_of("done", [bool(int(x)) for x in self.done]),
            _one_of(classify.run_state(F.col("run_flag")), self.running_status),
        ])


def filter_grouped(df: DataFrame, request: WatchFilter, direct_feed: DataFrame | None = None) -> DataFrame:
    """Request over the grouped watch list, whose status is already a class."""
    kept = df.where(request.condition(F.col("status")))
    return filter_direct_feed(kept, request.direct_feed, direct_feed)


def filter_rows(df: DataFrame, request: WatchFilter, direct_feed: DataFrame | None = None) -> DataFrame:
    """Request over single parts; the raw status is classed the simple way first."""
    kept = df.where(request.condition(classify.simple_category(F.col("status"))))
    return filter_direct_feed(kept, request.direct_feed, direct_feed)


def filter_direct_feed(df: DataFrame, wanted: Sequence[int], direct_feed: DataFrame | None) -> DataFrame:
    """Keep rows whose manufacturer has (1) or has not (0) a direct feed."""
    flags = {int(x) for x in wanted} & {0, 1}
    if not wanted or flags == {0, 1}:
        return df
    if not flags:
        return df.where(F.lit(False))
    suppliers = direct_feed.where(F.col("direct_feed") == 1).select(F.col("supplier").alias("man"))
    return df.join(suppliers, "man", "left_semi" if flags == {1} else "left_anti")


@dataclass(frozen=True)
class RegistryFilter:
    """Filter request of the registry views."""

    man_names: Sequence[str] = ()
    module_names: Sequence[str] = ()
    priorities: Sequence[str] = ()
    statuses: Sequence[str] = ()
    run_flags: Sequence[int] = ()
    error_status: Sequence[str] = ()
    lc_outdated: Sequence[int] = ()
    expired: Sequence[str] = ()
    cs_labels: Sequence[str] = ()
    date_start: date | None = None
    date_end: date | None = None

    def condition(self, label_rule: str = "word") -> Column:
        """One predicate; ``label_rule`` is ``word``, ``text`` (substring) or ``member``."""
        rule = {"word": text.has_label_word, "text": text.has_label_text, "member": text.has_label}
        return all_of([
            _one_of("man_name", self.man_names),
            _one_of("module_name", self.module_names),
            _one_of("prty", self.priorities),
            _one_of("status", self.statuses),
            _one_of("run_flag", [int(x) for x in self.run_flags]),
            _one_of("error_status", self.error_status),
            _one_of("lc_outdated", [int(x) for x in self.lc_outdated]),
            _one_of("is_expired", _truths(self.expired)),
            rule[label_rule](F.col("cs"), self.cs_labels) if self.cs_labels else None,
            F.col("lr_date") >= F.lit(self.date_start) if self.date_start else None,
            F.col("lr_date") <= F.lit(self.date_end) if self.date_end else None,
        ])


def filter_registry(df: DataFrame, request: RegistryFilter, label_rule: str = "word") -> DataFrame:
    return df.where(request.condition(label_rule))
