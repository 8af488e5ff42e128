"""Registry dashboard: figures, charts, timeline, options and table over a snapshot.

Everything here reads the snapshot once and reduces it to the few distinct
combinations of its chart columns before anything is expanded.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlens.functions.dates import days_before
from partlens.functions.figures import percentage, sum_where, total
from partlens.functions.text import label_list
from partlens.operators.options import distinct_options

# Fixed value: how a missing name, priority or status is shown.
MISSING = "(none)"
TOP_MANUFACTURERS = 10
TIMELINE_DAYS = 365


def _shown(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


def _priority_due() -> Column:
    return F.coalesce(F.col("prty").startswith("P"), F.lit(False))


def kpis(snapshot: DataFrame) -> DataFrame:
    """One row of totals, distinct counts and percentages (one digit)."""
    count = F.col("count")
    # One row per (man, module) first: the distinct counts then run on few rows.
    cells = snapshot.groupBy("man_name", "module_name").agg(
        F.sum("count").alias("total"),
        sum_where(F.col("status") == "found", count).alias("found"),
        sum_where(F.col("status") == "not found", count).alias("not_found"),
        sum_where(F.col("status") == "not run", count).alias("not_run"),
        sum_where(_priority_due(), count).alias("due"),
        sum_where(F.col("is_expired"), count).alias("by_date"),
        sum_where(F.col("lc_outdated") == 1, count).alias("lc"),
    )
    sums = cells.agg(
        total(F.col("total")).alias("total_parts"),
        total(F.col("found")).alias("found_parts"),
        total(F.col("not_found")).alias("not_found_parts"),
        total(F.col("not_run")).alias("not_run_parts"),
        total(F.col("due")).alias("expired_parts"),
        total(F.col("by_date")).alias("expired_by_date"),
        total(F.col("lc")).alias("lc_outdated_parts"),
        F.count_distinct(_shown("module_name")).alias("unique_modules"),
        F.count_distinct(_shown("man_name")).alias("unique_manufacturers"),
    )
    shares = {
        "found_percentage": "found_parts",
        "not_found_percentage": "not_found_parts",
        "not_run_percentage": "not_run_parts",
        "expired_percentage": "expired_parts",
        "lc_outdated_percentage": "lc_outdated_parts",
    }
    return sums.select(
        "*", *[percentage(F.col(c), F.col("total_parts"), 1).alias(name) for name, c in shares.items()]
    )


def charts(snapshot: DataFrame) -> DataFrame:
    """All one-column distributions as ``(chart, label, value)``."""
    cells = snapshot.groupBy("status", "prty", "run_flag", "lc_outdated", "error_status").agg(
        F.sum("count").alias("n")
    )

    def bar(chart: str, label: Column, value: Column | str = "n") -> Column:
        value = F.col(value) if isinstance(value, str) else value
        return F.struct(F.lit(chart).alias("chart"), label.alias("label"), value.alias("value"))

    def share(condition: Column) -> Column:
        return F.when(condition, F.col("n")).otherwise(F.lit(0)).cast("bigint")

    error = F.nullif(F.col("error_status"), F.lit(""))
    bars = F.array(
        bar("status", _shown("status")),
        bar("priority", _shown("prty")),
        bar("run_flag", F.col("run_flag").cast("string")),
        bar("error_status", error),
        # Both labels always come out, with 0 when nothing falls under them.
        bar("lc_outdated", F.lit("Up to Date"), share(F.col("lc_outdated") == 0)),
        bar("lc_outdated", F.lit("Outdated"), share(F.col("lc_outdated") == 1)),
        bar("expired", F.lit("Active"), share(~_priority_due())),
        bar("expired", F.lit("Expired"), share(_priority_due())),
    )
    return (
        cells.select(F.inline(bars))
        .where(F.col("label").isNotNull())
        .groupBy("chart", "label")
        .agg(F.sum("value").alias("value"))
    )


def chart_sets(snapshot: DataFrame) -> DataFrame:
    """Distributions by one column each through GROUPING SETS, NULL labels kept apart from totals."""
    dims = ["status", "prty", "run_flag"]
    cells = snapshot.groupBy(*dims).agg(F.sum("count").alias("n"))
    which = F.grouping_id()
    grouped = cells.groupingSets([[d] for d in dims], *dims).agg(
        F.sum("n").alias("value"), which.alias("gid")
    )
    # grouping_id has one bit per column, first column highest; 0 marks the grouped one.
    full = (1 << len(dims)) - 1
    chart, label = F.lit(None), F.lit(None)
    for i, dim in enumerate(dims):
        own = F.col("gid") == full - (1 << (len(dims) - 1 - i))
        chart = F.when(own, dim).otherwise(chart)
        label = F.when(own, _shown(dim)).otherwise(label)
    return grouped.select(chart.alias("chart"), label.alias("label"), "value")


def top_manufacturers(snapshot: DataFrame, k: int = TOP_MANUFACTURERS) -> DataFrame:
    sums = snapshot.groupBy(_shown("man_name").alias("man_name")).agg(F.sum("count").alias("value"))
    return sums.orderBy(F.desc("value"), "man_name").limit(k)


def label_counts(snapshot: DataFrame, kept: Column | None = None) -> DataFrame:
    """Parts per label. ``kept`` narrows the counts, not the list of labels.

    Rows are summed per packed label text first, so each distinct text is
    split and exploded once.
    """
    count = F.col("count") if kept is None else F.when(kept, F.col("count")).otherwise(F.lit(0))
    packed = snapshot.groupBy("cs").agg(F.sum(count).alias("n"))
    return (
        packed.select(F.explode(label_list(F.col("cs"))).alias("label"), "n")
        .groupBy("label")
        .agg(F.sum("n").cast("bigint").alias("value"))
    )


def timeline(snapshot: DataFrame, as_of: date) -> DataFrame:
    """Parts per last date, over the year before ``as_of``.

    The documented start is the later of the first date and a year back; no
    row lies before the first date, so the year alone decides.
    """
    return (
        snapshot.where(F.col("lr_date") >= days_before(as_of, TIMELINE_DAYS))
        .groupBy(F.col("lr_date").alias("date"))
        .agg(F.sum("count").alias("value"))
    )


def timeline_range(snapshot: DataFrame, as_of: date) -> DataFrame:
    """First and last date and the default window."""
    return snapshot.agg(F.min("lr_date").alias("min_date"), F.max("lr_date").alias("max_date")).select(
        "min_date",
        "max_date",
        F.when(F.col("min_date").isNotNull(), F.greatest("min_date", days_before(as_of, TIMELINE_DAYS))).alias(
            "default_start"
        ),
        F.col("max_date").alias("default_end"),
    )


def filter_options(snapshot: DataFrame) -> DataFrame:
    """Every value each filter can take, as ``(option, value)``."""
    makers = {
        "man_names": _shown("man_name"),
        "module_names": _shown("module_name"),
        "run_flags": F.col("run_flag").cast("string"),
    }
    states = {
        "priorities": _shown("prty"),
        "statuses": _shown("status"),
        "lc_outdated": F.col("lc_outdated").cast("string"),
        "error_status": F.nullif(F.col("error_status"), F.lit("")),
    }
    return distinct_options(snapshot, [makers, states, {"cs_labels": F.col("cs")}], {"cs_labels": label_list})


def table(snapshot: DataFrame) -> DataFrame:
    """Figures per manufacturer and module."""
    count = F.col("count")
    return snapshot.groupBy(_shown("man_name").alias("man_name"), _shown("module_name").alias("module_name")).agg(
        F.sum("count").alias("count"),
        sum_where(_priority_due(), count).alias("outdated"),
        sum_where(F.col("is_expired"), count).alias("expired"),
        sum_where(F.col("status") == "found", count).alias("found"),
        sum_where(F.col("status") == "not found", count).alias("notfound"),
    )


def dashboard(snapshot: DataFrame, as_of: date | datetime) -> dict[str, DataFrame]:
    """Every piece of the dashboard; persist ``snapshot`` when several are wanted at once."""
    return {
        "kpis": kpis(snapshot),
        "charts": charts(snapshot),
        "top_manufacturers": top_manufacturers(snapshot),
        "labels": label_counts(snapshot),
        "timeline": timeline(snapshot, as_of),
        "timeline_range": timeline_range(snapshot, as_of),
        "options": filter_options(snapshot),
        "table": table(snapshot),
    }
