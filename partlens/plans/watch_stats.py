"""Watch-list figures: cube, key figures, module, file and validation statistics."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partlens.functions import classify
from partlens.functions.dates import days_before, in_period, is_done
from partlens.functions.figures import distinct_with_null, percentage, sum_where, total
from partlens.functions.text import or_dash, unquoted
from partlens.operators.lookups import first_match
from partlens.operators.options import distinct_options

CUBE_KEYS = (
    "man", "module", "file_id", "status", "last_run_date", "table_name", "prty", "file_name", "is_expired",
)
CUBE_FIRSTS = ("last_check_date", "upload_date", "stop_monitor_date", "man_id", "module_id", "run_flag")

PENDING = "Pending data team"
# Fixed value: above this total a list is rejected.
REJECT_ABOVE = 10
RECENT_DAYS = 3


def classed(results: DataFrame) -> DataFrame:
    """Result rows with the status class; the text is kept as ``status_orig``."""
    return (
        results.withColumn("status_orig", F.col("status"))
        .withColumn("status", classify.watch_class(F.col("status")))
        .withColumn("prty", or_dash(F.col("prty")))
        .withColumn("table_name", or_dash(F.col("table_name")))
        .withColumn("done", is_done(F.col("last_run_date"), F.col("upload_date")))
    )


def simply_classed(results: DataFrame) -> DataFrame:
    """Result rows under the daily report's classes."""
    return (
        results.withColumn("status", classify.simple_class(F.col("status")))
        .withColumn("prty", or_dash(F.col("prty")))
        .withColumn("table_name", or_dash(F.col("table_name")))
    )


def ungrouped(rows: DataFrame) -> DataFrame:
    """Classed rows counting one each; every figure below takes them in place of the cube."""
    return rows.withColumn("count", F.lit(1).cast("bigint"))


def cube(rows: DataFrame) -> DataFrame:
    """Counts per nine keys, NULL groups kept."""
    return (
        rows.groupBy(*CUBE_KEYS)
        .agg(F.count("*").alias("count"), *[F.min(c).alias(c) for c in CUBE_FIRSTS])
        .withColumn("done", is_done(F.col("last_run_date"), F.col("upload_date")))
    )


def kpis(grouped: DataFrame) -> DataFrame:
    count = F.col("count")
    return grouped.agg(
        total(count).alias("total_parts"),
        sum_where(F.col("is_expired"), count).alias("expired_parts"),
        sum_where(~F.col("is_expired"), count).alias("active_parts"),
        sum_where(F.col("status").isin(*classify.MODULE_ERROR_STATUSES), count).alias("error_parts"),
        sum_where(F.col("table_name") == "not run", count).alias("missing_parts"),
        distinct_with_null(F.col("module")).alias("module_count"),
    )


def distributions(grouped: DataFrame) -> DataFrame:
    """Parts by status, module and table in one scan, NULL labels left out."""
    dims = ["status", "module", "table_name"]
    cells = grouped.groupBy(*dims).agg(F.sum("count").alias("n"))
    sets = cells.groupingSets([[d] for d in dims], *dims).agg(
        F.sum("n").alias("value"), F.grouping_id().alias("gid")
    )
    # Bit of a column in grouping_id is 0 in the set it belongs to.
    chart = F.when(F.col("gid") == 0b011, "status").when(F.col("gid") == 0b101, "module").otherwise("table_name")
    return sets.select(chart.alias("chart"), F.coalesce(*dims).alias("label"), "value").where(
        F.col("label").isNotNull()
    )


def timeline(grouped: DataFrame) -> DataFrame:
    dated = grouped.where(F.col("last_run_date").isNotNull())
    return dated.groupBy(F.col("last_run_date").alias("date")).agg(F.sum("count").alias("value")).orderBy("date")


def status_by_date(grouped: DataFrame, start: date, granularity: str = "day") -> DataFrame:
    kept = grouped.where(in_period(F.col("last_run_date"), start, granularity) & F.col("status").isNotNull())
    return kept.groupBy("status").agg(F.sum("count").alias("value"))


def status_counts(results: DataFrame) -> DataFrame:
    """Rows per raw status, NULL left out."""
    return results.where(F.col("status").isNotNull()).groupBy("status").agg(F.count("*").alias("value"))


def direct_feed_flag(rows: DataFrame, direct_feed: DataFrame) -> DataFrame:
    """Rows with ``direct_feed`` = 1 when the manufacturer is a flagged supplier, else 0."""
    flagged = direct_feed.where(F.col("direct_feed") == 1).select(F.col("supplier").alias("man")).distinct()
    joined = rows.join(flagged.withColumn("_fed", F.lit(1)), "man", "left")
    return joined.withColumn("direct_feed", F.coalesce("_fed", F.lit(0))).drop("_fed")


def _pair_figures(grouped: DataFrame, as_of: date | datetime) -> DataFrame:
    """One row per (module, man) pair with the figures of the whole module.

    Rows are counted per pair first; the module totals are then summed over the
    few pairs of a module, so the large table is read once.
    """
    count, status = F.col("count"), F.col("status")
    pairs = grouped.where(F.col("module").isNotNull()).groupBy("module", "man").agg(
        F.min("run_flag").alias("run_flag"),
        total(count).alias("total_count"),
        sum_where(status.isin(*classify.MODULE_ERROR_STATUSES), count).alias("error_count"),
        sum_where(status == "found", count).alias("found_count"),
        sum_where(F.col("is_expired"), count).alias("expired_count"),
        sum_where(F.col("last_run_date") >= days_before(as_of, RECENT_DAYS), count).alias("recent_count"),
    )
    module = Window.partitionBy("module")
    sums = ("total_count", "error_count", "found_count", "expired_count", "recent_count")
    return pairs.select(
        "module", "man", F.min("run_flag").over(module).alias("run_flag"),
        *[F.sum(name).over(module).alias(name) for name in sums],
    )


def module_stats(
    grouped: DataFrame, matrix: DataFrame, direct_feed: DataFrame, as_of: date | datetime
) -> DataFrame:
    """Figures of a module, once per (module, man) pair that occurs.

    The figures are per module; only the direct-feed status is per pair.
    """
    known = first_match(matrix, "modules", ["running_status", "module_comment", "old"], "row_no")
    dim = known.select(
        F.col("modules").alias("module"),
        F.lit(True).alias("in_matrix"),
        unquoted(F.col("running_status")).alias("matrix_status"),
        unquoted(F.col("module_comment")).alias("matrix_comment"),
        unquoted(F.col("old")).alias("matrix_old"),
    )
    feed = first_match(direct_feed, "supplier", ["direct_feed"], "row_no").select(
        F.col("supplier").alias("man"), F.col("direct_feed").alias("fed")
    )
    rows = _pair_figures(grouped, as_of).join(dim, "module", "left").join(feed, "man", "left")
    whole = F.col("total_count")
    shares = {
        f"{kind}_percentage": percentage(F.col(f"{kind}_count"), whole)
        for kind in ("error", "found", "expired", "recent")
    }
    return rows.select(
        "module", "man",
        classify.run_state(F.col("run_flag")).alias("running_status"),
        *[or_dash(F.col(c)).alias(c) for c in ("matrix_status", "matrix_comment", "matrix_old")],
        F.when(F.col("in_matrix"), F.coalesce("fed", F.lit(0))).otherwise(F.lit(0)).alias("direct_feed_status"),
        "total_count", "error_count", "found_count", "expired_count", "recent_count",
        *[column.alias(name) for name, column in shares.items()],
    )


def file_stats(grouped: DataFrame, grace_days: int = 1) -> DataFrame:
    """Figures per file. Parts are done from ``grace_days`` before the upload date.

    Errors among the done parts are always measured from the upload date itself.
    """
    count, status = F.col("count"), F.col("status")
    error = status.isin(*classify.FILE_ERROR_STATUSES)
    done = is_done(F.col("last_run_date"), F.col("upload_date"), grace_days)
    since_upload = is_done(F.col("last_run_date"), F.col("upload_date"), 0)
    sums = grouped.where(F.col("file_name").isNotNull()).groupBy(F.col("file_name").alias("file")).agg(
        total(count).alias("total_count"),
        sum_where(error, count).alias("error_count"),
        sum_where(status == "Not Found", count).alias("notfound_count"),
        sum_where(status == "found", count).alias("found_count"),
        sum_where(done, count).alias("done_count"),
        sum_where(error & since_upload, count).alias("error_done_count"),
    )
    whole = F.col("total_count")
    return sums.select(
        "file", "total_count", "error_count", "notfound_count", "found_count",
        percentage(F.col("error_count"), whole).alias("error_percentage"),
        percentage(F.col("found_count"), whole).alias("found_percentage"),
        percentage(F.col("done_count"), whole).alias("done_percentage"),
        percentage(F.col("error_done_count"), F.col("done_count")).alias("error_done_percentage"),
    )


def daily_file_stats(results: DataFrame) -> DataFrame:
    """File figures of the daily report: simple classes and no grace day."""
    return file_stats(ungrouped(simply_classed(results)), grace_days=0)


def banded(stats: DataFrame) -> DataFrame:
    """File figures with the colour band of each percentage; error shares are banded inverted."""

    def band(name: str, inverted: bool) -> Column:
        share = F.col(f"{name}_percentage")
        return classify.colour_band(F.lit(100.0) - share if inverted else share).alias(f"{name}_band")

    return stats.select(
        "*", band("error", True), band("found", False), band("done", False), band("error_done", True)
    )


def largest_first(stats: DataFrame, *tie: str) -> DataFrame:
    return stats.orderBy(F.desc("total_count"), *tie)


def validation(stats: DataFrame) -> DataFrame:
    """Accept or reject from module statistics.

    Parts of a module count once per (module, man) pair, but the total counts
    each module once; percentages are NULL on empty input.
    """
    stopped, pending = F.col("running_status") == "Stopped", F.col("matrix_status") == PENDING
    weight = F.col("total_count")
    # One row per module first: its figures are equal in every pair.
    per_module = stats.groupBy("module", "running_status", "matrix_status", "total_count").agg(
        F.count("*").alias("pairs"), F.count_if(F.col("direct_feed_status") == 1).alias("fed")
    )
    pairs = F.col("pairs")
    sums = per_module.agg(
        total(pairs).alias("module_pairs"),
        total(weight).alias("total_parts"),
        sum_where(stopped, pairs).alias("stopped_modules"),
        sum_where(stopped, weight * pairs).alias("stopped_parts"),
        sum_where(pending, pairs).alias("pending_modules"),
        sum_where(pending, weight * pairs).alias("pending_parts"),
        total(F.col("fed")).alias("direct_feed_modules"),
    )

    def share(name: str, whole: str) -> Column:
        return percentage(F.col(name), F.col(whole), empty=None).alias(f"{name}_percentage")

    shares = sums.select(
        "*",
        share("stopped_modules", "module_pairs"),
        share("stopped_parts", "total_parts"),
        share("pending_modules", "module_pairs"),
        share("pending_parts", "total_parts"),
        share("direct_feed_modules", "module_pairs"),
    )
    critical = F.round(
        F.col("stopped_parts_percentage") + F.col("pending_parts_percentage")
        + F.col("direct_feed_modules_percentage"), 2,
    )
    return shares.select(
        "*", critical.alias("total_critical_percentage"),
        F.when(critical > REJECT_ABOVE, "Rejected").when(critical.isNotNull(), "Accepted").alias("file_status"),
    )


def filter_options(grouped: DataFrame) -> DataFrame:
    """Distinct values per filter as ``(option, value)``, NULL left out, plus the fixed run states."""
    groups = [
        {"files": "file_name"}, {"teams": "module", "manufacturers": "man"},
        {"status": "status", "priorities": "prty", "table_name": "table_name"},
    ]
    return distinct_options(grouped, [{name: F.col(c) for name, c in group.items()} for group in groups])


def run_states(spark) -> DataFrame:
    """The run states a filter can ask for."""
    states = list(dict.fromkeys(classify.RUN_FLAGS.values()))
    return spark.createDataFrame([(state,) for state in states], "running_status string")
