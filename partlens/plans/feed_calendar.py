"""Which days are missing, which snapshots stay, which report slots exist."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlens.functions.dates import moment, slot_label
from partlens.functions.text import day_of_name, slot_of_name

# Snapshots kept, and hours after which the newest one is stale.
KEEP_SNAPSHOTS = 7
FRESH_HOURS = 24


def days_between(spark: SparkSession, start: date, end: date) -> DataFrame:
    days = F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(days).alias("date"))


def missing_days(present: DataFrame, start: date, end: date) -> DataFrame:
    """Days of the range without a row in ``present(date)``."""
    kept = present.where(F.col("date").between(start, end)).select("date").distinct()
    return days_between(present.sparkSession, start, end).join(kept, "date", "left_anti")


def day_members(landed: DataFrame, start: date, end: date) -> DataFrame:
    """Landed feed rows of a date range; prunes partitions when ``date`` is one."""
    return landed.where(F.col("date").between(start, end))


def surviving_days(dates: DataFrame, keep: int = KEEP_SNAPSHOTS) -> DataFrame:
    """The newest ``keep`` snapshot dates."""
    known = dates.where(F.col("download_date").isNotNull())
    return known.select("download_date").distinct().orderBy(F.desc("download_date")).limit(keep)


def surviving_rows(snapshots: DataFrame, keep: int = KEEP_SNAPSHOTS) -> DataFrame:
    """Snapshot rows of the newest ``keep`` dates; the few dates become literals so the scan prunes."""
    days = [row[0] for row in surviving_days(snapshots, keep).collect()]
    return snapshots.where(F.col("download_date").isin(*days) if days else F.lit(False))


def surviving_names(names: DataFrame, prefix: str, keep: int = KEEP_SNAPSHOTS) -> DataFrame:
    """File names kept by retention: the newest dates in ``prefix<yyyy-MM-dd>.csv``.

    Names without a date, the ``latest`` copy among them, are never retired.
    """
    day = F.try_to_date(F.regexp_extract("file_name", rf"^{prefix}(\d{{4}}-\d{{2}}-\d{{2}})\.csv$", 1), "yyyy-MM-dd")
    dated = names.select("file_name", day.alias("download_date"))
    kept = dated.join(surviving_days(dated, keep), "download_date", "left_semi")
    return kept.select("file_name").unionByName(
        dated.where(F.col("download_date").isNull()).select("file_name")
    )


def newest_snapshot(snapshots: DataFrame, as_of: datetime) -> DataFrame:
    """Rows of the newest snapshot, with ``stale`` set when it is a day old or older."""
    newest = snapshots.agg(F.max("download_date")).first()[0]
    old = moment(as_of - timedelta(hours=FRESH_HOURS))
    return snapshots.where(F.col("download_date") == F.lit(newest)).withColumn(
        "stale", F.col("download_timestamp") <= old
    )


def report_slots(names: DataFrame, mark: str = "NotFound") -> DataFrame:
    """Distinct ``dd-MMM-yyyy_hh_AM`` slots in export file names, newest first."""
    kept = names.where(F.col("file_name").endswith(".txt") & F.col("file_name").contains(mark))
    slots = kept.select(slot_of_name(F.col("file_name")).alias("slot")).where(F.col("slot").isNotNull()).distinct()
    day = F.try_to_date(F.substring("slot", 1, 11), "dd-MMM-yyyy")
    hour = F.substring("slot", 13, 2).cast("int") % 12 + F.when(F.col("slot").endswith("PM"), 12).otherwise(0)
    return slots.select("slot", day.alias("report_date"), hour.alias("report_hour")).orderBy(
        F.desc("report_date"), F.desc("report_hour"), F.desc("slot")
    )


def report_days(names: DataFrame) -> DataFrame:
    """Distinct days in export file names, oldest first."""
    days = names.select(day_of_name(F.col("file_name")).alias("report_date"))
    return days.where(F.col("report_date").isNotNull()).distinct().orderBy("report_date")


def expected_names(days: DataFrame, hour: int, template: str = "Export_{table}Feed_") -> DataFrame:
    """Export file names expected for each day at an hour slot, one per table."""
    slot = F.concat(F.date_format("date", "dd-MMM-yyyy"), F.lit("_"), slot_label(F.lit(hour)), F.lit(".txt"))
    tables = F.array(F.lit("NotFound_"), F.lit(""))
    head, tail = template.split("{table}")
    return days.select("date", F.explode(tables).alias("_t")).select(
        "date", F.concat(F.lit(head), "_t", F.lit(tail), slot).alias("file_name")
    )
