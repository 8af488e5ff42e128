"""Result files, snapshots and histories."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partlens.functions.dates import moment
from partlens.plans.activity import KEPT_ENTRIES, recent_entries
from partlens.session import scratch_path
from partlens.sources.versions import KEEP, VersionedTable

#: Versions of the recent log entries kept for a batch that is done again.
LOG_VERSIONS = 3


def write_text(df: DataFrame, path: str, sep: str = ",") -> None:
    """Delimited files with header; the commit protocol makes the overwrite all or nothing."""
    df.write.mode("overwrite").csv(path, header=True, sep=sep, quote='"', escape='"')


def write_run_export(df: DataFrame, path: str, run_at: datetime, copy_to: str | None = None) -> None:
    """Result rows of one run under its timestamp, and a copy elsewhere if asked."""
    run = f"run_at={run_at:%Y-%m-%d__%H_%M_%S}"
    for root in filter(None, (path, copy_to)):
        write_text(df, f"{root}/{run}")


def write_snapshot(df: DataFrame, path: str, taken_at: datetime) -> None:
    """Registry snapshot of a day; writing the same day again replaces that day only."""
    stamped = df.withColumn("download_timestamp", moment(taken_at)).withColumn(
        "download_date", F.lit(taken_at.date())
    )
    _replace_partitions(stamped, path, "download_date")


def append_summary(row: DataFrame, path: str) -> None:
    """One dated summary row added to the history, once per day."""
    _replace_partitions(row, path, "summary_date")


def write_report(rows: DataFrame, path: str) -> None:
    """Reconciliation report rows by day, under the name ``report_date``."""
    _replace_partitions(rows.withColumn("report_date", F.col("date")), path, "report_date")


def append_log(entries: DataFrame, path: str, batch: int, keep: int = KEPT_ENTRIES) -> None:
    """Log entries added as batch ``batch``; doing a batch again replaces it in place of adding it twice.

    ``<path>/entries`` has one folder per batch. ``<path>/recent`` has the newest ``keep`` entries as a version per
    batch, made from the version before the batch and its own entries. Only where that version is gone, as for an old
    batch done again, are the entries up to the batch read.
    """
    spark = entries.sparkSession
    entries.write.mode("overwrite").parquet(f"{path}/entries/batch={batch}")
    stored = spark.read.schema(entries.schema).parquet(f"{path}/entries/batch={batch}")
    recent = VersionedTable(spark, f"{path}/recent")
    before = [version for version in recent.versions() if int(version.key) < batch]
    if before:
        rows = recent.read(before[-1]).unionByName(stored)
    else:
        rows = read_log(spark, path, entries.schema, batch)
    # Versions are ordered by the batch's number, whenever it was written.
    recent.write(recent_entries(rows, keep), str(batch), datetime(1970, 1, 1) + timedelta(seconds=batch), LOG_VERSIONS)


def read_log(spark: SparkSession, path: str, schema: T.StructType, last_batch: int | None = None) -> DataFrame:
    """All entries, or those of the batches up to ``last_batch``."""
    batched = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])
    rows = spark.read.schema(batched).parquet(f"{path}/entries")
    return (rows if last_batch is None else rows.where(F.col("batch") <= last_batch)).drop("batch")


def read_recent_log(spark: SparkSession, path: str) -> DataFrame:
    """The newest entries, as the last batch left them; the log itself is not read."""
    return VersionedTable(spark, f"{path}/recent").read()


def built_once(df: DataFrame, label: str) -> DataFrame:
    """Rows that are written several times: built and written to the scratch folder now, read from there each time."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_snapshot(df: DataFrame, path: str, taken_at: datetime, keep: int = KEEP) -> None:
    """Registry snapshot of a day as a version; writing the day again replaces it, the newest ``keep`` days stay."""
    stamped = df.withColumn("download_timestamp", moment(taken_at)).withColumn("download_date", F.lit(taken_at.date()))
    VersionedTable(df.sparkSession, path).write(stamped, taken_at.date().isoformat(), taken_at, keep)


def read_snapshot(spark: SparkSession, path: str, as_of: datetime) -> DataFrame:
    """The newest snapshot, with ``stale`` set when it is a day old or older; opens the files of one day only."""
    return VersionedTable(spark, path).read_newest(as_of)


def write_parts(parts: DataFrame, path: str, version: datetime) -> None:
    """A merged parts table as a new version, beside the one that was read."""
    VersionedTable(parts.sparkSession, path).write(parts, version.isoformat(), version)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the parts table."""
    return VersionedTable(spark, path).read()


def _replace_partitions(df: DataFrame, path: str, column: str) -> None:
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(column)
        .parquet(path)
    )
