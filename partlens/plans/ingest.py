"""Watch-list ingest: which files are new, their ids, and removal with their rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlens.operators.merge import delete_cascade
from partlens.schemas import PARTS


def new_files(listing: DataFrame, registered: DataFrame, exempt: str | None = None) -> DataFrame:
    """Listed files not ingested before; the exempt name always counts as new."""
    known = registered.select("file_name")
    if exempt is not None:
        known = known.where(F.col("file_name") != exempt)
    return listing.join(known, "file_name", "left_anti")


def file_id(ingest_ts: datetime) -> Column:
    """Id of a file in one ingest run; there is no sequence to draw from."""
    return F.xxhash64(F.col("file_name"), F.lit(ingest_ts.isoformat()))


def register_files(listing: DataFrame, ingest_ts: datetime) -> DataFrame:
    """Rows for the file table."""
    return listing.select("file_name").distinct().select(
        file_id(ingest_ts).alias("id"), "file_name", F.lit(ingest_ts.date()).alias("upload_date"),
        F.lit(None).cast("date").alias("last_check_date"), F.lit(None).cast("date").alias("stop_monitor_date"),
    )


def next_id(parts: DataFrame) -> int:
    """First free id of the parts table."""
    return parts.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]


def register_parts(rows: DataFrame, ingest_ts: datetime, first_id: int = 0) -> DataFrame:
    """Watch-list rows (with ``file_name``) as rows of the parts table.

    Ids count up from ``first_id`` by partition and place, and the file id
    follows from the name, so nothing is shuffled or joined.
    """
    with_ids = rows.withColumn("file_id", file_id(ingest_ts)).withColumn(
        "id", F.lit(first_id) + F.monotonically_increasing_id()
    )
    return with_ids.select(*[
        (F.col(f.name) if f.name in with_ids.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in PARTS.fields
    ])


def delete_file(files: DataFrame, parts: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the file and its rows."""
    return delete_cascade(files, parts, F.col("file_name") == name, "id", "file_id")
