"""New watch lists picked up as they arrive."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from partlens.plans.ingest import next_id, register_files, register_parts
from partlens.session import scratch_path
from partlens.sources.readers import exact_path, read_watchlists, watchlist_catalog

# A file enters a stream once, so its id follows from the name alone.
STREAM_STAMP = datetime(1970, 1, 1)


def _stored_catalog(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The catalogue of some files, written once, as several steps of a batch read it."""
    found, path = watchlist_catalog(spark, paths), scratch_path(spark, "catalog")
    found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def watchlist_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Every file that appears in ``folder``, by path and time of change; contents are not read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).load(folder).select(
        "path", F.col("modificationTime").alias("modified")
    )


def start_ingest(
    spark: SparkSession, folder: str, files_path: str, parts_path: str, checkpoint: str, rejected_path: str | None = None
) -> StreamingQuery:
    """Loads each file once, with whatever header it has; the stream's checkpoint remembers which files are done.

    Every batch writes to a folder of its own number, so a repeated batch replaces its rows in place of adding them
    again. Files that are no watch lists are listed under ``rejected_path`` with their problem.
    """

    def load(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        arrived = batch.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "path", "modified")
        paths = [exact_path(row["path"]) for row in arrived.select("path").collect()]
        if not paths:
            return
        catalog = _stored_catalog(session, paths)
        rows = read_watchlists(session, paths, catalog=catalog)
        uploads = arrived.select("file_name", F.to_date("modified").alias("uploaded"))
        accepted = catalog.where("problem IS NULL").select("file_name")
        files = register_files(accepted, STREAM_STAMP).drop("upload_date").join(uploads, "file_name")
        files.select(
            "id", "file_name", F.col("uploaded").alias("upload_date"), "last_check_date", "stop_monitor_date"
        ).write.mode("overwrite").parquet(f"{files_path}/batch={number}")
        first = 0
        if number:
            earlier = session.read.schema("id long, batch int").parquet(parts_path)
            first = next_id(earlier.where(F.col("batch") < number))
        register_parts(rows, STREAM_STAMP, first).write.mode("overwrite").parquet(f"{parts_path}/batch={number}")
        if rejected_path:
            bad = catalog.where("problem IS NOT NULL").select("file_name", "header", "problem")
            bad.write.mode("overwrite").parquet(f"{rejected_path}/batch={number}")

    return (
        watchlist_stream(spark, folder)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
