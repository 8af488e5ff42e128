"""Delimited records with line ends inside quotes, read by many tasks however large one file is.

Spark cuts a file into blocks and reads lines; whether a line begins a record depends on the quotes before it in the
whole file. A block alone says what it does for either start: whether it turns the quote state, and where its last
record would begin if it started outside or inside quotes. Prefix sums over the blocks of a file (one row each) then
give every block its true start, and lines that belong to one record meet by the place of its head, across block ends.
Only records of several lines are gathered; one that fits its line stays where it was read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with file, first byte of their block, and a number that grows inside the block."""
    # Only the line feed ends a line here, so that carriage returns inside quotes are kept.
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return rows.select(
        "file", "block", F.monotonically_increasing_id().alias("line"), (quotes % 2).cast("int").alias("turn"), "value"
    )


def _blocks(lines: DataFrame) -> DataFrame:
    """One row per block: quote state at its start, head of the record open there, and first line of the file."""
    here = F.struct("block", "line")
    per_block = lines.groupBy("file", "block").agg(
        (F.sum("turn") % 2).alias("turn"), F.min("line").alias("first"),
        F.max(F.when(F.col("before") == 0, here)).alias("last_outside"),
        F.max(F.when(F.col("before") == 1, here)).alias("last_inside"),
    )
    whole = Window.partitionBy("file")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    started = per_block.withColumn("inside", F.coalesce(F.sum("turn").over(earlier), F.lit(0)) % 2)
    # Inside quotes at its start, a block's records begin where the quotes before them turn the state back.
    last = F.when(F.col("inside") == 0, F.col("last_outside")).otherwise(F.col("last_inside"))
    return started.withColumn("last", last).select(
        "file", "block", "inside", F.last("last", ignorenulls=True).over(earlier).alias("open"),
        F.min(F.struct("block", F.col("first").alias("line"))).over(whole).alias("top"),
    )


def quoted_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """One row per record: ``file`` (its path) and ``record``, the text with the line ends inside quotes.

    A quote inside a field has to be doubled in a quoted field, as CSV writers do; a stray one would hold back the
    rest of its file as one record. ``header`` drops each file's first record. Blank lines between records are no
    records.
    """
    place = Window.partitionBy("file", "block").orderBy("line")
    above = place.rowsBetween(Window.unboundedPreceding, -1)
    so_far = place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.struct("block", "line")
    lines = _lines(spark, path).withColumn("before", (F.coalesce(F.sum("turn").over(above), F.lit(0)) % 2).cast("int"))
    headed = lines.withColumn("outside", F.max(F.when(F.col("before") == 0, here)).over(so_far)).withColumn(
        "turned", F.max(F.when(F.col("before") == 1, here)).over(so_far)
    )
    # The blocks are one row each, and the lines are dealt by the same two columns already.
    told = headed.join(_blocks(lines), ["file", "block"])
    own = F.when(F.col("inside") == 0, F.col("outside")).otherwise(F.col("turned"))
    told = told.select(
        "file", "value", here.alias("here"), F.coalesce(own, F.col("open")).alias("head"), "top",
        ((F.col("before") == F.col("inside")) & (F.col("turn") == 0)).alias("alone"),
    )
    if header:
        told = told.where(F.col("head") != F.col("top"))
    pieces = told.where("NOT alone").groupBy("file", "head").agg(
        F.array_sort(F.collect_list(F.struct("here", "value"))).alias("lines")
    )
    joined = pieces.select("file", F.array_join(F.col("lines.value"), "\n").alias("value"))
    records = told.where("alone").select("file", "value").unionByName(joined)
    return records.select("file", F.regexp_replace("value", "\r$", "").alias("record")).where("record != ''")


def parsed_records(records: DataFrame, schema: T.StructType, sep: str = ",") -> DataFrame:
    """The fields of each record under the names of ``schema``; missing ones are NULL, surplus ones are left out."""
    fields = F.from_csv("record", schema.simpleString()[len("struct<"):-1].replace(":", " "), {
        "sep": sep, "escape": '"', "mode": "PERMISSIVE",
    })
    return records.select("file", fields.alias("fields")).select("file", "fields.*")
