"""Delimited files and logs, always with an explicit schema."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partlens.functions.dates import parse_date, parse_timestamp
from partlens.functions.text import day_of_name
from partlens.schemas import (
    DIRECT_FEED, FEED_EXPORT, MATRIX, PART_DETAILS, PROCESS_LOG, WATCHLIST_LEADING, WATCHLIST_OPTIONAL,
)
from partlens.sources.quoted import parsed_records, quoted_records


def _name(encoded) -> Column:
    """A file name or path as it is written; Spark's metadata has it as part of a URI."""
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def exact_path(path: str) -> str:
    """The path as a pattern that only this file matches."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder; contents are not read."""
    listed = spark.read.format("binaryFile").load(folder)
    return listed.select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), "path", F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified"),
    )


def watchlist_catalog(spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """What each watch list's first line says: file, file_name, header, columns, problem.

    ``columns`` holds the three leading names and then the optional ones in the file's order. A list has exactly three
    leading columns of any name before its optional ones; ``problem`` tells why a file is rejected and is NULL for an
    accepted one. A file without any line has no row. First lines are found where the files are read, one row per task
    and file goes to the group-by.
    """
    lines = spark.read.option("encoding", encoding).text(path if isinstance(path, str) else list(path)).select(
        _name(F.col("_metadata.file_path")).alias("file"), _name(F.col("_metadata.file_name")).alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value",
    )
    # Only first blocks can hold a first line; the text of the smallest place is kept on the map side.
    first = lines.where("block = 0").groupBy("file", "file_name").agg(F.min_by("value", "line").alias("first"))
    text = F.regexp_replace("first", "^\ufeff|\r$", "")
    names = F.transform(F.split(text, "\t"), lambda n: F.regexp_replace(n, '^"(.*)"$', "$1"))
    optional = F.array(*[F.lit(name) for name in WATCHLIST_OPTIONAL])
    listed = first.select("file", "file_name", names.alias("header"))
    known = F.transform("header", lambda n: F.array_contains(optional, n))
    leading = F.coalesce(F.nullif(F.array_position(known, True), F.lit(0)), F.size("header") + 1) - 1
    tail = F.slice("header", F.lit(len(WATCHLIST_LEADING) + 1), F.size("header"))
    problem = (
        F.when(leading < len(WATCHLIST_LEADING), "too few leading columns")
        .when(leading > len(WATCHLIST_LEADING), "too many leading columns")
        .when(F.exists(tail, lambda n: ~F.array_contains(optional, n)), "unknown column")
        .when(F.size(F.array_distinct(tail)) < F.size(tail), "repeated column")
    )
    columns = F.concat(F.array(*[F.lit(name) for name in WATCHLIST_LEADING]), tail)
    return listed.withColumn("problem", problem).select(
        "file", "file_name", "header", F.when(F.col("problem").isNull(), columns).alias("columns"), "problem"
    )


def rejected_watchlists(catalog: DataFrame) -> DataFrame:
    """How many files of a catalogue each problem rejects."""
    return catalog.where(F.col("problem").isNotNull()).groupBy("problem").agg(F.count("*").alias("files"))


def read_watchlists(
    spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8", catalog: DataFrame | None = None
) -> DataFrame:
    """Rows of all accepted watch lists with ``file_name``; optional columns a file lacks are NULL.

    Files are grouped by their header (``catalog``, by default that of ``path``): every layout is read with its own
    schema, and the layouts are united by name. The driver holds the paths of the files, as the file listing of any
    read does; the layouts are the few orders in which the optional columns occur.
    """
    known = watchlist_catalog(spark, path, encoding) if catalog is None else catalog
    layouts: dict[tuple, list[str]] = {}
    for row in known.where(F.col("problem").isNull()).select("columns", "file").collect():
        layouts.setdefault(tuple(row["columns"]), []).append(exact_path(row["file"]))
    parts = [_watchlist_rows(spark, sorted(files), names, encoding) for names, files in sorted(layouts.items())]
    if not parts:
        names = (*WATCHLIST_LEADING, "status", "cm_date", "table_name", "features", "monitor_features", "file_name")
        return spark.createDataFrame([], ", ".join(f"{n} string" for n in names) + ", last_run_date date").select(
            *names[:5], "last_run_date", *names[5:]
        )
    return reduce(DataFrame.unionByName, parts)


def _watchlist_rows(spark: SparkSession, files: list[str], columns: Sequence[str], encoding: str) -> DataFrame:
    schema = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    rows = spark.read.csv(files, sep="\t", header=True, schema=schema, encoding=encoding, escape='"', mode="PERMISSIVE")

    def optional(name: str):
        return F.col(f"`{name}`") if name in columns else F.lit(None).cast("string")

    return rows.select(
        *WATCHLIST_LEADING,
        optional("STATUS").alias("status"),
        optional("CM_DATE").alias("cm_date"),
        parse_date(optional("LAST_RUN_DATE")).alias("last_run_date"),
        optional("TABLE_NAME").alias("table_name"),
        optional("Features").alias("features"),
        optional("monitor features").alias("monitor_features"),
        _name(F.col("_metadata.file_name")).alias("file_name"),
    )


def read_all_text(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = "\t", encoding: str = "UTF-8",
    header: bool = True, places: bool = False,
) -> DataFrame:
    """All-string rows; lines with too many fields are skipped, short ones padded with NULL.

    Lines whose field count is off arrive whole in ``_line``; their separators
    outside quotes tell short from long. Parsing stays per line, so files
    split freely. Columns are not pruned while parsing, as that would hide
    surplus fields. With ``places`` every row has its file's path as ``file`` and its place in it as ``file_place``.
    """
    rows = spark.read.option("columnPruning", "false").csv(
        path, sep=sep, header=header, encoding=encoding, escape='"', mode="PERMISSIVE", enforceSchema=True,
        schema=T.StructType([*schema.fields, T.StructField("_line", T.StringType())]),
        columnNameOfCorruptRecord="_line",
    )
    unquoted = F.regexp_replace("_line", '"(?:[^"]|"")*"', "")
    separators = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(sep), F.lit("")))
    # A short line always lacks its last field.
    short = F.col(schema.names[-1]).isNull() & (separators < len(schema.names))
    # A block's first byte, then a number that grows inside the block.
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    placed = [F.col("_metadata.file_path").alias("file"), place.alias("file_place")] if places else []
    return rows.where(F.col("_line").isNull() | short).select(
        *schema.names, _name(F.col("_metadata.file_name")).alias("file_name"), *placed
    )


def read_feed(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Found or not-found export feed."""
    return read_all_text(spark, path, FEED_EXPORT, encoding=encoding)


def read_part_details(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Part details; ``file_date`` is the day in the file's own name, ``file`` and ``file_place`` tell where a row stood."""
    rows = read_all_text(spark, path, PART_DETAILS, encoding=encoding, places=True)
    return rows.withColumn("file_date", day_of_name(F.col("file_name")))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Module matrix; ``row_no`` keeps the file's order for first-match lookups."""
    rows = spark.read.csv(path, header=True, schema=MATRIX, escape='"')
    return rows.withColumn("row_no", F.monotonically_increasing_id())


def read_direct_feed(spark: SparkSession, path: str) -> DataFrame:
    """Supplier list; names may hold quoted commas."""
    rows = spark.read.csv(path, header=True, schema=DIRECT_FEED, quote='"', escape='"')
    return rows.withColumn("row_no", F.monotonically_increasing_id())


def _process_records(spark: SparkSession, path: str) -> DataFrame:
    rows = parsed_records(quoted_records(spark, path), PROCESS_LOG).drop("file")
    return rows.withColumn("_time", parse_timestamp(F.col("timestamp")))


def read_process_logs(spark: SparkSession, path: str) -> DataFrame:
    """All process logs of a folder as one table, with whole details: a quoted traceback may span lines.

    One large file is read by many tasks (``quoted_records``). Records whose time can't be read are in
    ``rejected_process_logs``.
    """
    rows = _process_records(spark, path).where(F.col("_time").isNotNull())
    return rows.withColumn("timestamp", F.col("_time")).drop("_time")


def rejected_process_logs(spark: SparkSession, path: str) -> DataFrame:
    """Records of the folder's logs that have no readable time, as they stand."""
    return _process_records(spark, path).where(F.col("_time").isNull()).drop("_time")


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """The table without its all-NULL columns, found in one pass."""
    filled = df.agg(*[F.count(F.col(f"`{name}`")).alias(name) for name in df.columns]).first()
    return df.select(*[F.col(f"`{name}`") for name in df.columns if filled[name] > 0])


def acceptable_download(df: DataFrame, more_than: int = 3) -> bool:
    """A downloaded table is taken only when it has rows and more than three columns."""
    return len(df.columns) > more_than and not df.isEmpty()
