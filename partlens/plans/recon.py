"""Feed reconciliation: delivered part details against the two imported feeds, all days at once."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlens.functions import classify
from partlens.functions.dates import parse_date
from partlens.operators.align import align_sides, provenance
from partlens.operators.lookups import join_lookups

MATCH_KEY = ("date", "mpn", "man", "module")
REPORT_COLUMNS = ("part_number", "module_name", "status", "auto_import_status", "category", "date")

# Import states as numbers, so that the state of a duplicated feed row is its smallest.
_STATES = ("In Progress", "Not Imported", "Imported", "")


def _state_number(auto_status: Column, knows_not_imported: bool) -> Column:
    state = classify.import_class(auto_status, F.lit(False), knows_not_imported)
    number = F.lit(len(_STATES) - 1)
    for i, name in enumerate(_STATES[:-1]):
        number = F.when(state == name, i).otherwise(number)
    return number


def _state_name(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in _STATES]), number + 1)


def _feed(feed: DataFrame) -> DataFrame:
    return feed.withColumn("date", parse_date(F.col("check_date"))).where(F.col("date").isNotNull())


def file_days(details: DataFrame) -> DataFrame:
    """The day of every details file, as (file, date): all its rows are of one delivery, whatever their own dates say.

    Of rows with a priority each part counts once, found before not found, then by its place in the file. The first of
    them by part, maker and module (NULL last) that has a readable date gives the day; a file without any takes the
    day of its name. Both steps combine on the map side, and the second has one row per part.
    """
    code = F.when(F.lower(F.col("status")) == "found", 0).otherwise(1)
    key = ["mpn", "man", "module"]
    first = F.min(F.struct(code.alias("code"), "file_place", parse_date(F.col("sys_date")).alias("day"))).alias("first")
    parts = details.where(F.col("priority").isNotNull()).groupBy("file", *key).agg(
        first, F.min("file_date").alias("file_date")
    )
    order = F.struct(*[c for name in key for c in (F.col(name).isNull(), F.col(name))])
    return parts.groupBy("file").agg(
        F.coalesce(F.min_by("first.day", F.when(F.col("first.day").isNotNull(), order)), F.min("file_date")).alias("date")
    )


def dated_by_file(details: DataFrame) -> DataFrame:
    """Details rows with the day of their file as ``date``."""
    return join_lookups(details, [(file_days(details), ["file"])])


def _details(details: DataFrame) -> DataFrame:
    """Details with a priority and a date: that of their file where it is known, else their own.

    Tables that were not read from files have no file; there the row's date counts, and ``file_date`` stands in for a
    missing one.
    """
    if "date" not in details.columns:
        day = parse_date(F.col("sys_date"))
        if "file_date" in details.columns:
            day = F.coalesce(day, F.col("file_date"))
        details = details.withColumn("date", day)
    return details.where(F.col("priority").isNotNull() & F.col("date").isNotNull())


def match(found_feed: DataFrame, notfound_feed: DataFrame, details: DataFrame) -> DataFrame:
    """Every (date, table, part) of either side with provenance, received flag and import state.

    Details and both feeds meet in one group-by on (date, part): a part both
    found and not found in a day counts as found, and each kept row is then
    looked at once for the found table and once for the not-found table.
    """
    found = F.lower(F.col("status")) == "found"
    code = F.when(found, 0).otherwise(1)
    aligned = align_sides(
        {
            "found_feed": (_feed(found_feed), {"found_state": _state_number(F.col("auto_imp_status"), True)}),
            "notfound_feed": (
                _feed(notfound_feed), {"notfound_state": _state_number(F.col("auto_imp_status"), False)}
            ),
            "details": (
                _details(details),
                {"outcome": code, "details_row": F.struct(code.alias("code"), F.col("status").alias("status"))},
            ),
        },
        MATCH_KEY,
    )

    def side(table: str, in_feed: str, state: str, outcome: int) -> Column:
        return F.struct(
            F.lit(table).alias("table"),
            F.col(in_feed).alias("in_feed"),
            F.coalesce(F.col("outcome") == outcome, F.lit(False)).alias("in_details"),
            F.col(state).alias("state"),
        )

    tables = F.inline(F.array(
        side("found", "in_found_feed", "found_state", 0),
        side("notfound", "in_notfound_feed", "notfound_state", 1),
    ))
    rows = aligned.select(*MATCH_KEY, F.col("details_row.status").alias("details_status"), tables)
    in_feed, in_details = F.col("in_feed"), F.col("in_details")
    return rows.where(in_feed | in_details).select(
        *MATCH_KEY, "table", "in_feed", "in_details",
        provenance(in_feed, in_details).alias("provenance"),
        F.when(in_details, F.when(in_feed, "received").otherwise("not received")).alias("received"),
        F.when(in_feed, _state_name(F.col("state"))).otherwise("").alias("auto_imp_status"),
        F.when(in_details, F.col("details_status")).alias("details_status"),
    )


def reported_days(found_feed: DataFrame, details: DataFrame) -> DataFrame:
    """Days that have details and also occur in the found feed; only these are reported."""
    fed = _feed(found_feed).select("date").distinct()
    return _details(details).select("date").distinct().join(fed, "date", "left_semi")


def report(matched: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Both tables' rows with label and category in one frame."""
    # Broadcast bound: one four-byte date per calendar day.
    rows = matched if days is None else matched.join(F.broadcast(days), "date", "left_semi")
    label = classify.report_label(F.col("auto_imp_status"))
    return rows.select(
        F.col("mpn").alias("part_number"),
        F.col("module").alias("module_name"),
        F.col("details_status").alias("status"),
        label.alias("auto_import_status"),
        "received",
        classify.report_category(label, F.col("table")).alias("category"),
        "date",
    )


def imported_report(rows: DataFrame) -> DataFrame:
    """Received rows that were imported or not imported."""
    kept = F.col("auto_import_status").isin("Imported", "Not Imported") & (F.col("received") == "received")
    return rows.where(kept).select(*REPORT_COLUMNS)


def missed_report(rows: DataFrame) -> DataFrame:
    """Rows still in progress or not received. Feed-only rows are in neither report."""
    in_progress = (F.col("auto_import_status") == "In Progress") & (F.col("received") == "received")
    return rows.where(in_progress | (F.col("received") == "not received")).select(*REPORT_COLUMNS)


def counts(matched: DataFrame) -> DataFrame:
    """Figures per (date, table), for days with details and found-feed rows.

    Feed-only rows keep their import state and count there, not as received.
    Days on which nothing was received are dropped. Both tables of a day come
    from one group-by on the day, which also tells whether the day is reported.
    """
    state = F.col("auto_imp_status")
    measures = {
        "total_parts": F.col("in_details"),
        "received_count": F.col("received") == "received",
        "imported_count": state == "Imported",
        "not_imported_count": state == "Not Imported",
        "in_progress_count": state == "In Progress",
        "not_received_count": F.col("received") == "not received",
    }
    tables = ("found", "notfound")
    per_day = matched.groupBy("date").agg(
        F.bool_or("in_details").alias("has_details"),
        F.bool_or((F.col("table") == "found") & F.col("in_feed")).alias("has_feed"),
        *[
            F.count_if((F.col("table") == table) & condition).alias(f"{table}_{name}")
            for table in tables
            for name, condition in measures.items()
        ],
    )
    both = F.array(*[
        F.struct(F.lit(table).alias("table"), *[F.col(f"{table}_{name}").alias(name) for name in measures])
        for table in tables
    ])
    return (
        per_day.where(F.col("has_details") & F.col("has_feed"))
        .select("date", F.inline(both))
        .where(F.col("not_received_count") != F.col("total_parts"))
    )


def pivot(count_rows: DataFrame) -> DataFrame:
    """Per date: in progress and not received, found against not found; 0 where a table has no row."""

    def cell(table: str, name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("table") == table, F.col(name))), F.lit(0))

    return count_rows.groupBy("date").agg(
        cell("found", "in_progress_count").alias("in_progress_found"),
        cell("found", "not_received_count").alias("not_received_found"),
        cell("notfound", "in_progress_count").alias("in_progress_not_found"),
        cell("notfound", "not_received_count").alias("not_received_not_found"),
    )


def reports_between(stored: DataFrame, start: date, end: date) -> DataFrame:
    """Stored report rows of a date range (partition column ``report_date``)."""
    return stored.where(F.col("report_date").between(start, end))
