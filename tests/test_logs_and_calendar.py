"""Logs, days, retention and ingest."""

from datetime import date, datetime

from pyspark.sql import functions as F

from partlens import schemas
from partlens.plans import activity, feed_calendar, ingest


def test_security_figures(spark):
    noon = datetime(2024, 1, 1, 12)
    log = spark.createDataFrame(
        [
            (datetime(2024, 1, 1, 11, 30), "a", "LOGIN"),
            (datetime(2024, 1, 1, 11, 40), "a", "LOGIN"),
            (datetime(2024, 1, 1, 11, 0), "b", "LOGIN"),
            (datetime(2024, 1, 1, 11, 50), "c", "LOGIN_FAILED"),
            (datetime(2024, 1, 1, 9), "c", "ADMIN_ACCESS_DENIED"),
        ],
        "timestamp timestamp_ntz, username string, action string",
    ).select("*", F.lit("").alias("details"), F.lit("").alias("ip_address"))
    assert tuple(activity.security_figures(log, noon).first()) == (5, 2, 1)
    assert [r["username"] for r in activity.recent_entries(log, 2).collect()] == ["c", "a"]


def test_parsed_messages(spark):
    messages = [
        ("PROCESS START: load", "START", "load", None),
        ("PROCESS END: load - FAILED", "END", "load", "FAILED"),
        ("STEP: read", "STEP", "read", None),
        ("ERROR in save: disk full", "ERROR", "save", None),
        ("Status query completed in 1.25 seconds", "INFO", None, None),
    ]
    log = spark.createDataFrame(
        [(datetime(2024, 1, 1), "p", "s", "INFO", m[0], "") for m in messages],
        "timestamp timestamp_ntz, parent_process string, subprocess string, level string, message string, details string",
    )
    got = {r["message"]: (r["kind"], r["subject"], r["outcome"]) for r in activity.parsed_log(log).collect()}
    assert got == {m[0]: m[1:] for m in messages}
    assert [float(r["total_seconds"]) for r in activity.step_seconds(log).collect()] == [1.25]


def test_runs(spark):
    def line(hour, minute, message):
        return (datetime(2024, 1, 1, hour, minute), "p", "s", "INFO", message, "")

    log = spark.createDataFrame(
        [
            line(1, 0, "PROCESS START: a"), line(1, 30, "STEP: x"), line(5, 0, "PROCESS END: a - SUCCESS"),
            line(6, 0, "PROCESS START: a"), line(7, 0, "PROCESS START: a"), line(7, 0, "PROCESS END: a - FAILED"),
            line(8, 0, "PROCESS START: a"), line(8, 0, "PROCESS START: b"), line(8, 10, "PROCESS END: b - SUCCESS"),
            *[line(9, 0, "PROCESS START: c")] * 3, line(9, 5, "PROCESS END: c - SUCCESS"),
            line(9, 5, "PROCESS END: c - FAILED"),
        ],
        "timestamp timestamp_ntz, parent_process string, subprocess string, level string, message string, details string",
    )
    runs = activity.process_runs(log)
    hour = 3_600_000_000
    rows = runs.collect()
    # Three records at one instant: only the last can end.
    assert sorted((r["outcome"], r["runs"], r["micros"]) for r in rows if r["subject"] == "c") == [
        ("FAILED", 1, hour // 12), ("UNFINISHED", 2, None)
    ]
    got = {(r["subject"], r["started"].hour): (r["outcome"], r["micros"]) for r in rows if r["subject"] != "c"}
    assert got == {
        ("a", 1): ("SUCCESS", 4 * hour), ("a", 6): ("UNFINISHED", None), ("a", 7): ("FAILED", 0),
        ("a", 8): ("UNFINISHED", None), ("b", 8): ("SUCCESS", hour // 6),
    }
    row = {r["subject"]: r for r in activity.process_durations(runs).collect()}["a"]
    assert (row["runs"], row["succeeded"], row["unfinished"], row["success_percentage"]) == (4, 1, 2, 25.0)


def test_missing_days_and_expected_names(spark):
    present = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 3),), (None,)], "date date")
    gaps = feed_calendar.missing_days(present, date(2023, 12, 31), date(2024, 1, 4))
    assert sorted(r[0] for r in gaps.collect()) == [date(2023, 12, 31), date(2024, 1, 2), date(2024, 1, 4)]
    names = feed_calendar.expected_names(present.where("date = DATE '2024-01-03'"), 12)
    assert {r["file_name"] for r in names.collect()} == {
        "Export_Feed_03-Jan-2024_12_PM.txt", "Export_NotFound_Feed_03-Jan-2024_12_PM.txt"
    }


def test_retention(spark):
    names = [(f"snap_2024-01-{d:02d}.csv",) for d in range(1, 11)]
    names += [("snap_latest.csv",), ("snap_2024-13-40.csv",), ("snap_x.csv",)]
    got = feed_calendar.surviving_names(spark.createDataFrame(names, "file_name string"), "snap_")
    assert {r[0] for r in got.collect()} == {
        *(f"snap_2024-01-{d:02d}.csv" for d in range(4, 11)), "snap_latest.csv", "snap_2024-13-40.csv", "snap_x.csv"
    }


def test_report_slots_sort_by_time(spark):
    names = [
        ("Export_NotFound_Feed_02-Feb-2024_09_AM.txt",), ("Export_NotFound_Feed_31-Jan-2024_11_PM.txt",),
        ("Export_NotFound_Feed_02-Feb-2024_12_PM.txt",), ("Export_NotFound_Feed_02-Feb-2024_09_AM.txt",),
        ("Export_Feed_05-Feb-2024_09_AM.txt",), ("Export_NotFound_Feed_02-Feb-2024_08_AM.zip",),
        ("Export_NotFound_Feed_none.txt",),
    ]
    df = spark.createDataFrame(names, "file_name string")
    assert [r["slot"] for r in feed_calendar.report_slots(df).collect()] == [
        "02-Feb-2024_12_PM", "02-Feb-2024_09_AM", "31-Jan-2024_11_PM"
    ]
    assert [r[0] for r in feed_calendar.report_days(df).collect()] == [
        date(2024, 1, 31), date(2024, 2, 2), date(2024, 2, 5)
    ]


def test_new_files_and_ids(spark):
    listing = spark.createDataFrame([("a",), ("b",), ("always",)], "file_name string")
    known = spark.createDataFrame([("a",), ("always",)], "file_name string")
    assert {r[0] for r in ingest.new_files(listing, known).collect()} == {"b"}
    assert {r[0] for r in ingest.new_files(listing, known, exempt="always").collect()} == {"b", "always"}
    first, later = datetime(2024, 1, 1, 6), datetime(2024, 1, 2, 6)
    files = ingest.register_files(listing, first)
    assert [f.name for f in files.schema] == schemas.UPLOADED_FILES.names
    again = ingest.register_files(listing, later)
    assert files.select("id").intersect(again.select("id")).count() == 0
    rows = spark.createDataFrame([("p", "m", "x", "a")] * 50, "part string, man string, module string, file_name string")
    parts = ingest.register_parts(rows, first, first_id=1000)
    assert parts.schema.simpleString() == schemas.PARTS.simpleString()
    ids = [r["id"] for r in parts.collect()]
    assert len(set(ids)) == 50 and min(ids) >= 1000
    assert ingest.next_id(parts) == max(ids) + 1
    assert ingest.next_id(parts.where("false")) == 0
    assert {r["file_id"] for r in parts.collect()} == {files.where("file_name = 'a'").first()["id"]}
