"""Truth tables of the scalar rules: one row per branch, NULL and overlapping texts."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from partlens.functions import classify, dates, figures, text


def values(spark, rows, schema, column):
    frame = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], f"i int, {schema}")
    return [row[0] for row in frame.orderBy("i").select(column).collect()]


TEXTS = [
    "HTTP 403", "Output Pattern not found", "Link Step have no links", "Error in loading page :404", "Not Found",
    "found", "Part not found here", "Error x", "Incomplete", "SomeException", "java.lang", "a-b", "", None,
    "anything", "Error 403", "Not Found Error", "Exception Error", "found-1",
]


def test_watch_class(spark):
    got = values(spark, [(t,) for t in TEXTS], "s string", classify.watch_class(F.col("s")))
    assert got == [
        "not assigned error", "SITE", "SITE", "SITE", "Not Found", "found", "found", "Proxy", "Proxy", "SW", "SW",
        "-", "not run", "not run", "not assigned error", "Proxy", "Not Found", "Proxy", "found",
    ]


def test_simple_class(spark):
    got = values(spark, [(t,) for t in TEXTS], "s string", classify.simple_class(F.col("s")))
    assert got == [
        "Proxy", "Output Pattern not found", "Link Step have no links", "Error", "Not Found", "found",
        "Part not found here", "Error", "Error", "Error", "java.lang", "a-b", "", "-", "anything", "Proxy", "Error",
        "Error", "found-1",
    ]


def test_registry_error(spark):
    rule = classify.registry_error(F.col("s"), F.lit("not found"))
    got = values(spark, [(t,) for t in TEXTS], "s string", rule)
    none = "not assigned error"
    assert got == [
        "Proxy", "SITE", "SITE", "SITE", "Not Found", "", "", "Proxy", "Proxy", "SW", "SW", none, none, none, none,
        "Proxy", "Not Found", "Proxy", "",
    ]
    found = classify.registry_error(F.col("s"), F.lit("found"))
    assert set(values(spark, [(t,) for t in TEXTS], "s string", found)) == {""}
    unknown = classify.registry_error(F.col("s"), F.lit(None).cast("string"))
    assert values(spark, [("HTTP 403",)], "s string", unknown) == ["Proxy"]


def test_part_class(spark):
    rows = [
        (False, "P", True, False, True, "not_valid"),
        (True, "not_valid", True, False, True, "not_valid"),
        (True, None, None, None, None, "not SE part"),
        (True, "P", True, True, True, "not run"),
        (True, "P", True, False, True, "found"),
        (True, "P", True, False, False, "not found"),
        (True, "P", True, None, None, "not found"),
    ]
    rule = classify.part_class(F.col("known"), F.col("s"), F.col("reg"), F.col("never"), F.col("later"))
    schema = "known boolean, s string, reg boolean, never boolean, later boolean"
    assert values(spark, [r[:-1] for r in rows], schema, rule) == [r[-1] for r in rows]


def test_registry_status_and_date(spark):
    early, late, none = date(2000, 1, 1), date(2001, 1, 1), date(1970, 1, 1)
    rows = [(late, early), (early, late), (none, none), (late, late)]
    status = classify.registry_status(F.col("f"), F.col("n"))
    assert values(spark, rows, "f date, n date", status) == ["found", "not found", "not run", None]
    last = classify.last_registry_date(F.col("f"), F.col("n"))
    assert values(spark, rows, "f date, n date", last) == [late, late, None, None]


def test_run_state(spark):
    got = values(spark, [(i,) for i in (0, 1, 2, 3, 4, 9, None)], "f int", classify.run_state(F.col("f")))
    assert got == [
        "Stopped", "Regular Running", "Run By Request", "schedule Running", "schedule Running", "Unknown", "Unknown"
    ]


def test_import_class(spark):
    rows = [
        (None, False), ("Imported", True), ("In Progress", False), ("Not Imported - x", False), ("Done", False),
        ("in progress", False),
    ]
    found = classify.import_class(F.col("s"), F.col("absent"), True)
    assert values(spark, rows, "s string, absent boolean", found) == [
        "", "", "In Progress", "Not Imported", "Imported", "Imported"
    ]
    other = classify.import_class(F.col("s"), F.col("absent"), False)
    assert values(spark, rows, "s string, absent boolean", other) == [
        "", "", "In Progress", "Imported", "Imported", "Imported"
    ]


def test_details_status_and_band(spark):
    got = values(spark, [("Found",), ("FOUND",), ("found ",), ("no",), (None,)], "s string",
                 classify.details_status(F.col("s")))
    assert got == ["found", "found", "not found", "not found", "not found"]
    bands = values(spark, [(39.99,), (40.0,), (69.99,), (70.0,)], "p double", classify.colour_band(F.col("p")))
    assert bands == ["red", "orange", "orange", "green"]


def test_percentage_rounds_half_up_and_guards_zero(spark):
    rows = [(1, 8), (1, 3), (2, 3), (1, 200), (0, 5), (3, 0), (5, 5)]
    got = values(spark, rows, "a long, b long", figures.percentage(F.col("a"), F.col("b")))
    assert got == [12.5, 33.33, 66.67, 0.5, 0.0, 0.0, 100.0]
    assert values(spark, [(1, 16)], "a long, b long", figures.percentage(F.col("a"), F.col("b"), 1)) == [6.3]
    assert values(spark, [(0, 0)], "a long, b long", figures.percentage(F.col("a"), F.col("b"), empty=None)) == [None]
    huge = 10**12
    assert values(spark, [(huge // 3, huge)], "a long, b long", figures.percentage(F.col("a"), F.col("b"))) == [33.33]


def test_labels(spark):
    rows = [("a | b||a",), ("",), (None,), ("C++|x",)]
    assert values(spark, rows, "cs string", text.label_list(F.col("cs"))) == [["a", "b"], [], [], ["C++", "x"]]
    names = [("ring|Brand#2",), ("string|Brand#21",), (None,)]
    assert values(spark, names, "cs string", text.has_label_word(F.col("cs"), ["ring"])) == [True, False, False]
    assert values(spark, names, "cs string", text.has_label_text(F.col("cs"), ["ring"])) == [True, True, None]
    assert values(spark, names, "cs string", text.has_label(F.col("cs"), ["Brand#2"])) == [True, False, False]
    # The trailing word bound never holds after a symbol, so such labels never match as words.
    assert values(spark, [("C++",)], "cs string", text.has_label_word(F.col("cs"), ["C++"])) == [False]
    assert values(spark, names, "cs string", text.label_flag(F.col("cs"), "ring")) == [1, 0, 0]


def test_text_rules(spark):
    parts = [("http://x",), ("LM317",), (None,)]
    assert values(spark, parts, "p string", text.upload_priority(F.col("p"))) == ["P0", "P1", None]
    quoted = [('"Running"',), (None,)]
    assert values(spark, quoted, "p string", text.unquoted(F.col("p"))) == ["Running", "-"]
    names = [("Export_NotFound_Feed_08-Mar-2025_10_AM.txt",), ("nothing.txt",)]
    assert values(spark, names, "n string", text.slot_of_name(F.col("n"))) == ["08-Mar-2025_10_AM", None]
    assert values(spark, names, "n string", text.day_of_name(F.col("n"))) == [date(2025, 3, 8), None]


def test_parse_date(spark):
    rows = [("2024-02-29",), ("08-Mar-2025",), ("2024-02-30",), ("x",), ("",), (None,), (" 2024-01-01 ",)]
    assert values(spark, rows, "d string", dates.parse_date(F.col("d"))) == [
        date(2024, 2, 29), date(2025, 3, 8), None, None, None, None, date(2024, 1, 1)
    ]


def test_slot_label(spark):
    got = values(spark, [(h,) for h in (0, 1, 11, 12, 13, 23)], "h int", dates.slot_label(F.col("h")))
    assert got == ["00_AM", "01_AM", "11_AM", "12_PM", "01_PM", "11_PM"]


def test_expired_and_done(spark):
    as_of = date(2024, 3, 31)
    rows = [(None,), (date(2024, 3, 1),), (date(2024, 2, 29),)]
    assert values(spark, rows, "d date", dates.is_expired(F.col("d"), as_of)) == [True, False, True]
    # With a time of day the limit falls inside the day.
    noon = datetime(2024, 3, 31, 12)
    assert values(spark, rows, "d date", dates.is_expired(F.col("d"), noon)) == [True, True, True]
    pairs = [(date(2024, 3, 1), date(2024, 3, 2)), (date(2024, 2, 28), date(2024, 3, 2)), (None, date(2024, 3, 2))]
    done = dates.is_done(F.col("r"), F.col("u"))
    assert values(spark, pairs, "r date, u date", done) == [True, False, False]
    strict = dates.is_done(F.col("r"), F.col("u"), 0)
    assert values(spark, pairs, "r date, u date", strict) == [False, False, False]


@pytest.mark.parametrize(
    ("granularity", "last"),
    [("day", date(2024, 1, 31)), ("month", date(2024, 2, 28)), ("quarter", date(2024, 4, 29)),
     ("year", date(2025, 1, 30))],
)
def test_period_is_anchored_at_its_start(spark, granularity, last):
    start = date(2024, 1, 31)
    days = spark.sql("SELECT explode(sequence(DATE '2023-12-01', DATE '2025-06-01')) AS d")
    kept = days.where(dates.in_period(F.col("d"), start, granularity)).agg(F.min("d"), F.max("d")).first()
    assert tuple(kept) == (start, last)


def test_unknown_granularity():
    with pytest.raises(ValueError):
        dates.in_period(F.col("d"), date(2024, 1, 1), "week")
