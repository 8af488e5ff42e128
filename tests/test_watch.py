"""Watch-list status run and figures on hand-made cases."""

from datetime import date

from pyspark.sql import functions as F

from partlens import schemas
from partlens.plans import watch_stats, watch_status

AS_OF = date(2024, 6, 1)


def tables(spark):
    files = spark.createDataFrame(
        [
            (1, "due", date(2024, 5, 1), None, None),
            (2, "checked today", date(2024, 5, 1), AS_OF, None),
            (3, "stopped", date(2024, 5, 1), None, AS_OF),
            (4, "later stop", date(2024, 5, 1), date(2024, 5, 31), date(2024, 6, 2)),
        ],
        schemas.UPLOADED_FILES,
    )
    parts = [
        # id, part, module, file, status, last run, table
        (1, "unknown module", "zz", 1, None, None, None),
        (2, "unregistered", "m", 1, None, None, None),
        (3, "other module", "m", 1, None, None, None),
        (4, "never", "m", 1, None, None, None),
        (5, "found", "m", 1, None, None, None),
        (6, "lost", "m", 1, None, None, None),
        (7, "equal", "m", 1, None, None, None),
        (8, "found", "m", 2, "keep", date(2023, 1, 1), "not SE part"),
        (9, "stored", "m", 4, "not_valid", None, None),
        (10, "old", "m", 1, None, None, None),
        (11, "found", "other", 2, "keep", date(2023, 1, 1), None),
    ]
    rows = [
        (i, part, "Maker", module, file, status, None, run, table, "before", "watch", None, None, None)
        for i, part, module, file, status, run, table in parts
    ]
    modules = spark.createDataFrame([("m", 1, 10, 1), ("other", 2, 20, 0)], schemas.MAN_MODULES)
    early, late = date(2024, 1, 1), date(2024, 3, 1)
    registry = spark.createDataFrame(
        [
            ("other module", 1, 99, "P1", None, late, None),
            ("never", 1, 10, "P1", None, None, None),
            ("never", 1, 10, "P9", None, late, None),
            ("found", 1, 10, "P2", None, late, early),
            ("found", 1, 10, "P3", None, early, None),
            ("lost", 1, 10, "P4", None, early, late),
            ("equal", 1, 10, "P5", None, late, late),
            ("stored", 1, 10, "P6", None, late, None),
            ("old", 1, 10, "P7", None, date(2001, 1, 1), None),
        ],
        schemas.PRIORITY_PARTS,
    )
    feed = spark.createDataFrame(
        [
            ("lost", 1, 10, date(2024, 4, 1), "newest"),
            ("lost", 1, 10, date(2024, 2, 1), "older"),
            ("lost", 1, 10, None, "undated"),
            ("equal", 1, 10, None, "only undated"),
            ("found", 1, 10, date(2024, 5, 1), "hidden"),
        ],
        schemas.NOTFOUND_FEED,
    )
    features = spark.createDataFrame(
        [
            (1, 10, "found", "b", date(2024, 5, 10)),
            (1, 10, "found", "a", date(2024, 5, 10)),
            (1, 10, "found", "a", date(2024, 5, 10)),
            (1, 10, "found", "gone", date(2024, 5, 9)),
            (1, 10, "lost", None, date(2024, 4, 1)),
            (1, 10, "equal", "x", date(2023, 1, 1)),
            (1, 10, "unregistered", "u", date(2024, 5, 1)),
            (1, 10, "never", "n", None),
            (2, 20, "found", "out of scope", date(2024, 5, 1)),
        ],
        schemas.FEATURES,
    )
    return spark.createDataFrame(rows, schemas.PARTS), files, modules, registry, feed, features


def by_id(df, *columns):
    return {row["id"]: tuple(row[c] for c in columns) for row in df.collect()}


def test_eligible_files(spark):
    _, files, *_ = tables(spark)
    assert set(by_id(watch_status.eligible_files(files, AS_OF))) == {1, 4}
    assert set(by_id(watch_status.eligible_files(files, AS_OF, ["due", "stopped"]))) == {1}
    assert set(by_id(watch_status.eligible_files(files, AS_OF, ignore_check_date=True))) == {1, 2, 4}


def test_status_merge(spark):
    parts, files, modules, registry, feed, _ = tables(spark)
    due = watch_status.eligible_files(files, AS_OF)
    merged = watch_status.merge_status(parts, due, modules, registry, feed)
    got = by_id(merged, "table_name", "status", "last_run_date", "prty", "man_id")
    assert got == {
        1: ("not_valid", None, None, None, None),
        2: ("not SE part", None, None, None, 1),
        3: ("not found", None, None, None, 1),
        4: ("not run", None, date(2024, 3, 1), "P9", 1),
        5: ("found", None, date(2024, 5, 1), "P2", 1),
        6: ("not found", "newest", date(2024, 4, 1), "P4", 1),
        7: ("not found", "only undated", date(2024, 3, 1), "P5", 1),
        8: ("not SE part", "keep", date(2023, 1, 1), None, None),
        9: ("not_valid", None, date(2024, 3, 1), "P6", 1),
        10: ("found", None, None, "P7", 1),
        11: (None, "keep", date(2023, 1, 1), None, None),
    }
    assert merged.columns == parts.columns
    source = by_id(watch_status.status_source(parts, due, modules, registry, feed), "table_name", "prty")
    assert source == {i: (got[i][0], got[i][3]) for i in (1, 2, 3, 4, 5, 6, 7, 9, 10)}


def test_found_merge_and_scope(spark):
    parts, files, modules, registry, feed, features = tables(spark)
    due = watch_status.eligible_files(files, AS_OF)
    run = watch_status.run_status(parts, files, modules, registry, feed, features, AS_OF)
    got = by_id(run, "table_name", "status", "last_run_date", "features")
    assert got[5] == ("found", "found", date(2024, 5, 10), "a|b|")
    # Same date: status changes, the date is not newer.
    assert got[6] == ("found", "found", date(2024, 4, 1), "|")
    # Older features still replace the feature text.
    assert got[7] == ("not found", "only undated", date(2024, 3, 1), "x|")
    # An unregistered part keeps its class but becomes found.
    assert got[2] == ("not SE part", "found", date(2024, 5, 1), "u|")
    # An undated feature row is the newest one and changes only the features.
    assert got[4] == ("not run", None, date(2024, 3, 1), "n|")
    # A part of a file that is not due, in a module that is: touched by the found merge alone.
    assert got[8] == ("not SE part", "found", date(2024, 5, 10), "a|b|")
    # Its module occurs in no due file.
    assert got[11] == (None, "keep", date(2023, 1, 1), "before")
    two_steps = watch_status.merge_found(
        watch_status.merge_status(parts, due, modules, registry, feed), due, modules, features
    )
    assert by_id(two_steps, *parts.columns) == by_id(run, *parts.columns)
    by_file = watch_status.merge_found(parts, due, modules, features, scope="file")
    assert by_id(by_file, "status")[8] == ("keep",)
    unnamed = by_id(watch_status.merge_found(parts, due, modules, features, has_names=False), "status", "features")
    assert unnamed[5] == ("found", "before")


def test_every_pair_of_a_module_name_counts(spark):
    _, files, _, *_ = tables(spark)
    names = ["second", "both", "plain", "unknown"]
    rows = [(i, part, "Maker", "m", 1, None, None, None, None, None, "watch", None, None, None) for i, part in enumerate(names)]
    parts = spark.createDataFrame(rows, schemas.PARTS)
    modules = spark.createDataFrame([("m", 1, 10, 1), ("m", 2, 20, 0), ("m", 2, 20, 1)], schemas.MAN_MODULES)
    registry = spark.createDataFrame(
        [
            ("second", 2, 20, "P1", None, date(2024, 1, 1), date(2024, 2, 1)),
            ("both", 1, 10, "P2", None, date(2024, 3, 1), None),
            ("both", 2, 20, "P3", None, None, date(2024, 1, 1)),
            ("plain", 2, 99, "P4", None, None, None),
        ],
        schemas.PRIORITY_PARTS,
    )
    feed = spark.createDataFrame(
        [("second", 2, 20, date(2024, 2, 1), "lost"), ("both", 2, 20, date(2024, 4, 1), "gone"), ("both", 1, 10, date(2024, 1, 1), "old")],
        schemas.NOTFOUND_FEED,
    )
    due = watch_status.eligible_files(files, AS_OF)
    merged = watch_status.merge_status(parts, due, modules, registry, feed)
    assert by_id(merged, "table_name", "status", "prty", "man_id", "module_id") == {
        0: ("not found", "lost", "P1", 2, 20),
        1: ("not found", "gone", "P3", 2, 20),
        2: ("not found", None, None, 2, 20),
        3: ("not SE part", None, None, 1, 10),
    }
    features = spark.createDataFrame(
        [(2, 20, "second", "a", date(2024, 5, 1)), (1, 10, "both", "x", date(2024, 5, 1)), (2, 20, "both", "y", date(2024, 5, 2))],
        schemas.FEATURES,
    )
    found = by_id(watch_status.merge_found(merged, due, modules, features), "status", "features", "last_run_date")
    assert found[0] == ("found", "a|", date(2024, 5, 1)) and found[1] == ("found", "y|", date(2024, 5, 2))
    run = watch_status.run_status(parts, files, modules, registry, feed, features, AS_OF)
    assert by_id(run, "status", "features", "last_run_date") == found
    assert sorted(tuple(r) for r in watch_status.modules_of(parts, due, modules).collect()) == [("m", 1, 10), ("m", 2, 20)]


def test_second_run_changes_nothing(spark):
    parts, files, modules, registry, feed, features = tables(spark)
    once = watch_status.run_status(parts, files, modules, registry, feed, features, AS_OF)
    rows = spark.createDataFrame(once.collect(), schemas.PARTS)
    twice = watch_status.run_status(rows, files, modules, registry, feed, features, AS_OF)
    first, second = by_id(once, *parts.columns), by_id(twice, *parts.columns)
    # The run replaces the stored status, so a stored not_valid counts only once.
    assert first.pop(9)[8] == "not_valid" and second.pop(9)[8] == "found"
    assert second == first


def test_results_and_counts(spark):
    parts, files, modules, registry, feed, _ = tables(spark)
    due = watch_status.eligible_files(files, AS_OF)
    merged = watch_status.merge_status(parts, due, modules, registry, feed)
    result = watch_status.results(merged, files, modules, AS_OF, ["due"])
    assert set(by_id(result)) == {2, 3, 4, 5, 6, 7, 10}
    expired = by_id(result, "is_expired")
    assert expired[5] == (True,) and expired[2] == (True,)
    counts = {r["file_name"]: r["not_valid_count"] for r in watch_status.validity_counts(merged, files).collect()}
    assert counts == {"due": 1, "checked today": 0, "later stop": 1}
    assert watch_status.expired_upload_list(result).columns == ["Part", "Module", "Prty"]


def classed(spark):
    rows = [
        # man, module, status, run, table, flag
        ("A", "m", "found", date(2024, 6, 1), None, 0),
        ("A", "m", "Timeout Error", date(2024, 5, 1), "not run", 0),
        ("B", "m", None, None, "found", 0),
        ("B", "n", "found", date(2024, 4, 29), "found", 1),
        (None, "n", "Not Found", date(2024, 4, 30), "found", 1),
    ]
    schema = "man string, module string, status string, last_run_date date, table_name string, run_flag int"
    df = spark.createDataFrame(rows, schema).select(
        "*", F.lit(1).cast("bigint").alias("file_id"), F.lit("f").alias("file_name"),
        F.lit(None).cast("string").alias("prty"), F.lit(date(2024, 5, 1)).alias("upload_date"),
        F.lit(None).cast("date").alias("last_check_date"), F.lit(None).cast("date").alias("stop_monitor_date"),
        F.lit(1).alias("man_id"), F.lit(1).alias("module_id"),
        (F.col("last_run_date").isNull() | (F.col("last_run_date") < date(2024, 5, 2))).alias("is_expired"),
    )
    return watch_stats.classed(df)


def test_figures_agree_on_cube_and_rows(spark):
    rows = classed(spark)
    cube, plain = watch_stats.cube(rows), watch_stats.ungrouped(rows)
    for figures in (watch_stats.kpis, watch_stats.distributions, watch_stats.timeline, watch_stats.file_stats):
        assert sorted(map(tuple, figures(cube).collect())) == sorted(map(tuple, figures(plain).collect()))
    kpis = watch_stats.kpis(cube).first().asDict()
    assert kpis == {
        "total_parts": 5, "expired_parts": 4, "active_parts": 1, "error_parts": 1, "missing_parts": 1,
        "module_count": 2,
    }
    assert cube.agg(F.sum("count")).first()[0] == rows.count()


def test_file_stats_by_hand(spark):
    row = watch_stats.file_stats(watch_stats.ungrouped(classed(spark))).first().asDict()
    # Run on 1 Jun, 1 May and 30 Apr are done with the grace day; 29 Apr and never are not.
    assert row["done_percentage"] == 60.0
    assert row["error_done_percentage"] == 33.33
    assert (row["error_count"], row["found_count"], row["notfound_count"]) == (1, 2, 1)
    strict = watch_stats.file_stats(watch_stats.ungrouped(classed(spark)), 0).first().asDict()
    assert strict["done_percentage"] == 40.0 and strict["error_done_percentage"] == 50.0


def test_module_stats_and_validation(spark):
    matrix = spark.createDataFrame(
        [("m", '"Pending data team"', None, None, 1), ("m", "Running", "later", "x", 2)],
        "modules string, running_status string, module_comment string, old string, row_no int",
    )
    feed = spark.createDataFrame([("A", 1, 1), ("B", 1, 2)], "supplier string, direct_feed int, row_no int")
    stats = watch_stats.module_stats(watch_stats.ungrouped(classed(spark)), matrix, feed, date(2024, 6, 1))
    got = {(r["module"], r["man"]): r for r in stats.collect()}
    assert set(got) == {("m", "A"), ("m", "B"), ("n", "B"), ("n", None)}
    # Figures are of the module, whatever the manufacturer.
    assert got["m", "A"]["total_count"] == got["m", "B"]["total_count"] == 3
    assert got["m", "A"]["matrix_status"] == "Pending data team" and got["m", "A"]["matrix_comment"] == "-"
    assert got["m", "A"]["direct_feed_status"] == 1
    # Not in the matrix: direct feed is not looked up.
    assert got["n", "B"]["direct_feed_status"] == 0 and got["n", "B"]["matrix_status"] == "-"
    assert got["m", "A"]["recent_count"] == 1 and got["m", "A"]["recent_percentage"] == 33.33
    valid = watch_stats.validation(stats).first().asDict()
    assert (valid["stopped_modules"], valid["stopped_parts"], valid["total_parts"]) == (2, 6, 5)
    assert valid["stopped_parts_percentage"] == 120.0 and valid["file_status"] == "Rejected"


def test_validation_of_nothing(spark):
    rows = classed(spark).where(F.lit(False))
    matrix = spark.createDataFrame(
        [], "modules string, running_status string, module_comment string, old string, row_no int"
    )
    feed = spark.createDataFrame([], "supplier string, direct_feed int, row_no int")
    stats = watch_stats.module_stats(watch_stats.ungrouped(rows), matrix, feed, AS_OF)
    row = watch_stats.validation(stats).first().asDict()
    assert row["total_parts"] == 0 and row["stopped_parts_percentage"] is None and row["file_status"] is None
    assert watch_stats.kpis(watch_stats.ungrouped(rows)).first()["total_parts"] == 0


def test_flags_and_states(spark):
    rows = spark.createDataFrame([("A",), ("B",), (None,)], "man string")
    feed = spark.createDataFrame([("A", 1), ("A", 1), ("B", 0)], "supplier string, direct_feed int")
    got = {r["man"]: r["direct_feed"] for r in watch_stats.direct_feed_flag(rows, feed).collect()}
    assert got == {"A": 1, "B": 0, None: 0}
    assert watch_stats.run_states(spark).count() == 4
