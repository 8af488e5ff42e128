"""Files in and out."""

from datetime import date, datetime

from pyspark.sql import functions as F

from partlens.plans import feed_calendar
from partlens.session import scratch_path, shared_folder
from partlens.sources import readers, writers


def put(folder, name, content, encoding="utf-8"):
    (folder / name).write_bytes(content.encode(encoding))
    return str(folder / name)


def test_watchlists_of_mixed_length(spark, tmp_path):
    put(tmp_path, "short.txt", "PN\tMAN\tMOD\nA1\tm\tx\nhttp://b\tm\t\n")
    full = "part\tman\tmodule\tSTATUS\tCM_DATE\tLAST_RUN_DATE\tTABLE_NAME\tFeatures\tmonitor features\n"
    put(tmp_path, "full.txt", full + "C1\tm\tx\tfound\tc\t2024-01-05\tt\tf1|f2\tall\n")
    put(tmp_path, "empty.txt", "PN\tMAN\tMOD\n")
    rows = {r["part"]: r for r in readers.read_watchlists(spark, str(tmp_path)).collect()}
    assert set(rows) == {"A1", "http://b", "C1"}
    assert rows["C1"]["last_run_date"] == date(2024, 1, 5) and rows["C1"]["monitor_features"] == "all"
    assert rows["A1"]["status"] is None and rows["A1"]["file_name"] == "short.txt"
    assert rows["http://b"]["module"] is None


def test_watchlists_of_mixed_headers(spark, tmp_path):
    put(tmp_path, "some [1]+{list}.txt", "a\tb\tc\tFeatures\r\nP\tm\tx\tf|\r\n")
    put(tmp_path, "turned.txt", "a\tb\tc\tmonitor features\tSTATUS\nQ\tm\tx\tall\tfound\nshort\tm\n")
    put(tmp_path, "quoted.txt", '"a"\t"b"\t"c"\t"STATUS"\nR\tm\tx\tgone\n')
    put(tmp_path, "no_rows.txt", "a\tb\tc")
    put(tmp_path, "nothing.txt", "")
    bad = {
        "two.txt": ("a\tb", "too few leading columns"), "four.txt": ("a\tb\tc\td", "too many leading columns"),
        "mixed.txt": ("a\tSTATUS\tb\tc", "too few leading columns"),
        "other.txt": ("a\tb\tc\tSTATUS\tnote", "unknown column"),
        "twice.txt": ("a\tb\tc\tSTATUS\tSTATUS", "repeated column"),
    }
    for name, (header, _) in bad.items():
        put(tmp_path, name, header + "\nx\ty\n")
    rows = {r["part"]: r for r in readers.read_watchlists(spark, str(tmp_path)).collect()}
    assert set(rows) == {"P", "Q", "R", "short"}
    assert (rows["P"]["features"], rows["P"]["status"], rows["P"]["file_name"]) == ("f|", None, "some [1]+{list}.txt")
    assert (rows["Q"]["status"], rows["Q"]["monitor_features"], rows["R"]["status"]) == ("found", "all", "gone")
    assert rows["short"]["module"] is None and rows["short"]["status"] is None
    catalog = readers.watchlist_catalog(spark, str(tmp_path))
    problems = {r["file_name"]: r["problem"] for r in catalog.where("problem IS NOT NULL").collect()}
    assert problems == {name: problem for name, (_, problem) in bad.items()}
    counted = {r["problem"]: r["files"] for r in readers.rejected_watchlists(catalog).collect()}
    assert counted["too few leading columns"] == 2 and sum(counted.values()) == len(bad)


def test_no_watchlist_at_all(spark, tmp_path):
    put(tmp_path, "two.txt", "a\tb\nx\ty\n")
    rows = readers.read_watchlists(spark, str(tmp_path))
    assert rows.count() == 0 and rows.columns[:4] == ["part", "man", "module", "status"]


def test_other_encoding(spark, tmp_path):
    path = put(tmp_path, "latin.txt", "a\tb\tc\nµA741\tm\tx\n", "latin-1")
    rows = readers.read_watchlists(spark, path, encoding="ISO-8859-1")
    assert rows.first()["part"] == "µA741"


def test_lines_with_surplus_fields_are_skipped(spark, tmp_path):
    body = "mpn\tman\tmodule\tcheck_date\tauto_imp_status\n"
    body += "ok\tm\tx\t2024-01-01\tDone\n" + "short\tm\n" + "long\tm\tx\t2024-01-01\tDone\textra\n"
    body += "longer\tm\tx\t2024-01-01\tDone\t\tmore\n" + "tail\tm\tx\t2024-01-01\tDone\t\n" + "blank\tm\t\t\tDone\n" + 'quoted\t"m\tn"\tx\t\t\n'
    path = put(tmp_path, "feed.txt", body)
    rows = {r["mpn"]: r for r in readers.read_feed(spark, path).collect()}
    assert set(rows) == {"ok", "short", "blank", "quoted"}
    assert rows["short"]["auto_imp_status"] is None and rows["blank"]["module"] is None
    assert rows["quoted"]["man"] == "m\tn"
    # A narrow selection must not change which lines are kept.
    assert readers.read_feed(spark, path).select("man").count() == 4
    assert readers.read_feed(spark, path).count() == 4


def test_details_carry_the_date_of_their_file(spark, tmp_path):
    header = "a\tb\tc\td\te\tf\tg\th\n"
    put(tmp_path, "PartDetailsReport@08-Mar-2025.txt", header + "p\tm\tx\tP1\tl\tFound\tf\t\n")
    row = readers.read_part_details(spark, str(tmp_path)).first()
    assert row["file_date"] == date(2025, 3, 8) and row["sys_date"] is None and row["status"] == "Found"


def test_dimensions(spark, tmp_path):
    path = put(tmp_path, "feed.csv", 'Supplier,Direct Feed\nPlain,1\n"Parts, Inc.",0\n')
    assert [tuple(r)[:2] for r in readers.read_direct_feed(spark, path).orderBy("row_no").collect()] == [
        ("Plain", 1), ("Parts, Inc.", 0)
    ]
    path = put(tmp_path, "matrix.csv", 'Modules,Running Status,Module Comment,old\nm,"say ""hi""",,\n')
    row = readers.read_matrix(spark, path).first()
    assert (row["modules"], row["running_status"], row["old"]) == ("m", 'say "hi"', None)


def test_process_logs_keep_whole_details_and_rejects(spark, tmp_path):
    head = "timestamp,parent_process,subprocess,level,message,details\n"
    trace = '"Traceback\n  File x, line 1\nboom"'
    put(tmp_path, "one.csv", head + f"2024-01-01 10:00:00,one,s,ERROR,ERROR in a: b,{trace}\n")
    put(tmp_path, "two.csv", head + '2024-01-01 11:00:00,two,s,INFO,"STEP: a, b",\n')
    put(tmp_path, "three.csv", head + "2024-01-01T11:00:00Z!,three,s,INFO,x,\n")
    rows = {r["parent_process"]: r for r in readers.read_process_logs(spark, str(tmp_path)).collect()}
    assert set(rows) == {"one", "two"} and rows["two"]["message"] == "STEP: a, b"
    assert "boom" in rows["one"]["details"]
    assert [r["parent_process"] for r in readers.rejected_process_logs(spark, str(tmp_path)).collect()] == ["three"]


def test_empty_columns(spark):
    df = spark.createDataFrame([(1, None, "", None)], "a int, b string, c string, `d e` int")
    assert readers.drop_empty_columns(df).columns == ["a", "c"]
    assert readers.acceptable_download(df)
    assert not readers.acceptable_download(df.drop("a"))
    assert not readers.acceptable_download(df.where("false"))


def test_list_files(spark, tmp_path):
    put(tmp_path, "a.txt", "12345")
    row = readers.list_files(spark, str(tmp_path)).first()
    assert (row["file_name"], row["bytes"]) == ("a.txt", 5)


def test_text_and_run_exports(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"', None)], "p string, q string, r string")
    run_at = datetime(2024, 1, 2, 3, 4, 5)
    writers.write_run_export(df, str(tmp_path / "x"), run_at, copy_to=str(tmp_path / "y"))
    for root in ("x", "y"):
        back = spark.read.csv(
            str(tmp_path / root / "run_at=2024-01-02__03_04_05"), header=True, escape='"'
        ).first()
        assert tuple(back) == ("a,b", 'say "x"', None)
    writers.write_text(df, str(tmp_path / "z"))
    writers.write_text(df, str(tmp_path / "z"))
    assert spark.read.csv(str(tmp_path / "z"), header=True, escape='"').count() == 1


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snap")
    for day, value in ((1, "a"), (2, "b"), (2, "c"), (1, "d")):
        df = spark.createDataFrame([(value,)], "v string")
        writers.write_snapshot(df, path, datetime(2024, 1, day, 6))
    stored = spark.read.parquet(path)
    assert {r["v"] for r in stored.collect()} == {"c", "d"}
    fresh = feed_calendar.newest_snapshot(stored, datetime(2024, 1, 3, 5)).first()
    assert fresh["v"] == "c" and fresh["stale"] is False
    assert feed_calendar.newest_snapshot(stored, datetime(2024, 1, 3, 6)).first()["stale"] is True
    newest = feed_calendar.newest_snapshot(stored, datetime(2024, 1, 3, 6))
    assert "PartitionFilters: [isnotnull(download_date" in newest._jdf.queryExecution().toString()
    assert {r["v"] for r in feed_calendar.surviving_rows(stored, 1).collect()} == {"c"}


def test_log_entries_add_up(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "timestamp timestamp_ntz, username string, action string, details string"

    def batch(number, *hours):
        rows = [(datetime(2024, 1, 1, hour), f"u{hour}", "LOGIN", "") for hour in hours]
        writers.append_log(spark.createDataFrame(rows, schema), path, number, keep=3)

    def recent():
        return [r["username"] for r in writers.read_recent_log(spark, path).orderBy("timestamp").collect()]

    batch(0, 1, 2)
    assert recent() == ["u1", "u2"]
    batch(1, 9, 4, 5)
    assert recent() == ["u4", "u5", "u9"]
    batch(1, 9, 4, 5)
    assert recent() == ["u4", "u5", "u9"]
    for number in range(2, 8):
        batch(number, 10 + number)
    batch(7, 17)
    assert recent() == ["u15", "u16", "u17"]
    schema = writers.read_recent_log(spark, path).schema
    assert writers.read_log(spark, path, schema).count() == 11
    batch(0, 1, 2)  # its version is long gone: made from the entries up to it, and older than all others
    assert recent() == ["u15", "u16", "u17"] and writers.read_log(spark, path, schema).count() == 11


def test_parts_versions(spark, tmp_path):
    path = str(tmp_path / "parts")
    for day in (1, 2):
        writers.write_parts(spark.createDataFrame([(day,)], "id int"), path, datetime(2024, 1, day))
    assert [r["id"] for r in writers.read_parts(spark, path).collect()] == [2]


def test_reports_by_day(spark, tmp_path):
    path = str(tmp_path / "reports")
    rows = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-01-05')) AS date")
    writers.write_report(rows, path)
    writers.write_report(rows.where(F.col("date") == date(2024, 1, 3)), path)
    assert spark.read.parquet(path).count() == 5


def test_scratch_paths_differ(spark):
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second and first.startswith(shared_folder(spark))
