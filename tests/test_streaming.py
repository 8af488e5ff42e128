"""Streams drained over a few files."""

from datetime import datetime

from partlens.plans.activity import hourly_figures
from partlens.streaming.activity_windows import start_hourly_activity
from partlens.streaming.watch_ingest import start_ingest

LOG_SCHEMA = "timestamp timestamp, username string, action string"


def test_hourly_activity_matches_the_batch(spark, tmp_path):
    rows = [
        (datetime(2024, 1, 1, hour, minute), f"u{minute % 3}" if minute != 40 else None, action)
        for hour in (1, 2, 3)
        for minute, action in ((5, "LOGIN"), (10, "LOGIN"), (11, "LOGIN"), (20, "LOGIN_FAILED"), (25, "LOGIN"), (40, "LOGIN"))
    ]
    path, figures, checkpoint = (str(tmp_path / name) for name in ("log", "figures", "cp"))

    def arrive(part):
        spark.createDataFrame(part, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(LOG_SCHEMA).parquet(path)
        start_hourly_activity(stream, figures, checkpoint).awaitTermination(120)

    # The same users come in two batches of one hour: they count once.
    arrive(rows[:8])
    arrive(rows[8:])
    arrive([(datetime(2024, 1, 3), "late", "LOGIN")])
    arrive([(datetime(2024, 1, 1, 1, 30), "too late", "LOGIN")])
    got = sorted(map(tuple, spark.read.parquet(figures).collect()))
    assert got == sorted(map(tuple, hourly_figures(spark.createDataFrame(rows, LOG_SCHEMA)).collect()))
    assert [r[1:] for r in got] == [(6, 1, 2)] * 3


def test_files_enter_once(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    files, parts, checkpoint = (str(tmp_path / name) for name in ("files", "parts", "cp"))

    def arrive(name, *rows):
        (inbox / name).write_text("\n".join(["a\tb\tc", *rows]) + "\n")
        start_ingest(spark, str(inbox), files, parts, checkpoint).awaitTermination(120)

    arrive("one.txt", "p1\tm\tx", "p2\tm\tx")
    arrive("two.txt", "p3\tm\tx")
    start_ingest(spark, str(inbox), files, parts, checkpoint).awaitTermination(120)
    names = {r["id"]: r["file_name"] for r in spark.read.parquet(files).collect()}
    assert sorted(names.values()) == ["one.txt", "two.txt"]
    rows = spark.read.parquet(parts).collect()
    assert sorted((r["part"], names[r["file_id"]]) for r in rows) == [
        ("p1", "one.txt"), ("p2", "one.txt"), ("p3", "two.txt")
    ]
    assert len({r["id"] for r in rows}) == 3


def test_lists_of_any_header_enter_and_others_are_listed(spark, tmp_path):
    inbox = tmp_path / "in box"
    inbox.mkdir()
    files, parts, checkpoint, rejected = (str(tmp_path / name) for name in ("files", "parts", "cp", "rejected"))
    (inbox / "a.txt").write_text("a\tb\tc\tFeatures\tSTATUS\np1\tm\tx\tf|\tfound\n")
    (inbox / "b.txt").write_text("a\tb\np2\tm\n")
    start_ingest(spark, str(inbox), files, parts, checkpoint, rejected).awaitTermination(120)
    (inbox / "c [x].txt").write_text("a\tb\tc\tSTATUS\np3\tm\tx\tgone\n")
    start_ingest(spark, str(inbox), files, parts, checkpoint, rejected).awaitTermination(120)
    rows = {r["part"]: r for r in spark.read.parquet(parts).collect()}
    assert (rows["p1"]["features"], rows["p1"]["status"], rows["p3"]["status"]) == ("f|", "found", "gone")
    assert len(rows) == 2 and rows["p1"]["id"] != rows["p3"]["id"]
    assert {r["file_name"] for r in spark.read.parquet(files).collect()} == {"a.txt", "c [x].txt"}
    assert [tuple(r)[:3] for r in spark.read.parquet(rejected).collect()] == [("b.txt", ["a", "b"], "too few leading columns")]
