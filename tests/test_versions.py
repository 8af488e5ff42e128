"""Versioned tables, stored pages, and records with line ends inside quotes."""

import csv
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from partlens.operators.options import distinct_options
from partlens.operators.pages import Pages, store_pages
from partlens.schemas import PROCESS_LOG
from partlens.sources.quoted import parsed_records, quoted_records
from partlens.sources.versions import VersionedTable


def frame(spark, value, rows=1):
    return spark.range(rows).select(F.lit(value).alias("v"), "id")


def values(df):
    return {row["v"] for row in df.collect()}


# Versions ---------------------------------------------------------------------


def test_a_version_replaces_its_key_and_readers_see_the_newest(spark, tmp_path):
    store = VersionedTable(spark, str(tmp_path / "t"))
    assert store.newest() is None
    with pytest.raises(ValueError):
        store.read()
    old = store.write(frame(spark, "a"), "2024-01-01", datetime(2024, 1, 1, 6))
    reader = store.read()
    store.write(frame(spark, "b"), "2024-01-02", datetime(2024, 1, 2, 6))
    store.write(frame(spark, "c"), "2024-01-02", datetime(2024, 1, 2, 7))
    store.write(frame(spark, "d"), "2024-01-01", datetime(2024, 1, 1, 8))
    assert values(store.read()) == {"c"} and [v.key for v in store.versions()] == ["2024-01-01", "2024-01-02"]
    assert values(reader) == {"a"} and old not in store.versions()
    opened = store.read().inputFiles()
    assert opened and all(store.newest().name in path for path in opened)


def test_commits_on_top_of_each_other(spark, tmp_path):
    first, second = (VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    state, calls = first._state, []

    def late():
        found = state()
        if not calls:
            calls.append(1)
            second.write(frame(spark, "other"), "b", datetime(2024, 1, 2))
        return found

    first._state = late
    first.write(frame(spark, "mine"), "a", datetime(2024, 1, 1))
    assert [v.key for v in second.versions()] == ["a", "b"] and values(second.read()) == {"other"}
    assert not [name for name in first._names("manifest") if name.startswith(".") and not name.endswith(".crc")]


def test_fresh_stale_and_failing_builds(spark, tmp_path):
    store = VersionedTable(spark, str(tmp_path / "t"))

    def fails():
        raise RuntimeError("away")

    with pytest.raises(RuntimeError):
        store.read_fresh(datetime(2024, 1, 1), fails)
    assert store.read_fresh(datetime(2024, 1, 1, 6), lambda: frame(spark, "a")).first()["stale"] is False
    assert values(store.read_fresh(datetime(2024, 1, 2, 5, 59), fails)) == {"a"}
    kept = store.read_fresh(datetime(2024, 1, 2, 6), fails).first()
    assert (kept["v"], kept["stale"]) == ("a", True)
    assert values(store.read_fresh(datetime(2024, 1, 2, 6), lambda: frame(spark, "b"))) == {"b"}


def test_retired_versions_are_swept_later(spark, tmp_path):
    store = VersionedTable(spark, str(tmp_path / "t"))
    for day in range(1, 6):
        store.write(frame(spark, day), str(day), datetime(2024, 1, day), keep=4)
    assert [v.key for v in store.versions()] == ["2", "3", "4", "5"]
    assert [v.key for v in store.retire(2)] == ["2", "3"]
    assert store.sweep(datetime(2000, 1, 1)) == []
    assert len(store.sweep(datetime(2100, 1, 1))) == 3 and len(store._names("data")) == 2
    assert values(store.read()) == {5}


# Pages ------------------------------------------------------------------------


def test_pages_of_one_order(spark, tmp_path):
    df = spark.range(2000).select((F.col("id") * 7919 % 2000).alias("id"), (F.col("id") % 3).alias("g"))
    pages = store_pages(df, ["g", "id"], str(tmp_path / "p"), pieces=7)
    expected = [tuple(r) for r in df.orderBy("g", "id").collect()]
    opened = Pages(spark, str(tmp_path / "p"))
    assert len(opened) == 2000 and len(pages.pieces) > 1
    for start, end in ((0, 0), (0, 49), (650, 1400), (1990, 5000)):
        assert [tuple(r) for r in opened.page(start, end).collect()] == expected[start : end + 1]
    assert opened.page(2000, 2100).count() == 0
    one = opened.page(0, 9)
    assert len({path.rsplit("/", 2)[1] for path in one.inputFiles()}) == 1
    plan = one._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_pages_of_nothing(spark, tmp_path):
    pages = store_pages(spark.range(0), ["id"], str(tmp_path / "p"))
    assert len(pages) == 0 and pages.page(0, 10).collect() == [] and pages.page(0, 10).columns == ["id"]


# Quoted records ---------------------------------------------------------------


def write_log(path, rows, end):
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, lineterminator=end)
        writer.writerow(PROCESS_LOG.names)
        writer.writerows(rows)


@pytest.mark.parametrize("block", [64, 1000, 10**7])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_blocks_of_a_file_give_the_same_records_as_the_whole(spark, tmp_path, block, end):
    draw = random.Random(block)
    pieces = ["plain", 'say "x"', "a,b", "line\nmore", "\n", '"', "é\U0001F600", "", "Traceback\n  File x\n\nboom", "x" * 300]
    folder = tmp_path / "logs"
    folder.mkdir()
    every = []
    for name in ("one", "two"):
        rows = [
            (f"2024-01-01 10:00:{i % 60:02d}", name, f"r{i}", "INFO", draw.choice(pieces) + "!", draw.choice(pieces) + draw.choice(pieces))
            for i in range(200)
        ]
        every += [tuple(value or None for value in row) for row in rows]
        write_log(folder / f"{name}.csv", rows, end)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        records = quoted_records(spark, str(folder))
        tasks = spark.read.text(str(folder)).rdd.getNumPartitions()
        got = parsed_records(records, PROCESS_LOG).drop("file").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert block > 10**6 or tasks > 20
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, every))


def test_blank_lines_headers_and_open_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h1,h2\n\n1,"x\n\ny"\n\n2,z\n3,"open\nto the end\n')
    (tmp_path / "b.csv").write_text('"h\n1",h2\n4,w')
    (tmp_path / "c.csv").write_text("")
    records = {r["record"] for r in quoted_records(spark, str(tmp_path)).collect()}
    assert records == {'1,"x\n\ny"', "2,z", '3,"open\nto the end', "4,w"}
    kept = quoted_records(spark, str(tmp_path / "b.csv"), header=False)
    assert {r["record"] for r in kept.collect()} == {'"h\n1",h2', "4,w"}


# Options ----------------------------------------------------------------------


def test_options_of_several_groups(spark):
    rows = [("a", "x|y", 1), ("a", "y", 2), (None, None, 2), ("b", "", None)]
    df = spark.createDataFrame(rows, "m string, l string, n int")
    found = distinct_options(
        df, [{"names": F.col("m"), "numbers": F.col("n").cast("string")}, {"labels": F.col("l")}],
        {"labels": lambda c: F.filter(F.split(c, "[|]"), lambda x: x != "")},
    )
    assert sorted(map(tuple, found.collect())) == [
        ("labels", "x"), ("labels", "y"), ("names", "a"), ("names", "b"), ("numbers", "1"), ("numbers", "2")
    ]
    assert distinct_options(df.limit(0), [{"names": F.col("m")}]).count() == 0
