"""Operators against plain Python on small data."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from partlens.operators.align import align_sides, provenance
from partlens.operators.dedup import keep_first, largest_null_first, latest_per_key, newest_values, smallest_null_last
from partlens.operators.filters import (
    RegistryFilter, WatchFilter, filter_direct_feed, filter_grouped, filter_registry, filter_rows,
)
from partlens.operators.lookups import first_match, known_modules
from partlens.operators.merge import delete_cascade, merge_update, update_where
from partlens.operators.sequence import with_next
from partlens.operators.slicing import positional_slice


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merge_keeps_every_target_row_once(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3)], "id int, v string, w int")
    source = spark.createDataFrame([(2, "new"), (3, None), (9, "x")], "id int, v string")
    once = merge_update(target, source, ["id"], {"v": F.coalesce(F.col("s.v"), F.lit("null in source"))})
    assert rows_of(once) == [(1, "a", 1), (2, "new", 2), (3, "null in source", 3)]
    assert once.columns == target.columns
    again = merge_update(once, source, ["id"], {"v": F.coalesce(F.col("s.v"), F.lit("null in source"))})
    assert rows_of(again) == rows_of(once)


def test_update_with_null_condition_leaves_the_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    assert rows_of(update_where(df, F.col("v") == "a", {"id": F.lit(7)})) == [(2, None), (7, "a")]


def test_cascade(spark):
    parent = spark.createDataFrame([(1, "x"), (2, None)], "id int, name string")
    child = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id int, parent int")
    kept, left = delete_cascade(parent, child, F.col("name") == "x", "id", "parent")
    assert rows_of(kept) == [(2, None)]
    assert {row["id"] for row in left.collect()} == {11, 12}


def test_latest_takes_null_as_newest(spark):
    df = spark.createDataFrame(
        [("a", date(2024, 1, 1), "old"), ("a", None, "none"), ("b", date(2024, 1, 1), "x"),
         ("b", date(2024, 1, 2), "y"), ("b", date(2024, 1, 2), "z")],
        "k string, d date, v string",
    )
    got = latest_per_key(df, ["k"], largest_null_first("d"), ["v"])
    assert rows_of(got) == [("a", "none"), ("b", "z")]
    first = keep_first(df, ["k"], smallest_null_last("d"), ["v"])
    assert rows_of(first) == [("a", "old"), ("b", "x")]


def test_newest_values_keeps_ties(spark):
    df = spark.createDataFrame(
        [(1, date(2024, 1, 1), "old"), (1, date(2024, 1, 2), "b"), (1, date(2024, 1, 2), "a"),
         (1, date(2024, 1, 2), "a"), (1, date(2024, 1, 2), None), (2, None, "n"), (2, date(2024, 1, 1), "x")],
        "k int, d date, v string",
    )
    got = newest_values(df, ["k"], "d", "v", "names")
    assert rows_of(got) == [(1, date(2024, 1, 2), ["", "a", "b"]), (2, None, ["n"])]
    assert rows_of(newest_values(df, ["k"], "d", None, "names")) == [(1, date(2024, 1, 2)), (2, None)]


def test_align_equals_a_null_safe_full_outer_join(spark):
    rng = random.Random(5)
    keys = [None, "a", "b", "c", "d", "e"]
    left = [(rng.choice(keys), rng.choice([1, 2]), rng.randint(0, 9)) for _ in range(8)]
    right = [(rng.choice(keys), rng.choice([1, 2]), rng.randint(0, 9)) for _ in range(8)]

    def reduced(rows):
        best = {}
        for k, n, v in rows:
            best[k, n] = min(v, best.get((k, n), v))
        return best

    left_best, right_best = reduced(left), reduced(right)
    expected = []
    for key in left_best.keys() | right_best.keys():
        where = "both" if key in left_best and key in right_best else (
            "left_only" if key in left_best else "right_only"
        )
        expected.append((*key, left_best.get(key), right_best.get(key), where))
    schema = "k string, n int, v int"
    got = align_sides(
        {
            "left": (spark.createDataFrame(left, schema), {"lv": F.col("v")}),
            "right": (spark.createDataFrame(right, schema), {"rv": F.col("v")}),
        },
        ["k", "n"],
    ).select("k", "n", "lv", "rv", provenance(F.col("in_left"), F.col("in_right")))
    assert rows_of(got) == sorted(expected, key=str)
    counts = [row[-1] for row in rows_of(got)]
    assert len(counts) == len(left_best.keys() | right_best.keys())


@pytest.mark.parametrize("slot", ["hour", "day"])
def test_next_record_across_slots(spark, slot):
    rng = random.Random(11)
    start = datetime(2024, 1, 1)
    rows, seen = [], set()
    for key in ("hot", "cold", "single"):
        for _ in range({"hot": 120, "cold": 10, "single": 1}[key]):
            moment = start + timedelta(minutes=rng.randint(0, 6000))
            if (key, moment) not in seen:
                seen.add((key, moment))
                rows.append((key, moment, rng.choice("ab")))
    expected = []
    for key in ("hot", "cold", "single"):
        own = sorted(r for r in rows if r[0] == key)
        following = [r[1:] for r in own[1:]] + [None]
        expected += [(k, t, v, n) for (k, t, v), n in zip(own, following)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, v string")
    got = with_next(df, ["k"], "t", [F.col("v")], ["t", "v"], slot=slot)
    flat = [(r["k"], r["t"], r["v"], tuple(r["next"]) if r["next"] else None) for r in got.collect()]
    assert sorted(flat, key=str) == sorted(expected, key=str)


def test_slice_is_in_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("id"), (F.col("id") % 3).alias("g"))
    ordered = sorted(((r["g"], r["id"]) for r in df.collect()))
    got = positional_slice(df, 120, 349, ["g", "id"])
    assert [(r["g"], r["id"]) for r in got.collect()] == ordered[120:350]
    assert positional_slice(df, 990, 5000, ["g", "id"]).count() == 10
    assert positional_slice(df, 5, 4, ["g", "id"]).count() == 1000
    assert positional_slice(df, -1, 4, ["g", "id"]).count() == 1000


def test_first_match_follows_the_order(spark):
    dim = spark.createDataFrame([("m", "second", 2), ("m", "first", 1), ("n", None, 3)], "k string, v string, row_no int")
    assert rows_of(first_match(dim, "k", ["v"], "row_no")) == [("m", "first"), ("n", None)]
    modules = spark.createDataFrame([("m", 2, 1, 0), ("m", 1, 9, 1)], "module_name string, man_id long, module_id long, run_flag int")
    assert rows_of(known_modules(modules)) == [("m", 1, 9, 1)]


WATCH = [
    ("m1", "f1", "A", "found", "P0", True, "found", date(2024, 1, 1), True, 0),
    ("m2", "f1", "B", "Proxy", "-", False, "not run", date(2024, 2, 1), False, 3),
    ("m3", "f2", None, "Error 1", "P1", False, "-", None, False, 7),
]
WATCH_SCHEMA = (
    "module string, file_name string, man string, status string, prty string, is_expired boolean, "
    "table_name string, last_run_date date, done boolean, run_flag int"
)


@pytest.mark.parametrize(
    ("request_", "kept"),
    [
        (WatchFilter(), {"m1", "m2", "m3"}),
        (WatchFilter(module=[], status=[]), {"m1", "m2", "m3"}),
        (WatchFilter(module=["m1", "m3"]), {"m1", "m3"}),
        (WatchFilter(file_name=["f1"]), {"m1", "m2"}),
        (WatchFilter(man=["A"]), {"m1"}),
        (WatchFilter(status=["Proxy"]), {"m2"}),
        (WatchFilter(prty=["-", "P0"]), {"m1", "m2"}),
        (WatchFilter(is_expired=["True"]), {"m1"}),
        (WatchFilter(is_expired=["true", "false"]), {"m1", "m2", "m3"}),
        (WatchFilter(table_name=["not run"]), {"m2"}),
        (WatchFilter(start_date=date(2024, 1, 1)), {"m1", "m2", "m3"}),
        (WatchFilter(start_date=date(2024, 1, 1), end_date=date(2024, 1, 31)), {"m1"}),
        (WatchFilter(done=[0]), {"m2", "m3"}),
        (WatchFilter(running_status=["Stopped", "Unknown"]), {"m1", "m3"}),
        (WatchFilter(direct_feed=[1]), {"m1"}),
        (WatchFilter(direct_feed=[0]), {"m2", "m3"}),
        (WatchFilter(direct_feed=[0, 1]), {"m1", "m2", "m3"}),
        (WatchFilter(direct_feed=[5]), set()),
        (WatchFilter(file_name=["f1"], is_expired=["false"]), {"m2"}),
    ],
)
def test_watch_filter(spark, request_, kept):
    df = spark.createDataFrame(WATCH, WATCH_SCHEMA)
    feed = spark.createDataFrame([("A", 1), ("B", 0)], "supplier string, direct_feed int")
    assert {r["module"] for r in filter_grouped(df, request_, feed).collect()} == kept


def test_row_filter_classes_the_status_first(spark):
    df = spark.createDataFrame(WATCH, WATCH_SCHEMA)
    assert {r["module"] for r in filter_rows(df, WatchFilter(status=["Error"])).collect()} == {"m3"}
    assert filter_grouped(df, WatchFilter(status=["Error"])).count() == 0
    assert filter_direct_feed(df, [], None).count() == 3


REGISTRY = [
    ("M1", "a", "P1", "found", 0, "", 0, False, "ring|Brand#2", date(2024, 1, 5)),
    ("M2", "b", "X", "not found", 1, "Proxy", 1, True, "string|Brand#21", date(2024, 2, 5)),
    ("M3", "c", None, None, 2, "SW", 0, True, None, None),
]
REGISTRY_SCHEMA = (
    "man_name string, module_name string, prty string, status string, run_flag int, error_status string, "
    "lc_outdated int, is_expired boolean, cs string, lr_date date"
)


@pytest.mark.parametrize(
    ("request_", "rule", "kept"),
    [
        (RegistryFilter(), "word", {"M1", "M2", "M3"}),
        (RegistryFilter(man_names=["M2"], module_names=["b"]), "word", {"M2"}),
        (RegistryFilter(priorities=["P1"]), "word", {"M1"}),
        (RegistryFilter(statuses=["found", "not found"]), "word", {"M1", "M2"}),
        (RegistryFilter(run_flags=["1", 2]), "word", {"M2", "M3"}),
        (RegistryFilter(error_status=["SW"]), "word", {"M3"}),
        (RegistryFilter(lc_outdated=["0"]), "word", {"M1", "M3"}),
        (RegistryFilter(expired=["true"]), "word", {"M2", "M3"}),
        (RegistryFilter(expired=["true", "false"]), "word", {"M1", "M2", "M3"}),
        (RegistryFilter(cs_labels=["ring"]), "word", {"M1"}),
        (RegistryFilter(cs_labels=["ring"]), "text", {"M1", "M2"}),
        (RegistryFilter(cs_labels=["Brand#2"]), "member", {"M1"}),
        (RegistryFilter(date_start=date(2024, 2, 1)), "word", {"M2"}),
        (RegistryFilter(date_end=date(2024, 2, 1)), "word", {"M1"}),
    ],
)
def test_registry_filter(spark, request_, rule, kept):
    df = spark.createDataFrame(REGISTRY, REGISTRY_SCHEMA)
    assert {r["man_name"] for r in filter_registry(df, request_, rule).collect()} == kept
