"""Physical plans: no cross joins, no Python, pushed filters; joins with heavy keys."""

from datetime import date

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from workload.spark_queries import QUERIES
from partlens import schemas
from partlens.operators.lookups import join_lookups
from partlens.plans import registry, watch_status
from partlens.sources import writers

FOLDER = "/root/testdata/sf0.001"
WRITES = {
    "summary_history", "snapshot_store", "recon_reports_between", "parts_versions", "snapshot_refreshed", "activity_appended",
    "activity_appended_counts", "activity_stream_hours", "ingest_mixed_watchlists", "watchlist_problems", "summary_export",
}


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER)).split("== Physical Plan ==")[1]
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "FlatMapGroups"):
        assert bad not in plan, f"{name}: {bad}"


def test_scans_read_only_what_they_need(spark):
    plan = plan_of(entry.queries()["classify_error"](spark, FOLDER))
    assert "l_extendedprice" not in plan.split("ReadSchema")[-1]


def test_rank_limit_runs_before_the_shuffle(spark):
    physical = plan_of(entry.queries()["watch_found_source"](spark, FOLDER)).split("== Physical Plan ==")[1]
    # Before and after the shuffle.
    assert physical.count("WindowGroupLimit") == 2


def hot_registry(spark):
    """A third of all rows under one key, a third of those without any date."""
    rows = spark.range(0, 6000, 1, 8)
    hot, day = F.col("id") % 3 == 0, F.lit(date(2024, 1, 1))
    return rows.select(
        F.when(hot, F.lit("hot")).otherwise(F.concat(F.lit("p"), F.col("id") % 500)).alias("pn"),
        F.when(hot, F.lit(1)).otherwise(F.col("id") % 3).cast("bigint").alias("man_id"),
        F.lit(1).cast("bigint").alias("mod_id"),
        F.concat(F.lit("P"), F.col("id") % 5).alias("prty"), F.lit("a|b").alias("cs"),
        F.when(F.col("id") % 9 != 0, day).alias("lrd"), F.lit(None).cast("date").alias("v_notfound_dat"),
    )


def hot_parts(spark):
    rows = hot_registry(spark).select("pn", F.monotonically_increasing_id().alias("id"))
    return rows.select(
        "id", F.col("pn").alias("part"), F.lit("x").alias("man"),
        F.when(F.col("id") % 7 != 0, "m").otherwise("unknown").alias("module"),
        F.lit(1).cast("bigint").alias("file_id"),
        *[F.lit(None).cast("string").alias(c) for c in ("status", "cm_date")],
        F.lit(None).cast("date").alias("last_run_date"),
        *[F.lit(None).cast("string").alias(c) for c in ("table_name", "features", "monitor_features", "prty")],
        *[F.lit(None).cast("bigint").alias(c) for c in ("man_id", "module_id")],
    )


def marks_of(spark, facts):
    feed = facts.select(
        F.col("pn").alias("mpn"), "man_id", "mod_id", F.col("lrd").alias("check_date"), F.col("prty").alias("status")
    )
    return registry.part_marks(facts.where("prty = 'P1'").select("pn", "man_id"), registry.latest_status(feed))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def small_thresholds(spark):
    names = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.shuffle.partitions": "40",
    }
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_a_hot_key_of_a_lookup_join_is_split(spark, small_thresholds):
    facts = hot_registry(spark)
    marks = marks_of(spark, facts)
    joined = join_lookups(facts, [(marks, ["pn", "man_id"])])
    plain = facts.join(marks, ["pn", "man_id"], "left").select(joined.columns)
    assert rows_of(joined) == rows_of(plain)
    joined.collect()
    assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_hot_parts_get_their_status(spark):
    facts = hot_registry(spark)
    modules = spark.createDataFrame([("m", 1, 1, 0)], schemas.MAN_MODULES)
    files = spark.createDataFrame([(1, "f")], "id long, file_name string")
    feed = spark.createDataFrame([("hot", 1, 1, date(2024, 5, 1), "text")], schemas.NOTFOUND_FEED)
    merged = watch_status.merge_status(hot_parts(spark), files, modules, facts, feed)
    got = {(r["part"] == "hot", r["module"], r["table_name"]): r["count"] for r in
           merged.groupBy("part", "module", "table_name").count().collect() if r["part"] == "hot"}
    assert sum(got.values()) == 2000 and merged.count() == 6000
    # Some registry rows of the hot key have no date at all, so all its known parts are not run.
    assert {key[1:] for key in got} == {("m", "not run"), ("unknown", "not_valid")}


def test_status_run_reads_registry_and_feed_once(spark):
    physical = plan_of(entry.queries()["watch_status_source"](spark, FOLDER)).split("== Physical Plan ==")[1]
    assert physical.count("FileScan parquet [l_") == 2
    # The options come from one pass as well, whose rows are copied once per group of columns.
    physical = plan_of(entry.queries()["watch_filter_options"](spark, FOLDER)).split("== Physical Plan ==")[1]
    assert physical.count("Expand") == 1 and physical.count("FileScan parquet [o_") == 1


def test_a_snapshot_stored_three_times_is_built_once(spark, monkeypatch):
    plans, store = [], writers.store_snapshot

    def seen(df, *args):
        plans.append(plan_of(df).split("== Physical Plan ==")[1])
        store(df, *args)

    monkeypatch.setattr(writers, "store_snapshot", seen)
    entry.queries()["snapshot_store"](spark, FOLDER)
    assert len(plans) == 3 and not any("Exchange" in plan for plan in plans)
