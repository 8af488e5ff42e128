"""Queries by name: each takes (spark, folder of parquet tables) and gives a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partlens.functions import classify
from partlens.functions.dates import is_done, is_expired, parse_date, slot_label, versioned_name
from partlens.functions.text import label_flag, label_list
from partlens.operators.filters import (
    RegistryFilter, WatchFilter, filter_grouped, filter_registry, filter_rows,
)
from partlens.operators.merge import merge_update
from partlens.operators.pages import store_pages
from partlens.operators.slicing import positional_slice
from partlens.plans import (
    activity, feed_calendar, ingest, recon, registry, registry_charts, watch_stats, watch_status,
)
from partlens.session import scratch_path
from partlens.sources import bindings as b
from partlens.sources import readers, writers
from partlens.sources.versions import VersionedTable
from partlens.streaming.activity_windows import start_hourly_activity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Registry ------------------------------------------------------------------


def outdated(spark: SparkSession, folder: str) -> DataFrame:
    return registry.lc_outdated(**b.lifecycle(spark, folder), allowed_sources=b.ALLOWED_SOURCES, as_of=b.AS_OF)


def base(spark: SparkSession, folder: str, with_labels: bool = True) -> DataFrame:
    marks = registry.part_marks(
        outdated(spark, folder), registry.latest_status(b.registry_feed(spark, folder))
    )
    return registry.registry_base(b.registry(spark, folder, with_labels), marks)


def snapshot(spark: SparkSession, folder: str, lc_mode: str = "reference", with_labels: bool = True) -> DataFrame:
    return registry.snapshot(
        base(spark, folder, with_labels), b.registry_modules(spark, folder), b.manufacturer(spark, folder),
        b.AS_OF, lc_mode,
    )


def live(spark: SparkSession, folder: str, with_labels: bool = False) -> DataFrame:
    """Rows for the dashboard figures; labels are joined in only where they are shown."""
    return registry.live_rows(
        base(spark, folder, with_labels), b.registry_modules(spark, folder), b.manufacturer(spark, folder), b.AS_OF
    )


def drilldown(spark: SparkSession, folder: str, request: RegistryFilter | None, lc_mode: str, rule: str) -> DataFrame:
    return registry.drilldown(
        base(spark, folder), b.registry_modules(spark, folder), b.manufacturer(spark, folder), b.AS_OF,
        request, lc_mode, rule,
    )


REQUEST = RegistryFilter(
    priorities=["P1", "P2", "P3", "NotF<90", "NDF<30"], statuses=["found", "not found"],
    run_flags=[0, 1, 2, 3], cs_labels=["Brand#2", "red"], date_start=date(1997, 1, 1),
)
ERROR_REQUEST = RegistryFilter(
    error_status=["Proxy", "SW", "not assigned error"], expired=["true"], lc_outdated=[0], date_end=date(2000, 12, 31)
)
# Both expired values and empty lists: no filter at all.
OPEN_REQUEST = RegistryFilter(expired=["true", "false"], man_names=[], cs_labels=["gear"])


@query
def registry_lifecycle_chain(spark, folder):
    return outdated(spark, folder)


@query
def registry_latest_status(spark, folder):
    return registry.latest_status(b.registry_feed(spark, folder))


@query
def registry_snapshot(spark, folder):
    return snapshot(spark, folder)


@query
def registry_snapshot_distinct(spark, folder):
    return snapshot(spark, folder, "distinct")


@query
def registry_drilldown_substring_label(spark, folder):
    return drilldown(spark, folder, REQUEST, "reference", "text")


@query
def registry_drilldown_classified(spark, folder):
    return drilldown(spark, folder, ERROR_REQUEST, "distinct", "text")


@query
def registry_drilldown(spark, folder):
    return registry.upper_names(drilldown(spark, folder, None, "reference", "text"))


@query
def registry_filter_word_label(spark, folder):
    return filter_registry(snapshot(spark, folder), REQUEST, "word")


@query
def registry_filter_member_label(spark, folder):
    return filter_registry(snapshot(spark, folder), OPEN_REQUEST, "member")


@query
def registry_kpis(spark, folder):
    return registry_charts.kpis(live(spark, folder))


@query
def registry_charts_all(spark, folder):
    return registry_charts.charts(live(spark, folder))


@query
def registry_chart_sets(spark, folder):
    return registry_charts.chart_sets(live(spark, folder))


@query
def registry_top_mans(spark, folder):
    return registry_charts.top_manufacturers(live(spark, folder))


@query
def registry_labels(spark, folder):
    return registry_charts.label_counts(live(spark, folder, True))


@query
def registry_labels_filtered(spark, folder):
    narrow = RegistryFilter(cs_labels=["Brand#2"], statuses=["found"])
    return registry_charts.label_counts(live(spark, folder, True), narrow.condition("word"))


@query
def registry_timeline(spark, folder):
    return registry_charts.timeline(live(spark, folder), b.AS_OF)


@query
def registry_timeline_range(spark, folder):
    return registry_charts.timeline_range(live(spark, folder), b.AS_OF)


@query
def registry_options(spark, folder):
    return registry_charts.filter_options(live(spark, folder, True))


@query
def registry_table(spark, folder):
    return registry_charts.table(live(spark, folder))


@query
def priority_pivot(spark, folder):
    return registry.priority_summary(b.priority_parts(spark, folder), b.AS_OF)


@query
def summary_history(spark, folder):
    """Three days appended, one of them twice, read back in date order."""
    path = scratch_path(spark, "summary")
    for day in (date(2001, 6, 2), date(2001, 6, 1), date(2001, 6, 3), date(2001, 6, 2)):
        writers.append_summary(registry.priority_summary(b.priority_parts(spark, folder), day), path)
    return registry.summary_timeline(spark.read.parquet(path))


# Watch lists ---------------------------------------------------------------


def due_files(spark: SparkSession, folder: str) -> DataFrame:
    return watch_status.eligible_files(b.uploaded_files(spark, folder), b.AS_OF)


def status_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, ...]:
    return (
        b.parts(spark, folder), due_files(spark, folder), b.man_modules(spark),
        b.priority_parts(spark, folder), b.notfound_feed(spark, folder),
    )


@query
def watch_files_listing(spark, folder):
    return watch_status.listed_files(b.uploaded_files(spark, folder))


@query
def watch_eligible_files(spark, folder):
    return due_files(spark, folder)


@query
def watch_eligible_ignoring_check(spark, folder):
    return watch_status.eligible_files(b.uploaded_files(spark, folder), b.AS_OF, ignore_check_date=True)


@query
def watch_status_source(spark, folder):
    return watch_status.status_source(*status_inputs(spark, folder))


@query
def watch_merge_status(spark, folder):
    return watch_status.merge_status(*status_inputs(spark, folder))


@query
def watch_merge_by_id(spark, folder):
    """The status merge through the general MERGE on id."""
    source = watch_status.status_source(*status_inputs(spark, folder))
    columns = ("status", "last_run_date", "table_name", "monitor_features", "prty", "man_id", "module_id")
    return merge_update(b.parts(spark, folder), source, ["id"], {c: F.col(f"s.{c}") for c in columns})


@query
def watch_modules_of_files(spark, folder):
    parts, files, modules, _, _ = status_inputs(spark, folder)
    return watch_status.modules_of(parts, files, modules)


@query
def watch_found_source(spark, folder):
    parts, files, modules, _, _ = status_inputs(spark, folder)
    return watch_status.found_source(parts, files, modules, b.features(spark, folder))


@query
def watch_found_source_no_names(spark, folder):
    parts, files, modules, _, _ = status_inputs(spark, folder)
    return watch_status.found_source(parts, files, modules, b.features(spark, folder), has_names=False, scope="file")


@query
def watch_merge_found(spark, folder):
    parts, files, modules, _, _ = status_inputs(spark, folder)
    return watch_status.merge_found(parts, files, modules, b.features(spark, folder))


@query
def watch_run_status(spark, folder):
    """Both merges in one plan."""
    parts, _, modules, facts, feed = status_inputs(spark, folder)
    return watch_status.run_status(
        parts, b.uploaded_files(spark, folder), modules, facts, feed, b.features(spark, folder), b.AS_OF
    )


@query
def watch_results_join(spark, folder):
    return watch_status.results(
        watch_run_status(spark, folder), b.uploaded_files(spark, folder), b.man_modules(spark), b.AS_OF
    )


@query
def watch_valid_counts(spark, folder):
    merged = watch_status.merge_status(*status_inputs(spark, folder))
    return watch_status.validity_counts(merged, b.uploaded_files(spark, folder))


@query
def watch_mark_checked(spark, folder):
    names = [f"Customer#{i:09d}" for i in (1, 5, 9)]
    return watch_status.mark_checked(b.uploaded_files(spark, folder), b.AS_OF, names)


@query
def watch_stop_date(spark, folder):
    return watch_status.set_stop_date(b.uploaded_files(spark, folder), "Customer#000000007", date(2002, 1, 1))


def result_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Result rows with every kind of status text."""
    return watch_status.results(
        b.checked_parts(spark, folder), b.uploaded_files(spark, folder), b.man_modules(spark), b.AS_OF
    )


def classed_rows(spark: SparkSession, folder: str) -> DataFrame:
    return watch_stats.classed(result_rows(spark, folder))


def grouped(spark: SparkSession, folder: str) -> DataFrame:
    return watch_stats.cube(classed_rows(spark, folder))


def live_watch(spark: SparkSession, folder: str) -> DataFrame:
    return watch_stats.ungrouped(classed_rows(spark, folder))


def module_stats(spark: SparkSession, folder: str) -> DataFrame:
    return watch_stats.module_stats(
        live_watch(spark, folder), b.matrix(spark), b.direct_feed(spark, folder), b.AS_OF
    )


@query
def watch_cube(spark, folder):
    return grouped(spark, folder)


@query
def watch_kpis(spark, folder):
    return watch_stats.kpis(live_watch(spark, folder))


@query
def watch_distributions(spark, folder):
    return watch_stats.distributions(live_watch(spark, folder))


@query
def watch_timeline(spark, folder):
    return watch_stats.timeline(live_watch(spark, folder))


@query
def watch_status_counts(spark, folder):
    return watch_stats.status_counts(result_rows(spark, folder))


@query
def watch_module_stats(spark, folder):
    return watch_stats.largest_first(module_stats(spark, folder), "module", "man")


@query
def watch_validation(spark, folder):
    return watch_stats.validation(module_stats(spark, folder))


@query
def watch_file_stats_offset(spark, folder):
    return watch_stats.largest_first(watch_stats.file_stats(live_watch(spark, folder)), "file")


@query
def watch_file_stats_daily(spark, folder):
    return watch_stats.daily_file_stats(result_rows(spark, folder))


@query
def watch_file_bands(spark, folder):
    return watch_stats.banded(watch_stats.daily_file_stats(result_rows(spark, folder)))


@query
def watch_filter_options(spark, folder):
    return watch_stats.filter_options(live_watch(spark, folder))


@query
def watch_filter_grouped(spark, folder):
    request = WatchFilter(
        module=["1-URGENT", "2-HIGH", "4-NOT SPECIFIED"], status=["SITE", "Proxy", "found", "not run"],
        is_expired=["true"], start_date=date(1996, 1, 1), end_date=date(2000, 6, 30), done=[0, 1],
        running_status=["Stopped", "schedule Running"], direct_feed=[1],
    )
    return filter_grouped(grouped(spark, folder), request, b.direct_feed(spark, folder))


@query
def watch_filter_rows(spark, folder):
    request = WatchFilter(
        status=["Proxy", "Error", "found"], prty=["P0", "P2", "-"], table_name=["found", "-"],
        man=[f"NATION_{i}" for i in range(15)], direct_feed=[0],
    )
    rows = classed_rows(spark, folder).withColumn("status", F.col("status_orig"))
    return filter_rows(rows, request, b.direct_feed(spark, folder)).select(
        "id", "part", "man", "module", "status", "prty", "table_name", "file_name"
    )


def _status_by_date(granularity: str) -> Query:
    def run(spark, folder):
        return watch_stats.status_by_date(live_watch(spark, folder), date(1999, 1, 31), granularity)

    return run


for _granularity in ("day", "month", "quarter", "year"):
    QUERIES[f"watch_status_by_date_{_granularity}"] = _status_by_date(_granularity)


@query
def watch_upload_list(spark, folder):
    link = F.when(F.col("module") == "1-URGENT", F.concat(F.lit("http://parts/"), "part"))
    rows = b.parts(spark, folder).withColumn("part", F.coalesce(link, F.when(F.col("status") != "F", F.col("part"))))
    return watch_status.upload_list(rows)


@query
def watch_expired_upload_list(spark, folder):
    return watch_status.expired_upload_list(result_rows(spark, folder))


@query
def watch_slice_page(spark, folder):
    rows = result_rows(spark, folder).select("id", "part", "module", "status")
    return positional_slice(rows, 25, 124, ["id"])


@query
def watch_slice_far(spark, folder):
    """A slice in the numbered way, as for positions beyond a page."""
    rows = result_rows(spark, folder).select("id", "part", "module", "status")
    return positional_slice(rows, 500, 6999, ["module", "id"])


@query
def watch_slice_pages(spark, folder):
    """Three pages of one stored order."""
    rows = result_rows(spark, folder).select("id", "part", "module", "status")
    pages = store_pages(rows, ["module", "id"], scratch_path(spark, "pages"))
    asked = {"first": (0, 99), "middle": (700, 1199), "behind": (10**12, 10**12 + 9)}
    return reduce(DataFrame.unionByName, [
        pages.page(*span).withColumn("page", F.lit(name)) for name, span in asked.items()
    ])


@query
def watch_download_filtered(spark, folder):
    """The filtered rows as a download, read back as a client would."""
    path, rows = scratch_path(spark, "download"), watch_filter_rows(spark, folder)
    writers.write_text(rows, path)
    return spark.read.csv(path, header=True, schema=rows.schema, escape='"')


@query
def registry_download_filtered(spark, folder):
    """The filtered registry rows as a download with upper-case names, read back."""
    path = scratch_path(spark, "download")
    rows = filter_registry(snapshot(spark, folder), REQUEST, "word").select("man_name", "module_name", "prty", "status", "lr_date", "count")
    writers.write_text(registry.upper_names(rows), path)
    return spark.read.csv(path, header=True, schema=rows.schema, escape='"')


@query
def summary_export(spark, folder):
    """The summary history as a download of dates and counts, read back."""
    path = scratch_path(spark, "history")
    writers.write_text(registry.timeline_export(summary_history(spark, folder)), path)
    return spark.read.csv(path, header=True, schema="Date date, Count long").withColumnsRenamed({"Date": "date", "Count": "n"})


@query
def run_export_copies(spark, folder):
    """Results of a run written under its time in two places, and both read back; a file has no empty text but NULL."""
    path = scratch_path(spark, "exports")
    rows = result_rows(spark, folder).select("id", "part", "man", "status", "file_name", "last_run_date")
    run_at = datetime(2001, 6, 1, 6, 5, 4)
    writers.write_run_export(rows, f"{path}/own", run_at, copy_to=f"{path}/shared")
    schema = T.StructType([*rows.schema.fields, T.StructField("run_at", T.StringType())])
    return reduce(DataFrame.unionByName, [
        spark.read.csv(f"{path}/{place}", header=True, schema=schema, escape='"').withColumn("place", F.lit(place))
        for place in ("own", "shared")
    ])


@query
def direct_feed_flag(spark, folder):
    rows = result_rows(spark, folder).select("id", "man", "module")
    return watch_stats.direct_feed_flag(rows, b.direct_feed(spark, folder))


# Scalar rules --------------------------------------------------------------


@query
def classify_error(spark, folder):
    rows = b.registry_feed(spark, folder)
    state = F.when(F.col("mod_id") == 0, "found").when(F.col("mod_id") < 3, "not found")
    return rows.groupBy(classify.registry_error(F.col("status"), state).alias("class")).agg(F.count("*").alias("n"))


@query
def classify_watch(spark, folder):
    rows = b.checked_parts(spark, folder)
    return rows.select("id", classify.watch_class(F.col("status")).alias("class"))


@query
def classify_simple(spark, folder):
    return b.checked_parts(spark, folder).select("id", classify.simple_class(F.col("status")).alias("class"))


@query
def classify_documents(spark, folder):
    """The text rules over whole documents; what is neither class stays the text, shown as its digest."""
    text = F.col("text")
    simple = classify.simple_class(text)
    return b.table(spark, folder, "documents").select(
        "doc_id", classify.watch_class(text).alias("watch"), F.md5(simple.cast("binary")).alias("simple"),
        F.coalesce(classify.simple_category(text) != text, F.lit(False)).alias("flagged"),
    )


@query
def classify_running(spark, folder):
    modules = b.registry_modules(spark, folder)
    rows = b.registry(spark, folder, with_labels=False).join(
        modules.withColumnRenamed("module_id", "mod_id"), ["man_id", "mod_id"]
    )
    return rows.groupBy(classify.run_state(F.col("run_flag")).alias("running_status")).agg(F.count("*").alias("n"))


@query
def classify_registry_dates(spark, folder):
    rows = b.registry(spark, folder, with_labels=False)
    lrd = F.coalesce("lrd", F.lit(date(1970, 1, 1)))
    nf = F.coalesce("v_notfound_dat", F.lit(date(1970, 1, 1)))
    last = classify.last_registry_date(lrd, nf)
    return rows.select(
        classify.registry_status(lrd, nf).alias("status"), last.alias("lr_date"),
        is_expired(last, b.AS_OF).alias("is_expired"),
    ).groupBy("status", "lr_date", "is_expired").agg(F.count("*").alias("n"))


@query
def label_one_hot(spark, folder):
    """Distinct labels per packed text, and one-hot columns on request."""
    rows = b.registry(spark, folder).groupBy("cs").agg(F.count("*").alias("n"))
    return rows.select(
        "cs", "n", F.array_join(label_list(F.col("cs")), ",").alias("labels"),
        label_flag(F.col("cs"), "red").alias("cs_red"), label_flag(F.col("cs"), "Brand#2").alias("cs_brand_2"),
    )


@query
def date_rules(spark, folder):
    """Parsing in both spellings, slots, versioned names and the two done rules, per order."""
    rows = b.table(spark, folder, "orders")
    day = F.col("o_orderdate").cast("date")
    spelled = F.when(F.col("o_orderstatus") == "P", F.date_format(day, "dd-MMM-yyyy")).when(
        F.col("o_orderstatus") == "F", F.date_format(day, "yyyy-MM-dd")
    ).otherwise("n/a")
    upload = F.date_add(F.lit(date(1996, 1, 1)), (F.col("o_custkey") % 1500).cast("int"))
    return rows.select(
        F.col("o_orderkey").alias("id"),
        parse_date(spelled).alias("parsed"),
        slot_label((F.col("o_orderkey") % 24).cast("int")).alias("slot"),
        versioned_name(F.concat(F.lit("list_"), F.col("o_custkey")), b.AS_OF).alias("file_name"),
        is_done(day, upload, 1).alias("done_with_grace"),
        is_done(day, upload, 0).alias("done"),
    )


# Reconciliation ------------------------------------------------------------


def recon_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        b.import_feed(spark, folder, "view"), b.import_feed(spark, folder, "signup"), b.part_details(spark, folder)
    )


def recon_rows(spark: SparkSession, folder: str) -> DataFrame:
    found, notfound, details = recon_inputs(spark, folder)
    return recon.report(recon.match(found, notfound, details), recon.reported_days(found, details))


@query
def recon_join(spark, folder):
    return recon.match(*recon_inputs(spark, folder))


@query
def recon_report(spark, folder):
    return recon_rows(spark, folder)


@query
def recon_imported(spark, folder):
    return recon.imported_report(recon_rows(spark, folder))


@query
def recon_missed(spark, folder):
    return recon.missed_report(recon_rows(spark, folder))


@query
def recon_file_days(spark, folder):
    """Details delivered as one file a day, with stray and empty dates, reconciled by the day of their file."""
    path = scratch_path(spark, "details")
    day, stray = F.col("ts").cast("date"), F.date_format(F.date_add(F.col("ts").cast("date"), 1), "dd-MMM-yyyy")
    events = b.table(spark, folder, "events").where("event_type IN ('click', 'purchase', 'error')")
    rows = events.selectExpr("*", *b.EVENT_KEY).select(
        day.alias("day"), "mpn", "man", "module", F.expr("CASE WHEN value >= 1 THEN 'P1' END").alias("priority"),
        F.col("props").alias("online_link"), F.expr("CASE WHEN event_id % 4 IN (0, 2) THEN 'Found' ELSE 'no' END").alias("status"),
        F.lit(None).cast("string").alias("found_part"),
        F.when(F.col("user_id") % 3 == 0, F.lit(None).cast("string")).when(F.col("user_id") % 7 == 0, stray)
        .otherwise(F.date_format(day, "dd-MMM-yyyy")).alias("sys_date"),
    )
    rows.repartition("day").write.partitionBy("day").csv(path, sep="\t", header=True, escape='"')
    details = recon.dated_by_file(readers.read_part_details(spark, f"{path}/*"))
    found, notfound, _ = recon_inputs(spark, folder)
    return recon.counts(recon.match(found, notfound, details))


@query
def recon_counts(spark, folder):
    return recon.counts(recon.match(*recon_inputs(spark, folder)))


@query
def recon_pivot(spark, folder):
    return recon.pivot(recon.counts(recon.match(*recon_inputs(spark, folder))))


@query
def recon_reports_between(spark, folder):
    """Reports stored by day, then read for a range of days."""
    path = scratch_path(spark, "reports")
    writers.write_report(recon.missed_report(recon_rows(spark, folder)), path)
    return recon.reports_between(spark.read.parquet(path), date(2024, 1, 10), date(2024, 1, 15))


# Calendar and retention ----------------------------------------------------


def busy_days(spark: SparkSession, folder: str) -> DataFrame:
    rows = b.table(spark, folder, "orders")
    return rows.select(F.col("o_orderdate").cast("date").alias("date"))


def dated_orders(spark: SparkSession, folder: str) -> DataFrame:
    return b.table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("download_date"),
        F.col("o_orderdate").alias("download_timestamp"),
    )


def export_names(spark: SparkSession, folder: str) -> DataFrame:
    mark = F.when(F.col("event_type") == "view", "Export_Feed_").otherwise("Export_NotFound_Feed_")
    slot = F.date_format("ts", "dd-MMM-yyyy_hh_a")
    ending = F.when(F.col("event_type") == "error", ".csv").otherwise(".txt")
    return b.table(spark, folder, "events").select(F.concat(mark, slot, ending).alias("file_name"))


@query
def calendar_gaps(spark, folder):
    return feed_calendar.missing_days(busy_days(spark, folder), date(1995, 1, 1), date(2001, 8, 1))


@query
def calendar_day_members(spark, folder):
    rows = b.table(spark, folder, "events").select("event_id", F.col("ts").cast("date").alias("date"))
    return feed_calendar.day_members(rows, date(2024, 1, 5), date(2024, 1, 9))


@query
def expected_exports(spark, folder):
    days = busy_days(spark, folder).distinct()
    return feed_calendar.expected_names(days, 0)


@query
def retention_survivors(spark, folder):
    return feed_calendar.surviving_rows(dated_orders(spark, folder)).select("o_orderkey", "download_date")


@query
def retention_names(spark, folder):
    day = F.date_format("download_date", "yyyy-MM-dd")
    names = dated_orders(spark, folder).select(
        F.when(F.col("o_orderkey") == 3, "snapshot_latest.csv")
        .when(F.col("o_orderkey") == 4, "snapshot_bad-name.csv")
        .otherwise(F.concat(F.lit("snapshot_"), day, F.lit(".csv")))
        .alias("file_name")
    ).distinct()
    return feed_calendar.surviving_names(names, "snapshot_")


@query
def newest_snapshot(spark, folder):
    rows = feed_calendar.newest_snapshot(dated_orders(spark, folder), datetime(2001, 8, 2, 6, 0))
    return rows.select("o_orderkey", "download_date", "stale")


@query
def snapshot_store(spark, folder):
    """Two daily snapshots written, one of them twice, and the newest read back."""
    path = scratch_path(spark, "snapshots")
    rows = writers.built_once(snapshot(spark, folder, with_labels=False).drop("download_date"), "snapshot")
    for taken in (datetime(2001, 6, 1, 5), datetime(2001, 6, 2, 5), datetime(2001, 6, 2, 7)):
        writers.store_snapshot(rows, path, taken)
    kept = writers.read_snapshot(spark, path, datetime(2001, 6, 3, 6))
    return kept.select("man_name", "module_name", "prty", "status", "lr_date", "count", "download_date", "stale")


@query
def snapshot_refreshed(spark, folder):
    """A stored table read while fresh, built anew once it is a day old, and read as it is where building fails."""
    store = VersionedTable(spark, scratch_path(spark, "refreshed"))
    rows = registry_charts.table(live(spark, folder))

    def built(day: int):
        return lambda: rows.withColumn("built", F.lit(day))

    def fails():
        raise RuntimeError("the source is away")

    steps = [
        store.read_fresh(datetime(2001, 6, 1, 5), built(1)), store.read_fresh(datetime(2001, 6, 2, 4, 59), built(2)),
        store.read_fresh(datetime(2001, 6, 2, 5), built(3)), store.read_fresh(datetime(2001, 6, 4), fails),
    ]
    return reduce(DataFrame.unionByName, [step.withColumn("step", F.lit(i)) for i, step in enumerate(steps, 1)])


@query
def report_slots(spark, folder):
    return feed_calendar.report_slots(export_names(spark, folder))


@query
def report_days(spark, folder):
    return feed_calendar.report_days(export_names(spark, folder))


# Ingest and files ----------------------------------------------------------


EXEMPT = "Customer#000000001"


def file_listing(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    customers = b.table(spark, folder, "customer")
    ordered = b.table(spark, folder, "orders").where(F.col("o_orderstatus") == "F")
    listing = customers.select(F.col("c_name").alias("file_name"))
    known = customers.join(ordered, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return listing, known.select(F.col("c_name").alias("file_name"))


@query
def ingest_new_files(spark, folder):
    return ingest.new_files(*file_listing(spark, folder), exempt=EXEMPT)


@query
def ingest_register(spark, folder):
    """Part rows registered under their file: row and distinct id counts per file name."""
    names = b.uploaded_files(spark, folder).select(F.col("id").alias("_f"), "file_name")
    rows = b.parts(spark, folder).select("part", "man", "module", F.col("file_id").alias("_f")).join(names, "_f")
    stamp = datetime(2001, 6, 1, 6)
    loaded = ingest.register_parts(rows.drop("_f"), stamp)
    files = ingest.register_files(rows, stamp)
    return loaded.join(files.select(F.col("id").alias("file_id"), "file_name", "upload_date"), "file_id").groupBy(
        "file_name", "upload_date"
    ).agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"))


@query
def cascade_delete(spark, folder):
    files, parts = ingest.delete_file(b.uploaded_files(spark, folder), b.parts(spark, folder), "Customer#000000007")
    left = files.select(F.lit("file").alias("kind"), "id")
    return left.unionByName(parts.select(F.lit("part").alias("kind"), "id"))


@query
def ingest_watchlists(spark, folder):
    """Watch lists written as tab-separated files of three columns, then read."""
    path = scratch_path(spark, "watchlists")
    writers.write_text(b.parts(spark, folder).select("part", "man", "module"), path, sep="\t")
    return readers.read_watchlists(spark, path).drop("file_name")


def mixed_watchlists(spark: SparkSession, folder: str) -> str:
    """Watch lists in five layouts, and lists that are none; the last digit of a part decides its layout."""
    path, rows = scratch_path(spark, "mixed"), b.parts(spark, folder)
    leading = ["part", "man", "module"]
    layouts = [
        leading,
        ["part AS PN", "man AS MAKER", "module AS MOD", "status AS STATUS", "cast(last_run_date as string) AS LAST_RUN_DATE"],
        [*leading, "status AS STATUS", "cm_date AS CM_DATE", "date_format(last_run_date, 'dd-MMM-yyyy') AS LAST_RUN_DATE",
         "table_name AS TABLE_NAME", "features AS Features", "monitor_features AS `monitor features`"],
        [*leading, "features AS Features", "cm_date AS CM_DATE"],
        [*leading, "monitor_features AS `monitor features`", "table_name AS TABLE_NAME", "status AS STATUS"],
        ["part", "man"],
        [*leading, "status AS STATUS", "cm_date AS NOTE"],
        [*leading, "cm_date AS NOTE", "status AS STATUS"],
    ]
    for i, columns in enumerate(layouts):
        kept = rows.where(F.col("id") % len(layouts) == i)
        writers.write_text(kept.selectExpr(*columns), f"{path}/layout{i}", sep="\t")
    return f"{path}/*"


@query
def ingest_mixed_watchlists(spark, folder):
    return readers.read_watchlists(spark, mixed_watchlists(spark, folder)).drop("file_name")


@query
def watchlist_problems(spark, folder):
    """The kinds of files that are no watch lists, with the first lines they have."""
    catalog = readers.watchlist_catalog(spark, mixed_watchlists(spark, folder))
    return catalog.where("problem IS NOT NULL").select(F.array_join("header", ",").alias("header"), "problem").distinct()


@query
def folder_files(spark, folder):
    """One customer list per market segment, written and listed; the first two segments are registered already."""
    path = scratch_path(spark, "lists")
    rows = b.table(spark, folder, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("value"))
    rows.repartition("segment").write.partitionBy("segment").text(path)
    listed = readers.list_files(spark, f"{path}/*")
    names = listed.where("bytes > 0").select(F.concat(F.element_at(F.split("path", "/"), -2), F.lit(".txt")).alias("file_name"))
    known = spark.createDataFrame([("segment=AUTOMOBILE.txt",), ("segment=BUILDING.txt",)], "file_name string")
    return ingest.new_files(names, known)


@query
def dimension_files(spark, folder):
    """Module matrix and supplier list written as files, read back in their order, and used for the module figures."""
    path = scratch_path(spark, "dimensions")
    matrix, direct = b.matrix(spark), b.direct_feed(spark, folder)
    # Dimension files are one file each, as their order counts.
    writers.write_text(matrix.orderBy("row_no").drop("row_no").coalesce(1), f"{path}/matrix")
    writers.write_text(direct.orderBy("row_no").drop("row_no").coalesce(1), f"{path}/direct")
    return watch_stats.module_stats(
        live_watch(spark, folder), readers.read_matrix(spark, f"{path}/matrix"),
        readers.read_direct_feed(spark, f"{path}/direct"), b.AS_OF,
    )


@query
def feed_surplus_fields(spark, folder):
    """Feed lines, a fifth with a surplus field (skipped), a fifth too short (padded)."""
    path = scratch_path(spark, "feed")
    feed = b.import_feed(spark, folder, "view").na.fill("", ["mpn", "check_date"])
    status = F.col("auto_imp_status")
    line = F.concat_ws(
        "\t", "mpn", "man", "module", "check_date", status, F.when(status == "Done", F.lit("surplus"))
    )
    feed.select(line.alias("value")).write.text(path)
    rows = readers.read_all_text(spark, path, readers.FEED_EXPORT, header=False)
    return rows.drop("file_name")


@query
def drop_null_columns(spark, folder):
    return readers.drop_empty_columns(b.parts(spark, folder))


@query
def upload_list_file(spark, folder):
    path = scratch_path(spark, "upload")
    writers.write_text(watch_status.upload_list(b.parts(spark, folder)), path)
    return spark.read.csv(path, header=True, schema="Part string, Module string, Prty string")


@query
def parts_versions(spark, folder):
    """Merged parts written beside the table they came from, newest version read."""
    path = scratch_path(spark, "parts")
    writers.write_parts(b.parts(spark, folder), path, datetime(2001, 6, 1))
    merged = watch_status.merge_found(
        writers.read_parts(spark, path), due_files(spark, folder), b.man_modules(spark), b.features(spark, folder)
    )
    writers.write_parts(merged, path, datetime(2001, 6, 2))
    return writers.read_parts(spark, path)


# Logs ----------------------------------------------------------------------


@query
def activity_security(spark, folder):
    return activity.security_figures(b.activity_log(spark, folder), b.EVENTS_AS_OF)


@query
def activity_active_users(spark, folder):
    return activity.hourly_figures(b.activity_log(spark, folder))


@query
def activity_recent(spark, folder):
    return activity.recent_entries(b.activity_log(spark, folder))


@query
def activity_appended(spark, folder):
    """The log appended in four batches, two of them done again; the newest entries as the last batch left them."""
    path, log = scratch_path(spark, "activity"), b.activity_log(spark, folder)
    for batch in (0, 1, 1, 2, 0, 3):
        part = F.pmod(F.xxhash64("username"), F.lit(4)) == batch
        writers.append_log(log.where(part), path, batch)
    return writers.read_recent_log(spark, path)


@query
def activity_appended_counts(spark, folder):
    """All entries of an appended log by action, one batch done twice."""
    path, log = scratch_path(spark, "activity"), b.activity_log(spark, folder)
    for batch in (0, 1, 0):
        writers.append_log(log.where(F.dayofmonth("timestamp") % 2 == batch), path, batch)
    return writers.read_log(spark, path, log.schema).groupBy("action").agg(F.count("*").alias("n"))


@query
def activity_stream_hours(spark, folder):
    """Hourly figures as a stream: the whole log, then one later entry that closes its last hour."""
    path, log = scratch_path(spark, "hours"), b.activity_log(spark, folder)
    later = F.make_interval(hours=F.lit(48))
    last = log.agg(F.max("timestamp").alias("timestamp")).select(
        (F.col("timestamp") + later).alias("timestamp"), F.lit("closing").alias("username"),
        *[F.lit("").alias(name) for name in ("action", "details", "ip_address")],
    )
    schema = log.schema.simpleString().replace("timestamp_ntz", "timestamp")[len("struct<"):-1].replace(":", " ")
    for entries in (log, last):
        entries.withColumn("timestamp", F.col("timestamp").cast("timestamp")).write.mode("append").parquet(f"{path}/log")
        stream = spark.readStream.schema(schema).parquet(f"{path}/log")
        start_hourly_activity(stream, f"{path}/figures", f"{path}/checkpoint").awaitTermination()
    figures = "hour timestamp, total_logs long, security_events long, active_users long"
    rows = spark.read.schema(figures).parquet(f"{path}/figures")
    return rows.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query
def activity_kept(spark, folder):
    return activity.recent_entries(b.activity_log(spark, folder), activity.KEPT_ENTRIES)


@query
def process_runs(spark, folder):
    return activity.process_runs(b.process_log(spark, folder))


@query
def process_durations(spark, folder):
    return activity.process_durations(activity.process_runs(b.process_log(spark, folder)))


@query
def process_messages(spark, folder):
    return activity.message_counts(b.process_log(spark, folder))


@query
def process_step_seconds(spark, folder):
    return activity.step_seconds(b.process_log(spark, folder))


@query
def process_log_files(spark, folder):
    """Process logs written as CSV files and read back as one table."""
    path = scratch_path(spark, "logs")
    rows = b.process_log(spark, folder)
    stamped = rows.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    writers.write_text(stamped, path)
    return activity.message_counts(readers.read_process_logs(spark, path))


@query
def process_log_details(spark, folder):
    """Logs whose details span lines and hold quotes, read back whole: lines, characters and last lines per process."""
    path = scratch_path(spark, "traces")
    trace = F.concat(F.lit('Traceback "x",\n  File '), F.col("props"), F.lit('\r\n\n"boom"'))
    rows = b.table(spark, folder, "events").select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.concat(F.lit("proc_"), F.col("user_id") % 12).alias("parent_process"), F.col("event_type").alias("subprocess"),
        F.lit("INFO").alias("level"), F.lit("a, b").alias("message"),
        F.when(F.col("event_id") % 3 == 0, trace).otherwise(F.col("props")).alias("details"),
    )
    writers.write_text(rows, path)
    details = F.coalesce("details", F.lit(""))
    return readers.read_process_logs(spark, path).groupBy("parent_process").agg(
        F.count("*").alias("records"), F.sum(F.length(details)).alias("characters"),
        F.count_if(details.endswith('\n\n"boom"')).alias("whole"),
    )
