"""Registry: lifecycle and feed lookups, daily snapshot, drill-down, priority counts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlens.functions import classify
from partlens.functions.dates import EPOCH_1970, days_before, is_expired, or_sentinel
from partlens.operators.dedup import largest_null_first, latest_per_key
from partlens.operators.filters import RegistryFilter, filter_registry
from partlens.operators.lookups import join_lookups

# The priority buckets of the daily summary.
PRIORITY_BUCKETS = (
    "NDF<14", "NotF<90", "P6", "P8", "NDF<7", "P5", "P2", "NDF<60", "NotF<60", "P1", "P3",
    "NotF<7", "P10", "NDF<30", "updated", "P7", "NotF<30", "NDF<90", "NotF<14",
)
# Lifecycle states and the junk mark excluded from the outdated set.
LC_OBSOLETE = "Obsolete"
LC_LAST_BUY = "LTB"
JUNK_PART_MARK = "%)$.@(%"
LC_MAX_AGE_DAYS = 90

SNAPSHOT_COLUMNS = (
    "man_name", "module_name", "run_flag", "prty", "cs", "lrd2", "v_notfound_dat2", "status",
    "lr_date", "lc_outdated", "error_status", "count", "is_expired", "download_date",
)


def lc_outdated(
    component: DataFrame,
    history: DataFrame,
    lookup: DataFrame,
    reason: DataFrame,
    source: DataFrame,
    allowed_sources: Sequence[str],
    as_of: date | datetime,
) -> DataFrame:
    """(pn, man_id) of parts whose latest check by an allowed source is too old or missing.

    The three small tables are joined with each other before they meet the
    history, so the large sides are joined once.
    """
    kinds = (
        lookup.join(reason, "source_reason_id")
        .join(source.where(F.col("lc_src_name").isin(*allowed_sources)), "lc_src_id")
        .select("lc_lookup_id", "se_lc")
    )
    settled = (
        (F.col("last_checked_date") >= days_before(as_of, LC_MAX_AGE_DAYS))
        | (F.col("se_lc") == LC_OBSOLETE)
        | ((F.col("se_lc") == LC_LAST_BUY) & F.col("se_lc_date").isNotNull())
    )
    due = (
        history.where(F.col("latest") == 1)
        .join(kinds, "lc_lookup_id")
        .where(~settled | F.col("last_checked_date").isNull())
        .select("com_id")
    )
    named = component.where(~F.col("nan_partnum").like(JUNK_PART_MARK))
    return named.join(due, "com_id").select(F.col("com_partnum").alias("pn"), "man_id")


def latest_status(feed: DataFrame) -> DataFrame:
    """Newest feed record per part number alone; a missing check date is newest."""
    return latest_per_key(
        feed, ["mpn"], largest_null_first("check_date"), ["man_id", "status"]
    )


def part_marks(outdated: DataFrame, latest: DataFrame) -> DataFrame:
    """One row per (pn, man_id): how often it is outdated, and its feed status.

    Both lookups share their key, so they are gathered into one table and the
    registry is joined once. The number of outdated rows is carried as a weight
    in place of multiplying registry rows.
    """
    stale = outdated.select(
        "pn", "man_id", F.lit(1).alias("lc_rows"), F.lit(None).cast("string").alias("feed_status")
    )
    fed = latest.select(
        F.col("mpn").alias("pn"), "man_id", F.lit(0).alias("lc_rows"), F.col("status").alias("feed_status")
    )
    return stale.unionByName(fed).groupBy("pn", "man_id").agg(
        F.sum("lc_rows").alias("lc_rows"), F.max("feed_status").alias("feed_status")
    )


def registry_base(registry: DataFrame, marks: DataFrame) -> DataFrame:
    """Registry rows with coalesced dates, outdated flag, feed status and ``weight``.

    ``weight`` is the number of rows the plain left join to the outdated set
    would give for this row.
    """
    lc_rows = F.coalesce(F.col("lc_rows"), F.lit(0))
    key = ["pn", "man_id"]
    return join_lookups(registry, [(marks, key)]).select(
        "pn", "man_id", "mod_id", "prty", "cs",
        or_sentinel(F.col("lrd"), EPOCH_1970).alias("lrd2"),
        or_sentinel(F.col("v_notfound_dat"), EPOCH_1970).alias("v_notfound_dat2"),
        (lc_rows > 0).cast("int").alias("lc_outdated"),
        "feed_status",
        F.greatest(lc_rows, F.lit(1)).cast("bigint").alias("weight"),
    )


def _weight(lc_mode: str) -> Column:
    if lc_mode == "reference":
        return F.sum("weight")
    if lc_mode == "distinct":
        return F.count("*")
    raise ValueError(f"unknown lc_mode: {lc_mode}")


def _named(df: DataFrame, man_modules: DataFrame, manufacturer: DataFrame) -> DataFrame:
    """Names from both dimensions, joined one by one so that each is judged by its own size."""
    modules = man_modules.select("man_id", F.col("module_id").alias("mod_id"), "module_name", "run_flag")
    return df.join(modules, ["man_id", "mod_id"]).join(manufacturer.select("man_id", "man_name"), "man_id")


def _classed(df: DataFrame, as_of: date | datetime) -> DataFrame:
    found, missing = F.col("lrd2"), F.col("v_notfound_dat2")
    return (
        df.withColumn("status", classify.registry_status(found, missing))
        .withColumn("lr_date", classify.last_registry_date(found, missing))
        .withColumn("error_status", classify.registry_error(F.col("feed_status"), F.col("status")))
        .withColumn("is_expired", is_expired(F.col("lr_date"), as_of))
    )


def _day(as_of: date | datetime) -> date:
    return as_of.date() if isinstance(as_of, datetime) else as_of


def snapshot(
    base: DataFrame,
    man_modules: DataFrame,
    manufacturer: DataFrame,
    as_of: date | datetime,
    lc_mode: str = "reference",
) -> DataFrame:
    """Daily registry snapshot: counts per module, priority, labels, dates and feed status."""
    counted = base.groupBy(
        "man_id", "mod_id", "prty", "cs", "lc_outdated", "lrd2", "v_notfound_dat2", "feed_status"
    ).agg(_weight(lc_mode).cast("bigint").alias("count"))
    named = _named(counted, man_modules, manufacturer)
    return _classed(named, as_of).withColumn("download_date", F.lit(_day(as_of))).select(*SNAPSHOT_COLUMNS)


def live_rows(
    base: DataFrame, man_modules: DataFrame, manufacturer: DataFrame, as_of: date | datetime
) -> DataFrame:
    """Ungrouped rows that every dashboard figure takes in place of a snapshot.

    The figures only sum ``count``, so skipping the snapshot's wide grouping
    gives the same numbers with one large shuffle less. Use the stored
    snapshot when there is one.
    """
    return _classed(_named(base, man_modules, manufacturer), as_of).withColumnRenamed("weight", "count")


def drilldown(
    base: DataFrame,
    man_modules: DataFrame,
    manufacturer: DataFrame,
    as_of: date | datetime,
    request: RegistryFilter | None = None,
    lc_mode: str = "reference",
    label_rule: str = "text",
) -> DataFrame:
    """Registry rows with part number, under the same rules as the snapshot.

    ``lc_mode="reference"`` keeps ``weight``: how often the plain join to the
    outdated set would repeat the row. The copies would be equal in every
    column, and a part with many records on both sides would give all their
    pairs, so each row comes once with its number. ``"distinct"`` drops it.
    """
    rows = _classed(_named(base, man_modules, manufacturer), as_of)
    if request is not None:
        rows = filter_registry(rows, request, label_rule)
    extra = {"reference": ["weight"], "distinct": []}
    if lc_mode not in extra:
        raise ValueError(f"unknown lc_mode: {lc_mode}")
    return rows.select(
        F.col("pn").alias("part_number"), "man_name", "module_name", "run_flag", "prty", "cs",
        "lrd2", "v_notfound_dat2", "status", "lr_date", "lc_outdated", "error_status", "is_expired",
        *extra[lc_mode],
    )


def upper_names(df: DataFrame) -> DataFrame:
    """Upper-case column names, as snapshots and drill-downs are exported."""
    return df.toDF(*[name.upper() for name in df.columns])


def priority_summary(registry: DataFrame, as_of: date | datetime) -> DataFrame:
    """One dated row with the number of registry rows per listed priority."""
    counts = registry.groupBy().pivot("prty", list(PRIORITY_BUCKETS)).count()
    return counts.na.fill(0).select(F.lit(_day(as_of)).alias("summary_date"), *[f"`{b}`" for b in PRIORITY_BUCKETS])


def summary_timeline(history: DataFrame) -> DataFrame:
    """The summary history in date order."""
    return history.orderBy("summary_date")


def timeline_export(history: DataFrame) -> DataFrame:
    """The summary history as it is downloaded: dates in order, and the number of listed parts of each."""
    total = sum((F.col(f"`{bucket}`") for bucket in PRIORITY_BUCKETS), F.lit(0))
    return history.select(F.col("summary_date").alias("Date"), total.alias("Count")).orderBy("Date")
