"""The test tables seen as the logical tables of the package.

Every function reads whole tables and projects, renames or joins them; ``events`` is split into two
feeds and the details, ``ingest`` takes the names of finished orders as known. Small dimensions without a counterpart are inline values.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession

from partlens.plans.registry import PRIORITY_BUCKETS

AS_OF = date(2001, 6, 1)
EVENTS_AS_OF = datetime(2024, 1, 30, 12, 0, 0)
ALLOWED_SOURCES = ("AFRICA", "ASIA", "EUROPE")

# One text per branch of the status classes; the place after the last one is NULL.
STATUS_TEXTS = (
    "HTTP 403", "Output Pattern not found", "Link Step have no links", "Error in loading page :404",
    "Not Found", "Part found elsewhere", "Timeout Error", "Incomplete page", "NullPointerException",
    "java.lang crash", "a-b", "", "anything", "found",
)
IMPORT_TEXTS = ("In Progress", "Not Imported - duplicate", "Imported", "Done")


# Stated schemas save a footer-reading job per table.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def _texts(values: tuple[str, ...]) -> str:
    return "array(" + ", ".join(f"'{value}'" for value in values) + ")"


def _pick(values: tuple[str, ...], place: str) -> str:
    """The text at ``place``, counted from 0; NULL past the end."""
    return f"try_element_at({_texts(values)}, cast({place} as int) + 1)"


def _status(place: str) -> str:
    return _pick(STATUS_TEXTS, f"(({place}) % {len(STATUS_TEXTS) + 1})")


_PRTY = _pick((*PRIORITY_BUCKETS, "X1"), "((l_partkey * 7 + l_linenumber) % 21)")
_REGISTRY_DATES = (
    "CASE WHEN l_quantity <= 2 OR l_returnflag = 'R' THEN cast(l_shipdate as date) END AS lrd",
    "CASE WHEN l_quantity <= 2 OR l_returnflag = 'A' THEN cast(l_shipdate as date) END AS v_notfound_dat",
)


def _feed(lineitem: DataFrame, man_id: str, mod_id: str) -> DataFrame:
    return lineitem.selectExpr(
        "cast(l_orderkey as string) AS mpn",
        f"{man_id} AS man_id",
        f"{mod_id} AS mod_id",
        "CASE WHEN l_linenumber != 6 THEN date_add(cast(l_shipdate as date), 3) END AS check_date",
        f"{_status('l_partkey + l_linenumber')} AS status",
    )


# Watch-list side: four modules, keyed by order priority.


def parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey AS id",
        "cast(o_orderkey as string) AS part",
        "concat('NATION_', o_custkey % 25) AS man",
        "o_orderpriority AS module",
        "o_custkey AS file_id",
        "CASE WHEN o_totalprice < 20000 THEN 'not_valid' ELSE o_orderstatus END AS status",
        "cast(cast(o_orderdate as date) as string) AS cm_date",
        "CASE WHEN o_orderstatus != 'O' THEN cast(o_orderdate as date) END AS last_run_date",
        "CASE o_orderstatus WHEN 'F' THEN 'found' WHEN 'P' THEN 'not SE part' END AS table_name",
        "'old|' AS features",
        "o_orderstatus AS monitor_features",
        "cast(NULL as string) AS prty",
        "cast(NULL as bigint) AS man_id",
        "cast(NULL as bigint) AS module_id",
    )


def uploaded_files(spark: SparkSession, folder: str) -> DataFrame:
    as_of = f"DATE '{AS_OF}'"
    return table(spark, folder, "customer").selectExpr(
        "c_custkey AS id",
        "c_name AS file_name",
        "date_add(DATE '1996-01-01', cast(c_custkey % 1500 as int)) AS upload_date",
        f"CASE c_mktsegment WHEN 'MACHINERY' THEN {as_of} WHEN 'BUILDING' THEN NULL ELSE date_sub({as_of}, 5) END "
        "AS last_check_date",
        f"CASE WHEN c_acctbal >= 0 THEN date_add({as_of}, cast(c_custkey % 21 - 10 as int)) END AS stop_monitor_date",
    )


def man_modules(spark: SparkSession) -> DataFrame:
    rows = "('1-URGENT', 0L, 0L, 0), ('2-HIGH', 1L, 1L, 1), ('3-MEDIUM', 2L, 0L, 2), ('4-NOT SPECIFIED', 3L, 1L, 4)"
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(module_name, man_id, module_id, run_flag)")


def priority_parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "cast(l_orderkey as string) AS pn", "l_suppkey % 4 AS man_id", "l_partkey % 2 AS mod_id",
        f"{_PRTY} AS prty", *_REGISTRY_DATES,
    )


def notfound_feed(spark: SparkSession, folder: str) -> DataFrame:
    return _feed(table(spark, folder, "lineitem"), "l_suppkey % 4", "l_partkey % 2")


def features(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "l_suppkey % 4 AS man_id", "l_partkey % 2 AS module_id", "cast(l_orderkey as string) AS part",
        "CASE WHEN l_linenumber != 7 THEN concat(l_returnflag, l_linestatus) END AS feature_name",
        "CASE WHEN l_tax < 0.075D THEN cast(l_shipdate as date) END AS dat",
    )


def matrix(spark: SparkSession) -> DataFrame:
    rows = (
        "('1-URGENT', '\"Running\"', 'ok, fine', NULL, 0), ('1-URGENT', 'Pending data team', 'second', 'x', 1), "
        "('2-HIGH', 'Pending data team', NULL, 'old', 2), ('3-MEDIUM', NULL, 'third', NULL, 3)"
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(modules, running_status, module_comment, old, row_no)")


def direct_feed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").selectExpr(
        "n_name AS supplier", "n_regionkey % 2 AS direct_feed", "n_nationkey AS row_no"
    )


def checked_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Parts after a run, with status texts of every class."""
    return parts(spark, folder).drop("status", "table_name", "prty").selectExpr(
        "*",
        f"{_status('id + file_id')} AS status",
        "CASE id % 4 WHEN 0 THEN 'not run' WHEN 1 THEN 'found' WHEN 2 THEN 'not found' END AS table_name",
        "CASE WHEN monitor_features != 'O' THEN concat('P', id % 3) END AS prty",
    )


# Registry side: one manufacturer per supplier, four known modules out of five.


def registry(spark: SparkSession, folder: str, with_labels: bool = True) -> DataFrame:
    rows = table(spark, folder, "lineitem").selectExpr(
        "cast(l_orderkey as string) AS pn", "l_suppkey AS man_id", "l_partkey % 5 AS mod_id",
        f"{_PRTY} AS prty", "l_partkey", *_REGISTRY_DATES,
        *([] if with_labels else ["cast(NULL as string) AS cs"]),
    )
    if not with_labels:
        return rows.drop("l_partkey")
    first, second = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
    labels = table(spark, folder, "part").selectExpr(
        "p_partkey AS l_partkey",
        f"CASE WHEN p_size % 10 != 0 THEN concat({first}, ' | ', {second}, '|', p_brand, '||', {first}) END AS cs",
    )
    return rows.join(labels, "l_partkey").drop("l_partkey")


def registry_feed(spark: SparkSession, folder: str) -> DataFrame:
    return _feed(table(spark, folder, "lineitem"), "l_suppkey", "l_partkey % 5")


def registry_modules(spark: SparkSession, folder: str) -> DataFrame:
    places = table(spark, folder, "supplier").selectExpr("s_suppkey", "explode(array(0L, 1L, 2L, 3L)) AS k")
    return places.selectExpr(
        "concat('M', s_suppkey % 7, '-', k) AS module_name", "s_suppkey AS man_id", "k AS module_id",
        "cast((s_suppkey + k) % 6 as int) AS run_flag",
    )


def manufacturer(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").selectExpr("s_suppkey AS man_id", "s_name AS man_name")


def lifecycle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        "component": table(spark, folder, "lineitem").selectExpr(
            "l_partkey AS com_id", "cast(l_orderkey as string) AS com_partnum", "l_suppkey AS man_id",
            "CASE WHEN l_linenumber = 5 THEN 'A)$.@(B' WHEN l_linenumber != 6 THEN cast(l_orderkey as string) END "
            "AS nan_partnum",
        ),
        "history": table(spark, folder, "part").selectExpr(
            "p_partkey AS com_id",
            "CASE WHEN p_size % 4 != 0 THEN 1 ELSE 0 END AS latest",
            f"CASE WHEN p_size % 7 != 0 THEN date_sub(DATE '{AS_OF}', p_size * 4) END AS last_checked_date",
            "CASE WHEN p_size % 3 != 0 THEN DATE '2000-01-01' END AS se_lc_date",
            "p_partkey % 25 AS lc_lookup_id",
        ),
        "lookup": table(spark, folder, "nation").selectExpr(
            "cast(n_nationkey as bigint) AS lc_lookup_id",
            "CASE n_nationkey % 3 WHEN 0 THEN 'Obsolete' WHEN 1 THEN 'LTB' ELSE 'Active' END AS se_lc",
            "cast(n_regionkey as bigint) AS source_reason_id",
        ),
        "reason": table(spark, folder, "region").selectExpr(
            "cast(r_regionkey as bigint) AS source_reason_id", "r_regionkey + 100L AS lc_src_id"
        ),
        "source": table(spark, folder, "region").selectExpr(
            "r_regionkey + 100L AS lc_src_id", "r_name AS lc_src_name"
        ),
    }


# Event side: both feeds, part details, and the logs.

EVENT_KEY = (
    "CASE WHEN user_id % 50 != 0 THEN concat('U', user_id) END AS mpn",
    "concat('M', user_id % 5) AS man",
    "concat('X', user_id % 3) AS module",
)


def import_feed(spark: SparkSession, folder: str, event_type: str) -> DataFrame:
    """The found feed (``view``) or the not-found feed (``signup``)."""
    place = f"(floor(value) % {len(IMPORT_TEXTS) + 1})"
    return table(spark, folder, "events").where(f"event_type = '{event_type}'").selectExpr(
        *EVENT_KEY,
        "CASE WHEN value >= 0.5D THEN date_format(ts, 'yyyy-MM-dd') END AS check_date",
        f"{_pick(IMPORT_TEXTS, place)} AS auto_imp_status",
    )


def part_details(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").where("event_type IN ('click', 'purchase', 'error')")
    return events.selectExpr(
        *EVENT_KEY,
        "CASE WHEN value >= 1 THEN 'P1' END AS priority",
        "props AS online_link",
        f"{_pick(('Found', 'not found', 'FOUND'), '(event_id % 4)')} AS status",
        "cast(NULL as string) AS found_part",
        "date_format(ts, 'dd-MMM-yyyy') AS sys_date",
    )


def activity_log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "ts AS timestamp",
        "concat('user', user_id) AS username",
        "CASE event_type WHEN 'click' THEN 'LOGIN' WHEN 'error' THEN 'LOGIN_FAILED' WHEN 'view' THEN 'FILE_UPLOAD' "
        "WHEN 'signup' THEN 'PERMISSION_DENIED' ELSE 'RAW_DOWNLOAD' END AS action",
        "props AS details",
        "concat('10.0.0.', user_id % 256) AS ip_address",
    )


def process_log(spark: SparkSession, folder: str) -> DataFrame:
    message = (
        "CASE event_type WHEN 'click' THEN concat('PROCESS START: job', user_id % 3) "
        "WHEN 'purchase' THEN concat('PROCESS END: job', user_id % 3, ' - SUCCESS') "
        "WHEN 'error' THEN concat('PROCESS END: job', user_id % 3, ' - FAILED') "
        "WHEN 'view' THEN concat('STEP: job', user_id % 3) "
        "ELSE concat('Status query completed in ', cast(value as decimal(18, 2)), ' seconds') END"
    )
    return table(spark, folder, "events").selectExpr(
        "ts AS timestamp",
        "concat('proc_', user_id % 12) AS parent_process",
        "event_type AS subprocess",
        "CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level",
        f"{message} AS message",
        "props AS details",
    )
