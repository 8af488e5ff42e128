"""Schemas of the logical tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


STRING, LONG, INT, DATE, TIME = T.StringType(), T.LongType(), T.IntegerType(), T.DateType(), T.TimestampType()

PARTS = _schema(
    id=LONG, part=STRING, man=STRING, module=STRING, file_id=LONG, status=STRING, cm_date=STRING,
    last_run_date=DATE, table_name=STRING, features=STRING, monitor_features=STRING,
    prty=STRING, man_id=LONG, module_id=LONG,
)
UPLOADED_FILES = _schema(
    id=LONG, file_name=STRING, upload_date=DATE, last_check_date=DATE, stop_monitor_date=DATE
)
MAN_MODULES = _schema(module_name=STRING, man_id=LONG, module_id=LONG, run_flag=INT)
PRIORITY_PARTS = _schema(
    pn=STRING, man_id=LONG, mod_id=LONG, prty=STRING, cs=STRING, lrd=DATE, v_notfound_dat=DATE
)
NOTFOUND_FEED = _schema(mpn=STRING, man_id=LONG, mod_id=LONG, check_date=DATE, status=STRING)
FEATURES = _schema(man_id=LONG, module_id=LONG, part=STRING, feature_name=STRING, dat=DATE)
MANUFACTURER = _schema(man_id=LONG, man_name=STRING)
COMPONENT = _schema(com_id=LONG, com_partnum=STRING, man_id=LONG, nan_partnum=STRING)
LC_HISTORY = _schema(
    com_id=LONG, latest=INT, last_checked_date=DATE, se_lc_date=DATE, lc_lookup_id=LONG
)
LC_LOOKUP = _schema(lc_lookup_id=LONG, se_lc=STRING, source_reason_id=LONG)
LC_REASON = _schema(source_reason_id=LONG, lc_src_id=LONG)
LC_SOURCE = _schema(lc_src_id=LONG, lc_src_name=STRING)
MATRIX = _schema(modules=STRING, running_status=STRING, module_comment=STRING, old=STRING)
DIRECT_FEED = _schema(supplier=STRING, direct_feed=INT)
FEED_EXPORT = _schema(mpn=STRING, man=STRING, module=STRING, check_date=STRING, auto_imp_status=STRING)
PART_DETAILS = _schema(
    mpn=STRING, man=STRING, module=STRING, priority=STRING, online_link=STRING, status=STRING,
    found_part=STRING, sys_date=STRING,
)
ACTIVITY_LOG = _schema(timestamp=TIME, username=STRING, action=STRING, details=STRING, ip_address=STRING)
PROCESS_LOG = _schema(
    timestamp=STRING, parent_process=STRING, subprocess=STRING, level=STRING, message=STRING, details=STRING
)

# Columns a watch list must start with, and those it may add.
WATCHLIST_LEADING = ("part", "man", "module")
WATCHLIST_OPTIONAL = (
    "STATUS", "CM_DATE", "LAST_RUN_DATE", "TABLE_NAME", "Features", "monitor features",
)
