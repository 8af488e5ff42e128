"""Activity figures per hour over a stream of log entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from partlens.functions import classify


def hourly_activity(entries: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Entries, security events and logged-in users per window, each exact; for append mode.

    Two stateful steps: figures per (window, user) first, so a user counts once however often it logs in, then per
    window. The state holds the users of the windows that the watermark has not closed; a window comes out once it is
    closed, and entries later than ``late`` behind it are left out, as in any stream.
    """
    per_user = (
        entries.withWatermark("timestamp", late)
        .groupBy(F.window("timestamp", width).alias("span"), "username")
        .agg(
            F.count("*").alias("entries"),
            F.count_if(classify.security_action(F.col("action"))).alias("events"),
            F.max((F.col("action") == "LOGIN").cast("int")).alias("logged_in"),
        )
    )
    # A NULL name is no user, as in a distinct count.
    user = F.coalesce(F.col("logged_in") == 1, F.lit(False)) & F.col("username").isNotNull()
    return (
        per_user.groupBy(F.window("span", width).alias("hours"))
        .agg(
            F.sum("entries").alias("total_logs"), F.sum("events").alias("security_events"),
            F.count_if(user).alias("active_users"),
        )
        .select(F.col("hours.start").alias("hour"), "total_logs", "security_events", "active_users")
    )


def start_hourly_activity(
    entries: DataFrame, path: str, checkpoint: str, late: str = "10 minutes", width: str = "1 hour"
) -> StreamingQuery:
    """Closed windows appended to Parquet files under ``path``, each exactly once; runs until the input is used up."""
    return (
        hourly_activity(entries, late, width)
        .writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
