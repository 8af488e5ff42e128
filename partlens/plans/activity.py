"""Activity and process logs."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlens.functions import classify
from partlens.functions.dates import moment
from partlens.functions.figures import percentage, sum_where
from partlens.operators.sequence import with_next

# How many entries the log view keeps and shows.
KEPT_ENTRIES = 1000
SHOWN_ENTRIES = 50

# Process log message formats.
START_MARK = "PROCESS START: "
END_MARK = "PROCESS END: "
END_OUTCOMES = ("SUCCESS", "FAILED")
STEP_MARK = "STEP: "
ERROR_MARK = "ERROR in "
SECONDS_PATTERN = r"(?:completed|updated|processing .*) in ([0-9]+\.[0-9]{2}) seconds"


def recent_entries(log: DataFrame, k: int = SHOWN_ENTRIES) -> DataFrame:
    """The newest ``k`` entries, newest first."""
    return log.orderBy(F.desc("timestamp"), "username", "action", "details").limit(k)


def security_figures(log: DataFrame, as_of: datetime) -> DataFrame:
    """Entries, security events, and users who logged in during the hour before ``as_of``."""
    recent_login = (F.col("timestamp") > moment(as_of - timedelta(hours=1))) & (
        F.col("action") == "LOGIN"
    )
    return log.agg(
        F.count("*").alias("total_logs"),
        F.count_if(classify.security_action(F.col("action"))).alias("security_events"),
        F.count_distinct(F.when(recent_login, F.col("username"))).alias("active_users"),
    )


def hourly_figures(log: DataFrame) -> DataFrame:
    """Security events and distinct logged-in users per clock hour."""
    return log.groupBy(F.date_trunc("hour", "timestamp").alias("hour")).agg(
        F.count("*").alias("total_logs"),
        F.count_if(classify.security_action(F.col("action"))).alias("security_events"),
        F.count_distinct(F.when(F.col("action") == "LOGIN", F.col("username"))).alias("active_users"),
    )


def parsed_log(log: DataFrame) -> DataFrame:
    """Process log with the kind of each message and the parts it carries."""
    message = F.col("message")
    outcome = F.substring_index(message, " - ", -1)
    ended = message.startswith(END_MARK) & outcome.isin(*END_OUTCOMES)
    kind = (
        F.when(message.startswith(START_MARK), "START")
        .when(ended, "END")
        .when(message.startswith(STEP_MARK), "STEP")
        .when(message.startswith(ERROR_MARK) & message.contains(": "), "ERROR")
        .otherwise("INFO")
    )

    def after(mark: str):
        return F.substr(message, F.lit(len(mark) + 1))

    named = after(END_MARK)
    subject = (
        F.when(F.col("kind") == "START", after(START_MARK))
        .when(F.col("kind") == "END", F.substr(named, F.lit(1), F.length(named) - F.length(outcome) - 3))
        .when(F.col("kind") == "STEP", after(STEP_MARK))
        .when(F.col("kind") == "ERROR", F.substring_index(after(ERROR_MARK), ": ", 1))
    )
    seconds = F.nullif(F.regexp_extract(message, SECONDS_PATTERN, 1), F.lit("")).cast("decimal(18,2)")
    return log.withColumn("kind", kind).select(
        "*", subject.alias("subject"), F.when(F.col("kind") == "END", outcome).alias("outcome"),
        F.when(F.col("kind") == "INFO", seconds).alias("seconds"),
    )


def step_seconds(log: DataFrame) -> DataFrame:
    """Timed steps per process: how many, and their total and longest seconds."""
    timed = parsed_log(log).where(F.col("seconds").isNotNull())
    return timed.groupBy("parent_process").agg(
        F.count("*").alias("timed_steps"),
        F.sum("seconds").cast("decimal(28,2)").alias("total_seconds"),
        F.max("seconds").alias("longest_seconds"),
    )


def message_counts(log: DataFrame) -> DataFrame:
    return parsed_log(log).groupBy("parent_process", "kind").agg(F.count("*").alias("value"))


def process_runs(log: DataFrame, slot: str = "minute") -> DataFrame:
    """Each START with what follows it: ``runs`` alike START records per row.

    A run has ended only when the next lifecycle record is an END; a START
    followed by another START, or by nothing, is unfinished. At one instant
    STARTs come before ENDs. Records of one instant are counted together
    before anything is put in order, so repeated records cost nothing.
    """
    marks = parsed_log(log).where(F.col("kind").isin("START", "END"))
    key = ["parent_process", "subject"]
    instants = marks.groupBy(*key, "timestamp").agg(
        F.count_if(F.col("kind") == "START").alias("starts"), F.min("outcome").alias("outcome")
    )
    following = with_next(instants, key, "timestamp", [], ["timestamp", "starts", "outcome"], slot)
    here = F.col("outcome").isNotNull()
    there = F.coalesce(F.col("next.starts") == 0, F.lit(False))
    ended = F.when(here, F.col("timestamp")).when(there, F.col("next.timestamp"))
    outcome = F.when(here, F.col("outcome")).when(there, F.col("next.outcome")).otherwise("UNFINISHED")
    last = F.struct(ended.alias("ended"), outcome.alias("outcome"), F.lit(1).cast("bigint").alias("runs"))
    earlier = F.struct(
        F.lit(None).alias("ended"), F.lit("UNFINISHED").alias("outcome"), (F.col("starts") - 1).alias("runs")
    )
    rows = following.where(F.col("starts") > 0).select(
        *key, F.col("timestamp").alias("started"), F.inline(F.array(last, earlier))
    )
    micros = F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))
    return rows.where(F.col("runs") > 0).groupBy(*key, "started", "ended", "outcome").agg(
        F.sum("runs").alias("runs")
    ).withColumn("micros", micros)


def process_durations(runs: DataFrame) -> DataFrame:
    """Runs per process: counts, share of successes, longest and total time."""
    count, outcome = F.col("runs"), F.col("outcome")
    sums = runs.groupBy("parent_process", "subject").agg(
        F.sum(count).alias("runs"),
        sum_where(outcome == "SUCCESS", count).alias("succeeded"),
        sum_where(outcome == "FAILED", count).alias("failed"),
        sum_where(outcome == "UNFINISHED", count).alias("unfinished"),
        F.coalesce(F.sum(F.col("micros") * count), F.lit(0)).alias("total_micros"),
        F.coalesce(F.max("micros"), F.lit(0)).alias("longest_micros"),
    )
    return sums.select("*", percentage(F.col("succeeded"), F.col("runs")).alias("success_percentage"))
