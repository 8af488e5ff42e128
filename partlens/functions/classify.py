"""First-match classification rules as ``when`` chains.

All rules are case-sensitive unless said otherwise; the order of the branches
is part of each rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from partlens.functions.dates import EPOCH_1970
from partlens.functions.text import or_dash

# Whole status texts that blame the site.
SITE_TEXTS = (
    "Output Pattern not found",
    "Link Step have no links",
    "Error in loading page :404",
)

# Run flag codes.
RUN_FLAGS = {
    0: "Stopped",
    1: "Regular Running",
    2: "Run By Request",
    3: "schedule Running",
    4: "schedule Running",
}

# The statuses counted as errors in each set of figures.
MODULE_ERROR_STATUSES = ("Error", "Proxy")
FILE_ERROR_STATUSES = ("Error", "Exception", "Proxy", "Incomplete")

# Upper bounds of the colour bands.
BAND_RED_BELOW = 40
BAND_ORANGE_BELOW = 70


def _mentions(text: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(word) for word in words])


def part_class(
    module_known: Column,
    stored_status: Column,
    part_registered: Column,
    never_run: Column,
    found_later: Column,
) -> Column:
    """Status of a watched part from what the registry holds about it."""
    return (
        F.when(~module_known | F.coalesce(stored_status == "not_valid", F.lit(False)), "not_valid")
        .when(~F.coalesce(part_registered, F.lit(False)), "not SE part")
        .when(F.coalesce(never_run, F.lit(False)), "not run")
        .when(F.coalesce(found_later, F.lit(False)), "found")
        .otherwise("not found")
    )


def registry_status(found_date: Column, notfound_date: Column) -> Column:
    """Found or not found by the later date; equal dates are NULL unless both are the sentinel."""
    return (
        F.when(notfound_date > found_date, "not found")
        .when(found_date > notfound_date, "found")
        .when((found_date == F.lit(EPOCH_1970)) & (notfound_date == F.lit(EPOCH_1970)), "not run")
    )


def last_registry_date(found_date: Column, notfound_date: Column) -> Column:
    """The later of the two dates, NULL when they are equal."""
    return F.when(found_date != notfound_date, F.greatest(found_date, notfound_date))


def registry_error(feed_status: Column, status: Column) -> Column:
    """Error class of a registry row; found rows have none."""
    return (
        F.when(status == "found", "")
        .when(feed_status.contains("403"), "Proxy")
        .when(feed_status.isin(*SITE_TEXTS), "SITE")
        .when(feed_status.contains("Not Found"), "Not Found")
        .when(_mentions(feed_status, "Error", "Incomplete"), "Proxy")
        .when(_mentions(feed_status, "Exception", "java"), "SW")
        .when(feed_status.contains("found"), "")
        .otherwise("not assigned error")
    )


def simple_class(status: Column) -> Column:
    """Proxy, Error, or the status itself; NULL is a dash."""
    return or_dash(simple_category(status))


def simple_category(status: Column) -> Column:
    """As ``simple_class`` but a missing status stays missing."""
    return (
        F.when(status.contains("403"), "Proxy")
        .when(_mentions(status, "Error", "Exception", "Incomplete"), "Error")
        .otherwise(status)
    )


def watch_class(status: Column) -> Column:
    """Class of a watch-list status text."""
    return (
        F.when(status.isNull() | status.isin("", "nan"), "not run")
        .when(status.isin(*SITE_TEXTS), "SITE")
        .when(status.contains("Not Found"), "Not Found")
        .when(status.contains("found"), "found")
        .when(_mentions(status, "Error", "Incomplete"), "Proxy")
        .when(_mentions(status, "Exception", "java"), "SW")
        .when(status.contains("-"), "-")
        .otherwise("not assigned error")
    )


def run_state(flag: Column) -> Column:
    """Name of a run flag code."""
    chain = reduce(
        lambda acc, item: acc.when(flag == item[0], item[1]),
        list(RUN_FLAGS.items())[1:],
        F.when(flag == 0, RUN_FLAGS[0]),
    )
    return chain.otherwise("Unknown")


def import_class(auto_status: Column, absent: Column, knows_not_imported: bool) -> Column:
    """Import state of a feed row; empty when it carries no status or was not received."""
    chain = F.when(auto_status.isNull() | absent, "").when(auto_status == "In Progress", "In Progress")
    if knows_not_imported:
        chain = chain.when(auto_status.contains("Not Imported"), "Not Imported")
    return chain.otherwise("Imported")


def report_label(import_state: Column) -> Column:
    return F.when(import_state == "", "NotReceived").otherwise(import_state)


def report_category(label: Column, table: Column) -> Column:
    return F.concat(label, F.when(table == "found", " found").otherwise(" NotFound"))


def details_status(status: Column) -> Column:
    """``found`` in any case is found; everything else, NULL included, is not found."""
    return F.when(F.lower(status) == "found", "found").otherwise("not found")


def colour_band(percent: Column) -> Column:
    return (
        F.when(percent < BAND_RED_BELOW, "red")
        .when(percent < BAND_ORANGE_BELOW, "orange")
        .otherwise("green")
    )


def security_action(action: Column) -> Column:
    return _mentions(action, "FAILED", "DENIED")
