"""Label lists, name patterns and small text rules."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: date and hour slot inside an export file name.
SLOT_PATTERN = r"(\d{2}-[A-Za-z]{3}-\d{4})_(\d{2}_[APM]{2})"
# Fixed value: date alone inside an export file name.
DAY_PATTERN = r"\d{2}-[A-Za-z]{3}-\d{4}"


def label_list(packed: Column) -> Column:
    """``'a | b||a'`` -> ``['a', 'b']``; NULL gives an empty list."""
    parts = F.transform(F.split(F.coalesce(packed, F.lit("")), "[|]"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def has_label_word(packed: Column, labels: Iterable[str]) -> Column:
    """Any label present as a whole word; labels are quoted the way Java patterns are."""
    quoted = ["\\Q" + label.replace("\\E", "\\E\\\\E\\Q") + "\\E" for label in labels]
    return F.coalesce(packed, F.lit("")).rlike("\\b(?:" + "|".join(quoted) + ")\\b")


def has_label_text(packed: Column, labels: Iterable[str]) -> Column:
    """Any label present as a piece of the text."""
    return reduce(lambda a, b: a | b, [packed.contains(label) for label in labels])


def has_label(packed: Column, labels: Iterable[str]) -> Column:
    """Any label present as a member of the list."""
    return F.arrays_overlap(label_list(packed), F.array(*[F.lit(label) for label in labels]))


def label_flag(packed: Column, label: str) -> Column:
    """1 when the list holds ``label``, else 0."""
    return F.array_contains(label_list(packed), label).cast("int")


def or_dash(text: Column) -> Column:
    return F.coalesce(text, F.lit("-"))


def unquoted(text: Column) -> Column:
    """Text without double quotes; a missing value is a dash."""
    return or_dash(F.replace(text, F.lit('"'), F.lit("")))


def upload_priority(part: Column) -> Column:
    """``P0`` for links, ``P1`` for plain part numbers, NULL for no part."""
    return F.when(part.contains("http"), F.lit("P0")).when(part.isNotNull(), F.lit("P1"))


def slot_of_name(name: Column) -> Column:
    """``dd-MMM-yyyy_hh_AM`` found in a file name, else NULL."""
    return F.nullif(F.regexp_extract(name, SLOT_PATTERN, 0), F.lit(""))


def day_of_name(name: Column) -> Column:
    """The day found in a file name, else NULL."""
    return F.try_to_date(F.nullif(F.regexp_extract(name, DAY_PATTERN, 0), F.lit("")), "dd-MMM-yyyy")
