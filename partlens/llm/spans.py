"""Spans of pattern matches in whole texts, as SQL expressions: start, end (exclusive) in code points and value.

Patterns are Java regular expressions. Loops over groups are possessive and long runs start at their first character,
so that very long texts neither overflow the matcher's stack nor cost more than one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH = "array<struct<start:bigint,end:bigint,value:string>>"
SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of ``pattern``; none for a NULL text.

    The text between two matches is what ``split`` returns, so lengths add up to positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x).cast("bigint"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(None).cast(MATCH).alias("out"))

    def step(state, item):
        begin = state["at"] + item["gap"]
        end = begin + F.char_length(item["value"])
        this = F.array(F.struct(begin.alias("start"), end.alias("end"), item["value"].alias("value")))
        more = F.concat(F.coalesce(state["out"], F.array().cast(MATCH)), this)
        return F.when(item["value"].isNull(), state).otherwise(F.struct(end.alias("at"), more.alias("out")))

    # The gap behind the last match is paired with NULL.
    pairs = F.zip_with(found, between, lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    spans = F.aggregate(pairs, start, step, lambda state: state["out"])
    return F.coalesce(F.when(text.rlike(pattern), spans), F.array().cast(MATCH))


def named(found: Column, kind: str, rank: int) -> Column:
    """Matches as spans of a kind; ``rank`` is the kind's place among spans of one start."""
    return F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end")
        ),
    )


def ordered(parts: Sequence[Column]) -> Column:
    return F.array_sort(F.concat(*parts))


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas; the empty string for none."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def digest(spans: Column) -> Column:
    return F.sha2(joined(spans).cast("binary"), 256)


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with every run of overlapping or touching spans replaced by ``mask``."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(runs, span):
        last = F.try_element_at(runs, F.lit(-1))
        this = F.struct(span["start"].alias("start"), span["end"].alias("end"))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        shorter = F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0)))
        return F.when(F.size(runs) == 0, F.array(this)).when(
            span["start"] <= last["end"], F.concat(shorter, F.array(wider))
        ).otherwise(F.concat(runs, F.array(this)))

    runs = F.aggregate(spans, none, step)
    # Each run with the end of the run before it, and one more entry for the rest of the text.
    zero = F.array(F.lit(0).cast("bigint"))
    pairs = F.zip_with(
        runs, F.concat(zero, F.transform(F.aggregate(spans, none, step), lambda run: run["end"])),
        lambda run, done: F.struct(run["start"].alias("start"), done.cast("int").alias("done")),
    )
    pieces = F.transform(
        pairs,
        lambda p: F.when(p["start"].isNull(), text.substr(p["done"] + 1, F.lit(2**31 - 1)))
        .otherwise(F.concat(text.substr(p["done"] + 1, p["start"].cast("int") - p["done"]), F.lit(mask))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(pieces, ""))
