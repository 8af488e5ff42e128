"""Secrets in whole texts, by SQL expressions only: known forms, and strings whose characters look drawn at random.

The second part slides a window over candidate strings of a character class. Character counts change by one character
in and one out per step, and with them the sum of c * log2(c) that the window's Shannon entropy needs. Windows at or
above the class's threshold are joined to spans. What the allow list matches is cut out of a candidate, the pieces on
both sides are searched; rules with ^ or $ pass over the whole candidate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlens.llm.common import without
from partlens.llm.spans import matches, named, ordered

# The known forms. A dropped match is not searched again.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
# Runs of fewer characters would be dropped whole, so the least length stands in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Character classes: name, characters, pattern of a candidate (a maximal run), entropy in bits that makes a window suspect.
WINDOW = 20
CLASSES = (
    ("hex", "0123456789abcdefABCDEF", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{20,}+(?![0-9A-Za-z])", 3.0),
    (
        "base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=",
        r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}+", 4.0,
    ),
)
#: Strings that only look like secrets: placeholders, alphabets, digit series, UUIDs.
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]?key",
    r"(?i)abcdefgh|01234567|12345678|deadbeef",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
)


def suspect_windows(value: Column, characters: str, threshold: float, window: int = WINDOW) -> Column:
    """Spans (start, end) inside ``value`` covered by windows whose entropy reaches ``threshold``.

    A window must also hold a digit and a letter.
    """
    spans_type = "array<struct<start:bigint,end:bigint>>"
    codes = F.transform(
        F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(characters), c)
    )
    # Each step takes one character in and, once the window is full, one out.
    steps = F.zip_with(
        codes, F.slice(F.concat(F.array_repeat(F.lit(0), window), codes), F.lit(1), F.char_length(value)),
        lambda code, gone: F.struct(code.alias("code"), gone.alias("gone")),
    )
    steps = F.transform(steps, lambda s, i: F.struct(s["code"].alias("code"), s["gone"].alias("gone"), i.alias("i")))
    first_digit, last_digit = characters.index("0") + 1, characters.index("9") + 1

    def term(count):
        return F.when(count <= 1, F.lit(0.0)).otherwise(count * F.log2(count.cast("double")))

    def put(counts, code, by):
        return F.concat(
            F.slice(counts, F.lit(1), code - 1), F.array(F.get(counts, code - 1) + by),
            F.slice(counts, code + 1, F.lit(len(characters))),
        )

    def is_digit(code):
        return F.when(code.between(first_digit, last_digit), 1).otherwise(0)

    start = F.struct(
        F.array_repeat(F.lit(0), len(characters)).alias("counts"), F.lit(0.0).alias("total"),
        F.lit(0).alias("digits"), F.array().cast(spans_type).alias("out"),
    )

    def step(state, item):
        code, gone, i = item["code"], item["gone"], item["i"]
        had = F.get(state["counts"], code - 1)
        grown = put(state["counts"], code, 1)
        leaving = F.get(grown, gone - 1)
        full = i >= window
        counts = F.when(full, put(grown, gone, -1)).otherwise(grown)
        total = state["total"] - term(had) + term(had + 1) + F.when(full, term(leaving - 1) - term(leaving)).otherwise(0.0)
        digits = state["digits"] + is_digit(code) - F.when(full, is_digit(gone)).otherwise(0)
        entropy = F.lit(math.log2(window)) - total / window
        begin, end = (i - window + 1).cast("bigint"), (i + 1).cast("bigint")
        suspect = (i >= window - 1) & (F.round(entropy, 9) >= threshold) & digits.between(1, window - 1)
        last = F.try_element_at(state["out"], F.lit(-1))
        touching = F.coalesce(last["end"] >= begin, F.lit(False))
        this = F.array(F.struct(F.when(touching, last["start"]).otherwise(begin).alias("start"), end.alias("end")))
        before = F.when(touching, F.slice(state["out"], F.lit(1), F.size(state["out"]) - 1)).otherwise(state["out"])
        out = F.when(suspect, F.concat(before, this)).otherwise(state["out"])
        return F.struct(counts.alias("counts"), total.alias("total"), digits.alias("digits"), out.alias("out"))

    return F.aggregate(steps, start, step, lambda state: state["out"])


def _entropy_spans(body: Column, characters: str, pattern: str, threshold: float, allowed: Sequence[str]) -> Column:
    """Suspect windows of one character class that touch nothing the allow list matches."""
    whole = [rule for rule in allowed if "^" in rule or "$" in rule]
    parts = "|".join(f"(?:{rule})" for rule in allowed if rule not in whole)

    def listed(match):
        return F.lit(False) if not whole else F.array_max(F.array(*[match["value"].rlike(rule) for rule in whole]))

    def pieces(match):
        begin, value = match["start"], match["value"]
        if not parts:
            return F.array(F.struct(begin.alias("start"), value.alias("value")))
        cut = matches(value, parts)
        zero, size = F.lit(0).cast("bigint"), F.char_length(value).cast("bigint")
        between = F.zip_with(
            F.concat(F.array(zero), F.transform(cut, lambda c: c["end"])),
            F.concat(F.transform(cut, lambda c: c["start"]), F.array(size)),
            lambda a, b: F.struct(
                (begin + a).alias("start"), F.substr(value, (a + 1).cast("int"), (b - a).cast("int")).alias("value")
            ),
        )
        return F.filter(between, lambda piece: F.char_length(piece["value"]) >= WINDOW)

    def placed(piece):
        return F.transform(
            suspect_windows(piece["value"], characters, threshold),
            lambda s: F.struct(
                (piece["start"] + s["start"]).alias("start"), F.lit(3).alias("rank"), F.lit("entropy").alias("kind"),
                (piece["start"] + s["end"]).alias("end"),
            ),
        )

    candidates = F.filter(matches(body, pattern), lambda m: ~listed(m))
    return F.flatten(F.transform(F.flatten(F.transform(candidates, pieces)), placed))


def find_secrets(docs: DataFrame, text: str = "text", allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """Add ``base_secrets`` and ``secrets`` (all): spans of start, rank, kind and end in code points, in order.

    Kinds: assign, access, hex (known forms), entropy (windows not inside a known form). NULL and empty texts have
    none. Rows are independent, repeated rows get equal results; columns of these names are replaced, others stay.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    assign = F.filter(
        matches(body, ASSIGN), lambda m: F.char_length(F.regexp_extract(m["value"], ASSIGN, 1)) >= ASSIGN_LEAST
    )
    base = without(docs, ["base_secrets", "secrets", "_more"]).withColumn(
        "base_secrets",
        ordered([named(assign, "assign", 0), named(matches(body, ACCESS), "access", 1), named(matches(body, HEX), "hex", 2)]),
    )
    found = [_entropy_spans(body, characters, pattern, threshold, allowed) for _, characters, pattern, threshold in CLASSES]
    held = base.withColumn("_more", F.array_distinct(F.concat(*found)))
    new = F.filter(
        "_more",
        lambda s: ~F.exists("base_secrets", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])),
    )
    return held.withColumn("secrets", ordered([F.col("base_secrets"), new])).drop("_more")
