"""Personal data in whole texts by weak supervision, with SQL expressions only on the main path.

Candidates are the known forms (e-mail, IP address, card and phone number) and looser ones: spelled-out e-mail
addresses, phone numbers without a country code, digit groups as long as a card number. Labelers vote on each
candidate: form (regular expression), gazetteer (domains, country codes, issuers), context (words before it), check
(digit counts, Luhn, octets) and shape (what touches it). A vote is for (1), against (-1) or none (0).

Expectation-maximisation over the counts of vote patterns estimates how often each labeler is right for each kind,
without any label. Its posteriors are the soft labels of a logistic span classifier on the span's own features, fitted
to the counts of feature patterns. Both tables are bounded by the number of patterns, whatever the number of texts.
Looser candidates that the classifier accepts, and that do not fail their own check, are added; the known forms
always stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlens.llm.common import stored, without
from partlens.llm.spans import matches, ordered

KINDS = ("email", "ip", "card", "phone")
# The known forms. Loops are possessive and runs start at their first character, or where the last match
# ended, which finds the same matches in one pass.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Looser forms; bounded in length.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}"
             r"\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?|\x20at\x20[A-Za-z0-9-]{1,63}\x20dot\x20)"
             r"[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "phone": r"(?<![0-9+.-])(?<![0-9][\x20.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}"
             r"(?![\x20.-]?[0-9])",
}
# Gazetteers and context words.
DOMAINS = "com net org edu gov io de fr es at ch be eu info co uk us".split()
COUNTRIES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 81 86 91 351 352 353 358 420".split()
CONTEXT = {
    "email": r"(?i)(?:mail|contact|kontakt|correo|courriel|write to|reach)[^0-9]{0,20}$",
    "ip": r"(?i)(?:\bip\b|host|server|address|adresse|from|login)[^0-9]{0,20}$",
    "card": r"(?i)(?:card|karte|carte|tarjeta|visa|master|amex|credit|pay)[^0-9]{0,20}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|ruf|anruf|handy|llam|appel)[^0-9]{0,20}$",
}
AGAINST = r"(?i)(?:\bv|version|ver\.|section|chapter|page|isbn|no\.|nr\.|€|\$|#)\x20?$"
LABELERS = ("form", "gazetteer", "context", "check", "shape")
#: Characters before a span that context labelers read.
BEFORE = 40
#: Rounds of expectation-maximisation and of the classifier's gradient steps.
EM_ROUNDS, FIT_ROUNDS = 50, 300

_FOUND = "array<struct<start:bigint,end:bigint,value:string,kind:string,base:boolean,before:string,after:string>>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    figures = F.transform(F.filter(F.split(F.reverse(number), ""), lambda c: c != ""), lambda c: F.ascii(c) - 48)
    doubled = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def octets(value: Column) -> Column:
    """Whether all four parts of a dotted number are at most 255."""
    return F.forall(
        F.split(value, r"\."),
        lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("decimal(38,0)") <= 255, F.lit(False)),
    )


def _long_enough(value: Column, least: int, most: int) -> Column:
    return F.char_length(digits(value)).between(least, most)


def candidates(body: Column) -> Column:
    """All candidates of a text: span, value, kind, whether it is a known form, and what stands before and after.

    ``body`` should be a plain column.
    """

    def tagged(found, kind, base):
        return F.transform(found, lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), F.lit(kind).alias("kind"),
            base(m["value"]).alias("base"),
            body.substr(
                F.greatest(m["start"] - BEFORE, F.lit(0)).cast("int") + 1,
                F.least(m["start"], F.lit(BEFORE).cast("bigint")).cast("int"),
            ).alias("before"),
            body.substr(m["end"].cast("int") + 1, F.lit(2)).alias("after"),
        ))

    def never(value):
        return F.lit(False)

    parts = [
        tagged(matches(body, EMAIL), "email", lambda v: F.lit(True)),
        tagged(matches(body, IP), "ip", octets),
        tagged(matches(body, CARD), "card", lambda v: _long_enough(v, 12, 19) & luhn(digits(v))),
        tagged(matches(body, PHONE), "phone", lambda v: _long_enough(v, 9, 15)),
        *[tagged(matches(body, pattern), kind, never) for kind, pattern in LOOSE.items()],
    ]
    return F.concat(*[part.cast(_FOUND) for part in parts])


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(c: Column) -> list[Column]:
    """The votes on a candidate, in the order of ``LABELERS``."""
    kind, value, before, after = c["kind"], c["value"], c["before"], c["after"]
    number = digits(value)
    size = F.char_length(number)
    top = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1))
    country = [number.startswith(code) for code in COUNTRIES]
    known_country = country[0]
    for code in country[1:]:
        known_country = known_country | code
    form = _vote(c["base"], F.lit(False))
    gazetteer = (
        F.when(kind == "email", _vote(top.isin(*DOMAINS), ~top.rlike("^[a-z]{2,24}$")))
        .when(kind == "phone", _vote(value.startswith("+") & known_country, value.startswith("+")))
        .when(kind == "card", _vote(number.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"), F.lit(True)))
        .otherwise(_vote(number.rlike("^[1-9]"), number.startswith("0")))
    )
    cue = F.lit(False)
    for name, pattern in CONTEXT.items():
        cue = cue | ((kind == name) & before.rlike(pattern))
    context = _vote(cue, before.rlike(AGAINST))
    check = (
        F.when(kind == "card", _vote(size.between(12, 19) & luhn(number), F.lit(True)))
        .when(kind == "phone", _vote(size.between(9, 15), F.lit(True)))
        .when(kind == "ip", _vote(octets(value), F.lit(True)))
        .otherwise(_vote(value.rlike(r"\.[A-Za-z]{2,24}$"), F.lit(False)))
    )
    shape = _vote(
        before.rlike(r"(?:^|[\s(\[<:;,\"'])$") & after.rlike(r"^(?:$|[\s)\]>;,\"']|[.!?](?:\s|$))"),
        before.rlike(r"[A-Za-z0-9._/-]$") | after.rlike(r"^(?:[A-Za-z0-9_/-]|[.][0-9])"),
    )
    return [form, gazetteer, context, check, shape]


def features(c: Column) -> list[Column]:
    """The classifier's features of a span: small whole numbers of the span and its neighbours, no votes."""
    value = c["value"]
    size = F.char_length(digits(value))
    return [
        F.least(F.floor(size / 3), F.lit(6)).cast("int"),
        F.least(F.size(F.regexp_extract_all(value, F.lit(r"[\x20().-]+"), F.lit(0))), F.lit(4)).cast("int"),
        F.when(value.contains("@"), 2).when(value.startswith("+"), 1).otherwise(0),
        F.when(c["before"].rlike(r"[A-Za-z0-9._/-]$"), 1).otherwise(0),
        F.when(c["after"].rlike(r"^[A-Za-z0-9_/-]"), 1).otherwise(0),
        F.when(c["before"].rlike(AGAINST), 1).otherwise(0),
        F.when((c["kind"] == "card") & luhn(digits(value)), 1).otherwise(0),
        F.when(value.rlike(r"(?i)\(at\)|\[at\]|dot"), 1).otherwise(0),
    ]


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = EM_ROUNDS) -> dict:
    """Per kind the prior and each labeler's chance of every vote, given truth, by expectation-maximisation.

    ``patterns`` are (kind, votes, count); bounded by 3 ** labelers per kind.
    """
    learned = {}
    for kind in KINDS:
        own = [(v, n) for k, v, n in patterns if k == kind]
        sure = [1 / (1 + math.exp(-sum(v))) for v, _ in own]
        for _ in range(rounds):
            total = sum(n for _, n in own)
            yes = sum(p * n for p, (_, n) in zip(sure, own))
            prior = (yes + 1) / (total + 2)
            chance = {}
            for j in range(len(LABELERS)):
                for vote in (-1, 0, 1):
                    seen = [(p, n) for p, (v, n) in zip(sure, own) if v[j] == vote]
                    # The added counts keep a labeler from turning against its own meaning.
                    chance[j, vote, 1] = (sum(p * n for p, n in seen) + (4 if vote == 1 else 1)) / (yes + 6)
                    chance[j, vote, 0] = (sum((1 - p) * n for p, n in seen) + (4 if vote == -1 else 1)) / (total - yes + 6)
            learned[kind] = {"prior": prior, "chance": chance}
            sure = [posterior(learned[kind], v) for v, _ in own]
        learned.setdefault(kind, {"prior": 0.5, "chance": None})
    return learned


def posterior(kind_model: dict, vote: tuple[int, ...]) -> float:
    prior, chance = kind_model["prior"], kind_model["chance"]
    odds = math.log(prior / (1 - prior))
    if chance:
        odds += sum(math.log(chance[j, v, 1] / chance[j, v, 0]) for j, v in enumerate(vote))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def fit_classifier(rows: list[tuple[str, tuple[int, ...], float, float]], rounds: int = FIT_ROUNDS) -> dict:
    """Weights of a logistic classifier per (kind, feature, value), from (kind, features, positive, negative) counts."""
    weights: dict[tuple, float] = {}
    total = sum(p + n for _, _, p, n in rows) or 1.0
    for _ in range(rounds):
        step: dict[tuple, float] = {}
        size: dict[tuple, float] = {}
        for kind, values, p, n in rows:
            keys = [(kind, -1, 0), *[(kind, j, v) for j, v in enumerate(values)]]
            z = sum(weights.get(k, 0.0) for k in keys)
            guess = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            for k in keys:
                step[k] = step.get(k, 0.0) + p - (p + n) * guess
                size[k] = size.get(k, 0.0) + (p + n)
        for k, s in step.items():
            weights[k] = weights.get(k, 0.0) + 0.5 * (s - 1e-3 * total * weights.get(k, 0.0) / len(step)) / (size[k] + 1)
    return weights


def _accepted(c: Column, weights: dict) -> Column:
    """The classifier as an expression: whether a candidate's score is above zero."""
    score = F.lit(0.0)
    for j, feature in enumerate([F.lit(0), *features(c)], start=-1):
        values = {(k, v): w for (k, at, v), w in weights.items() if at == j}
        if values:
            term = F.lit(0.0)
            for (kind, v), w in sorted(values.items()):
                term = F.when((c["kind"] == kind) & (feature == v), F.lit(w)).otherwise(term)
            score = score + term
    return score > 0 if weights else F.lit(False)


def find_personal_data(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add ``base_personal`` (known forms) and ``personal`` (all): spans of start, rank, kind and end, in order.

    Positions are code points, end exclusive; kinds are email, ip, card and phone. NULL and empty texts have none.
    Rows are independent but for the reliabilities, which all rows' candidates give together; repeated rows get equal
    results. Columns of these names are replaced, others stay, the text only with ``keep_text``. An empty table gives
    no rows.
    """
    rows = without(docs, ["base_personal", "personal", "_body", "_found"]).withColumn(
        "_body", F.coalesce(F.col(text).cast("string"), F.lit(""))
    )
    held = stored(rows.withColumn("_found", candidates(F.col("_body"))).drop("_body", *([] if keep_text else [text])), "candidates")
    each = held.select(F.explode("_found").alias("c"))
    pattern = each.select(
        F.col("c.kind").alias("kind"), F.array(*votes(F.col("c"))).alias("votes"), F.array(*features(F.col("c"))).alias("features")
    )
    seen = pattern.groupBy("kind", "votes", "features").count().collect()  # bounded by the patterns there can be
    tally: dict[tuple, int] = {}
    for row in seen:
        key = (row["kind"], tuple(row["votes"]))
        tally[key] = tally.get(key, 0) + row["count"]
    model = reliabilities([(kind, vote, n) for (kind, vote), n in sorted(tally.items())])
    soft: dict[tuple, list[float]] = {}
    for row in seen:
        p = posterior(model[row["kind"]], tuple(row["votes"]))
        both = soft.setdefault((row["kind"], tuple(row["features"])), [0.0, 0.0])
        both[0] += p * row["count"]
        both[1] += (1 - p) * row["count"]
    weights = fit_classifier([(kind, f, p, n) for (kind, f), (p, n) in sorted(soft.items())])
    rank = {kind: i for i, kind in enumerate(KINDS)}

    def spans(found):
        def place(m):
            order = F.lit(0)
            for kind, i in rank.items():
                order = F.when(m["kind"] == kind, i).otherwise(order)
            return F.struct(m["start"].alias("start"), order.alias("rank"), m["kind"].alias("kind"), m["end"].alias("end"))

        return F.transform(found, place)

    base = F.filter("_found", lambda m: m["base"])
    more = F.filter("_found", lambda m: ~m["base"] & (votes(m)[LABELERS.index("check")] >= 0) & _accepted(m, weights))
    marked = held.withColumn("base_personal", ordered([spans(base)])).withColumn("_more", spans(more))
    new = F.filter(
        "_more", lambda s: ~F.exists("base_personal", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    )
    return marked.withColumn("personal", F.array_distinct(ordered([F.col("base_personal"), new]))).drop("_found", "_more")
