"""Quality classifier: perplexities under interpolated modified Kneser-Ney models of trusted text.

A text is seen in two ways, each with a trigram model of its own: as its characters, and as the shapes of its words
(length, case, what it ends with, and whether it is the word before it once more). The first knows spelling, the second
running text: a word that is looped has ordinary characters and an improbable row of shapes. A sequence has two start
marks and one end mark. Every order is a table of counts that joins by n-gram give discounts, back-off weights and
probabilities; no table goes to a driver or a task whole. Documents are scored in blocks: a block's distinct n-grams
are joined to the probabilities.

Thresholds are quantiles of trusted documents that the models were not trained on, per language and length, as short
texts vary more.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partlens.llm.blocks import numbered, pack, returned, symbols, unpack
from partlens.llm.common import BROADCAST_KEYS, bounded_batches, stored

#: Marks before and after a text; a character of that code in a text counts as the mark.
START, END = 2, 3
#: Text per block, and characters that are counted at once.
BLOCK_BYTES, PIECE = 4_000_000, 500_000
#: Up to so many possible trigrams of the characters in use are counted by position, beyond that by sorting.
BY_PLACE = 1 << 22
#: Share of trusted documents at or under their threshold, in each view.
QUANTILE = 0.998
#: One trusted document in so many is left out of training and used for the thresholds.
LEFT_OUT = 5
#: Tokens at which a text counts as longer, and trusted documents that a group needs for a threshold of its own.
BANDS, LEAST = (64, 256, 1024), 100
# What a document is to the models: learned from, left out to judge by, or neither.
LEARN, JUDGE, OTHERS = 0, 1, 2
#: Shapes of words: once more the word before it, the word two before it, and all others from here on.
AGAIN, SECOND, SHAPES = 4, 5, 6


def shape(word: str) -> int:
    """The shape of a word: short, middling or long; lower, title, upper case or another mixture; what it ends with.

    Few shapes, so that a row of them says how a text runs and not which words it has.
    """
    size, last = len(word), word[-1]
    length = 0 if size < 4 else 1 if size < 10 else 2
    plain = all(c.isalpha() or c in "'-.," for c in word[:-1])
    case = 3 if not plain else 0 if word.islower() else 2 if word.isupper() and size > 1 else 1 if word.istitle() else 3
    end = 0 if last.isalpha() else 1 if last in ".,;:!?" else 2
    return SHAPES + (length * 4 + case) * 3 + end


def _characters(texts: list[str]) -> list[np.ndarray]:
    return [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]


def _shapes(texts: list[str]) -> list[np.ndarray]:
    number: dict[str, int] = {}
    shapes: list[int] = []
    out = []
    for text in texts:
        words = text.split()
        for w in words:
            if w not in number:
                number[w] = len(shapes)
                shapes.append(shape(w))
        index = np.array([number[w] for w in words], np.int64)
        codes = np.array([shapes[i] for i in index.tolist()], np.uint32)
        codes[2:][index[2:] == index[:-2]] = SECOND
        codes[1:][index[1:] == index[:-1]] = AGAIN
        out.append(codes)
    return out


#: How a text becomes the numbers that are predicted, by the name of the view.
VIEWS = {"characters": _characters, "shapes": _shapes}


def _pieces(sequences: list[np.ndarray]):
    """Runs of (text number, part of the framed sequence) of about ``PIECE`` symbols.

    Parts of a longer sequence overlap by two symbols, so each of its trigrams begins in one part.
    """
    run, size = [], 0
    marks = np.array([START, START, END], np.uint32)
    for i, sequence in enumerate(sequences):
        framed = np.concatenate([marks[:2], sequence, marks[2:]])
        for begin in range(0, len(framed) - 2, PIECE):
            run.append((i, framed[begin : begin + PIECE + 2]))
            size += len(run[-1][1])
            if size >= PIECE:
                yield run
                run, size = [], 0
    if run:
        yield run


def _counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct trigrams, then per part: number, places and counts of its distinct trigrams)."""
    sizes = np.array([len(part) for part in parts], np.int64)
    code = np.concatenate(parts)
    # Dense numbers for the few symbols in use keep trigrams countable by position.
    used = np.flatnonzero(np.bincount(code))
    dense = np.zeros(used[-1] + 1, np.int64)
    dense[used] = np.arange(len(used))
    d, k = dense[code], len(used)
    gram = d[:-2] * (k * k) + d[1:-1] * k + d[2:]
    ends = np.cumsum(sizes)
    inside = np.ones(len(code), bool)
    inside[ends - 1] = inside[ends - 2] = False
    gram = gram[inside[: len(gram)]]
    if k**3 <= BY_PLACE:
        present = np.flatnonzero(np.bincount(gram))
        place = np.zeros(present[-1] + 1, np.int32)
        place[present] = np.arange(len(present))
        at = place[gram]
    else:
        present, at = np.unique(gram, return_inverse=True)
    at = at.astype(np.uint16 if len(present) <= 1 << 16 else np.int32)
    bounds = np.concatenate([[0], np.cumsum(sizes - 2)])
    held, places, counts = [], [], []
    for a, b in zip(bounds[:-1], bounds[1:]):
        own = np.sort(at[a:b], kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        held.append(len(edge))
        places.append(own[edge])
        counts.append(np.diff(np.append(edge, len(own))))
    grams = (used[present // (k * k)] << 42) | (used[present // k % k] << 21) | used[present % k]
    return grams, np.array(held), np.concatenate(places).astype(np.int32), np.concatenate(counts).astype(np.int32)


def _trigrams(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct trigrams, then per text: offsets, places of its distinct trigrams, their counts).

    Counting goes piece by piece, so memory follows the distinct trigrams of the texts and not their length.
    """
    owners, found = [], []
    for run in _pieces(sequences):
        owners.append(np.array([i for i, _ in run]))
        found.append(_counted([part for _, part in run]))
    grams = np.unique(np.concatenate([g for g, _, _, _ in found]))
    places = np.concatenate([np.searchsorted(grams, g)[p].astype(np.int32) for g, _, p, _ in found])
    counts = np.concatenate([c for _, _, _, c in found])
    owner = np.repeat(np.concatenate(owners), np.concatenate([held for _, held, _, _ in found]))
    if any(len(sequence) + 1 > PIECE for sequence in sequences):
        # Parts of one text may share trigrams: put each text's in order and add up equal ones.
        order = np.lexsort((places, owner))
        owner, places, counts = owner[order], places[order], counts[order]
        first = np.concatenate([[True], (owner[1:] != owner[:-1]) | (places[1:] != places[:-1])])
        counts = np.add.reduceat(counts, np.flatnonzero(first)).astype(np.int32)
        owner, places = owner[first], places[first]
    ends = np.searchsorted(owner, np.arange(len(sequences) + 1))
    return grams, ends, places, counts


def _steps(ends: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The rising places of each text as steps from one to the next."""
    steps = np.diff(places, prepend=0)
    steps[ends[:-1]] = places[ends[:-1]]
    return steps


def _places(ends: np.ndarray, steps: np.ndarray) -> np.ndarray:
    along = np.cumsum(steps)
    return along - np.repeat(along[ends[:-1]] - steps[ends[:-1]], np.diff(ends))


def _blocks(docs: DataFrame, view: str) -> DataFrame:
    """Block rows of documents (doc_id, lang, row_key, role, text); ``n`` counts the trigrams of texts to learn from."""
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("doc_ids", T.ArrayType(docs.schema["doc_id"].dataType)),
        T.StructField("langs", T.ArrayType(T.StringType())), T.StructField("keys", longs),
        T.StructField("roles", T.ArrayType(T.IntegerType())), T.StructField("lengths", longs),
        T.StructField("grams", longs), T.StructField("n", longs), T.StructField("packed", T.BinaryType()),
    ])

    def run(batches):
        import pyarrow as pa

        def one(values, kind):
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))

        for block, batch in numbered(batches, BLOCK_BYTES):
            sequences = VIEWS[view]([t or "" for t in batch.column(4).to_pylist()])
            grams, ends, places, counts = _trigrams(sequences)
            learned = np.repeat(batch.column(3).to_numpy(zero_copy_only=False) == LEARN, np.diff(ends))
            n = np.bincount(places[learned], counts[learned], len(grams)).astype(np.int64)
            columns = [batch.column(i) for i in range(4)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
            lengths = np.array([len(sequence) + 1 for sequence in sequences], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), *lists, one(lengths, pa.int64()), one(grams, pa.int64()),
                 one(n, pa.int64()), pa.array([pack(ends, _steps(ends, places), counts)], pa.binary())],
                names=schema.names,
            )

    return docs.select("doc_id", "lang", "row_key", "role", "text").mapInArrow(run, schema)


def _discounts(counts: DataFrame, n: str) -> dict[int, float]:
    """The three discounts of modified Kneser-Ney from the numbers of n-grams seen one to four times."""
    row = counts.agg(*[F.count(F.when(F.col(n) == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (row[f"n{k}"] for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return {k + 1: min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw)}


def _discount(n: str, d: dict[int, float]) -> Column:
    return F.when(F.col(n) == 1, d[1]).when(F.col(n) == 2, d[2]).otherwise(d[3])


def kneser_ney(trigrams: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, logp) with the natural log probability of the last symbol for every trigram in ``wanted`` (gram).

    ``trigrams`` has the trusted counts (gram, n) and may be empty: then all symbols are equally likely.
    """
    code = 1 << 21
    third = trigrams.select(
        "gram", "n", F.shiftright("gram", 21).alias("ab"), F.col("gram").bitwiseAND(code * code - 1).alias("bc")
    )
    d3 = _discounts(third, "n")
    second = stored(
        third.groupBy("bc").agg(F.count("*").alias("n"))
        .select("bc", "n", F.shiftright("bc", 21).alias("b"), F.col("bc").bitwiseAND(code - 1).alias("c")), "bigrams"
    )
    d2 = _discounts(second, "n")
    first = stored(second.groupBy("c").agg(F.count("*").alias("n")), "unigrams")
    d1 = _discounts(first, "n")

    def contexts(counts: DataFrame, key: str, d: dict[int, float]) -> DataFrame:
        """Per context: the total count and the weight left for the lower order."""
        return counts.groupBy(key).agg(
            F.sum("n").alias("total"), (F.sum(_discount("n", d)) / F.sum("n")).alias("left")
        )

    totals = first.agg(F.sum("n").alias("t"), F.sum(_discount("n", d1)).alias("left"), F.count("*").alias("v")).first()
    total, left, v = totals["t"] or 1, (totals["left"] if totals["t"] else 1.0), totals["v"]
    base = left / total / (v + 1)  # one more character stands for all that trusted text lacks
    p1 = first.select("c", (F.greatest(F.col("n") - _discount("n", d1), F.lit(0.0)) / total + base).alias("p1"))

    need2 = wanted.select(F.col("gram").bitwiseAND(code * code - 1).alias("bc")).distinct().select(
        "bc", F.shiftright("bc", 21).alias("b"), F.col("bc").bitwiseAND(code - 1).alias("c")
    )
    p2 = (
        need2.join(second.select("bc", "n"), "bc", "left")
        .join(contexts(second, "b", d2), "b", "left").join(p1, "c", "left")
        .select(
            "bc",
            (
                F.coalesce(F.greatest(F.col("n") - _discount("n", d2), F.lit(0.0)) / F.col("total"), F.lit(0.0))
                + F.coalesce("left", F.lit(1.0)) * F.coalesce("p1", F.lit(base))
            ).alias("p2"),
        )
    )
    keyed = wanted.select(
        "gram", F.shiftright("gram", 21).alias("ab"), F.col("gram").bitwiseAND(code * code - 1).alias("bc")
    )
    return (
        keyed.join(third.select("gram", "n"), "gram", "left")
        .join(contexts(third, "ab", d3), "ab", "left").join(p2, "bc")
        .select(
            "gram",
            F.log(
                F.coalesce(F.greatest(F.col("n") - _discount("n", d3), F.lit(0.0)) / F.col("total"), F.lit(0.0))
                + F.coalesce("left", F.lit(1.0)) * F.col("p2")
            ).alias("logp"),
        )
    )


def _scores(blocks: DataFrame, values: DataFrame) -> DataFrame:
    """One row per document of each block: ids, language, key, role, length, log probability."""
    schema = T.StructType([
        T.StructField("doc_id", blocks.schema["doc_ids"].dataType.elementType), T.StructField("lang", T.StringType()),
        T.StructField("row_key", T.LongType()), T.StructField("role", T.IntegerType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("logp", T.DoubleType()),
    ])
    columns = ["doc_ids", "langs", "keys", "roles", "lengths", "packed"]
    joined = blocks.select("block", *columns).join(values, "block").select(*columns, "logp")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                lists = [batch.column(i)[row].values for i in range(5)]
                ends, steps, counts = unpack(batch.column(5)[row].as_py())
                logp = batch.column(6)[row].values.to_numpy(zero_copy_only=False)
                # Texts have an end mark at least, so no document is without trigrams.
                total = np.add.reduceat(logp[_places(ends, steps)] * counts, ends[:-1])
                yield pa.RecordBatch.from_arrays([*lists, pa.array(total)], names=schema.names)

    return joined.mapInArrow(run, schema)


def _viewed(docs: DataFrame, view: str) -> DataFrame:
    """Rows of ``docs`` (doc_id, lang, text, row_key, role) with n_tokens and logp in one view."""
    blocks = stored(_blocks(docs, view), "blocks", records=8)
    counts = stored(
        symbols(blocks, ["grams", "n"]).where("n > 0").groupBy(F.col("grams").alias("gram")).agg(F.sum("n").alias("n")),
        "trigrams",
    )
    held = symbols(blocks, ["grams"]).withColumnRenamed("grams", "gram")
    model = stored(kneser_ney(counts, held.select("gram").distinct()), "model")
    values = returned(held.join(model, "gram"), ["logp"])
    return stored(_scores(blocks, values), "scores").withColumn("perplexity", F.exp(-F.col("logp") / F.col("n_tokens")))


def _with_threshold(scored: DataFrame, quantile: float) -> DataFrame:
    """Scores with ``threshold``: the quantile of trusted documents of the language and length.

    In a group with ``LEAST`` documents left out of training these decide, else all trusted ones if they are so many.
    A smaller group takes the larger of its own quantile and that of the next wider one: length within language,
    language, all. Without trusted documents there is none.
    """
    band = sum(((F.col("n_tokens") >= edge).cast("int") for edge in BANDS), F.lit(0))
    scored = scored.withColumn("band", band)
    good = scored.where(F.col("role") != OTHERS)
    judged = F.when(F.col("role") == JUDGE, F.col("perplexity"))
    parts = {
        "cut": F.when(F.count(judged) >= LEAST, F.percentile_approx(judged, quantile, 100_000)).otherwise(
            F.percentile_approx("perplexity", quantile, 100_000)
        ),
        "many": F.count("*") >= LEAST,
    }

    def groups(name: str, *keys: str) -> DataFrame:
        # One row per language and length class.
        return good.groupBy(*[F.col(key).alias(f"{key}_{name}") for key in keys]).agg(
            *[part.alias(f"{of}_{name}") for of, part in parts.items()]
        )

    fine, wide = groups("fine", "lang", "band"), groups("wide", "lang")
    overall = F.lit(good.agg(parts["cut"].alias("cut")).first()["cut"]).cast("double")
    joined = scored.join(
        fine, F.col("lang").eqNullSafe(F.col("lang_fine")) & (F.col("band") == F.col("band_fine")), "left"
    ).join(wide, F.col("lang").eqNullSafe(F.col("lang_wide")), "left")
    of_language = F.when(F.col("many_wide"), F.col("cut_wide")).otherwise(F.greatest("cut_wide", overall))
    return joined.withColumn(
        "threshold", F.when(F.col("many_fine"), F.col("cut_fine")).otherwise(F.greatest("cut_fine", of_language))
    ).select(*scored.columns, "threshold")


def classify(
    docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, left_out: int = LEFT_OUT, doc_id: str = "doc_id",
    text: str = "text", lang: str = "lang", label_id: str = "doc_id", label: str = "quality",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, n_tokens, log10_prob, perplexity, threshold, kept, row_key,
    shape_perplexity, shape_threshold.

    Trusted text is that of documents whose every label is 1; of these one in ``left_out`` (by hash of the id; 0: none)
    is not learned from and used for the thresholds. Tokens are the characters and the end of a text; NULL counts as
    the empty text, whose only token is the end. A document is kept if in both views its perplexity is at most its
    threshold. Languages are compared as they are, NULL is one of its own. Without trusted documents all are kept.
    Repeated rows get equal results. Texts may be of any length, an empty table gives no rows, and other columns are
    not read, whatever their names. ``row_key`` hashes id and text, to tell rows of one doc_id apart.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")
    ).withColumn("row_key", F.xxhash64("doc_id", "text"))
    trusted = stored(
        labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("id")).agg(
            F.min(F.coalesce(F.col(label), F.lit(0))).alias("label")
        ).where("label = 1").select("id", F.lit(True).alias("trusted")),
        "trusted",
    )
    few = trusted.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    marked = rows.join(F.broadcast(trusted) if few else trusted, F.col("doc_id") == F.col("id"), "left")
    out = F.pmod(F.xxhash64("doc_id"), F.lit(left_out)) == 0 if left_out else F.lit(False)
    role = F.when(~F.coalesce("trusted", F.lit(False)), OTHERS).when(out, JUDGE).otherwise(LEARN)
    marked = marked.withColumn("role", role).select("doc_id", "lang", "text", "row_key", "role")
    spelled = _with_threshold(_viewed(marked, "characters"), quantile)
    shaped = _with_threshold(_viewed(marked, "shapes"), quantile).groupBy(F.col("row_key").alias("shape_key")).agg(
        F.max("perplexity").alias("shape_perplexity"), F.max("threshold").alias("shape_threshold")
    )
    kept = (F.col("perplexity") <= F.col("threshold")) & (F.col("shape_perplexity") <= F.col("shape_threshold"))
    return spelled.join(shaped, F.col("row_key") == F.col("shape_key"), "left").select(
        "doc_id", "lang", "n_tokens", (F.col("logp") / F.log(F.lit(10.0))).alias("log10_prob"), "perplexity",
        "threshold", F.coalesce(kept, F.lit(True)).alias("kept"), "row_key", "shape_perplexity", "shape_threshold",
    )
