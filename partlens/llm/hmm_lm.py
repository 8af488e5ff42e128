"""Hidden Markov language model: latent states trained by Baum-Welch over all training text, exact scores per text.

A text is its words and one end. A state emits a symbol: the end, a word that holds at least ``share`` of the training
tokens (so there are at most 1 / share of them), or a spelling class, the hash of a word's last three characters.
Within a class, words have their smoothed share of the class's training tokens, whatever the state; a slot is left
for new words. So the model gives every text a probability, while states and symbols stay of bounded number.

Word counts are a table as large as the vocabulary; blocks of documents look their distinct words up by a join.
Expected counts of states are summed inside tasks, then across partitions. Scores come from the scaled forward
recursion over the whole text.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partlens.llm.blocks import numbered, pack, symbols, unpack
from partlens.llm.common import stored
from partlens.llm.shingles import tokens as word_tokens

#: Hidden states, spelling classes, and the share of the tokens that makes a word a symbol of its own.
STATES, CLASSES, SHARE = 8, 4096, 1e-4
#: Text per block; tokens per training window, which are the sequences that Baum-Welch sees.
BLOCK_BYTES, WINDOW = 2_000_000, 512
#: Tokens whose emissions are looked up at once in scoring; bounds memory for texts of any length.
TOKENS = 1 << 18
#: Passes over all training text; from the fourth on the held-out likelihood hardly changes.
PASSES = 5
#: Bits for a symbol or the count of a word that is no symbol (under ``share`` of all tokens).
CODE_BITS = 36
#: Tokens' worth of the overall symbol shares mixed into each state's emissions, and of evenness into its moves.
PRIOR, MOVES_PRIOR = 50.0, 1.0


def _blocks(docs: DataFrame) -> DataFrame:
    """Block rows of documents (doc_id, held, text): words, their classes and training counts; packed, the texts'
    ends and the sequence of words."""
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("doc_ids", T.ArrayType(docs.schema["doc_id"].dataType)),
        T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("classes", ints), T.StructField("n", T.ArrayType(T.LongType())),
        T.StructField("packed", T.BinaryType()),
    ])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def one(values, kind):
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))

        for block, batch in numbered(batches, BLOCK_BYTES):
            dictionary, index, offsets = word_tokens(batch.column(2))
            held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            learned = np.repeat(~held, np.diff(offsets))
            n = np.bincount(index[learned], minlength=len(dictionary)).astype(np.int64)
            endings = pc.utf8_slice_codeunits(dictionary, -3, 2**31 - 1).dictionary_encode()
            hashed = np.array([zlib.crc32(e.encode()) % CLASSES for e in endings.dictionary.to_pylist()], np.int32)
            classes = hashed[endings.indices.to_numpy(zero_copy_only=False)] if len(hashed) else np.zeros(0, np.int32)
            lists = [
                pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
                for c in (batch.column(0), batch.column(1), dictionary)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), *lists, one(classes, pa.int32()), one(n, pa.int64()),
                 pa.array([pack(offsets, index)], pa.binary())],
                names=schema.names,
            )

    return docs.select("doc_id", "held", "text").mapInArrow(run, schema)


class Symbols:
    """Which symbol a word is: its own place, or ``first_class`` plus its spelling class; ``end`` is the last."""

    def __init__(self, own: list[str]):
        self.own = own
        self.first_class = len(own)
        self.end = len(own) + CLASSES
        self.size = self.end + 1

    def of(self, words, classes: np.ndarray) -> np.ndarray:
        import pyarrow as pa
        import pyarrow.compute as pc

        place = pc.fill_null(pc.index_in(words, value_set=pa.array(self.own, pa.string())), -1)
        place = place.to_numpy(zero_copy_only=False)
        return np.where(place >= 0, place, classes + self.first_class)


def _sequences(tokens: np.ndarray, ends: np.ndarray, symbol: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, each followed by the end, and the offsets of the texts."""
    out = np.insert(symbol[tokens], ends[1:], end) if len(tokens) else np.full(len(ends) - 1, end)
    return out, ends + np.arange(len(ends))


def _by_length(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by length, longest first; the starts in that order; how many sequences have a t-th token."""
    order = np.argsort(-lengths, kind="stable")
    alive = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(lengths.max(initial=0)), side="right")
    return order, starts[order], alive


def _along(starts: np.ndarray, alive: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and sequence numbers of the first-th to last-th tokens (exclusive) of all sequences, step by step."""
    some = alive[first:last]
    ends = np.cumsum(some)
    column = np.arange(ends[-1]) - np.repeat(ends - some, some)
    return starts[column] + np.repeat(np.arange(first, last), some), column


def log_likelihood(model: dict, sequence: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Natural log probability of each text by the scaled forward recursion, all its tokens in one chain."""
    lengths = np.diff(offsets)
    order, starts, alive = _by_length(offsets[:-1], lengths)
    total = np.zeros(len(lengths))
    # A state is a row, so that a step works on a few long rows; emissions are looked up for many steps at once.
    emit, into = np.ascontiguousarray(model["emit"].T), np.ascontiguousarray(model["moves"].T)
    edges = np.concatenate([[0], np.cumsum(alive)])
    alpha, begin = np.tile(model["first"][:, None], (1, len(lengths))), 0
    while begin < len(alive):
        end = max(begin + 1, int(np.searchsorted(edges, edges[begin] + TOKENS, side="right")) - 1)
        at, column = _along(starts, alive, begin, end)
        seen, scales, a = np.take(emit, sequence[at], axis=1), np.empty(len(at)), 0
        for t, m in enumerate(alive[begin:end].tolist(), begin):
            alpha = (into @ alpha[:, :m] if t else alpha[:, :m]) * seen[:, a : a + m]
            scale = np.add.reduce(alpha, 0, out=scales[a : a + m])
            alpha /= scale
            a += m
        total += np.bincount(column, np.log(scales), len(total))
        begin = end
    out = np.empty(len(lengths))
    out[order] = total
    return out


def expected_counts(model: dict, sequence: np.ndarray, offsets: np.ndarray) -> dict:
    """Baum-Welch sums over windows of the texts: emissions, moves, first states, and the log likelihood."""
    k = len(model["first"])
    pieces = [np.arange(a, b, WINDOW) for a, b in zip(offsets[:-1], offsets[1:])]
    starts = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
    moves, emit = np.zeros((k, k)), np.zeros((model["emit"].shape[0], k))
    if not len(starts):
        return {"emit": emit, "moves": moves, "first": np.zeros(k), "likelihood": 0.0}
    opening = np.isin(starts, offsets[:-1])
    lengths = np.diff(np.append(starts, offsets[-1]))
    order, starts, alive = _by_length(starts, lengths)
    opening = opening[order]
    place = sequence[_along(starts, alive, 0, len(alive))[0]]
    ends = np.cumsum(alive).tolist()
    # A state is a row here too; step t has the columns from begin to end.
    into = np.ascontiguousarray(model["moves"].T)
    seen = np.take(np.ascontiguousarray(model["emit"].T), place, axis=1)
    forward, scales, begin = np.empty_like(seen), np.empty(len(place)), 0
    alpha = np.where(opening, model["first"][:, None], model["share"][:, None])
    for end in ends:
        alpha = into @ alpha[:, : end - begin] if begin else alpha
        alpha = np.multiply(alpha, seen[:, begin:end], out=forward[:, begin:end])
        scale = np.add.reduce(alpha, 0, out=scales[begin:end])
        alpha /= scale
        begin = end
    seen /= scales
    # Sequences that end at a step keep their ones; the forward values become the states' shares.
    beta = np.ones((k, len(starts)))
    for t in range(len(ends) - 1, -1, -1):
        begin, end = (ends[t - 1] if t else 0), ends[t]
        if t + 1 < len(ends):
            m = ends[t + 1] - end
            ahead = seen[:, end : end + m] * beta[:, :m]
            moves += forward[:, begin : begin + m] @ ahead.T
            beta[:, :m] = model["moves"] @ ahead
        forward[:, begin:end] *= beta[:, : end - begin]
    for state in range(k):
        emit[:, state] = np.bincount(place, forward[state], len(emit))
    first = forward[:, : len(starts)][:, opening].sum(1)
    return {"emit": emit, "moves": moves * model["moves"], "first": first, "likelihood": float(np.log(scales).sum())}


def reestimated(sums: dict, shares: np.ndarray) -> dict:
    """The model of the next pass; ``shares`` are the overall symbol shares."""
    emit = sums["emit"] + PRIOR * shares[:, None]
    moves = sums["moves"] + MOVES_PRIOR / len(sums["first"])
    first = sums["first"] + 1.0 / len(sums["first"])
    share = sums["emit"].sum(0) + 1.0
    return {
        "emit": emit / emit.sum(0), "moves": moves / moves.sum(1, keepdims=True),
        "first": first / first.sum(), "share": share / share.sum(),
    }


def _starting_model(states: int, shares: np.ndarray) -> dict:
    noise = np.random.default_rng(7).gamma(1.0, 1.0, (len(shares), states))
    emit = shares[:, None] * (0.2 + noise)
    moves = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return {
        "emit": emit / emit.sum(0), "moves": moves / moves.sum(1, keepdims=True),
        "first": np.full(states, 1 / states), "share": np.full(states, 1 / states),
    }


def _learned(row, known: Symbols):
    """Symbol sequence and offsets of the training texts of a block (words, classes, held, packed)."""
    words, classes, held, packed = row
    ends, tokens = unpack(packed)
    sequence, offsets = _sequences(tokens, ends, known.of(words, classes), known.end)
    keep = ~held
    inside = np.repeat(keep, np.diff(offsets))
    return sequence[inside], np.concatenate([[0], np.cumsum(np.diff(offsets)[keep])])


def _pass(blocks: DataFrame, known: Symbols, model: dict, states: int) -> dict:
    """One Baum-Welch pass over all blocks: sums inside each task, then across partitions per symbol."""
    sent = blocks.sparkSession.sparkContext.broadcast((known.own, model))
    names = [f"g{i}" for i in range(states)]
    schema = T.StructType([T.StructField("at", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches):
        import pyarrow as pa

        own, current = sent.value
        kinds, total = Symbols(own), None
        for batch in batches:
            for r in range(batch.num_rows):
                lists = [batch.column(i)[r].values for i in range(3)]
                row = (lists[0], *[x.to_numpy(zero_copy_only=False) for x in lists[1:]], batch.column(3)[r].as_py())
                sums = expected_counts(current, *_learned(row, kinds))
                total = sums if total is None else {name: total[name] + sums[name] for name in sums}
        if total is not None:
            # Rows after the symbols: moves out of each state, first states, log likelihood.
            last = np.zeros((1, states))
            last[0, 0] = total["likelihood"]
            rows = np.vstack([total["emit"], total["moves"], total["first"][None], last])
            some = np.flatnonzero(rows.any(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int64)), *[pa.array(rows[some, i]) for i in range(states)]], names=schema.names
            )

    summed = blocks.select("words", "classes", "held", "packed").mapInArrow(run, schema)
    rows = summed.groupBy("at").agg(*[F.sum(n).alias(n) for n in names]).collect()  # one per symbol and state
    table = np.zeros((known.size + states + 2, states))
    for row in rows:
        table[row["at"]] = [row[n] for n in names]
    return {
        "emit": table[: known.size], "moves": table[known.size : known.size + states],
        "first": table[known.size + states], "likelihood": float(table[-1, 0]),
    }


def _scores(blocks: DataFrame, counts: DataFrame, known: Symbols, model: dict, facts: dict) -> DataFrame:
    sent = blocks.sparkSession.sparkContext.broadcast((known.own, model, facts))
    schema = T.StructType([
        T.StructField("doc_id", blocks.schema["doc_ids"].dataType.elementType), T.StructField("held_out", T.BooleanType()),
        *[T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")],
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])
    columns = ["doc_ids", "held", "classes", "packed"]
    joined = blocks.select("block", *columns).join(counts, "block", "left").select(*columns, "codes")

    def run(batches):
        import pyarrow as pa

        own, current, known_facts = sent.value
        kinds = Symbols(own)
        n, v, ends_seen = known_facts["n"], known_facts["v"], known_facts["c_end"]
        base_of = lambda c: np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        for batch in batches:
            for r in range(batch.num_rows):
                ids, held, classes = (batch.column(i)[r].values for i in range(3))
                classes = classes.to_numpy(zero_copy_only=False)
                ends, tokens = unpack(batch.column(3)[r].as_py())
                # A block without words has no looked-up list.
                codes = batch.column(4)[r]
                codes = codes.values.to_numpy(zero_copy_only=False) if codes.is_valid else np.zeros(0, np.int64)
                code = codes & ((1 << CODE_BITS) - 1)
                is_own = code < len(own)
                symbol = np.where(is_own, code, classes + kinds.first_class)
                c = code - len(own)
                c[is_own] = known_facts["own_counts"][code[is_own]]
                sequence, offsets = _sequences(tokens, ends, symbol, kinds.end)
                spelled = symbol >= kinds.first_class
                inside = np.zeros(len(c))
                of = classes[spelled]
                inside[spelled] = np.log10(
                    (c[spelled] + 0.5) / (known_facts["class_n"][of] + 0.5 * (known_facts["class_v"][of] + 1))
                )
                per_word = np.stack([base_of(c), inside, (c > 0).astype(float)], 1) if len(c) else np.zeros((0, 3))
                at_end = np.array([base_of(ends_seen), 0.0, float(ends_seen > 0)])
                extra = np.vstack([per_word, at_end])
                row_of, _ = _sequences(tokens, ends, np.arange(len(c)), len(c))
                sums = np.add.reduceat(extra[row_of], offsets[:-1], axis=0)
                likelihood = log_likelihood(current, sequence, offsets) / math.log(10)
                lengths = np.diff(offsets).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids, held, pa.array(lengths), pa.array(np.rint(sums[:, 2]).astype(np.int64)),
                     pa.array(np.full(len(lengths), n, np.int64)), pa.array(sums[:, 0]),
                     pa.array(likelihood + sums[:, 1])],
                    names=schema.names,
                )

    return joined.mapInArrow(run, schema)


def score(
    docs: DataFrame, states: int = STATES, share: float = SHARE, passes: int = PASSES, doc_id: str = "doc_id",
    text: str = "text", held_out=None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from all rows that are not held out (by default those whose crc32(doc_id as text) mod 5 is not 1; a NULL
    doc_id is learned from). NULL and blank texts are the end alone. ``base_score`` is the add-half unigram score,
    ``score`` the model's; both are log10. Repeated rows count as often as they occur and score alike. Without
    training rows all words are new. An empty table gives no rows.
    """
    held = held_out if held_out is not None else F.crc32(F.col(doc_id).cast("string")) % 5 == 1
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text).cast("string").alias("text")
    )
    blocks = stored(_blocks(rows), "blocks", records=8)
    counts = stored(
        symbols(blocks, ["words", "classes", "n"]).groupBy("words").agg(
            F.sum("n").alias("c"), F.min("classes").alias("class")
        ).where("c > 0"),
        "word-counts",
    )
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    c_end = blocks.select(
        F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0)).alias("n")
    ).first()["n"]
    n, v = whole["n"] + c_end, whole["v"] + (1 if c_end else 0)
    frequent = counts.where(F.col("c") >= share * n).orderBy(F.desc("c"), "words").collect()  # at most 1 / share
    known = Symbols([row["words"] for row in frequent])
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in counts.where(F.col("c") < share * n).groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        class_n[row["class"]], class_v[row["class"]] = row["c"], row["v"]
    shares = np.concatenate([[row["c"] for row in frequent], class_n + 0.5, [c_end + 0.5]])
    shares = shares / shares.sum()
    model = _starting_model(states, shares)
    for _ in range(passes):
        model = reestimated(_pass(blocks, known, model, states), shares)
    places = blocks.sparkSession.createDataFrame(
        [(word, i) for i, word in enumerate(known.own)], "words string, own long"
    )
    values = counts.select("words", "c").join(F.broadcast(places), "words", "left")
    # One number per word: its place among the block's words, then its symbol or, past those, its count.
    code = F.coalesce("own", F.coalesce("c", F.lit(0)) + len(known.own))
    found = (
        symbols(blocks, ["words"]).join(values, "words", "left")
        .select("block", F.shiftleft(F.col("at").cast("bigint"), CODE_BITS).bitwiseOR(code).alias("code"))
        .groupBy("block").agg(F.array_sort(F.collect_list("code")).alias("codes"))
    )
    own_counts = np.array([row["c"] for row in frequent], np.int64)
    facts = {"n": n, "v": v, "c_end": c_end, "own_counts": own_counts, "class_n": class_n, "class_v": class_v}
    return _scores(blocks, found, known, model, facts)
