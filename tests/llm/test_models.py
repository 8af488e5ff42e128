"""Models: the exact parts against plain versions, the learned parts by held-out figures."""

import math
import re
import zlib
from collections import Counter
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from partlens.llm import blocks, hmm_lm, multi_index, quality, toxicity

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def test_language_model_base_figures_and_held_out_gain(spark):
    docs = table(spark, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    tokens = {d: re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER)) + [None] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    counts = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    gain = 0.0
    for row in hmm_lm.score(docs).collect():
        ws = tokens[row["doc_id"]]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"]) == (
            held[row["doc_id"]], len(ws), sum(counts[w] > 0 for w in ws), n
        )
        assert row["base_score"] == pytest.approx(base, rel=1e-9)
        gain += (row["score"] - row["base_score"]) * row["held_out"]
    assert gain > 0


def test_language_model_learns_from_all_text_however_it_is_cut(spark, monkeypatch):
    docs = table(spark, "documents").coalesce(1)
    found = []
    for size in (10_000, 10_000_000):
        monkeypatch.setattr(hmm_lm, "BLOCK_BYTES", size)
        found.append(sorted((r["doc_id"], r["score"]) for r in hmm_lm.score(docs).collect()))
    for (one, a), (other, b) in zip(*found):
        assert one == other and a == pytest.approx(b, rel=1e-6)


def test_forward_recursion_sums_over_all_paths():
    rng = np.random.default_rng(0)
    model = {
        "first": rng.dirichlet(np.ones(2)), "moves": rng.dirichlet(np.ones(2), 2),
        "emit": rng.dirichlet(np.ones(4), 2).T, "share": np.full(2, 0.5),
    }
    sequence, offsets = np.array([0, 3, 1, 2, 2, 0]), np.array([0, 4, 6])
    got = hmm_lm.log_likelihood(model, sequence, offsets)
    for (a, b), value in zip([(0, 4), (4, 6)], got):
        total = 0.0
        for path in product(range(2), repeat=b - a):
            p = model["first"][path[0]] * model["emit"][sequence[a], path[0]]
            for t in range(1, b - a):
                p *= model["moves"][path[t - 1], path[t]] * model["emit"][sequence[a + t], path[t]]
            total += p
        assert value == pytest.approx(math.log(total))


def test_baum_welch_does_not_lose_likelihood():
    rng = np.random.default_rng(1)
    sequence, offsets = rng.integers(0, 6, 4000), np.array([0, 1500, 1500, 4000])
    offsets = np.array([0, 1500, 4000])
    shares = np.bincount(sequence, minlength=6) / len(sequence)
    model, seen = hmm_lm._starting_model(3, shares), []
    for _ in range(6):
        sums = hmm_lm.expected_counts(model, sequence, offsets)
        seen.append(sums["likelihood"])
        assert sums["emit"].sum() == pytest.approx(len(sequence))
        model = hmm_lm.reestimated(sums, shares)
    assert seen[-1] > seen[0]


def test_expected_counts_hold_two_tables_of_tokens_and_states():
    import tracemalloc

    rng = np.random.default_rng(3)
    sequence, offsets = rng.integers(0, 50, 100_000), np.arange(0, 100_001, 500)
    model = hmm_lm._starting_model(8, np.full(50, 0.02))
    tracemalloc.start()
    try:
        sums = hmm_lm.expected_counts(model, sequence, offsets)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # The emissions and the forward values, eight bytes each, and some numbers per token.
    assert peak < 2.8 * 8 * 8 * len(sequence)
    assert sums["emit"].sum() == pytest.approx(len(sequence)) and sums["first"].sum() == pytest.approx(200)


def test_scores_do_not_depend_on_the_tokens_looked_up_at_once(monkeypatch):
    rng = np.random.default_rng(4)
    lengths = np.concatenate([rng.integers(1, 40, 60), [900]])
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    sequence, model = rng.integers(0, 9, offsets[-1]), hmm_lm._starting_model(3, np.full(9, 1 / 9))
    whole = hmm_lm.log_likelihood(model, sequence, offsets)
    for tokens in (1, 100):
        monkeypatch.setattr(hmm_lm, "TOKENS", tokens)
        assert hmm_lm.log_likelihood(model, sequence, offsets) == pytest.approx(whole, rel=1e-12)
    alone = [hmm_lm.log_likelihood(model, sequence[a:b], np.array([0, b - a]))[0] for a, b in zip(offsets[:-1], offsets[1:])]
    assert whole == pytest.approx(alone, rel=1e-12)


def test_language_model_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, "a b", 1), (2, None, 2), (None, "A b c", 2), (2, "", 3), (1, "a b", 1)], "doc_id long, text string, score int")
    found = hmm_lm.score(rows).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in found) == [(0, 4), (1, 3), (1, 3), (2, 1), (2, 1)]
    assert hmm_lm.score(rows.limit(0)).count() == 0


def test_packed_numbers_come_back():
    arrays = [np.array([0, 5, 2**31]), np.zeros(0, np.int64), np.arange(1000)]
    for a, b in zip(arrays, blocks.unpack(blocks.pack(*arrays))):
        assert a.tolist() == b.tolist()


def plain_kneser_ney(counts, grams):
    """Interpolated modified Kneser-Ney over character trigrams, by dictionaries."""

    def discounts(table):
        n = [sum(c == k for c in table.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        raw = (1 - 2 * y * n[1] / n[0] if n[0] else 0.5, 2 - 3 * y * n[2] / n[1] if n[1] else 1.0, 3 - 4 * y * n[3] / n[2] if n[2] else 1.5)
        return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw)]

    second = Counter(g[1:] for g in counts)
    first = Counter(g[1] for g in second)
    d3, d2, d1 = map(discounts, (counts, second, first))
    cut = lambda c, d: d[min(c, 3) - 1] if c else 0.0
    total1 = sum(first.values())
    base = sum(cut(c, d1) for c in first.values()) / total1 / (len(first) + 1)
    p1 = lambda c: max(first[c] - cut(first[c], d1), 0) / total1 + base

    def p2(b, c):
        own = {g: n for g, n in second.items() if g[0] == b}
        total = sum(own.values())
        if not total:
            return p1(c)
        left = sum(cut(n, d2) for n in own.values()) / total
        return max(second[b + c] - cut(second[b + c], d2), 0) / total + left * p1(c)

    def p3(g):
        own = {x: n for x, n in counts.items() if x[:2] == g[:2]}
        total = sum(own.values())
        if not total:
            return p2(g[1], g[2])
        left = sum(cut(n, d3) for n in own.values()) / total
        return max(counts[g] - cut(counts[g], d3), 0) / total + left * p2(g[1], g[2])

    return {g: math.log(p3(g)) for g in grams}


def test_quality_perplexities_against_a_plain_model(spark):
    texts = {1: "abcab abc", 2: "abd abd cab", 3: "zzz", 4: None, 5: "", 6: "abcab abc"}
    docs = spark.createDataFrame([(d, t, "en" if d != 3 else None, d) for d, t in texts.items()], "doc_id long, text string, lang string, kept int")
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (3, 0), (None, 1), (6, None)], "doc_id long, quality int")

    def shapes(t):
        out, w = [], (t or "").split()
        for i, word in enumerate(w):
            again = i > 0 and w[i - 1] == word
            out.append(quality.AGAIN if again else quality.SECOND if i > 1 and w[i - 2] == word else quality.shape(word))
        return "".join(map(chr, out))

    rows = {r["doc_id"]: r for r in quality.classify(docs, labels, left_out=0).collect()}
    for column, view in (("perplexity", lambda t: t or ""), ("shape_perplexity", shapes)):
        frame = lambda t: "\x02\x02" + view(t) + "\x03"  # noqa: E731, B023
        grams = lambda t: [frame(t)[i : i + 3] for i in range(len(frame(t)) - 2)]  # noqa: E731, B023
        counts = Counter(g for d in (1, 2) for g in grams(texts[d]))
        model = plain_kneser_ney(counts, {g for t in texts.values() for g in grams(t)})
        for d, row in rows.items():
            logp = sum(model[g] for g in grams(texts[d]))
            assert row[column] == pytest.approx(math.exp(-logp / (len(view(texts[d])) + 1)), rel=1e-9)
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert all(r["kept"] for r in quality.classify(docs, labels.limit(0)).collect())


def test_quality_parts_junk_from_clean_text(spark):
    found = quality.classify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    rows = found.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality"), "doc_id").collect()
    clean, junk = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in clean) >= 0.98 * len(clean)
    assert sum(not r["kept"] for r in junk) >= 0.95 * len(junk)


def test_quality_thresholds_by_group(spark):
    """Few documents of a group take the larger threshold; those left out of training decide where there are enough."""
    rows = [(1.0 + i / 1000, 100 + i % 3, "a", quality.JUDGE) for i in range(150)] + [(9.0, 2000, "a", quality.JUDGE)]
    rows += [(5.0, 100, "a", quality.LEARN), (3.0, 100, "b", quality.JUDGE), (2.0, 5, None, quality.OTHERS)]
    scored = spark.createDataFrame(rows, "perplexity double, n_tokens long, lang string, role int")
    got = {(r["lang"], r["n_tokens"], r["role"]): r["threshold"] for r in quality._with_threshold(scored, 0.99).collect()}
    assert got["a", 100, quality.LEARN] == pytest.approx(1.148, abs=0.002)  # the fourth band's 9.0 and the learned 5.0 are out
    assert got["a", 2000, quality.JUDGE] == 9.0
    assert got["b", 100, quality.JUDGE] == 3.0
    assert got[None, 5, quality.OTHERS] == pytest.approx(3.0, abs=1.9)


def test_counting_in_pieces_changes_nothing(monkeypatch):
    texts = ["abcab" * 50, "", "x", "中文" * 40, "ab " * 90]
    whole = quality._trigrams(quality._characters(texts))
    for piece in (1, 7, 64):
        monkeypatch.setattr(quality, "PIECE", piece)
        for one, other in zip(whole, quality._trigrams(quality._characters(texts))):
            assert np.array_equal(one, other)


def test_multi_index_recall_and_exact_scores(spark):
    rows = table(spark, "embeddings")
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in rows.collect()}
    ids = np.array(sorted(vectors))
    matrix = np.stack([vectors[i] for i in ids])
    extra = [(-1, None), (-2, [0.0] * 64), (-3, [float("nan")] * 64), (-4, [None] * 64), (-5, [1.0])]
    both = rows.select("vec_id", "embedding").unionByName(spark.createDataFrame(extra, "vec_id long, embedding array<float>"))
    found = {}
    for r in multi_index.search(both, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        scores = matrix @ vectors[q]
        best = [ids[i] for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        got = sorted(found[q])
        assert [g[0] for g in got] == list(range(1, 21))
        assert all(s == pytest.approx(vectors[q] @ vectors[v], abs=1e-12) for _, v, s in got)
        hits, total = hits + len({v for _, v, _ in got} & set(best)), total + 20
    assert hits >= 0.9 * total
    assert multi_index.search(both.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_walk_meets_cells_by_rising_distance():
    rng = np.random.default_rng(2)
    a, b, sizes = rng.normal(size=7), rng.normal(size=5), np.ones((7, 5), int)
    cells = list(multi_index.walk(a, b, sizes, 35))
    distances = [a[i] + b[j] for i, j in cells]
    assert len(set(cells)) == 35 and distances == sorted(distances)


def test_subsequence_kernel_against_all_subsequences():
    for s, t in (("idiot", "idxiot"), ("stupid", "sttupid"), ("abc", "xyz"), ("aaaa", "aaa")):
        total = 0.0
        for a in combinations(range(len(s)), toxicity.LENGTH):
            for b in combinations(range(len(t)), toxicity.LENGTH):
                if all(s[i] == t[j] for i, j in zip(a, b)):
                    total += toxicity.DECAY ** (a[-1] - a[0] + b[-1] - b[0] + 2)
        assert toxicity.kernel([s], t)[0] == pytest.approx(total, rel=1e-5)
    own = toxicity._self_kernels(["idiot"])[0]
    assert own == pytest.approx(toxicity.kernel(["idiot"], "idiot")[0], rel=1e-5)


def test_toxicity_tolerates_changed_insults():
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("aeinorstl"), 7)) for _ in range(400)]
    say = lambda *more: " ".join([*rng.choice(vocabulary, 30), *more])
    texts = [say("stupid") for _ in range(40)] + [say("wombug") for _ in range(40)] + [say() for _ in range(80)]
    model = toxicity.fit(texts, [1] * 80 + [0] * 80)

    def score(text):
        strings = [s for part in toxicity.sentence_strings(text) for s in part]
        return float(model.score(np.array([model.decide(strings).max()]))[0])

    assert min(score(say(w)) for w in ("stupid", "stuupid", "s t u p i d", "stup*id", "wombug")) >= 0.7
    assert max(score(say()) for _ in range(20)) < 0.7


def test_toxicity_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, 0), (2, "", 1), (3, "a b", 2), (None, "x", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    found = toxicity.classify(rows, labels).collect()
    assert len(found) == 4 and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in found)
    assert toxicity.classify(rows.limit(0), labels).count() == 0


def test_strings_that_meet_no_landmark_are_left_out_of_the_kernel(monkeypatch):
    rng = np.random.default_rng(5)
    strings = ["".join(rng.choice(list("abcdeéz"), rng.integers(3, 13))) for _ in range(400)]
    landmarks = ["abc", "cabé", "zzz", "deadbeef"]
    plain = np.array([[toxicity.kernel([s], z)[0] for z in landmarks] for s in strings])
    own = np.array([toxicity.kernel([s], s)[0] for s in strings + landmarks])
    expected = (plain / np.sqrt(own[:400, None] * own[None, 400:])) ** toxicity.POWER
    counted, dense = [], toxicity._kernel
    monkeypatch.setattr(toxicity, "_kernel", lambda codes, z: counted.append(codes.shape[1]) or dense(codes, z))
    assert toxicity.kernels(strings, landmarks) == pytest.approx(expected, rel=1e-5)
    assert sum(counted) == (expected > 0).sum() + len(landmarks) < expected.size


def test_a_worker_decides_on_a_token_once(monkeypatch):
    judge = toxicity.Judge({**toxicity.Machine(["idiot", "table"]).plain(), "learned": {}})
    tokens, seen, plain = ["idi0t,", "x" * 50, "the", "idiots"], [], toxicity.plain
    monkeypatch.setattr(toxicity, "plain", lambda token: seen.append(token) or plain(token))
    forms, worst = judge.tokens(tokens)
    assert forms == ["idiot", "x" * 50, "the", "idiots"] and worst.tolist() == judge.words(forms).tolist()
    again, same = judge.tokens(tokens[::-1])
    assert again == forms[::-1] and same.tolist() == worst.tolist()[::-1] and seen == [*tokens, "x" * 50]
    assert judge.tokens([])[1].tolist() == []
