"""Filter audit, token counts and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from partlens.llm import filter_audit, importance, token_machine

FOLDER = "/root/testdata/sf0.001"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


# Filter audit -----------------------------------------------------------------


def plain_bits(rows):
    """(part, bits, doc_id) of each (doc_id, text, source)."""
    out = []
    smallest = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            smallest[text or ""] = min(doc_id, smallest.get(text or "", doc_id))
    for doc_id, text, source in rows:
        text = text or ""
        words = SPLIT.findall(text)
        fails = (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text)),
            doc_id is not None and smallest[text] < doc_id,
        )
        out.append((source or "", sum(1 << i for i, fail in enumerate(fails) if fail), doc_id))
    return out


def plain_audit(rows, labels):
    good = {d for d, quality, _ in labels if quality == 1 and d is not None}
    toxic = {d for d, _, bad in labels if bad == 1 and d is not None}
    marked = plain_bits(rows)
    out = set()
    for part in {p for p, _, _ in marked}:
        docs = [(bits, d) for p, bits, d in marked if p == part]
        lines, shapley = [], Counter()
        for order in permutations("ABCDE"):
            alive = list(docs)
            for step, name in enumerate(order, 1):
                this = 1 << "ABCDE".index(name)
                removed = [d for d in alive if d[0] & this]
                alive = [d for d in alive if not d[0] & this]
                failing = sum(1 for bits, _ in docs if bits & this)
                lines.append((
                    "".join(order), step, len(alive), len(removed), failing - len(removed),
                    sum(1 for bits, _ in docs if bits == this), sum(1 for _, d in removed if d in good),
                    sum(1 for _, d in removed if d in toxic),
                ))
                shapley[name] += len(removed)
        out |= {(part, *line, shapley[line[0][line[1] - 1]]) for line in lines}
    return out


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_against_a_replay_of_every_order(spark):
    long_text = " ".join(f"w{i}" for i in range(250))
    rows = [
        (1, long_text, "a"), (2, long_text, "b"), (3, long_text + " # X", "a"), (3, long_text + " # X", "a"),
        (4, "same same same " * 100, "a"), (5, "A B C", None), (6, "A B C", None), (7, None, "b"), (8, "", "b"),
        (None, long_text, "a"), (None, None, None), (9, "x\x0by" * 300, "a"), (9, "other text of the same id", "a"),
        (10, "é\U0001F600 $ " * 40000, "b"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None), (9, 1, 0)]
    docs = spark.createDataFrame([(*row, 1) for row in rows], "doc_id long, text string, source string, bits int")
    marks = spark.createDataFrame([(*row, "x") for row in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit(docs, marks).select(*COLUMNS).collect()
    assert len(got) == 600 * 3 and {tuple(r) for r in got} == plain_audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    none = filter_audit.audit(docs, marks.limit(0))
    assert none.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0) and none.count() == 1800


def test_audit_matches_sql(spark):
    duck = duckdb.connect()
    for table in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    expected = duck.execute(entry.oracle_sql()["op11_filter_audit"])
    assert [c[0] for c in expected.description] == COLUMNS
    got = entry.queries()["op11_filter_audit"](spark, FOLDER).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(expected.fetchall())


# Token counts -----------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as lines:
        counter = token_machine.Counter(token_machine.compiled(lines.read()))
    return path, lambda texts: [len(e.ids) for e in model.encode_batch(texts, add_special_tokens=False)], counter


ODD = [
    "it's they're we'll I've 'll 'r 're 'rx 'l 'v 've 'd'd ''s !'s '' 'S 'RE", "a<|endoftext|>b<|startoftext|><|ENDOFTEXT|>",
    "É é é́ Σας ΟΔΟΣ İ ǅ ﬁ ١٢٣ ²½ 中文字 한국어 नमस्ते \U0001F600\U0001F1E9  x\x85y\xa0z\x1cq ​　",
    "", "   ", "'", "'r", "'l'l", "a" * 5000, "!" * 999, "ab" * 3000, "x̀́ ̈", "\x00\x01", "don't'r'e'll'lx",
]


def test_counts_equal_the_library(library):
    _, expected, counter = library
    draw = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz''''  .,!0123456789éßñΣ中́<|>"
    texts = ODD + ["".join(draw.choice(letters) for _ in range(draw.randint(1, 400))) for _ in range(500)]
    texts += ["".join(chr(draw.choice([draw.randint(0, 0x3000), draw.randint(0xE000, 0x10FFFF)])) for _ in range(60)) for _ in range(300)]
    assert counter(texts).tolist() == expected(texts)


def test_counts_do_not_depend_on_chunks_windows_or_memory(library, monkeypatch):
    path, expected, _ = library
    texts = [*ODD, "we're 'll it's " * 400, "x" * 700 + "'re" * 90]
    with open(path, encoding="utf-8") as lines:
        text = lines.read()
    for chunk, window, step, kept in ((1, 7, 50, 40), (3, 100, 1000, 500), (1000, 10**6, 10**6, 10**6)):
        for name, value in (("CHUNK", chunk), ("WINDOW", window), ("STEP", step), ("REMEMBERED", kept)):
            monkeypatch.setattr(token_machine, name, value)
        assert token_machine.Counter(token_machine.compiled(text))(texts).tolist() == expected(texts)


def test_state_maps_agree_with_one_run(monkeypatch):
    classes = np.random.default_rng(1).integers(0, 10, 5000).astype(np.uint8)
    classes[-1] = token_machine.SPACE
    monkeypatch.setattr(token_machine, "CHUNK", 16)
    whole = token_machine.piece_starts(classes)
    state, starts = token_machine.GAP, np.zeros(len(classes), bool)
    for i, c in enumerate(classes.tolist()):
        emit = token_machine.EMITS[state, c]
        starts[i] |= bool(emit & token_machine.HERE)
        if emit & token_machine.BEFORE:
            starts[i - 1] = True
        state = token_machine.STEPS[state, c]
    assert (whole == starts).all()


def test_count_query_and_odd_rows(spark, library):
    path, expected, _ = library
    got = entry.queries()["op12_token_machine"](spark, FOLDER).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    counts = dict(zip(texts, expected(list(texts.values()))))
    assert len(got) == len(texts)
    for row in got:
        n = counts[row["doc_id"]]
        assert tuple(row) == (row["doc_id"], len(texts[row["doc_id"]].encode()), n, n > 2048)
    rows = [(1, "a b", 7), (1, "a b", 7), (None, None, None), (2, "", 0)]
    odd = token_machine.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), path)
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in odd.collect()) == [(0, 0), (1, 2), (1, 2), (2, 0)]
    assert token_machine.count_tokens(odd.limit(0), path).count() == 0


def test_other_tokenizer_files_are_refused():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as lines:
        with pytest.raises(ValueError):
            token_machine.compiled(lines.read())


# Importance resampling --------------------------------------------------------


def features(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return len(words), [zlib.crc32(b" ".join(words[i : i + n])) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_draw(rows, target, percent=5, least=20):
    found = [(i, *features(text)) for i, text in rows]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for text in target for b in features(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    scored = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        scored.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((x for x in scored if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for rank, x in enumerate(able[: percent * len(able) // 100], 1):
        x[4] = rank
    return Counter(tuple(x[:5]) for x in scored)


def drawn(df):
    return Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect())


def test_draw_query_against_a_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert drawn(entry.queries()["op13_importance"](spark, FOLDER)) == plain_draw(rows, target)


def test_draw_of_odd_rows(spark):
    draw = random.Random(3)
    words = ["Über", "cat", "x1", "naïve", "中文", "dog", "a" * 300, "it's"]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 60))) for _ in range(60)]
    rows = [(draw.randint(-(2**40), 2**40), text) for text in texts] + [(7, texts[0]), (7, texts[0]), (None, texts[1]), (8, None), (9, ""), (-5, "-- \x00 !")]
    rows += [(2**63 - 1, texts[2]), (-(2**63), texts[3])]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, score int")
    target = spark.createDataFrame([("cat dog cat", 1), (None, 2)], "text string, weight int")
    for percent in (5, 50, 100):
        assert drawn(importance.resample(docs, target, percent)) == plain_draw(rows, ["cat dog cat", None], percent)
    assert drawn(importance.resample(docs, target.limit(0), 50)) == plain_draw(rows, [], 50)
    assert importance.resample(docs.limit(0), target).count() == 0


def test_radix_ranks_equal_a_sort(spark):
    draw = random.Random(5)
    values = [(draw.randint(0, 50), draw.randint(0, 2**40)) for _ in range(3000)] + [(3, 3)] * 500
    df = spark.createDataFrame(values, "a long, b long")
    ranked = importance.radix_ranked(df, ["a", "b"], digit_bits=7, block_rows=64).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, len(values) + 1))
    assert [(r["a"], r["b"]) for r in ranked] == sorted(values)


def test_run_hashes_equal_the_checksum():
    texts = ["a b cd", "", "x" * 70 + " é 1", "one two three four"]
    buckets, owner, sizes = importance.Hasher(10000)([t.encode() for t in texts])
    for i, text in enumerate(texts):
        n, expected = features(text)
        assert sizes[i] == n and sorted(buckets[owner == i].tolist()) == sorted(expected)
