"""Toxic documents by a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

The kernel of two strings counts their common subsequences of ``LENGTH`` characters, each weighted by ``DECAY`` per
character it spans in either string, so an insult with inserted or doubled characters stays close to the insult.
Strings are compared with a few landmark words; the inverse square root of the landmarks' kernel matrix makes features
of that, and a linear machine on them is the kernel machine (Nyström).

It is trained on the sentences of labelled documents. A toxic document has at least one toxic sentence, which one is
not labelled: its marking words are its first witnesses, and where
it has none the worst word of its worst sentence, chosen anew with each machine. Witnesses also enter
with a character inserted. A document's score is its worst string's, through a logistic curve between the worst of
clean documents and the marking strings.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partlens.llm.common import stored
from partlens.llm.shingles import slices, tokens

#: The kernel: characters per subsequence, the weight per character spanned, and the power that sharpens it.
LENGTH, DECAY, POWER = 3, 0.7, 2
#: Landmarks: strings that mark the labels most and are no closer to each other than ``APART``, the common string
#: closest to each, and the commonest.
MARKING, APART, COMMON = 32, 0.5, 2
#: Standard errors by which a marking word must be commoner in toxic documents, and the share of them that hold it.
SURE, COMMON_SHARE = 3.0, 0.02
#: Bound of the training sample per label, and of the texts in it (characters).
SAMPLE, SAMPLE_CHARS = 600, 20_000
#: Strings of one length that go through the kernel together.
GROUP = 8192
#: Words up to so many characters are compared whole; longer than ``STEM``, also every run of ``STEM`` characters is.
WHOLE, STEM = 12, 5
#: Machines trained, each with the witnesses of the one before; cost of an error
#: that all documents of a side share.
ROUNDS, COST = 3, 1000.0
#: What a missed witness weighs against a clean string taken for toxic: a document has many strings and few witnesses.
MISSED = 4.0
#: Strings besides the runs, and tokens, whose decision a worker remembers; either table starts anew when full.
#: Longer tokens are decided each time.
REMEMBERED, LONGEST = 400_000, 40
#: Score from which a document is predicted toxic, and the decision on a text without strings.
THRESHOLD, LOWEST = 0.7, -2.0

# Characters that stand for letters.
LEET = str.maketrans("013457@$!|", "oieastasil")


def plain(token: str) -> str:
    """A token's letters: accents dropped, look-alike characters read as letters where letters stand beside them."""
    token = token.strip("\"'()[]{}.,;:!?-_*#%&$|/\\<>~^`+=")
    if token.isascii():
        if token.isalpha():
            return token.lower()
    else:
        token = "".join(c for c in unicodedata.normalize("NFKD", token) if not unicodedata.combining(c))
    if any(c.isalpha() for c in token):
        token = token.translate(LEET)
    return "".join(c for c in token.lower() if c.isalpha())


def pieces(word: str) -> list[str]:
    """The strings compared for a word: itself unless too long or too short, and its runs of ``STEM`` characters.

    The runs find a stem under any ending, and an insult inside a longer word.
    """
    whole = [word] if LENGTH <= len(word) <= WHOLE else []
    return whole + [word[i : i + STEM] for i in range(len(word) - STEM + 1)] if len(word) > STEM else whole


def _codes(strings: list[str], width: int) -> np.ndarray:
    joined = "".join(s.ljust(width, "\0") for s in strings).encode("utf-32-le", "replace")
    return np.frombuffer(joined, np.uint32).reshape(len(strings), width)


def kernel(strings: list[str], landmark: str) -> np.ndarray:
    """The subsequence kernel of each string (all of one length) with ``landmark``, not normalised.

    One pass over the characters of the strings, all strings at a time. ``held[p][j]`` is the weight of common
    subsequences of p characters within the characters read so far and the landmark's first j, up to the ends of both.
    """
    return _kernel(np.ascontiguousarray(_codes(strings, len(strings[0])).T), landmark)


def _kernel(codes: np.ndarray, landmark: str) -> np.ndarray:
    """``kernel`` of the strings whose characters are the columns of ``codes``."""
    (width, n), m, decay = codes.shape, len(landmark), np.float32(DECAY)
    target = _codes([landmark], m)[0].tolist()
    one = np.ones(n, np.float32)
    held = [[one] * m, *[[np.zeros(n, np.float32) for _ in range(m)] for _ in range(LENGTH - 1)]]
    total, meet, along = (np.zeros(n, np.float32) for _ in range(3))
    for i in range(width):
        equal = {c: (codes[i] == c) * (decay * decay) for c in set(target)}
        for j in range(m):
            np.multiply(equal[target[j]], held[-1][j], out=meet)
            total += meet
        for p in range(LENGTH - 1, 0, -1):
            along[:] = 0
            for j in range(m - 1):
                along *= decay
                np.multiply(equal[target[j]], held[p - 1][j], out=meet)
                along += meet
                held[p][j + 1] *= decay
                held[p][j + 1] += along
    return total.astype(float)


def _meeting(letters: np.ndarray, alphabet: dict[str, int], landmark: str) -> np.ndarray:
    """Whether each string has any common subsequence of ``LENGTH`` characters with ``landmark``.

    The columns of ``letters`` are the strings' characters as numbers of ``alphabet``, 0 for all others. ``ends[p]`` has
    a bit for each place of the landmark where a common subsequence of p + 1 characters can end; one can go on at the
    places above the lowest such bit.
    """
    if len(landmark) > 63:
        return np.ones(letters.shape[1], bool)
    kind = np.uint16 if len(landmark) < 16 else np.uint64
    bits = np.zeros(len(alphabet) + 1, kind)
    for j, c in enumerate(landmark):
        bits[alphabet[c]] |= kind(1 << j)
    ends = [np.zeros(letters.shape[1], kind) for _ in range(LENGTH)]
    for at in bits[letters]:
        for p in range(LENGTH - 1, 0, -1):
            below = ends[p - 1]
            # Minus twice the lowest bit is every bit above it.
            ends[p] |= at & -((below & -below) << kind(1))
        ends[0] |= at
    return ends[-1] > 0


def kernels(strings: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel matrix to the power ``POWER``, a kernel too; 1 for equal strings.

    Strings that have no common subsequence with a landmark, which most have not, are told beforehand: 0.
    """
    out = np.zeros((len(strings), len(landmarks)))
    own = np.array([kernel([z], z)[0] for z in landmarks])
    alphabet = {c: i for i, c in enumerate(sorted(set("".join(landmarks))), 1)}
    known = np.array([ord(c) for c in alphabet], np.uint32)
    by_length: dict[int, list[int]] = {}
    for i, s in enumerate(strings):
        by_length.setdefault(len(s), []).append(i)
    for places in by_length.values():
        for begin in range(0, len(places), GROUP):
            part = places[begin : begin + GROUP]
            group = [strings[i] for i in part]
            codes = np.ascontiguousarray(_codes(group, len(group[0])).T)
            letters = np.searchsorted(known, codes).clip(max=len(known) - 1)
            letters = np.where(known[letters] == codes, letters + 1, 0)
            meeting = [np.flatnonzero(_meeting(letters, alphabet, z)) for z in landmarks]
            some = np.unique(np.concatenate(meeting))
            if not len(some):
                continue
            self_kernel = np.zeros(len(group))
            self_kernel[some] = _self_kernels([group[i] for i in some.tolist()])
            rows = np.array(part)
            for j, (z, met) in enumerate(zip(landmarks, meeting)):
                if len(met):
                    values = _kernel(codes[:, met], z) / np.sqrt(self_kernel[met] * own[j])
                    out[rows[met], j] = values**POWER
    return out


def _self_kernels(strings: list[str]) -> np.ndarray:
    """The kernel of each string (all of one length) with itself."""
    n, width = len(strings), len(strings[0])
    codes = _codes(strings, width)
    equal = (codes[:, :, None] == codes[:, None, :]).astype(np.float32) * np.float32(DECAY**2)
    gaps = np.arange(width)[None, :] - np.arange(width)[:, None]
    decayed = np.where(gaps >= 0, DECAY ** np.maximum(gaps, 0).astype(float), 0.0).astype(np.float32)
    before = np.ones((n, width, width), np.float32)
    for _ in range(LENGTH - 1):
        inner = np.einsum("ik,nij,jl->nkl", decayed, equal * before, decayed, optimize=True)
        before = np.zeros_like(before)
        before[:, 1:, 1:] = inner[:, :-1, :-1]
    return (equal * before).sum((1, 2)).astype(float)


#: What a machine consists of.
FIELDS = ("landmarks", "whiten", "weights", "bias", "slope", "offset")


class Machine:
    """Landmarks, their whitening, the weights of the linear machine and the logistic curve."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        values, vectors = np.linalg.eigh(kernels(landmarks, landmarks) + 1e-6 * np.eye(len(landmarks)))
        self.whiten = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
        self.weights, self.bias = np.zeros(len(landmarks)), -1.0
        self.slope, self.offset = 4.0, 0.0

    def plain(self) -> dict:
        """The machine as lists, arrays and numbers."""
        return {name: getattr(self, name) for name in FIELDS}

    @classmethod
    def of_plain(cls, fields: dict) -> "Machine":
        machine = cls.__new__(cls)
        for name in FIELDS:
            setattr(machine, name, fields[name])
        return machine

    def features(self, strings: list[str]) -> np.ndarray:
        return kernels(strings, self.landmarks) @ self.whiten

    def decide(self, strings: list[str]) -> np.ndarray:
        return self.features(strings) @ self.weights + self.bias if strings else np.zeros(0)

    def train(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Linear machine with squared hinge loss, by Newton steps on its support vectors."""
        ones = np.hstack([x, np.ones((len(x), 1))])
        w = np.append(self.weights, self.bias)
        ridge = np.eye(ones.shape[1])
        ridge[-1, -1] = 1e-6
        for _ in range(20):
            active = y * (ones @ w) < 1
            if not active.any():
                break
            a = ones[active] * (COST * weight[active])[:, None]
            new = np.linalg.solve(ones[active].T @ a + ridge, a.T @ y[active])
            if np.allclose(new, w, atol=1e-9):
                break
            w = new
        self.weights, self.bias = w[:-1], float(w[-1])

    def calibrate(self, worst: np.ndarray, y: np.ndarray) -> None:
        """Logistic curve over decisions, with the usual smoothed targets."""
        target = np.where(y, (np.sum(y) + 1) / (np.sum(y) + 2), 1 / (np.sum(~y) + 2))
        ones, b = np.stack([worst, np.ones(len(worst))], 1), np.array([2.0, -2.0])

        def loss(b):
            z = ones @ b
            return float((np.logaddexp(0, z) - target * z).sum() + 1e-2 * (b @ b))

        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(ones @ b, -30, 30)))
            hessian = ones.T @ (ones * (p * (1 - p))[:, None]) + 2e-2 * np.eye(2)
            step = np.linalg.solve(hessian, ones.T @ (p - target) + 2e-2 * b)
            size = 1.0
            while size > 1e-6 and loss(b - size * step) > loss(b):
                size /= 2
            b = b - size * step
        self.slope, self.offset = max(0.1, float(b[0])), float(b[1])

    def score(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.offset, -30, 30)))


def _single_runs(strings: list[str]) -> list[str]:
    """Words spelled out letter by letter: runs of three or more tokens of one letter."""
    out, run = [], ""
    for s in [*strings, "  "]:
        if len(s) == 1:
            run += s
        else:
            if len(run) >= LENGTH:
                out.append(run)
            run = ""
    return out


def sentence_strings(text: str) -> list[list[str]]:
    """Per sentence the strings that are compared."""
    out = []
    for sentence in re.split(r"[.!?\n]+(?:\s|$)", text):
        words = [plain(t) for t in sentence.split()]
        strings = [p for w in [*words, *_single_runs(words)] for p in pieces(w)]
        if strings:
            out.append(strings)
    return out


def fit(texts: list[str], toxic: list[int]) -> Machine:
    """Train on labelled texts; with one label only, everything scores low."""
    rng = np.random.default_rng(3)
    bags = [sorted({s for strings in sentence_strings(t) for s in strings}) for t in texts]
    strings = sorted({s for bag in bags for s in bag})
    place = {s: i for i, s in enumerate(strings)}
    bags = [np.array([place[s] for s in bag], np.int64) for bag in bags]
    y = np.array([1 if t else -1 for t in toxic])
    n_pos, n_neg = int((y > 0).sum()), int((y < 0).sum())

    def held_by(label: int) -> np.ndarray:
        chosen = [bag for bag, l in zip(bags, y) if l == label]
        return np.bincount(np.concatenate(chosen) if chosen else np.zeros(0, np.int64), minlength=len(strings))

    in_toxic, in_clean = held_by(1), held_by(-1)
    p, q = in_toxic / max(1, n_pos), in_clean / max(1, n_neg)
    sure = (p - q) / np.sqrt((p * (1 - p) + 1e-9) / max(1, n_pos) + q * (1 - q) / max(1, n_neg) + 1e-6)
    marks = (in_toxic >= max(3, COMMON_SHARE * n_pos)) & (sure >= SURE) & (q <= 0.2 * p)
    # A run of characters that only its marking word brings along marks nothing by itself.
    longer = [i for i in np.flatnonzero(marks) if len(strings[i]) > STEM]
    for i in np.flatnonzero(marks):
        if any(strings[i] in strings[j] and in_toxic[i] <= 1.2 * in_toxic[j] for j in longer if j != i):
            marks[i] = False
    top: list[str] = []
    for i in sorted(np.flatnonzero(marks).tolist(), key=lambda i: (-sure[i], strings[i])):
        if len(top) < MARKING and (not top or kernels([strings[i]], top).max() < APART):
            top.append(strings[i])
    often = sorted(range(len(strings)), key=lambda i: (-(in_toxic[i] + in_clean[i]), strings[i]))
    others = [strings[i] for i in often if not marks[i]]
    # Also the common strings that come closest to a marking one, so that the two can be told apart.
    near = others[:3000]
    close = {near[i] for i in kernels(near, top).argmax(0)} if top and near else set()
    machine = Machine((top + sorted(close | set(others[:COMMON]))) or ["none"])
    if not top or not n_neg:
        machine.bias, machine.offset = -1.0, -4.0
        return machine
    x = machine.features(strings).astype(np.float32)
    clean = np.flatnonzero(in_clean > 0)
    toxic_bags = [bag for bag, label in zip(bags, y) if label > 0 and len(bag)]
    witnesses = [bag[marks[bag]] for bag in toxic_bags]
    letters = "abcdefghijklmnopqrstuvwxyz"
    for _ in range(ROUNDS):
        counted = np.bincount(np.concatenate(witnesses), minlength=len(strings))
        counted[q > 0.2 * p] = 0  # a string as common in clean documents bears no witness
        own = np.flatnonzero(counted)
        if not len(own):
            break
        changed, changed_weight = [], []
        for i in own.tolist():
            s = strings[i]
            for _ in range(4):
                at = int(rng.integers(1, len(s)))
                changed.append(s[:at] + letters[int(rng.integers(26))] + s[at:])
                changed_weight.append(counted[i] / 8)
        rows = np.vstack([x[clean], x[own], machine.features(changed).astype(np.float32)])
        label = np.concatenate([-np.ones(len(clean)), np.ones(len(own) + len(changed))])
        p_weight = np.array([*counted[own], *changed_weight], float)
        # An error weighs as much as the share of its side's documents that hold the string.
        machine.train(rows, label, np.concatenate([in_clean[clean] / n_neg, MISSED * p_weight / n_pos]))
        worth = x @ machine.weights + machine.bias
        witnesses = [
            bag[chosen] if (chosen := marks[bag] | (worth[bag] >= 1)).any() else bag[[int(worth[bag].argmax())]]
            for bag in toxic_bags
        ]
    worth = x @ machine.weights + machine.bias
    # The curve parts what clean documents reach at worst from what one marking string alone reaches.
    clean_worst = np.array([worth[bag].max() if len(bag) else -2.0 for bag, label in zip(bags, y) if label < 0])
    alone = worth[[strings.index(s) for s in top]]
    decided = np.concatenate([np.maximum(clean_worst, -2.0), np.repeat(alone, max(1, n_neg // len(alone)))])
    machine.calibrate(decided, np.arange(len(decided)) >= n_neg)
    return machine


class Judge:
    """Decisions on strings and words, from the plain fields of a machine; decisions made are kept beside them.

    Runs of ``STEM`` letters a to z are numbered, and their decisions stand in a table by number, as most strings are
    such runs; other strings are remembered by themselves, to a bound.
    """

    def __init__(self, fields: dict):
        self.machine = Machine.of_plain(fields)
        learned = fields["learned"]
        self.seen = learned.setdefault("seen", {})
        self.known = learned.setdefault("known", {})
        if "runs" not in learned:
            learned["runs"] = np.full(26**STEM, np.nan, np.float32)
        self.runs = learned["runs"]

    def strings(self, strings: list[str]) -> np.ndarray:
        seen = self.seen
        new = sorted({s for s in strings if s not in seen})
        if len(seen) + len(new) > REMEMBERED:
            seen.clear()
            new = sorted(set(strings))
        seen.update(zip(new, self.machine.decide(new).astype(np.float32).tolist()))
        return np.array([seen[s] for s in strings], float)

    def tokens(self, tokens: list[str]) -> tuple[list[str], np.ndarray]:
        """The letters of distinct tokens, and the worst decision among the pieces of each."""
        known = self.known
        new = [t for t in tokens if t not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = tokens
        forms = [plain(t) for t in new]
        fresh = dict(zip(new, zip(forms, self.words(forms).tolist()))) if new else {}
        known.update((t, found) for t, found in fresh.items() if len(t) <= LONGEST)
        found = [fresh.get(t) or known[t] for t in tokens]
        return [form for form, _ in found], np.array([worst for _, worst in found], float)

    def words(self, forms: list[str]) -> np.ndarray:
        """The worst decision among the pieces of each word."""
        code = np.frombuffer("\n".join([*forms, ""]).encode("utf-32-le", "replace"), np.uint32).astype(np.int64) - ord("a")
        code[(code < 0) | (code > 25)] = -1
        sizes = np.array([len(form) for form in forms], np.int64)
        ends = np.cumsum(sizes + 1)
        owner = np.repeat(np.arange(len(forms)), sizes + 1)
        out = np.full(len(forms), LOWEST)
        # Words with other letters go string by string, and of the others the whole words.
        other = np.zeros(len(forms), bool)
        inner = np.ones(len(code), bool)
        inner[ends - 1] = False
        other[owner[inner & (code < 0)]] = True
        singles = [(i, p) for i, form in enumerate(forms) for p in (pieces(form) if other[i] else pieces(form)[:1] if LENGTH <= sizes[i] <= WHOLE else [])]
        if len(code) >= STEM:
            windows = np.lib.stride_tricks.sliding_window_view(code, STEM)
            begin = np.flatnonzero((windows >= 0).all(1) & (sizes[owner[: len(windows)]] > STEM) & ~other[owner[: len(windows)]])
            number = windows[begin] @ (26 ** np.arange(STEM - 1, -1, -1))
            missing = np.unique(number[np.isnan(self.runs[number])])
            if len(missing):
                letters = missing[:, None] // 26 ** np.arange(STEM - 1, -1, -1) % 26 + ord("a")
                self.runs[missing] = self.machine.decide(["".join(map(chr, row)) for row in letters.tolist()])
            if len(begin):
                whose = owner[begin]
                first = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]]))
                out[whose[first]] = np.maximum(out[whose[first]], np.maximum.reduceat(self.runs[number].astype(float), first))
        if singles:
            np.maximum.at(out, [i for i, _ in singles], self.strings([p for _, p in singles]))
        return out


def training_sample(docs: DataFrame, labels: DataFrame, learn) -> tuple[list[str], list[int]]:
    """At most ``SAMPLE`` labelled texts per label that ``learn`` (a condition on doc_id) admits, by hash order."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")
    )
    short = docs.where(learn & (F.char_length("text") <= SAMPLE_CHARS))
    # Texts that are too long leave before the ids are limited, so they do not shrink the sample.
    able = stored(short.select("doc_id").distinct().join(known.where(learn), "doc_id"), "labelled")
    parts = []
    for label in (1, 0):
        ids = able.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        rows = short.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(SAMPLE)
        parts += [(row["text"], label) for row in rows.select("text").collect()]
    return [t for t, _ in parts], [l for _, l in parts]


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out=None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from ``THRESHOLD``), worst_word.

    Labels (doc_id, toxic) are learned from documents that are not held out (by default crc32(doc_id as text) mod 3
    is not 1; a NULL doc_id has no label). Contradicting labels of one document count as toxic. NULL texts and texts
    without words get the lowest score. Repeated rows score alike; an empty table gives no rows, and without labels
    of both kinds all scores are low. Only the text enters a score.
    """
    held = F.coalesce(held_out if held_out is not None else F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    machine = fit(*training_sample(rows, labels.select("doc_id", "toxic"), ~held))
    # Plain arrays travel, so executors need no copy of the classes. Decisions that a worker has made stay with its
    # copy for its later tasks.
    sent = rows.sparkSession.sparkContext.broadcast({**machine.plain(), "learned": {}})
    schema = T.StructType([
        rows.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()), T.StructField("worst_word", T.StringType()),
    ])

    def run(batches):
        import pyarrow as pa

        judge = Judge(sent.value)

        for batch in batches:
            begin = 0
            for texts in slices(batch.column(2), 2_000_000):
                part = batch.slice(begin, len(texts))
                begin += len(texts)
                dictionary, index, offsets = tokens(texts)
                forms, per_form = judge.tokens(dictionary.to_pylist())
                # Words spelled letter by letter, per document.
                single = np.array([len(form) == 1 for form in forms], bool)
                letters = single[index] if len(index) else np.zeros(0, bool)
                of = np.repeat(np.arange(len(texts)), np.diff(offsets))
                starts = np.flatnonzero(letters & np.concatenate([[True], ~letters[:-1] | (of[1:] != of[:-1])]) if len(letters) else letters)
                spelled: list[tuple[int, str]] = []
                for a in starts.tolist():
                    b = a
                    while b < len(index) and letters[b] and of[b] == of[a]:
                        b += 1
                    if b - a >= LENGTH:
                        spelled += [(int(of[a]), p) for p in pieces("".join(forms[i] for i in index[a:b].tolist()))]
                of_spelled = judge.strings([p for _, p in spelled]).tolist()
                worst = np.full(len(texts), LOWEST)
                some = np.diff(offsets) > 0
                at = np.full(len(texts), -1)
                if some.any():
                    values = per_form[index]
                    worst[some] = np.maximum.reduceat(values, offsets[:-1][some])
                    hit = np.flatnonzero(values == worst[of])
                    at[of[hit][::-1]] = index[hit][::-1]
                words = [forms[i] if i >= 0 else None for i in at.tolist()]
                for (d, p), worth in zip(spelled, of_spelled):
                    if worth > worst[d]:
                        worst[d], words[d] = worth, p
                score = judge.machine.score(np.maximum(worst, LOWEST))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)),
                     pa.array(words, pa.string())],
                    names=schema.names,
                )

    return rows.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, schema)
