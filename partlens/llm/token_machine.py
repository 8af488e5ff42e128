"""Token counts from a tokenizer compiled into finite-state transducers, run over chunks of text in parallel.

Two machines follow each other. The *splitter* reads characters and marks where pieces begin; it has seven states, and
the split pattern's alternatives (contractions, letters, one number, the rest) are its transitions. The *piece machine*
reads the bytes of a piece; every transition carries the change in the number of tokens, so the sum along a piece is
its number of tokens.

The splitter's state at a character is unknown where a text is cut, so every chunk is run from all states at once: the
result is the chunk's state map. Maps compose, composition is associative, and a prefix scan over the maps gives every
chunk its true first state; a second run from there writes the marks. Chunks are the lanes of array operations.

The piece machine is that of byte-pair merging. The tokens of a prefix are a function of its last bytes alone: a token
that ends at a byte follows the last token of the prefix before it, where the two stay two when merged alone, and just
one token does. A state is therefore the longest suffix that may still grow into a token, with the last token and the
number of tokens at each of its places (relative to its end). States are made when first reached and kept in the
worker's copy of the tables, to a bound; this changes the time and not the result.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partlens.llm.common import add_columns

#: Characters of a chunk, of a window of one long text (cut at a space), and of a step over many texts.
CHUNK, WINDOW, STEP = 256, 1_000_000, 2_000_000
#: States, checked token pairs and pieces that a worker remembers; each table starts anew when full.
REMEMBERED = 300_000
#: The split pattern that the splitter's transitions stand for (fixed by the tokenizer file).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Classes of characters. Those behind LETTER are letters that may follow an apostrophe.
SPACE, NUMBER, OTHER, QUOTE, LETTER, ALONE, R, V, L, E = range(10)
UNKNOWN = 255
# States of the splitter: between pieces, in letters, in other characters, after a leading apostrophe, and after a
# leading apostrophe and r, v or l, which becomes a piece with the letter that completes it, else two pieces.
GAP, LETTERS, OTHERS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(7)
# What a transition emits: a piece begins here, or began one character ago.
HERE, BEFORE = 1, 2


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission by (state, class)."""
    step, out = np.zeros((7, 10), np.uint8), np.zeros((7, 10), np.uint8)
    letters = (LETTER, ALONE, R, V, L, E)

    def on(state, classes, target, emit=0):
        for c in classes:
            step[state, c], out[state, c] = target, emit

    for state in (GAP, LETTERS, OTHERS, QUOTED):
        on(state, [SPACE], GAP)
        on(state, [NUMBER], GAP, HERE)
        on(state, letters, LETTERS, HERE)
        on(state, [OTHER], OTHERS, HERE)
        on(state, [QUOTE], QUOTED, HERE)
    on(LETTERS, letters, LETTERS)
    on(OTHERS, [OTHER, QUOTE], OTHERS)
    on(QUOTED, [OTHER, QUOTE], OTHERS)
    on(QUOTED, [ALONE], GAP)
    for state, first, second in ((QUOTED_R, R, E), (QUOTED_V, V, E), (QUOTED_L, L, L)):
        on(QUOTED, [first], state)
        step[state], out[state] = step[LETTERS], out[LETTERS] | BEFORE
        on(state, [second], GAP)
    return step, out


STEPS, EMITS = splitter()


def piece_starts(classes: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each character; the last class has to be SPACE."""
    size = len(classes)
    lanes = -(-size // CHUNK)
    padded = np.full(lanes * CHUNK, SPACE, np.uint8)
    padded[:size] = classes
    by_place = np.ascontiguousarray(padded.reshape(lanes, CHUNK).T)
    flat = STEPS.ravel()
    # The state map of every chunk: where each of the seven states leads.
    maps = np.repeat(np.arange(7, dtype=np.uint8)[:, None], lanes, axis=1)
    for row in by_place:
        maps = flat[maps * np.uint8(10) + row]
    # Inclusive scan: after the round with distance d, each map covers 2 d chunks up to its own.
    distance = 1
    while distance < lanes:
        later = np.take_along_axis(maps[:, distance:], maps[:, :-distance].astype(np.intp), axis=0)
        maps = np.concatenate([maps[:, :distance], later], axis=1)
        distance *= 2
    state = np.concatenate([[GAP], maps[GAP, :-1]]).astype(np.uint8)
    emitted = np.empty((CHUNK, lanes), np.uint8)
    emits = EMITS.ravel()
    for at, row in enumerate(by_place):
        index = state * np.uint8(10) + row
        emitted[at] = emits[index]
        state = flat[index]
    marks = np.ascontiguousarray(emitted.T).ravel()[:size]
    starts = (marks & HERE).astype(bool)
    starts[:-1] |= (marks[1:] & BEFORE).astype(bool)
    return starts


# Compilation ------------------------------------------------------------------


def byte_chars() -> list[str]:
    """The character of each byte: itself where Latin-1 prints it, else the next of U+0100 onwards."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def compiled(text: str) -> dict:
    """Plain tables of a tokenizer file (its JSON); ValueError where the machines do not fit it.

    A piece is a run of symbols: its bytes, the last one with the word end (256 is added to it), written as the
    characters of these numbers. ``spelled`` holds the symbols of each token, ``parts`` the two tokens that it is
    merged from, and ``pair`` the place of a merge by its two tokens.
    """
    data = json.loads(text)
    model, added = data["model"], data["added_tokens"]
    normal = [n["type"] for n in (data["normalizer"] or {}).get("normalizers", [])]
    split = [p for p in (data["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
    fits = (
        model["type"] == "BPE" and not model["dropout"] and not model["unk_token"] and not model["ignore_merges"]
        and model["end_of_word_suffix"] and normal == ["NFC", "Replace", "Lowercase"]
        and [p["pattern"].get("Regex") for p in split] == [PATTERN]
        and not any(a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"] for a in added)
    )
    if not fits:
        raise ValueError("the machines fit lower-cased byte-pair files with word ends and the known split pattern only")
    end = model["end_of_word_suffix"]
    byte_of = {c: b for b, c in enumerate(byte_chars())}

    def symbols(token: str) -> str:
        if token.endswith(end) and token != end:
            plain = [byte_of[c] for c in token[: -len(end)]]
            return "".join(map(chr, [*plain[:-1], plain[-1] + 256]))
        return "".join(chr(byte_of[c]) for c in token)

    spelled = [chr(s) for s in range(512)]
    number = {token: s for s, token in enumerate(spelled)}
    parts: list = [None] * 512
    pair: dict[tuple[int, int], int] = {}
    for place, merge in enumerate(model["merges"]):
        left, right = (number.get(symbols(half)) for half in (merge if isinstance(merge, list) else merge.split(" ")))
        if left is None or right is None or spelled[left] + spelled[right] in number:
            raise ValueError("a merge that uses a later token, or makes a token anew")
        number[spelled[left] + spelled[right]] = len(spelled)
        pair[left, right] = place
        spelled.append(spelled[left] + spelled[right])
        parts.append((left, right))
    return {
        "pair": pair, "parts": parts, "spelled": spelled,
        "added": [a["content"] for a in added], "json": text,
    }


class PieceMachine:
    """The number of tokens of a piece, from plain tables; ``tables`` also keeps what was learned."""

    def __init__(self, tables: dict):
        self.pair, self.parts, self.spelled = tables["pair"], tables["parts"], tables["spelled"]
        learned = tables.setdefault("learned", {})
        if not learned:
            learned["stays"] = {}
            learned["edges"] = {}
            self.learned = learned
            # Only tokens that their own merges lead to can occur: others are passed by.
            whole = [t for t in range(len(self.parts)) if t < 512 or self._reached(t)]
            learned["suffix"] = {self.spelled[t]: t for t in whole}
            learned["growing"] = {self.spelled[t][:k] for t in whole for k in range(1, len(self.spelled[t]))}
            self._fresh()
        self.learned = learned

    def _fresh(self) -> None:
        """Only the state of the empty prefix: nothing read, no token, and one place."""
        start = ("", ((-1, 0),))
        self.learned |= {"states": [start], "index": {start: 0}, "next": {}}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at an edge (side 0 left, 1 right) over time, and the merge place that uses each up."""
        out, limit = [(token, len(self.parts))], token
        while self.parts[limit]:
            out.append((self.parts[limit][side], limit - 512))
            limit = self.parts[limit][side]
        return out

    def _edges(self, token: int):
        edges = self.learned["edges"]
        if token not in edges:
            if len(edges) >= REMEMBERED:
                edges.clear()
            edges[token] = (self._edge(token, 0), self._edge(token, 1))
        return edges[token]

    def _meets(self, left: int, right: int, own: int | None = None) -> bool:
        """Whether some merge takes a token of the left one's right edge and one of the right one's left edge.

        It does if it comes before both are used up; a merge of the same place goes to the left pair first. ``own`` is
        the place of the merge of the two themselves, which does not count.
        """
        limit = len(self.parts) if own is None else own
        for a, a_used in self._edges(left)[1]:
            for b, b_used in self._edges(right)[0]:
                place = self.pair.get((a, b))
                if place is not None and place != own and place < min(a_used, limit) and place <= min(b_used, limit):
                    return True
        return False

    def _reached(self, token: int) -> bool:
        left, right = self.parts[token]
        return not self._meets(left, right, token - 512)

    def _stays(self, left: int, right: int) -> bool:
        """Whether two tokens side by side stay two."""
        stays = self.learned["stays"]
        known = stays.get((left, right))
        if known is None:
            if len(stays) >= REMEMBERED:
                stays.clear()
            known = stays[left, right] = not self._meets(left, right)
        return known

    def step(self, state: int, symbol: str) -> tuple[int, int]:
        """(next state, change in the number of tokens) of a transition that is used for the first time."""
        learned = self.learned
        suffix, places = learned["states"][state]
        # places[k] holds the last token k symbols before the end, and the number of tokens there less that at the
        # end; a token of size k + 1 follows it. The first place of a piece has no token (-1) and fits any.
        grown = suffix + symbol
        tokens, size = learned["suffix"], len(grown)
        while True:
            token = tokens.get(grown[-size:])
            if token is not None:
                before, count = places[size - 1]
                if before < 0 or self._stays(before, token):
                    break
            size -= 1
        change = count + 1
        growing, keep = learned["growing"], grown
        while keep and keep not in growing:
            keep = keep[1:]
        key = (keep, ((token, 0), *[(t, c - change) for t, c in places[: len(keep)]]))
        index = learned["index"]
        if key not in index:
            index[key] = len(learned["states"])
            learned["states"].append(key)
        learned["next"][state, symbol] = made = (index[key], change)
        return made

    def count(self, piece: bytes) -> int:
        learned = self.learned
        if len(learned["states"]) + len(learned["next"]) >= 2 * REMEMBERED:
            self._fresh()
        state = total = 0
        known = learned["next"]
        symbols = piece.decode("latin-1")
        for symbol in (*symbols[:-1], chr(piece[-1] + 256)):
            state, change = known.get((state, symbol)) or self.step(state, symbol)
            total += change
        return total


class Counter:
    """Token counts of texts, from the tables of ``compiled``."""

    def __init__(self, tables: dict):
        from tokenizers import Tokenizer

        self.pieces = PieceMachine(tables)
        self.library = Tokenizer.from_str(tables["json"])
        self.added = re.compile("|".join(map(re.escape, tables["added"]))) if tables["added"] else None
        self.seen = tables["learned"].setdefault("seen", {})
        classes = tables["learned"].setdefault("classes", np.full(0x110000, UNKNOWN, np.uint8))
        self.classes = classes

    def normalized(self, text: str) -> str:
        """NFC and lower case. White space is left as it is: all of it is one class for the splitter.

        Where every character is an old one and none can combine, Python agrees with the library, but for the final
        sigma, which the library does not know; all other texts go through the library.
        """
        if text.isascii():
            return text.lower()
        if not _ODD.search(text) and unicodedata.is_normalized("NFC", text):
            return text.replace("Σ", "σ").lower()
        return self.library.normalizer.normalize_str(text)

    def learn(self, points: np.ndarray) -> None:
        """Classes of code points, as the library's own split treats them."""
        split = self.library.pre_tokenizer.pre_tokenize_str
        for point in points.tolist():
            c = chr(point)
            if len(split(f"a{c}a")) == 1:
                kind = LETTER
            elif len(split(f"!{c}!")) == 1:
                kind = OTHER
            else:
                kind = NUMBER if len(split(f"!{c}!")) == 3 else SPACE
            special = {"'": QUOTE, "r": R, "v": V, "l": L, "e": E, "s": ALONE, "t": ALONE, "m": ALONE, "d": ALONE}
            self.classes[point] = special.get(c, kind)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of normalized texts without added tokens."""
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = self.classes[points]
        if (classes == UNKNOWN).any():
            self.learn(np.unique(points[classes == UNKNOWN]))
            classes = self.classes[points]
        starts = piece_starts(classes)
        # A piece ends at the next piece or white space.
        edges = np.flatnonzero(starts | (classes == SPACE))
        first = starts[edges]
        begins, ends = edges[first], edges[np.flatnonzero(first) + 1]
        seen, found = self.seen, []
        for a, b in zip(begins.tolist(), ends.tolist()):
            piece = joined[a:b]
            n = seen.get(piece)
            if n is None:
                n = self.pieces.count(piece.encode("utf-8", "replace"))
                if len(piece) < 64:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[piece] = n
            found.append(n)
        # Running sums: a text's tokens are those of the pieces between its two ends.
        sums = np.concatenate([[0], np.cumsum(np.array(found, np.int64))])
        sizes = np.cumsum([len(text) + 1 for text in texts])
        return np.diff(sums[np.searchsorted(begins, sizes)], prepend=0)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        units, owners, size = [], [], 0

        def flush():
            nonlocal units, owners, size
            if units:
                np.add.at(out, owners, self.counts(units))
            units, owners, size = [], [], 0

        for i, text in enumerate(texts):
            for part in self._parts(text or "", i, out):
                units.append(self.normalized(part))
                owners.append(i)
                size += len(part) + 1
                if size >= STEP:
                    flush()
        flush()
        return out

    def _parts(self, text: str, i: int, out: np.ndarray):
        """Windows of a text, cut at spaces, without added tokens; those are counted here."""
        if self.added and "<" in text:
            parts = self.added.split(text)
            out[i] += len(parts) - 1
        else:
            parts = [text]
        for part in parts:
            at = 0
            while len(part) - at > WINDOW:
                cut = part.find(" ", at + WINDOW)
                if cut < 0:
                    break
                yield part[at:cut]
                at = cut
            yield part[at:]


#: Characters outside the blocks that have been full for long, or that may combine: left to the library.
_ODD = re.compile("[^\x00-˿Ͱ-҂Ҋ-ԯ - ‐-‧　-〩一-龥가-힣]")


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """Add ``name``: the number of tokens that the tokenizer file gives for every row's whole text.

    Special strings inside a text count as one token each; nothing is added, cut or filled up. NULL and empty texts
    have none. Rows are independent: repeated rows give repeated results, an empty table gives none. A text of any
    length is read in windows cut at spaces (one without spaces is one window). A column called ``name`` is replaced,
    all others stay.
    """
    import pyarrow as pa

    with open(tokenizer_path, encoding="utf-8") as lines:
        tables = docs.sparkSession.sparkContext.broadcast(compiled(lines.read()))

    def task():
        counter = Counter(tables.value)
        return lambda texts: [pa.array(counter(texts.to_pylist()), pa.int64())]

    return add_columns(docs, [T.StructField(name, T.LongType(), False)], [text], task)


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
