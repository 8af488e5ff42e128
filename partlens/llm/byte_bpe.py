"""Byte-level BPE encoding with offsets, and decoding, over Arrow batches with the ``tokenizers`` library.

The vocabulary is a rank file (base64 token and rank per line). The library works on characters, so each byte
stands for one printable character (``byte_chars``). A rank file gives no merge list: every way to cut a token into
two tokens is a merge, with the rank of the token, which is what merging by rank means.

Texts are cut before each space that a non-space follows. No match of the split pattern reaches over such a point and
none depends on what lies behind it, so the cuts can be encoded one by one, and those seen before in the task come
from a table of bounded size.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partlens.llm.common import add_columns

#: Cuts that one task remembers; the table starts anew when full, which changes the time and not the result.
REMEMBERED = 200_000


def byte_chars() -> list[str]:
    """The character of each byte: itself where Latin-1 prints it, else the next of U+0100 onwards."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def tokenizer_json(ranks: dict[bytes, int]) -> str:
    """The library's model of a rank file, as text that travels to the tasks."""
    from tokenizers import Tokenizer, models

    chars = byte_chars()
    spell = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = [
        (spell[token[:cut]], spell[token[cut:]])
        for token in sorted(ranks, key=ranks.get)
        for cut in range(1, len(token))
        if token[:cut] in ranks and token[cut:] in ranks
    ]
    return Tokenizer(models.BPE(vocab={spell[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)).to_str()


def read_model(model_json: str):
    """The library's model; a task reads it once, as it takes tens of megabytes."""
    from tokenizers import Tokenizer

    return Tokenizer.from_str(model_json).model


def piece_encoder(model, pattern: str, with_offsets: bool = True):
    """A function from a text to (ids, start and end characters of each token), or to (ids,) alone.

    A token that holds part of a character's bytes gets the span of that whole character.
    """
    import regex

    split = regex.compile(pattern).findall
    tokenize = model.tokenize
    chars = byte_chars()
    ascii_chars = {b: chars[b] for b in range(128)}

    def spelled(piece: str) -> str:
        if piece.isascii():
            return piece.translate(ascii_chars)
        return "".join([chars[b] for b in piece.encode("utf-8", "replace")])

    def encode_ids(text: str):
        return ([token.id for piece in split(text) for token in tokenize(spelled(piece))],)

    def encode(text: str):
        ids, starts, ends, at = [], [], [], 0
        for piece in split(text):
            owner = [at + i for i, c in enumerate(piece) for _ in c.encode("utf-8", "replace")]
            done = 0
            for token in tokenize(spelled(piece)):
                size = len(token.value)
                ids.append(token.id)
                starts.append(owner[done])
                ends.append(owner[done + size - 1] + 1)
                done += size
            at += len(piece)
        return ids, starts, ends

    return encode if with_offsets else encode_ids


def word_encoder(model, pattern: str):
    """Whether the pattern keeps a space with the letters after it, and a function that encodes such a piece."""
    import regex

    tokenize = model.tokenize
    chars = byte_chars()
    plain = regex.findall(pattern, " ab, ab.c") == [" ab", ",", " ab", ".", "c"]

    def encode_word(word: str) -> list[int]:
        spelled = word if word.isascii() else "".join([chars[b] for b in word.encode("utf-8", "replace")])
        return [token.id for token in tokenize(chars[0x20] + spelled)]

    return plain, encode_word


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", with_offsets: bool = True
) -> DataFrame:
    """Add ``ids`` and, with offsets, ``starts`` and ``ends`` (code points, end exclusive) to every row.

    NULL and empty texts give empty arrays. Columns of these names are replaced, all others stay. Rows are
    independent: repeated rows give repeated results.
    """
    import pyarrow as pa

    model_json = docs.sparkSession.sparkContext.broadcast(tokenizer_json(read_ranks(ranks_path)))
    numbers = T.ArrayType(T.IntegerType())
    names = ["ids", "starts", "ends"] if with_offsets else ["ids"]

    def offsets_task():
        encode_text = piece_encoder(read_model(model_json.value), pattern)

        def compute(texts):
            found = [encode_text(value) if value else ([], [], []) for value in texts.to_pylist()]
            return [pa.array([x[k] for x in found], pa.list_(pa.int32())) for k in range(3)]

        return compute

    def ids_task():
        import re
        from array import array

        model = read_model(model_json.value)
        encode_text = piece_encoder(model, pattern, with_offsets=False)
        # A space before white space or the end is no place to cut; such texts are encoded as one.
        odd = re.compile(r" (?=\s|\Z)|\A ").search
        seen: dict[str, bytes] = {}

        def packed(piece: str) -> bytes:
            return array("i", encode_text(piece)[0]).tobytes()

        def learn(part: str) -> bytes:
            """The ids of a space and ``part``, without a space or other gap at its start."""
            if len(seen) >= REMEMBERED:
                seen.clear()
            if plain and part[-1] in ".,;:" and part[:-1].isalpha():
                ids = (seen.get(part[:-1]) or learn(part[:-1])) + marks[part[-1]]
            elif plain and part.isalpha():
                ids = array("i", encode_word(part)).tobytes()
            else:
                ids = packed(" " + part)
            if len(part) < 64:
                seen[part] = ids
            return ids

        plain, encode_word = word_encoder(model, pattern)
        marks = {mark: packed(mark) for mark in ".,;:"}

        def compute(texts):
            joined, sizes = [], [0]
            for value in texts.to_pylist():
                if not value:
                    sizes.append(sizes[-1])
                    continue
                if odd(value):
                    ids = packed(value)
                else:
                    parts = value.split(" ")
                    ids = packed(parts[0]) + b"".join([seen.get(part) or learn(part) for part in parts[1:]])
                joined.append(ids)
                sizes.append(sizes[-1] + len(ids) // 4)
            flat = pa.Array.from_buffers(pa.int32(), sizes[-1], [None, pa.py_buffer(b"".join(joined))])
            return [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)]

        return compute

    task = offsets_task if with_offsets else ids_task
    return add_columns(docs, [T.StructField(n, numbers, False) for n in names], [text], task)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded_bytes`` and ``decoded``: the bytes of all ids, joined, and their text.

    Bytes are joined before they are read as UTF-8, so a character whose bytes lie in several tokens comes back
    whole; what is no UTF-8 (cut id lists) becomes U+FFFD in ``decoded`` and stays in ``decoded_bytes``.
    A NULL list counts as empty; NULL and unknown ids stand for no bytes.
    """
    import pyarrow as pa

    ranks = read_ranks(ranks_path)
    by_id = [b""] * (max(ranks.values()) + 2)  # the last stands for unknown ids
    for token, i in ranks.items():
        by_id[i] = token
    known = df.sparkSession.sparkContext.broadcast(by_id)

    def task():
        table = np.empty(len(known.value), object)
        table[:] = known.value

        def compute(lists):
            offsets = lists.offsets.to_numpy()
            flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).fill_null(-1).to_numpy(zero_copy_only=False)
            pieces = table[np.where((flat < 0) | (flat >= len(table)), len(table) - 1, flat)].tolist()
            offsets = (offsets - offsets[0]).tolist()
            empty = lists.is_null().to_pylist()
            raw = [b"" if e else b"".join(pieces[a:b]) for a, b, e in zip(offsets[:-1], offsets[1:], empty)]
            return [pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())]

        return compute

    fields = [T.StructField("decoded_bytes", T.BinaryType(), False), T.StructField("decoded", T.StringType(), False)]
    return add_columns(df, fields, [ids], task)


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by commas, in lower-case hex."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256)
