"""Hashed words and word shingles of whole texts, over Arrow arrays inside tasks."""

from __future__ import annotations

import numpy as np

_WORD_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts, limit: int = 4_000_000):
    """Cut an array of texts into runs of about ``limit`` bytes; a longer text is a run of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    groups = np.cumsum(sizes) // limit
    edges = np.flatnonzero(np.diff(groups)) + 1
    begin = 0
    for end in [*edges.tolist(), len(texts)]:
        if end > begin:
            yield texts.slice(begin, end - begin)
            begin = end


def tokens(texts):
    """(dictionary array of words, index of each word, offsets of each text) with A-Z in lower case."""
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    first, last = offsets[0], offsets[-1]
    encoded = lists.values.slice(first, last - first).dictionary_encode()
    index = encoded.indices.to_numpy(zero_copy_only=False)
    blank = pc.index(encoded.dictionary, "").as_py()
    offsets = offsets - first
    if blank >= 0:
        real = index != blank
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        index = index[real]
    return encoded.dictionary, index, offsets


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, offsets of each text)."""
    import pandas as pd

    dictionary, index, offsets = tokens(texts)
    values = dictionary.to_numpy(zero_copy_only=False)
    hashed = pd.util.hash_array(values, categorize=False) if len(values) else np.zeros(0, np.uint64)
    return hashed[index], offsets


def shingle_hashes(texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``size`` words, offsets of each text), repeats included.

    A text with fewer words gives its whole word sequence as one shingle, one without words none.
    """
    words, offsets = word_hashes(texts)
    counts = np.diff(offsets)
    n = len(words)
    rolled = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        rolled = rolled * _WORD_STEP + words[k : n - size + 1 + k]
    rolled = mix(rolled)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_offsets = np.concatenate([[0], np.cumsum(made)])
    start_of = np.repeat(offsets[:-1], made)
    within = np.arange(out_offsets[-1]) - np.repeat(out_offsets[:-1], made)
    at = start_of + within
    out = rolled[np.minimum(at, max(0, len(rolled) - 1))] if len(rolled) else np.zeros(len(at), np.uint64)
    for text in np.flatnonzero((counts > 0) & (counts < size)):
        value = np.uint64(0)
        with np.errstate(over="ignore"):
            for word in words[offsets[text] : offsets[text + 1]]:
                value = value * _WORD_STEP + word
            out[out_offsets[text]] = mix(mix(np.array([value + np.uint64(counts[text])])))[0]
    return out, out_offsets


def distinct_sets(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted and without repeats, and the new offsets."""
    parts = [np.unique(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    sizes = [len(part) for part in parts]
    return (np.concatenate(parts) if parts else values), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
