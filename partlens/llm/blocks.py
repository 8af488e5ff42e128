"""Blocks of documents whose distinct symbols are looked up in a table too large to send to every task.

A task turns a few megabytes of documents into one block row: the documents, the distinct symbols they hold, and the
documents' contents as numbers of these symbols. Only the distinct symbols of a block are joined to the table, by a
shuffle on the symbol; the found values come back to the block as one list in the order of its symbols.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlens.llm.common import small_batches


def numbered(batches, limit: int):
    """(block number, part of an Arrow batch of about ``limit`` bytes); numbers are unique among partitions."""
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 33
    for i, batch in enumerate(small_batches(batches, limit)):
        yield first + i, batch


def symbols(blocks: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per block and distinct symbol: block, its place ``at``, and the items of the list columns ``names``."""
    lists = F.arrays_zip(*names)
    return blocks.select("block", F.posexplode(lists).alias("at", "item")).select("block", "at", "item.*")


def returned(found: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per block the lists of found values, ordered by place; every symbol needs its row."""
    rows = F.array_sort(F.collect_list(F.struct("at", *names)))
    grouped = found.groupBy("block").agg(rows.alias("rows"))
    return grouped.select("block", *[F.col(f"rows.{name}").alias(name) for name in names])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 to 2**32 - 1 as compressed bytes, equal bytes of the numbers side by side."""
    import pyarrow as pa

    planes = b"".join(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in arrays)
    head = np.array([len(arrays), *map(len, arrays)], "<u4").tobytes()
    return head + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    import pyarrow as pa

    (count,) = np.frombuffer(data[:4], "<u4").tolist()
    sizes = np.frombuffer(data[4 : 4 + 4 * count], "<u4").tolist()
    raw = pa.decompress(data[4 + 4 * count :], 4 * sum(sizes), codec="zstd", asbytes=True)
    parts, at = [], 0
    for size in sizes:
        planes = np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, size)
        parts.append(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))
        at += 4 * size
    return parts
