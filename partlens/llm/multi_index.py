"""Approximate nearest neighbours by inner product with an inverted multi-index.

The two halves of the vectors are quantised apart, so ``k`` centroids each give ``k * k`` cells. A query walks the
pairs of centroids in the order of their summed distance (minus the inner product with the query's halves), with a
heap, until the cells it has met hold enough entries, and the entries of these cells are ranked by their exact inner
product. How many entries are enough is measured when the index is fitted: on a bounded sample, as the share of
entries to walk before the wanted part of the true neighbours has been met.

Ranking is block against block: the entries of a first centroid, cut into bounded blocks, meet the queries that visit
them, in bounded blocks too, so a cell that holds a third of all entries is spread like any other.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partlens.llm.common import stored

#: Centroids per half (at most 63: a query's visited cells travel as bits), fitting sample, queries tried on it.
CENTROIDS, SAMPLE, TRIED = 32, 20_000, 200
#: Part of the true neighbours that the walk has to meet on the sample. The smaller sample has farther neighbours
#: than the whole table, so the whole table comes out above.
RECALL = 0.95
#: Entries and queries that meet in one group.
ENTRY_BLOCK, QUERY_BLOCK = 4096, 1024


def valid_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) of usable rows: not NULL or zero, all components finite, of the commonest length; repeats once."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (common["d"] if common else 0)).distinct()


def _k_means(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    rng = np.random.default_rng(11)
    centres = np.unique(x, axis=0)
    centres = centres[rng.permutation(len(centres))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        for c in range(len(centres)):
            own = x[near == c]
            if len(own):
                centres[c] = own.mean(0)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


def _split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = (x.shape[1] + 1) // 2
    return x[:, :half], x[:, half:] if x.shape[1] > 1 else np.zeros((len(x), 1))


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: int):
    """Pairs of centroids by rising summed distance until they hold ``enough`` entries (multi-sequence walk)."""
    a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    heap, pushed, met = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, 0
    while heap and met < enough:
        _, i, j = heapq.heappop(heap)
        met += int(sizes[a[i], b[j]])
        yield a[i], b[j]
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in pushed:
                pushed.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))


def fit(sample: np.ndarray, neighbours: int, k: int = CENTROIDS, recall: float = RECALL, tried: int = TRIED):
    """(centroids of each half, share of all entries to walk) from a bounded sample of vectors."""
    left, right = _split(sample)
    c1, c2 = _k_means(left, k), _k_means(right, k)
    n1, n2 = _nearest(left, c1), _nearest(right, c2)
    sizes = np.zeros((len(c1), len(c2)), np.int64)
    np.add.at(sizes, (n1, n2), 1)
    needed = []
    for q in range(min(tried, len(sample))):
        order = np.argsort(-(sample @ sample[q]), kind="stable")
        true = order[order != q][:neighbours]
        met, at = 0, {}
        for cell in walk(-c1 @ left[q], -c2 @ right[q], sizes, len(sample)):
            met += sizes[cell]
            at[cell] = met
        needed += [at[n1[t], n2[t]] / len(sample) for t in true]
    return c1, c2, float(np.quantile(needed, recall)) if needed else 1.0


def search(
    df: DataFrame, queries, neighbours: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
    k: int = CENTROIDS, sample: int = SAMPLE, recall: float = RECALL,
) -> DataFrame:
    """The ``neighbours`` nearest found per query: query_id, rank (from 1), vec_id, score; ties to the smaller vec_id.

    ``queries`` is a condition on ``vec_id``. Candidates are all rows but those of the query's own id. Rows whose
    vector is NULL or zero, holds NULL or non-finite components or has not the commonest length take no part, nor do
    rows without an id. Rows that repeat an id count with their best score. Extra columns are ignored; an empty table
    gives no rows. The scores are exact inner products in double precision.
    """
    id_type = df.schema[vec_id].dataType
    rows = stored(valid_vectors(df, vec_id, vector), "vectors")
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    result = T.StructType([
        T.StructField("query_id", id_type), T.StructField("vec_id", id_type), T.StructField("score", T.DoubleType())
    ])
    if few.num_rows == 0:
        return df.sparkSession.createDataFrame([], result).select(
            "query_id", F.lit(1).alias("rank"), "vec_id", "score"
        )
    c1, c2, share = fit(np.stack([x.values.to_numpy() for x in few.column(0).combine_chunks()]), neighbours, k, recall)
    books = df.sparkSession.sparkContext.broadcast((c1, c2))

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                left, right = _split(v)
                cells = [pa.array(_nearest(h, c).astype(np.int32)) for h, c in zip((left, right), books.value)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cells], names=["vec_id", "v", "c1", "c2"])

    cells = T.StructType([*rows.schema.fields, T.StructField("c1", T.IntegerType()), T.StructField("c2", T.IntegerType())])
    index = stored(rows.mapInArrow(assign, cells), "index")
    sizes = np.zeros((len(c1), len(c2)), np.int64)
    for row in index.groupBy("c1", "c2").count().collect():  # at most k * k
        sizes[row["c1"], row["c2"]] = row["count"]
    total = int(sizes.sum())
    enough = min(total, max(math.ceil(share * total), 10 * neighbours))
    entry_blocks = [max(1, math.ceil(n / ENTRY_BLOCK)) for n in sizes.sum(1).tolist()]
    asked = index.where(queries)
    query_blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))

    def visit(batches):
        import pyarrow as pa

        for batch in batches:
            out = ([], [], [], [])
            for i in range(batch.num_rows):
                v = batch.column(1)[i].values.to_numpy()
                left, right = _split(v[None])
                bits: dict[int, int] = {}
                for a, b in walk(-books.value[0] @ left[0], -books.value[1] @ right[0], sizes, enough):
                    bits[a] = bits.get(a, 0) | 1 << b
                for a, seen in bits.items():
                    for column, value in zip(out, (i, a, seen)):
                        column.append(value)
            take = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64())],
                names=["query_id", "q", "c1", "seen"],
            )

    visits = T.StructType([
        T.StructField("query_id", id_type), T.StructField("q", T.ArrayType(T.DoubleType())),
        T.StructField("c1", T.IntegerType()), T.StructField("seen", T.LongType()),
    ])
    blocks_of = F.element_at(F.array(*[F.lit(n) for n in entry_blocks]), F.col("c1") + 1)
    left = index.withColumn("e", F.pmod(F.xxhash64("vec_id"), blocks_of)).withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    )
    right = asked.select("vec_id", "v").mapInArrow(visit, visits).withColumn(
        "b", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")
    ).withColumn("e", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks_of.cast("bigint") - 1)))

    def rank(entries, wanted):
        import pyarrow as pa

        found = ([], [], [])
        if entries.num_rows and wanted.num_rows:
            ids = entries["vec_id"].combine_chunks()
            x = np.stack([v.values.to_numpy() for v in entries["v"].combine_chunks()])
            q = np.stack([v.values.to_numpy() for v in wanted["q"].combine_chunks()])
            cell, seen = entries["c2"].to_numpy(), wanted["seen"].to_numpy()
            names = ids.to_numpy(zero_copy_only=False)
            place = np.argsort(np.argsort(names, kind="stable"), kind="stable")
            own = wanted["query_id"].to_numpy()
            for r in range(wanted.num_rows):
                may = np.flatnonzero((seen[r] >> cell & 1).astype(bool) & (names != own[r]))
                if not len(may):
                    continue
                near = x[may] @ q[r]
                if len(may) > neighbours:
                    bound = np.partition(near, -neighbours)[-neighbours]
                    may = may[near >= bound - 1e-9 * max(1.0, abs(bound))]
                exact = (x[may] * q[r]).sum(1)  # the same sum wherever a pair meets, so ties are ties
                best = np.lexsort((place[may], -exact))[:neighbours]
                found[0].append(np.full(len(best), r))
                found[1].append(may[best])
                found[2].append(exact[best])
        rows_, at, score = (np.concatenate(f) if f else np.zeros(0) for f in found)
        if not len(score):
            return pa.table({"query_id": wanted["query_id"].slice(0, 0), "vec_id": entries["vec_id"].slice(0, 0), "score": pa.array([], pa.float64())})
        return pa.table({"query_id": wanted["query_id"].take(pa.array(rows_)), "vec_id": entries["vec_id"].take(pa.array(at)), "score": pa.array(score)})

    near = left.groupBy("c1", "e", "b").cogroup(right.groupBy("c1", "e", "b")).applyInArrow(rank, result)
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours).select(
        "query_id", "rank", "vec_id", "score"
    )
