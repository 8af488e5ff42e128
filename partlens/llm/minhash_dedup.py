"""Near-duplicate documents by tensored MinHash banding, every link confirmed on full shingle sets.

Tensored banding: two collections of ``m`` short hashes, each of ``width`` minimum values, are computed per document.
A table key is a pair, one hash out of each collection, so ``2 * m`` short hashes give ``m * m`` tables of
``2 * width`` values each: about the square root of the minimum values that as many separate tables would cost.

Documents with equal shingle sets are one node. Inside a bucket no pairs are formed at first: all members are compared
with one pivot. Only buckets whose members still lie in several components go on, and there only pairs that shared
shingles still allow are compared: blocks of a bucket's members meet block by block, however large the bucket. Both
bounds are exact, so no link between candidates is lost.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partlens.llm.common import bounded_batches, free_name, stored, with_keys
from partlens.llm.components import components
from partlens.llm.shingles import distinct_sets, mix, shingle_hashes, slices

#: Minimum values in one short hash; a table key has twice as many.
WIDTH = 3
#: Parts of the hash range in which shared shingles are counted to rule out pairs.
PARTS = 64
#: Members of an open bucket in one block; two blocks meet in one row.
BLOCK = 512
#: Bytes of text whose minimum values are computed at once; the worker's memory follows them.
SLICE = 1_000_000
#: Chance to miss a single pair that is just similar enough, per collection.
MISSED = 1e-3


def collection_size(percent: int, width: int = WIDTH, missed: float = MISSED) -> int:
    """Short hashes per collection so that similar pairs agree on one with chance 1 - ``missed``."""
    agree = (percent / 100) ** width
    return 1 if agree >= 1 else max(1, math.ceil(math.log(missed) / math.log(1 - agree)))


def signatures(docs: DataFrame, size: int, m: int, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, a 128-bit fingerprint of the set (f, g) and the two collections (u, v)."""
    schema = T.StructType([
        docs.schema[doc_id], T.StructField("n_shingles", T.LongType()), T.StructField("f", T.LongType()),
        T.StructField("g", T.LongType()), T.StructField("u", T.ArrayType(T.LongType())),
        T.StructField("v", T.ArrayType(T.LongType())),
    ])

    def run(batches):
        import pyarrow as pa

        rng = np.random.default_rng(20240229)
        odd = rng.integers(0, 2**63, (2 * m, width), np.uint64) * np.uint64(2) + np.uint64(1)
        flip = rng.integers(0, 2**63, (2 * m, width), np.uint64)
        for batch in batches:
            begin = 0
            for texts in slices(batch.column(1), SLICE):
                ids = batch.column(0).slice(begin, len(texts))
                begin += len(texts)
                values, offsets = distinct_sets(*shingle_hashes(texts, size))
                counts = np.diff(offsets)
                some = counts > 0
                starts = offsets[:-1][some]
                short = np.zeros((len(texts), 2 * m), np.uint64)
                prints = np.zeros((len(texts), 2), np.uint64)
                if len(starts):
                    prints[some, 0] = np.add.reduceat(mix(values), starts)
                    prints[some, 1] = np.add.reduceat(mix(values ^ flip[0, 0]), starts)
                    for j in range(2 * m):
                        joined = np.zeros(len(starts), np.uint64)
                        for k in range(width):
                            joined = mix(joined + np.minimum.reduceat((values ^ flip[j, k]) * odd[j, k], starts))
                        short[some, j] = joined
                lists = [
                    pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum(np.where(some, m, 0))]), pa.int32()),
                        pa.array(short[some, side].ravel().view(np.int64)),
                    )
                    for side in (slice(0, m), slice(m, 2 * m))
                ]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(counts), pa.array(prints[:, 0].copy().view(np.int64)),
                     pa.array(prints[:, 1].copy().view(np.int64)), *lists],
                    names=schema.names,
                )

    return docs.select(doc_id, text).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """Per row: doc, fingerprint f and the sorted shingle set as hashes."""
    schema = T.StructType([
        T.StructField("doc", docs.schema[doc_id].dataType), T.StructField("f", T.LongType()),
        T.StructField("shingles", T.ArrayType(T.LongType())),
    ])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            begin = 0
            for texts in slices(batch.column(1)):
                ids = batch.column(0).slice(begin, len(texts))
                begin += len(texts)
                values, offsets = distinct_sets(*shingle_hashes(texts, size))
                some = np.diff(offsets) > 0
                prints = np.zeros(len(texts), np.uint64)
                if some.any():
                    prints[some] = np.add.reduceat(mix(values), offsets[:-1][some])
                sets = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(prints.view(np.int64)), sets], names=schema.names)

    return docs.select(doc_id, text).mapInArrow(run, schema)


def _similar(shared: Column, size_a: str, size_b: str, percent: int) -> Column:
    return 100 * shared >= percent * (F.col(size_a) + F.col(size_b) - shared)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, fa, b, fb) whose full sets are similar enough."""
    left = sets.select(F.col("doc").alias("a"), F.col("f").alias("fa"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc").alias("b"), F.col("f").alias("fb"), F.col("shingles").alias("sb"))
    both = pairs.join(left, ["a", "fa"]).join(right, ["b", "fb"])
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def _named(df: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Add ``comp``, the component found so far."""
    if roots is None:
        return df.withColumn("comp", F.col("doc"))
    joined = with_keys(df, roots.withColumnRenamed("node", "doc"), "doc", "left")
    return joined.withColumn("comp", F.coalesce("root", "doc")).drop("root")


def _open(members: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component, and ``size``, the members of their bucket."""
    keys = members.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("size"))
    return members.drop("size").join(keys.where("x < y").select("key", "size"), "key")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after more links; ``links`` is stored."""
    if links.isEmpty():
        return roots
    return components(roots.selectExpr("node AS a", "root AS b").unionByName(links))


def _pivot_pairs(members: DataFrame, pivot: Column, shared: str, percent: int) -> DataFrame:
    """Each member with its bucket's pivot, where they lie apart and sizes allow a link."""
    chosen = members.groupBy("key").agg(pivot.alias("p")).select(
        "key", F.col("p.doc").alias("b"), F.col("p.f").alias("fb"), F.col("p.n").alias("nb"),
        F.col("p.comp").alias("cb"), F.col(f"p.{shared}").alias("kb"),
    )
    possible = _similar(F.least(F.col(shared), F.col("kb")), "n", "nb", percent)
    return members.join(chosen, "key").where((F.col("comp") != F.col("cb")) & possible).select(
        F.col("doc").alias("a"), F.col("f").alias("fa"), "b", "fb"
    ).distinct()


def _shared_short(sets_of: DataFrame) -> DataFrame:
    """Per set (doc, f, n) the short hashes of either collection that another set has too: u and v, as place i and s.

    Sets that meet under a table key agree on both of its short hashes. So only these are combined into keys, and a
    set without relatives makes ``2 * m`` rows and not ``m * m``.
    """
    sides = [
        F.transform(side, lambda s, i: F.struct(F.lit(side == "v").alias("second"), i.alias("i"), s.alias("s")))
        for side in ("u", "v")
    ]
    rows = sets_of.select("doc", "f", "g", F.col("n_shingles").alias("n"), F.explode(F.concat(*sides)).alias("at")).select(
        "doc", "f", "g", "n", "at.*"
    )
    several = rows.groupBy("s").count().where("count > 1").select("s")
    items = F.struct("i", "s")
    found = rows.join(several, "s", "left_semi").groupBy("doc", "f", "g", "n").agg(
        F.collect_list(F.when(~F.col("second"), items)).alias("u"), F.collect_list(F.when(F.col("second"), items)).alias("v")
    )
    return stored(found.where("size(u) > 0 AND size(v) > 0"), "short-hashes")


def links(docs: DataFrame, signed: DataFrame, sets_of: DataFrame, size: int, percent: int,
          doc_id: str, text: str) -> DataFrame | None:
    """(node, root) of the nodes that confirmed links join to a smaller one; None without candidates.

    ``sets_of`` has one row per distinct shingle set: f, g, n, its smallest document ``doc``, u and v.
    """
    short = _shared_short(sets_of)
    # The low bits of a key name its table: the places of the two short hashes.
    tables = F.flatten(F.transform("u", lambda x: F.transform("v", lambda y: (
        F.shiftleft(F.shiftright(F.xxhash64(x["i"], y["i"], x["s"], y["s"]), 16), 16)
        .bitwiseOR((x["i"] * 256 + y["i"]).cast("bigint"))
    ))))
    keyed = short.select("doc", "f", "n", F.explode(tables).alias("key"))
    shared_keys = keyed.groupBy("key").count().where("count > 1").select("key")
    members = stored(keyed.join(shared_keys, "key", "left_semi"), "buckets")
    ids = stored(members.select(F.col("doc").alias(doc_id)).distinct(), "candidates")
    if ids.isEmpty():
        return None
    sets = stored(
        shingle_sets(with_keys(docs, ids, doc_id, "left_semi"), size, doc_id, text)
        .join(members.select("doc", "f").distinct(), ["doc", "f"], "left_semi")
        .dropDuplicates(["doc", "f"]),
        "sets",
    )
    fields = F.struct("doc", "f", "n", "comp")
    first = _pivot_pairs(_named(members, None), F.min(fields), "n", percent)
    found = stored(confirmed(first, sets, percent), "found")
    roots = components(found)

    # What a document shares with no other open one can be in no intersection. The rest is counted by parts of the
    # hash range: two documents share at most the sum of the smaller counts.
    rest = stored(_open(_named(members, roots)), "open")
    if rest.isEmpty():
        return roots
    open_sets = sets.join(rest.select("doc", "f").distinct(), ["doc", "f"], "left_semi")
    part = F.pmod("s", F.lit(PARTS))
    alone = (
        open_sets.select("doc", "f", F.explode("shingles").alias("s"))
        .groupBy("s").agg(F.count("*").alias("c"), F.min(F.struct("doc", "f")).alias("d")).where("c = 1")
        .groupBy("d.doc", "d.f").agg(F.array(*[F.count(F.when(part == p, 1)) for p in range(PARTS)]).alias("alone"))
    )
    all_parts = F.transform(
        F.sequence(F.lit(0), F.lit(PARTS - 1)),
        lambda p: F.size(F.filter("shingles", lambda s: F.pmod(s, F.lit(PARTS)) == p)).cast("bigint"),
    )
    none = F.array_repeat(F.lit(0).cast("bigint"), PARTS)
    shared = open_sets.select("doc", "f", all_parts.alias("parts")).join(alone, ["doc", "f"], "left").select(
        "doc", "f", F.zip_with("parts", F.coalesce("alone", none), lambda x, y: (x - y).cast("int")).alias("parts")
    ).withColumn("k", F.aggregate("parts", F.lit(0).cast("bigint"), lambda x, y: x + y))
    rest = rest.join(stored(shared, "shared"), ["doc", "f"])
    smallest = rest.groupBy("key").agg(F.min("n").alias("least"))
    able = rest.join(smallest, "key").where(
        100 * F.col("k") >= percent * (F.col("n") + F.greatest("least", "k") - F.col("k"))
    )
    rest = stored(_open(able.select("key", "doc", "f", "n", "k", "parts", "comp")), "open")
    if rest.isEmpty():
        return roots
    common = F.max_by(F.struct("doc", "f", "n", "comp", "k"), F.struct(F.col("k") / F.col("n"), F.xxhash64("doc")))
    second = stored(confirmed(_pivot_pairs(rest, common, "k", percent), sets, percent), "found")
    roots = _merged(roots, second)
    rest = stored(_open(_named(rest.drop("comp"), roots)), "open")
    if rest.isEmpty():
        return roots
    return _merged(roots, stored(confirmed(_pairs_left(rest, percent), sets, percent), "found"))


def allowed(n, k, parts, comp, first, second, percent: int, at_once: int = 16_384):
    """(i, j): pairs of the members ``first`` and ``second`` in different components that the bounds allow.

    ``second`` is ``first`` itself for the pairs among those, each taken once. The members' shingles ``n``, those that
    another member may share ``k`` and by parts of the hash range ``parts`` are given. Cheap bounds first; the parts
    are compared for ``at_once`` pairs at a time.
    """
    apart = np.less if second is first else np.not_equal
    least = percent * (n[first][:, None] + n[second])
    i, j = np.nonzero(
        apart(comp[first][:, None], comp[second]) & ((100 + percent) * np.minimum(k[first][:, None], k[second]) >= least)
    )
    least, i, j = least[i, j], first[i], second[j]
    able = [np.zeros(0, bool)]
    for begin in range(0, len(i), at_once):
        some = slice(begin, begin + at_once)
        able.append((100 + percent) * np.minimum(parts[i[some]], parts[j[some]]).sum(1, dtype=np.int64) >= least[some])
    able = np.concatenate(able)
    return i[able], j[able]


def _pairs_left(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs of open documents of one bucket in different components that the bounds allow.

    A bucket's members fall into blocks by hash. Each pair of blocks is a row of its own, so a large bucket is spread
    over tasks and rows stay short; a block's own pairs are those of it with itself.
    """
    schema = T.StructType([
        T.StructField("a", rest.schema["doc"].dataType), T.StructField("fa", T.LongType()),
        T.StructField("b", rest.schema["doc"].dataType), T.StructField("fb", T.LongType()),
    ])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            members = lists.values.slice(ends[0], ends[-1] - ends[0])
            doc, f, n, k, comp, block, parts = members.flatten()
            f, n, k, block = (x.to_numpy(zero_copy_only=False) for x in (f, n, k, block))
            comp = comp.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            parts = parts.flatten().to_numpy(zero_copy_only=False).reshape(-1, PARTS)
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            bounds = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends - ends[0], ends[1:] - ends[0])
            for x, y, begin, end in bounds:
                first = begin + np.flatnonzero(block[begin:end] == x)
                second = first if x == y else begin + np.flatnonzero(block[begin:end] == y)
                i, j = allowed(n, k, parts, comp, first, second, percent)
                # The smaller fingerprint first, so a pair of several buckets is one row in the end.
                fore = np.where(f[i] < f[j], i, j)
                left.append(fore)
                right.append(i + j - fore)
            left, right = (pa.array(np.concatenate(side)) for side in (left, right))
            prints = pa.array(f)
            yield pa.RecordBatch.from_arrays(
                [doc.take(left), prints.take(left), doc.take(right), prints.take(right)], names=schema.names
            )

    bounded_batches(rest.sparkSession)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("doc", "f"), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1))
    )
    met = dealt.groupBy("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")).agg(
        F.collect_list(F.struct("doc", "f", "n", "k", "comp", "block", "parts")).alias("members")
    )
    return met.select("x", "y", "members").mapInArrow(run, schema).distinct()


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text",
    width: int = WIDTH, m: int | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``size`` words make a shingle, ``percent`` of the union must be shared. Texts are lower-cased A-Z; texts with
    fewer words have their whole word sequence as one shingle. NULL and blank texts have no shingles, link with
    nothing and are kept. Rows with a NULL doc_id link with nothing: component_id is NULL, kept is true. Rows that
    repeat a doc_id are one node and get equal components. Extra columns are ignored. An empty table gives no rows.
    """
    m = m or collection_size(percent, width)
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = stored(signatures(named, size, m, width), "signatures")
    linkable = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    sets_of = stored(
        linkable.groupBy("f", "g", "n_shingles").agg(
            F.min("doc_id").alias("doc"), F.first("u").alias("u"), F.first("v").alias("v")
        ),
        "distinct-sets",
    )
    # One document id under several texts joins their sets.
    several = linkable.groupBy("doc_id").agg(F.min(F.struct("f", "g")).alias("x"), F.max(F.struct("f", "g")).alias("y"))
    bridges = (
        linkable.join(several.where("x < y").select("doc_id"), "doc_id", "left_semi")
        .join(sets_of.select("f", "g", "n_shingles", "doc"), ["f", "g", "n_shingles"])
        .selectExpr("doc_id AS a", "doc AS b")
    )
    roots = links(named, signed, sets_of, size, percent, "doc_id", "text")
    bridges = stored(bridges, "bridges")
    if not bridges.isEmpty():
        star = roots.selectExpr("node AS a", "root AS b") if roots is not None else bridges
        roots = components(bridges.unionByName(star))
    by_set = sets_of.select("f", "g", "n_shingles", "doc")
    if roots is not None:
        by_set = by_set.join(roots.withColumnRenamed("node", "doc"), "doc", "left")
        by_set = by_set.select("f", "g", "n_shingles", F.coalesce("root", "doc").alias("component"))
    else:
        by_set = by_set.withColumnRenamed("doc", "component")
    result = signed.select("doc_id", "n_shingles", "f", "g").join(by_set, ["f", "g", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), "doc_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one document of each component; columns as they are.

    The document with the smallest doc_id stays, of rows that repeat a doc_id the one with the smallest text.
    Rows with a NULL doc_id and texts without words stay.
    """
    key = free_name(docs, "_id")
    found = stored(near_duplicates(docs, size, percent, doc_id, text).withColumnRenamed("doc_id", key), "decided")
    gone = stored(found.where("NOT kept").select(key).distinct(), "copies")
    twice = stored(found.where(F.col("kept") & F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key), "repeated")
    left = with_keys(docs.withColumn(key, F.col(doc_id)), gone, key, "left_anti")
    if not twice.isEmpty():
        # The smallest row of an id, found on the map side however often the id is repeated.
        order = [text, *[c for c in docs.columns if c not in (doc_id, text)]]
        first = with_keys(left, twice, key, "left_semi").groupBy(key).agg(F.min(F.struct(*order)).alias("row"))
        rows = first.select(F.col(key).alias(doc_id), *[F.col("row").getField(c).alias(c) for c in order])
        left = with_keys(left, twice, key, "left_anti").select(*docs.columns).unionByName(rows.select(*docs.columns))
    return left.select(*docs.columns)
