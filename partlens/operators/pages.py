"""Pages of a table in a declared order, from a stored range index.

The rows are put in order once: range-partitioned, sorted inside their piece, and written piece by piece. The index
has one row per piece, with its first position and its size. A page opens only the pieces that hold its positions and
picks its rows by their stored places, so pages after the first cost neither a sort of the table nor a pass over it.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# monotonically_increasing_id keeps the row's place inside its partition in the low 33 bits.
PLACE_BITS = 33
INDEX = "piece int, first long, size long, schema string"


class Pages:
    """A stored order; ``page`` gives the rows at any positions of it, counted from 0."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        # One short row per piece; a table without rows has one piece of size 0.
        index = spark.read.schema(INDEX).parquet(f"{path}/index").orderBy("piece").collect()
        self.pieces = [(row["piece"], row["first"], row["size"]) for row in index]
        self.schema = T.StructType.fromJson(json.loads(index[0]["schema"]))

    def __len__(self) -> int:
        return sum(size for _, _, size in self.pieces)

    def page(self, start: int, end: int) -> DataFrame:
        """Rows ``start`` to ``end`` (both in the page) in order; positions behind the last row have none."""
        held = {piece: first for piece, first, size in self.pieces if size and first <= end and start < first + size}
        if not held:
            return self.spark.createDataFrame([], self.schema)
        names = self.schema.names
        stored = T.StructType([*self.schema.fields, T.StructField("_at", T.LongType()), T.StructField("_piece", T.IntegerType())])
        rows = self.spark.read.schema(stored).option("basePath", f"{self.path}/rows").parquet(
            *[f"{self.path}/rows/_piece={piece}" for piece in held]
        )
        firsts = F.from_json(F.lit(json.dumps(held)), "map<string,bigint>")
        place = F.element_at(firsts, F.col("_piece").cast("string")) + F.col("_at")
        wanted = rows.withColumn("_place", place).where(F.col("_place").between(start, end))
        return wanted.orderBy("_place").limit(end - start + 1).select(*[F.col(f"`{name}`") for name in names])


def store_pages(df: DataFrame, order: Sequence[str], path: str, pieces: int | None = None) -> Pages:
    """Put ``df`` in ``order`` (a total one) under ``path`` and open it.

    The engine chooses the number of pieces by their size unless ``pieces`` is given. No column may be called ``_at``
    or ``_piece``.
    """
    ranged = df.repartitionByRange(pieces, *order) if pieces else df.repartitionByRange(*order)
    numbered = ranged.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    piece = F.shiftright("_id", PLACE_BITS).cast("int")
    at = F.col("_id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    numbered.withColumn("_at", at).withColumn("_piece", piece).drop("_id").write.partitionBy("_piece").parquet(
        f"{path}/rows"
    )
    spark, schema = df.sparkSession, df.schema
    stored = T.StructType([T.StructField("_at", T.LongType()), T.StructField("_piece", T.IntegerType())])
    sizes = spark.read.schema(stored).parquet(f"{path}/rows").groupBy("_piece").agg(F.count("*").alias("size"))
    index, first = [], 0
    for row in sorted(sizes.collect(), key=lambda row: row["_piece"]):
        index.append((row["_piece"], first, row["size"], schema.json()))
        first += row["size"]
    spark.createDataFrame(index or [(0, 0, 0, schema.json())], INDEX).coalesce(1).write.parquet(f"{path}/index")
    return Pages(spark, path)
