"""First-match lookups into small dimension tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlens.operators.dedup import keep_first


def first_match(dim: DataFrame, key: str, values: Sequence[str], order: str) -> DataFrame:
    """The dimension reduced to its first row per key, by ``order``."""
    return keep_first(dim, [key], [F.col(order)], list(values))


def join_lookups(facts: DataFrame, lookups: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Left joins of ``facts`` to ``lookups``, each with one row per its keys.

    The hash of the keys is one more join column on both sides. A lookup grouped on the same keys would
    otherwise be joined in the partitions of its group-by, and the engine splits hot keys only where both
    sides of a join are shuffled for it.
    """
    for lookup, keys in lookups:
        hashed = facts.withColumn("_h", F.xxhash64(*keys))
        facts = hashed.join(lookup.withColumn("_h", F.xxhash64(*keys)), ["_h", *keys], "left").drop("_h")
    return facts


def known_modules(man_modules: DataFrame) -> DataFrame:
    """One row per module name, so that joining it never multiplies rows."""
    return keep_first(man_modules, ["module_name"], [], ["man_id", "module_id", "run_flag"])


def module_pairs(man_modules: DataFrame) -> DataFrame:
    """Every (man_id, module_id) of a module name, once each."""
    return man_modules.select("module_name", "man_id", "module_id").where(
        F.col("man_id").isNotNull() & F.col("module_id").isNotNull()
    ).distinct()
