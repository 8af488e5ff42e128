"""Watch lists: which files are due, the computed status of their parts, and both merges."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlens.functions import classify
from partlens.functions.dates import EARLIEST_RUN, EPOCH_1900, FAR_FUTURE, is_expired, moment, or_sentinel
from partlens.functions.figures import count_where
from partlens.functions.text import upload_priority
from partlens.operators.dedup import newest_values
from partlens.operators.lookups import join_lookups, known_modules, module_pairs
from partlens.operators.merge import update_where

NOT_REGISTERED = "not SE part"
FEATURE_KEY = ("man_id", "module_id", "part")
FEATURE_LOOKUP_KEY = ("part", "module")


def _named(names: Sequence[str] | None) -> Column:
    return F.lit(True) if names is None else F.col("file_name").isin(*names)


def eligible_files(
    files: DataFrame,
    as_of: date | datetime,
    names: Sequence[str] | None = None,
    ignore_check_date: bool = False,
) -> DataFrame:
    """Files asked for, not past their stop date and (unless ignored) not checked on ``as_of``."""
    kept = files.where(_named(names) & (or_sentinel(F.col("stop_monitor_date"), FAR_FUTURE) > moment(as_of)))
    if ignore_check_date:
        return kept
    day = as_of.date() if isinstance(as_of, datetime) else as_of
    return kept.where(or_sentinel(F.col("last_check_date"), EPOCH_1900) < F.lit(day))


def listed_files(files: DataFrame) -> DataFrame:
    """The file table with its dates as text, for listing."""
    dates = ("upload_date", "last_check_date", "stop_monitor_date")
    return files.select("id", "file_name", *[F.col(c).cast("string").alias(c) for c in dates])


def in_files(parts: DataFrame, files: DataFrame) -> DataFrame:
    return parts.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")


def key_facts(registry: DataFrame, feed: DataFrame) -> DataFrame:
    """Registry facts and newest feed record per (part, man_id, mod_id), in one shuffle.

    Stands in for four correlated subqueries (never run, found later than not
    found, newest date, priority of the newest row) and for ranking the feed:
    both tables are combined on the map side and meet in one group-by, so the
    parts are joined to what it gives. A missing feed date counts as 1900.
    """
    found = or_sentinel(F.col("lrd"), EPOCH_1900)
    missing = or_sentinel(F.col("v_notfound_dat"), EPOCH_1900)
    registry_rows = registry.select(
        F.col("pn").alias("part"), F.col("man_id").alias("new_man_id"), F.col("mod_id").alias("new_module_id"),
        (F.col("lrd").isNull() & F.col("v_notfound_dat").isNull()).alias("never_run"),
        (found > missing).alias("found_later"),
        F.struct(F.greatest(found, missing).alias("seen"), F.col("prty").alias("prty")).alias("newest"),
    )
    feed_rows = feed.select(
        F.col("mpn").alias("part"), F.col("man_id").alias("new_man_id"), F.col("mod_id").alias("new_module_id"),
        F.struct(
            or_sentinel(F.col("check_date"), EPOCH_1900).alias("checked"),
            F.col("check_date").alias("check_date"),
            F.col("status").alias("status"),
        ).alias("fed"),
    )
    rows = registry_rows.unionByName(feed_rows, allowMissingColumns=True)
    return rows.groupBy("part", "new_man_id", "new_module_id").agg(
        F.bool_or("never_run").alias("never_run"),
        F.bool_or("found_later").alias("found_later"),
        F.max("newest").alias("newest"),
        F.max("fed").alias("fed"),
    ).select(
        "part", "new_man_id", "new_module_id", "never_run", "found_later",
        F.col("newest.seen").alias("seen"), F.col("newest.prty").alias("new_prty"),
        F.col("fed.check_date").alias("check_date"), F.col("fed.status").alias("feed_status"),
    )


def part_facts(registry: DataFrame, feed: DataFrame) -> DataFrame:
    """Per (part, man_id): whether the registry knows it, and the facts of each of its modules as a map by module.

    ``key_facts`` reads both tables once and combines them on the map side. What is grouped again is one row per key,
    and a map holds at most the modules of one maker. So a part needs one join, for any of its module's pairs.
    """
    values = ["never_run", "found_later", "seen", "new_prty", "check_date", "feed_status"]
    known = key_facts(registry, feed).where(F.col("part").isNotNull() & F.col("new_man_id").isNotNull())
    entry = F.struct(F.col("new_module_id"), F.struct(*values))
    return known.groupBy("part", "new_man_id").agg(
        F.max(F.when(F.col("never_run").isNotNull(), True)).alias("registered"),
        F.map_from_entries(F.collect_list(F.when(F.col("new_module_id").isNotNull(), entry))).alias("_modules"),
    )


def with_modules(parts: DataFrame, man_modules: DataFrame) -> DataFrame:
    """Parts with the ids of their module; unknown modules have none."""
    dim = known_modules(man_modules).select(
        F.col("module_name").alias("module"), F.lit(True).alias("module_known"),
        F.col("man_id").alias("new_man_id"), F.col("module_id").alias("new_module_id"),
    )
    return join_lookups(parts, [(dim, ["module"])])


def several_pairs(man_modules: DataFrame) -> DataFrame:
    """Every pair of the module names that have more than one, as (module, new_man_id, new_module_id)."""
    pairs = module_pairs(man_modules)
    return pairs.groupBy(F.col("module_name").alias("module")).agg(
        F.collect_list(F.struct("man_id", "module_id")).alias("pairs")
    ).where(F.size("pairs") > 1).select("module", F.explode("pairs").alias("p")).select(
        "module", F.col("p.man_id").alias("new_man_id"), F.col("p.module_id").alias("new_module_id")
    )


def _with_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows with the facts of their part under their pair of ids; every part and maker is one row of ``facts``."""
    joined = join_lookups(rows, [(facts, ["part", "new_man_id"])])
    return joined.withColumn("_facts", F.try_element_at("_modules", F.col("new_module_id"))).drop("_modules")


def chosen_pairs(keys: DataFrame, several: DataFrame, facts: DataFrame) -> DataFrame:
    """The pair that decides, per (part, module) of ``keys`` whose name has several pairs, with its facts.

    The newest feed record decides, then the newest registry date, then whether the registry knows the part, then the
    smallest pair. Pairs are joined on the module, so a part meets the pairs of its own module only.
    """
    candidates = _with_facts(keys.join(several, "module"), facts)
    rank = F.struct(
        or_sentinel(F.col("_facts.check_date"), EPOCH_1900).alias("checked"), F.col("_facts.seen").alias("seen"),
        F.coalesce("registered", F.lit(False)).alias("registered"),
        (-F.col("new_man_id")).alias("man"), (-F.col("new_module_id")).alias("mod"),
    )
    found = ["new_man_id", "new_module_id", "registered", "_facts"]
    best = candidates.groupBy("part", "module").agg(F.max_by(F.struct(*found), rank).alias("_best"))
    return best.select("part", "module", "_best.*")


def _looked_up(
    parts: DataFrame,
    man_modules: DataFrame,
    registry: DataFrame,
    feed: DataFrame,
    more: Sequence[tuple[DataFrame, Sequence[str]]] = (),
) -> DataFrame:
    """Parts with every value the status rules read, one row per part.

    Every lookup is unique on its key, so no join multiplies rows and the newest feed record needs no window over the
    parts. Parts of module names with several pairs, where the dimension has such names, are looked up under each pair
    first; both ways read the same facts.
    """
    facts, several = part_facts(registry, feed), several_pairs(man_modules)
    rows = with_modules(parts, man_modules)
    if several.isEmpty():
        looked = _with_facts(rows, facts)
    else:
        many = several.select("module").distinct()
        one = _with_facts(rows.join(many, "module", "left_anti"), facts)
        others = rows.join(many, "module", "left_semi")
        chosen = chosen_pairs(others.select("part", "module").distinct(), several, facts)
        ids = ["new_man_id", "new_module_id"]
        found = chosen.withColumnsRenamed({name: f"_{name}" for name in ids})
        joined = join_lookups(others, [(found, ["part", "module"])])
        # A part without a name meets no key and keeps the smallest pair.
        best = joined.withColumns({name: F.coalesce(f"_{name}", name) for name in ids})
        looked = one.unionByName(best.drop(*[f"_{name}" for name in ids]))
    return join_lookups(looked.select("*", "_facts.*").drop("_facts"), more)


def _computed() -> dict[str, Column]:
    """New values of the merged columns, over the frame of ``_looked_up``."""
    part_class = classify.part_class(
        F.coalesce(F.col("module_known"), F.lit(False)), F.col("status"), F.col("registered"),
        F.col("never_run"), F.col("found_later"),
    )
    last = F.greatest(or_sentinel(F.col("check_date"), EPOCH_1900), or_sentinel(F.col("seen"), EPOCH_1900))
    return {
        "status": F.when(part_class != "found", F.col("feed_status")),
        "last_run_date": F.when(last > F.lit(EARLIEST_RUN), last),
        "table_name": part_class,
        "prty": F.col("new_prty"),
        "man_id": F.col("new_man_id"),
        "module_id": F.col("new_module_id"),
    }


def status_source(
    parts: DataFrame, files: DataFrame, man_modules: DataFrame, registry: DataFrame, feed: DataFrame
) -> DataFrame:
    """The rows the status merge would bring: one per part of the given files."""
    looked = _looked_up(in_files(parts, files), man_modules, registry, feed)
    kept = ["id", "part", "man", "module", "file_id", "cm_date", "monitor_features"]
    return looked.select(*kept, *[column.alias(name) for name, column in _computed().items()])


def merge_status(
    parts: DataFrame, files: DataFrame, man_modules: DataFrame, registry: DataFrame, feed: DataFrame
) -> DataFrame:
    """Status merge over the whole parts table.

    The source comes from the target row by row, so the merged columns are put
    in place directly; there is no second join on id. Parts of other files pass
    by without being shuffled.
    """
    values = _computed()
    looked = _looked_up(in_files(parts, files), man_modules, registry, feed)
    merged = looked.select(
        *[values[name].alias(name) if name in values else F.col(name) for name in parts.columns]
    )
    others = parts.join(files.select(F.col("id").alias("file_id")), "file_id", "left_anti")
    return merged.unionByName(others.select(*parts.columns))


def modules_of(parts: DataFrame, files: DataFrame, man_modules: DataFrame) -> DataFrame:
    """Known modules that occur in the given files, with every pair of ids."""
    used = in_files(parts, files).select(F.col("module").alias("module_name")).distinct()
    return module_pairs(man_modules).join(used, "module_name").select("module_name", "man_id", "module_id")


def newest_features(features: DataFrame, has_names: bool = True) -> DataFrame:
    """Newest date per part of a module with the names tied on it, packed as ``a|b|``."""
    newest = newest_values(features, FEATURE_KEY, "dat", "feature_name" if has_names else None, "names")
    if not has_names:
        return newest.select(*FEATURE_KEY, F.col("dat").alias("new_last_run_date"))
    packed = F.concat(F.array_join("names", "|"), F.lit("|"))
    return newest.select(*FEATURE_KEY, F.col("dat").alias("new_last_run_date"), packed.alias("new_features"))


def _with_scope(
    parts: DataFrame, files: DataFrame, man_modules: DataFrame, scope: str
) -> DataFrame:
    """Parts with ``in_scope``."""
    if scope == "module":
        used = modules_of(parts, files, man_modules).select(F.col("module_name").alias("module")).distinct()
        rows = parts.join(used.withColumn("_used", F.lit(True)), "module", "left")
        return rows.withColumn("in_scope", F.coalesce("_used", F.lit(False))).drop("_used")
    if scope != "file":
        raise ValueError(f"unknown scope: {scope}")
    due = files.select(F.col("id").alias("file_id"), F.lit(True).alias("_due"))
    return parts.join(due, "file_id", "left").withColumn("in_scope", F.coalesce("_due", F.lit(False)))


def _feature_lookup(features: DataFrame, man_modules: DataFrame, has_names: bool) -> DataFrame:
    """Newest features per part and module name: of a name's pairs the one with the newest date, dated before undated."""
    values = ["new_last_run_date", *(["new_features"] if has_names else [])]
    named = newest_features(features, has_names).join(module_pairs(man_modules), ["man_id", "module_id"])
    newest = named.groupBy("part", F.col("module_name").alias("module")).agg(F.max(F.struct(*values)).alias("_newest"))
    return newest.select("part", "module", *[F.col(f"_newest.{v}").alias(v) for v in values], F.lit(True).alias("has_feature"))


def found_source(
    parts: DataFrame,
    files: DataFrame,
    man_modules: DataFrame,
    features: DataFrame,
    has_names: bool = True,
    scope: str = "module",
) -> DataFrame:
    """The rows the found merge would bring: parts with feature records."""
    rows = _with_scope(parts, files, man_modules, scope).where("in_scope")
    lookup = _feature_lookup(features, man_modules, has_names)
    extra = ["new_features"] if has_names else []
    return join_lookups(rows, [(lookup, FEATURE_LOOKUP_KEY)]).where("has_feature").select(
        "id", "part", *extra, "new_last_run_date"
    )


def found_rules(has_names: bool = True) -> dict[str, Column]:
    """New values of the columns the found merge sets."""
    new, old = F.col("new_last_run_date"), F.col("last_run_date")
    newer = new.isNotNull() & (old.isNull() | (new > old))
    not_older = new.isNotNull() & (old.isNull() | (new >= old))
    registered = F.coalesce(F.col("table_name") != NOT_REGISTERED, F.lit(False))
    rules = {
        "last_run_date": F.when(newer, new).otherwise(old),
        "status": F.when(not_older, "found").otherwise(F.col("status")),
        "table_name": F.when(not_older & registered, "found").otherwise(F.col("table_name")),
    }
    if has_names:
        rules["features"] = F.col("new_features")
    return rules


def merge_found(
    parts: DataFrame,
    files: DataFrame,
    man_modules: DataFrame,
    features: DataFrame,
    has_names: bool = True,
    scope: str = "module",
) -> DataFrame:
    """Found merge over the whole parts table; every module of the files in one join."""
    rows = _with_scope(parts, files, man_modules, scope)
    joined = join_lookups(rows, [(_feature_lookup(features, man_modules, has_names), FEATURE_LOOKUP_KEY)])
    hit = F.col("in_scope") & F.col("has_feature")
    return update_where(joined, hit, found_rules(has_names)).select(*parts.columns)


def run_status(
    parts: DataFrame,
    files: DataFrame,
    man_modules: DataFrame,
    registry: DataFrame,
    feed: DataFrame,
    features: DataFrame,
    as_of: date | datetime,
    names: Sequence[str] | None = None,
    ignore_check_date: bool = False,
) -> DataFrame:
    """Both merges as one plan: the parts table after a status run.

    Module names and files do not change in the first merge, so the scope of the
    second is known from the start.
    """
    due = eligible_files(files, as_of, names, ignore_check_date)
    used = modules_of(parts, due, man_modules).select(
        F.col("module_name").alias("module"), F.lit(True).alias("in_scope")
    ).distinct()
    flags = due.select(F.col("id").alias("file_id"), F.lit(True).alias("is_due"))
    rows = parts.join(flags, "file_id", "left").join(used, "module", "left")
    lookup = _feature_lookup(features, man_modules, True)
    joined = _looked_up(rows, man_modules, registry, feed, [(lookup, FEATURE_LOOKUP_KEY)])
    checked = update_where(joined, F.col("is_due"), _computed())
    merged = update_where(checked, F.col("in_scope") & F.col("has_feature"), found_rules())
    return merged.select(*parts.columns)


def mark_checked(files: DataFrame, as_of: date, names: Sequence[str] | None = None) -> DataFrame:
    """Files with their last check date set; the listed ones, eligible or not."""
    return update_where(files, _named(names), {"last_check_date": F.lit(as_of)})


def set_stop_date(files: DataFrame, name: str, stop: date) -> DataFrame:
    return update_where(files, F.col("file_name") == name, {"stop_monitor_date": F.lit(stop)})


def results(
    parts: DataFrame,
    files: DataFrame,
    man_modules: DataFrame,
    as_of: date | datetime,
    names: Sequence[str] | None = None,
    expire_days: int = 30,
) -> DataFrame:
    """Parts with their file and run flag; parts of unknown modules drop out."""
    listed = files.where(_named(names)).select(
        F.col("id").alias("file_id"), "file_name", "upload_date", "last_check_date", "stop_monitor_date"
    )
    dim = man_modules.select(
        F.col("module_name").alias("module"), F.col("man_id").alias("dim_man_id"),
        F.col("module_id").alias("dim_module_id"), "run_flag",
    )
    joined = parts.drop("man_id", "module_id").join(listed, "file_id").join(dim, "module")
    return joined.withColumnsRenamed({"dim_man_id": "man_id", "dim_module_id": "module_id"}).withColumn(
        "is_expired", is_expired(F.col("last_run_date"), as_of, expire_days)
    )


def validity_counts(merged_parts: DataFrame, files: DataFrame) -> DataFrame:
    """Valid and not valid parts per file."""
    names = files.select(F.col("id").alias("file_id"), "file_name")
    per_file = merged_parts.groupBy("file_id").agg(
        F.count("*").alias("total_count"),
        count_where(F.col("table_name") == "not_valid").alias("not_valid_count"),
    )
    return per_file.join(names, "file_id").select(
        "file_name", "total_count", "not_valid_count",
        (F.col("total_count") - F.col("not_valid_count")).alias("valid_count"),
    )


def upload_list(parts: DataFrame, part: str = "part", module: str = "module") -> DataFrame:
    """The three columns of an upload list."""
    return parts.select(
        F.col(part).alias("Part"), F.col(module).alias("Module"), upload_priority(F.col(part)).alias("Prty")
    )


def expired_upload_list(result_rows: DataFrame) -> DataFrame:
    """Upload list of the expired parts only."""
    return upload_list(result_rows.where("is_expired"))
