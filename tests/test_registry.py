"""Registry plans on hand-made cases and by their invariants."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from partlens import schemas
from partlens.operators.filters import RegistryFilter
from partlens.plans import registry, registry_charts

AS_OF = date(2024, 6, 1)


def base(spark):
    facts = spark.createDataFrame(
        [
            ("a", 1, 1, "P1", "x|y", date(2024, 5, 30), None),
            ("a", 1, 1, "P1", "x|y", date(2024, 5, 30), None),
            ("a", 1, 2, "updated", "y", None, date(2024, 1, 1)),
            ("b", 1, 1, None, None, None, None),
            ("c", 2, 1, "P2", "xx|y", date(2024, 1, 1), date(2024, 1, 1)),
            ("d", 9, 1, "P2", "z", date(2024, 1, 1), None),
        ],
        schemas.PRIORITY_PARTS,
    )
    outdated = spark.createDataFrame([("a", 1), ("a", 1), ("a", 1), ("c", 2), ("zz", 1)], "pn string, man_id long")
    feed = spark.createDataFrame(
        [
            ("a", 1, 1, date(2024, 1, 1), "HTTP 403"),
            ("b", 1, 1, date(2024, 1, 1), "Not Found"),
            ("b", 2, 1, None, "other maker"),
            ("c", 2, 1, date(2024, 1, 1), "Timeout Error"),
        ],
        schemas.NOTFOUND_FEED,
    )
    modules = spark.createDataFrame(
        [("m11", 1, 1, 0), ("m12", 1, 2, 1), ("m21", 2, 1, 4)], schemas.MAN_MODULES
    )
    makers = spark.createDataFrame([(1, "One"), (2, "Two"), (9, "Nine")], schemas.MANUFACTURER)
    marks = registry.part_marks(outdated, registry.latest_status(feed))
    return registry.registry_base(facts, marks), modules, makers


def test_latest_status_is_per_part_number_alone(spark):
    feed = spark.createDataFrame(
        [("b", 1, 1, date(2024, 1, 1), "Not Found"), ("b", 2, 1, None, "other maker")], schemas.NOTFOUND_FEED
    )
    assert [tuple(r) for r in registry.latest_status(feed).collect()] == [("b", 2, "other maker")]


def test_snapshot(spark):
    rows = registry.snapshot(*base(spark), AS_OF).collect()
    got = {(r["module_name"], r["prty"]): r for r in rows}
    # Two registry rows, three outdated records each; the unknown module of maker 9 drops out.
    assert got["m11", "P1"]["count"] == 6 and got["m11", "P1"]["lc_outdated"] == 1
    assert got["m11", "P1"]["status"] == "found" and got["m11", "P1"]["error_status"] == ""
    assert got["m12", "updated"]["error_status"] == "Proxy" and got["m12", "updated"]["is_expired"]
    # The newest feed record of b belongs to another maker, so b has none.
    assert got["m11", None]["error_status"] == "not assigned error" and got["m11", None]["status"] == "not run"
    assert got["m21", "P2"]["status"] is None and got["m21", "P2"]["lr_date"] is None
    assert len(rows) == 4
    distinct = registry.snapshot(*base(spark), AS_OF, "distinct")
    assert distinct.agg(F.sum("count")).first()[0] == 5


def test_drilldown_modes_agree_with_the_snapshot(spark):
    inputs = base(spark)
    total = registry.snapshot(*inputs, AS_OF).agg(F.sum("count")).first()[0]
    rows = registry.drilldown(*inputs, AS_OF)
    assert rows.agg(F.sum("weight")).first()[0] == total == 11
    assert registry.drilldown(*inputs, AS_OF, lc_mode="distinct").count() == rows.count() == 5
    assert "WEIGHT" in registry.upper_names(rows).columns
    with pytest.raises(ValueError):
        registry.drilldown(*inputs, AS_OF, lc_mode="other")


def test_drilldown_filters_after_classing(spark):
    request = RegistryFilter(error_status=["Proxy"], expired=["true"])
    rows = registry.drilldown(*base(spark), AS_OF, request).collect()
    assert {r["part_number"] for r in rows} == {"a", "c"}
    labelled = registry.drilldown(*base(spark), AS_OF, RegistryFilter(cs_labels=["x"]), "distinct")
    assert {r["part_number"] for r in labelled.collect()} == {"a", "c"}


def test_figures_sum_to_the_total_on_snapshot_and_rows(spark):
    inputs = base(spark)
    snapshot, live = registry.snapshot(*inputs, AS_OF), registry.live_rows(*inputs, AS_OF)
    kpis = registry_charts.kpis(snapshot).first().asDict()
    assert kpis["total_parts"] == 11 and kpis["unique_manufacturers"] == 2 and kpis["unique_modules"] == 3
    assert kpis["expired_parts"] == 7 and kpis["expired_by_date"] == 5
    assert kpis["found_percentage"] == 54.5
    for figure in (
        registry_charts.kpis, registry_charts.charts, registry_charts.chart_sets, registry_charts.table,
        registry_charts.label_counts, registry_charts.top_manufacturers, registry_charts.filter_options,
    ):
        assert sorted(map(tuple, figure(snapshot).collect())) == sorted(map(tuple, figure(live).collect()))
    sums = {}
    for row in registry_charts.charts(snapshot).collect():
        sums[row["chart"]] = sums.get(row["chart"], 0) + row["value"]
    assert {sums[c] for c in ("status", "priority", "run_flag", "lc_outdated", "expired")} == {11}


def test_labels_keep_zeros_when_narrowed(spark):
    snapshot = registry.snapshot(*base(spark), AS_OF)
    narrowed = registry_charts.label_counts(snapshot, F.col("status") == "found")
    assert dict(narrowed.collect()) == {"x": 6, "y": 6, "xx": 0}
    assert dict(registry_charts.label_counts(snapshot).collect()) == {"x": 6, "y": 10, "xx": 1}


def test_timeline_window(spark):
    snapshot = registry.snapshot(*base(spark), AS_OF)
    assert dict(registry_charts.timeline(snapshot, AS_OF).collect()) == {date(2024, 5, 30): 6, date(2024, 1, 1): 3}
    span = registry_charts.timeline_range(snapshot, AS_OF).first()
    assert tuple(span) == (date(2024, 1, 1), date(2024, 5, 30), date(2024, 1, 1), date(2024, 5, 30))
    late = registry_charts.timeline_range(snapshot, date(2025, 5, 1)).first()
    assert late["default_start"] == date(2024, 5, 1)
    empty = registry_charts.timeline_range(snapshot.where("false"), AS_OF).first()
    assert tuple(empty) == (None, None, None, None)


def test_lifecycle_predicate(spark):
    """Every branch of the outdated rule, NULL dates and names included."""
    old, fresh = date(2024, 1, 1), date(2024, 5, 1)
    history = [
        (1, 1, old, None, 1), (2, 1, fresh, None, 1), (3, 1, old, None, 2), (4, 1, old, old, 3), (5, 1, old, None, 3),
        (6, 1, None, old, 2), (7, 0, old, None, 1), (8, 1, old, None, 4), (9, 1, old, None, 1), (10, 1, old, None, 1),
        (11, 1, old, None, 5),
    ]
    names = {9: "bad)$.@(part", 10: None}
    component = [(i, f"p{i}", 1, names.get(i, f"p{i}")) for i in range(1, 13)]
    got = registry.lc_outdated(
        spark.createDataFrame(component, schemas.COMPONENT),
        spark.createDataFrame(history, schemas.LC_HISTORY),
        spark.createDataFrame(
            [(1, "Active", 1), (2, "Obsolete", 1), (3, "LTB", 1), (4, "Active", 2), (5, None, 1)], schemas.LC_LOOKUP
        ),
        spark.createDataFrame([(1, 1), (2, 2)], schemas.LC_REASON),
        spark.createDataFrame([(1, "good"), (2, "other")], schemas.LC_SOURCE),
        ["good"], AS_OF,
    )
    assert {r["pn"] for r in got.collect()} == {"p1", "p5", "p6"}


def test_priority_summary(spark):
    facts = spark.createDataFrame([("P1",), ("P1",), ("NDF<7",), ("other",), (None,)], "prty string")
    row = registry.priority_summary(facts, AS_OF).first().asDict()
    assert row.pop("summary_date") == AS_OF
    assert {k: v for k, v in row.items() if v} == {"P1": 2, "NDF<7": 1}
    assert len(row) == 19
    empty = registry.priority_summary(facts.where("false"), AS_OF).collect()
    assert [sum(v for v in r[1:]) for r in empty] == [0]
