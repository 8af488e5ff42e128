"""Reconciliation on hand-made days."""

from datetime import date

from partlens import schemas
from partlens.plans import recon
from partlens.sources import readers

D1, D2, D3 = date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 3)


def tables(spark):
    def feed(rows):
        return spark.createDataFrame([(m, "M", "X", d, s) for m, d, s in rows], schemas.FEED_EXPORT)

    found = feed([
        ("both", "2024-01-01", "Imported"),
        ("feed only", "2024-01-01", "In Progress"),
        ("dup", "2024-01-01", "Not Imported - a"),
        ("dup", "2024-01-01", "In Progress"),
        ("no status", "2024-01-01", None),
        (None, "2024-01-01", "Not Imported"),
        ("undated", None, "Imported"),
        ("both", "2024-01-02", "Imported"),
    ])
    notfound = feed([
        ("lost", "2024-01-01", "Not Imported - x"),
        ("twice", "2024-01-01", "Imported"),
        ("only notfound day", "2024-01-03", "Imported"),
    ])
    details = spark.createDataFrame(
        [
            (mpn, "M", "X", prio, None, status, None, day)
            for mpn, prio, status, day in [
                ("both", "P1", "Found", "01-Jan-2024"),
                ("dup", "P1", "FOUND", "01-Jan-2024"),
                ("no status", "P1", "found", "2024-01-01"),
                (None, "P1", "found", "2024-01-01"),
                ("missing", "P1", "found", "2024-01-01"),
                ("lost", "P1", "Not here", "2024-01-01"),
                ("twice", "P1", None, "2024-01-01"),
                ("twice", "P1", "found", "2024-01-01"),
                ("dropped", None, "found", "2024-01-01"),
                ("late", "P1", "found", "2024-01-02"),
                ("only notfound day", "P1", "no", "2024-01-03"),
            ]
        ],
        schemas.PART_DETAILS,
    )
    return found, notfound, details


def matched(spark):
    return {
        (r["date"], r["table"], r["mpn"]): (r["provenance"], r["received"], r["auto_imp_status"])
        for r in recon.match(*tables(spark)).collect()
    }


def test_match(spark):
    got = matched(spark)
    assert got == {
        (D1, "found", "both"): ("both", "received", "Imported"),
        (D1, "found", "feed only"): ("left_only", None, "In Progress"),
        (D1, "found", "dup"): ("both", "received", "In Progress"),
        (D1, "found", "no status"): ("both", "received", ""),
        # NULL part numbers meet each other.
        (D1, "found", None): ("both", "received", "Not Imported"),
        (D1, "found", "missing"): ("right_only", "not received", ""),
        # Both found and not found in a day: found wins, so its not-found feed row stands alone.
        (D1, "found", "twice"): ("right_only", "not received", ""),
        (D1, "notfound", "twice"): ("left_only", None, "Imported"),
        # The not-found side knows no "Not Imported".
        (D1, "notfound", "lost"): ("both", "received", "Imported"),
        (D2, "found", "both"): ("left_only", None, "Imported"),
        (D2, "found", "late"): ("right_only", "not received", ""),
        (D3, "notfound", "only notfound day"): ("both", "received", "Imported"),
    }


def test_provenance_counts_add_up(spark):
    rows = recon.match(*tables(spark)).collect()
    left = sum(r["in_feed"] for r in rows)
    right = sum(r["in_details"] for r in rows)
    both = sum(r["provenance"] == "both" for r in rows)
    assert len(rows) == left + right - both


def test_counts_and_pivot(spark):
    counts = recon.counts(recon.match(*tables(spark)))
    got = {(r["date"], r["table"]): r.asDict() for r in counts.collect()}
    # Day 2: nothing received, dropped; its not-found table has 0 of 0, dropped too. Day 3 is not in the found feed.
    assert set(got) == {(D1, "found"), (D1, "notfound")}
    found = got[D1, "found"]
    assert found["total_parts"] == 6 and found["received_count"] == 4 and found["not_received_count"] == 2
    assert found["in_progress_count"] == 2 and found["imported_count"] == 1 and found["not_imported_count"] == 1
    lost = got[D1, "notfound"]
    assert (lost["total_parts"], lost["received_count"], lost["imported_count"]) == (1, 1, 2)
    pivot = recon.pivot(counts).collect()
    assert [tuple(r) for r in pivot] == [(D1, 2, 2, 0, 0)]


def test_reports(spark):
    found, notfound, details = tables(spark)
    days = recon.reported_days(found, details)
    assert {r[0] for r in days.collect()} == {D1, D2}
    rows = recon.report(recon.match(found, notfound, details), days)
    imported = {(r["part_number"], r["category"]) for r in recon.imported_report(rows).collect()}
    assert imported == {("both", "Imported found"), (None, "Not Imported found"), ("lost", "Imported NotFound")}
    missed = {(r["part_number"], r["category"], r["date"]) for r in recon.missed_report(rows).collect()}
    assert missed == {
        ("dup", "In Progress found", D1), ("missing", "NotReceived found", D1), ("twice", "NotReceived found", D1),
        ("late", "NotReceived found", D2),
    }


def test_a_details_file_has_one_day(spark, tmp_path):
    header = "a\tb\tc\td\te\tf\tg\th\n"

    def put(name, *rows):
        lines = ["\t".join([mpn, "m", "x", prty, "", status, "", day]) for mpn, prty, status, day in rows]
        (tmp_path / name).write_text(header + "\n".join(lines) + "\n")

    # The first part in order counts: b is the first with a priority, and of its rows the found one, which is empty.
    put("PartDetails@08-Mar-2025.txt", ("c", "P1", "Found", "10-Mar-2025"), ("b", "P1", "no", "01-Jan-2025"),
        ("b", "P2", "found", ""), ("d", "P1", "no", "11-Mar-2025"), ("a", "", "Found", "02-Jan-2025"))
    # Ties go to the place in the file; a date that can't be read is passed by.
    put("PartDetails@09-Mar-2025.txt", ("a", "P1", "no", "soon"), ("b", "P1", "no", "03-Mar-2025"), ("b", "P1", "no", "04-Mar-2025"))
    put("PartDetails@11-Mar-2025.txt", ("a", "P1", "no", ""), ("b", "", "no", "05-Mar-2025"))
    details = readers.read_part_details(spark, str(tmp_path))
    days = {r["file"].rsplit("@", 1)[1]: r["date"] for r in recon.file_days(details).collect()}
    assert days == {
        "08-Mar-2025.txt": date(2025, 3, 10), "09-Mar-2025.txt": date(2025, 3, 3), "11-Mar-2025.txt": date(2025, 3, 11)
    }
    dated = recon.dated_by_file(details)
    assert dated.count() == 10 and dated.where("date IS NULL").count() == 0
    found = spark.createDataFrame([("c", "m", "x", "2025-03-10", "Imported")], "mpn string, man string, module string, check_date string, auto_imp_status string")
    matched = recon.match(found, found.limit(0), dated).where("provenance = 'both'").collect()
    assert [(r["mpn"], r["date"]) for r in matched] == [("c", date(2025, 3, 10))]
    assert recon.file_days(details.limit(0)).count() == 0
