"""A year with many new patterns names all of them."""

from __future__ import annotations

from lodestar.operators.migration import structural_changes


def test_no_change_is_left_out(spark):
    rows = [("20230101120000", "https://x.test/a/0/x")] + [("20240101120000", f"https://x.test/a/{i}/x") for i in range(1, 60)]
    found = structural_changes(snapshots=spark.createDataFrame(rows, "timestamp string, original string")).collect()
    assert sorted((r["year"], r["change"], r["pattern"]) for r in found) == sorted([("2024", "new", f"/a/{i}") for i in range(1, 60)] + [("2024", "removed", "/a/0")])
