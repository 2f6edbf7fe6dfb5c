"""Queries over the rows that they once left out."""

import math

import pytest

from tilewright.plans import genome, signals


def test_ancestor_tiles_of_all_zooms(spark, tmp_path):
    records = [(1, 0, 5, 9), (2, 8, (1 << 33) - 1, 3 << 25), (3, 9, 7 << 24, 8 << 24), (4, 17, 1 << 16, (1 << 33) - 1), (5, None, 1, 2), (6, 3, None, 2)]
    names = "uid string, fields string, importance double, tileset string, fromY long, toY long, chrOffset long"
    df = spark.createDataFrame([(*r, None, None, None, None, None, None, None) for r in records], f"id long, zoomLevel int, fromX long, toX long, {names}")
    df.write.parquet(f"{tmp_path}/intervals.parquet")
    want = {(i, z, min(a, b) >> (33 - z)) for i, zoom, a, b in records if None not in (zoom, a, b) for z in range(zoom + 1)}
    got = [tuple(r) for r in genome.ancestor_tiles(spark, str(tmp_path)).select("id", "z", "x").collect()]
    assert set(got) == want and len(got) == len(want) == 1 + 9 + 10 + 18


def test_exp2_of_all_values(spark, tmp_path):
    given = ["1.5", "NA", "40", "1e3", "2000", "-2000", "39.9", "readable?"]
    lines = [(i, f"c1 {i} {i + 1} {v}") for i, v in enumerate(given)]
    spark.createDataFrame(lines, "line_id long, raw_line string").write.parquet(f"{tmp_path}/dm3_values.parquet")
    got = {r["start"]: r["value"] for r in signals.exp2_transform(spark, str(tmp_path)).collect()}
    assert got[1] is None and sorted(got) == [0, 1, 2, 3, 4, 5, 6]
    want = [2**1.5, None, 2.0**40, 2.0**1000, math.inf, 0.0, 2**39.9]
    assert [got[i] for i in range(7) if i != 1] == pytest.approx([w for w in want if w is not None], rel=1e-12, abs=1e-6)


def test_default_vectors_of_all_lines(spark, tmp_path):
    given = ["1.5", "-1.2e-3", "NA", "0.5d", "0.5f", "0x1p3", "x", "", None, "+.5E+2\r", "1,234.5", "inf", "na"]
    lines = [(k, v, "2e1\r") for k, v in enumerate(given)]
    spark.createDataFrame(lines, "row_id long, copynumber string, segmented string").write.parquet(f"{tmp_path}/cnvs_hw.parquet")
    got = {(r["row_id"], r["i"]): r["v"] for r in signals.default_vectors(spark, str(tmp_path)).collect()}
    want = {0: 1.5, 1: -0.0012, 9: 50.0, 11: math.inf}
    assert len(got) == 3 * len(given) and all(got[k, 1] == 20 and math.isnan(got[k, 2]) for k in range(len(given)))
    assert all(got[k, 0] == want[k] if k in want else math.isnan(got[k, 0]) for k in range(len(given)))


def test_spine_reaches_the_last_bin(spark, tmp_path):
    lines = [(0, "c1 500 1500 2"), (1, "c1 300000 301000 1"), (2, "c1 301000 302001 NA"), (3, "c2 199000 200000 3"), (4, "c3 199999 200001 4")]
    spark.createDataFrame(lines, "line_id long, raw_line string").write.parquet(f"{tmp_path}/dm3_values.parquet")
    got = {(r["chrom"], r["bin"]): r["sum"] for r in signals.signal_on_spine(spark, str(tmp_path)).collect()}
    filled = {("c1", 0): 1000, ("c1", 1): 1000, ("c1", 300): 1000, ("c2", 199): 3000, ("c3", 199): 4, ("c3", 200): 4}
    assert got == {(c, b): filled.get((c, b), 0) for c, n in (("c1", 303), ("c2", 200), ("c3", 201)) for b in range(n)}
