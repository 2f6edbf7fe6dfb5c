import math

import pytest

from tilewright.llm.top_n import top_n_per_group


def brute(rows, n):
    groups = {}
    for g, s, i in rows:
        if s is not None and not math.isnan(s):
            groups.setdefault(g, []).append((-s, (i is not None, i or 0), i))
    return sorted((repr(g), k + 1, i) for g, x in groups.items() for k, (_, _, i) in enumerate(sorted(x, key=lambda r: r[:2])[:n]))


@pytest.mark.parametrize("salts", [1, 3, 16])
def test_equals_a_full_sort(spark, salts):
    rows = [(f"g{i % 7 if i % 3 else 0}", float((i * 7919) % 13) if i % 11 else None, i) for i in range(900)]
    rows += [(None, 1.0, 2000 + i) for i in range(5)] + [("one", float("nan"), 3000), ("one", -0.0, 3001), ("one", 0.0, 3002)]
    df = spark.createDataFrame(rows, "g string, s double, id long")
    got = sorted((repr(r["g"]), r["place"], r["id"]) for r in top_n_per_group(df, ["g"], "s", "id", 4, salts).collect())
    assert got == brute(rows, 4)


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([("a", 1.0, 1, 5, 6)], "g string, s double, id long, place int, _salt int")
    assert [tuple(r) for r in top_n_per_group(df, ["g"], "s", "id", 3).collect()] == [("a", 1, 1)]
    assert top_n_per_group(df.where("false"), ["g"], "s", "id").collect() == []
    with pytest.raises(ValueError):
        top_n_per_group(df, ["g"], "s", "id", 0)


def test_rows_are_dropped_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 as g", "cast(id as double) as s", "id")
    plan = top_n_per_group(df, ["g"], "s", "id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
