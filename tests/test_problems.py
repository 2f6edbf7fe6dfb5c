"""The operators of the general problems against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import random
from collections import Counter
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tilewright.operators import hotkeys, orphans, strict_load
from tilewright.operators.blocks import block_lead, block_running_sum
from tilewright.operators.gff_parents import parent_of
from tilewright.operators.hierarchy import Forest
from tilewright.operators.periods import periods_and_gaps
from pyspark.sql import functions as F


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ------------------------------------------------------------------------------------------ hierarchies


def walk(parents, node):
    seen, at = [], node
    while True:
        if at in seen:
            return None, seen, at
        seen.append(at)
        up = parents.get(at)
        if up is None or up not in parents:
            return at, seen, None
        at = up


def expected(parents):
    out = {}
    for n in parents:
        root, path, again = walk(parents, n)
        out[n] = (root, len(path) - 1) if root is not None else ("", -1 if again == n else -2)
    return out


def forests():
    rnd = random.Random(1)
    for n in (1, 2, 30, 120):
        parents = {f"n{i}": (f"n{rnd.randrange(n)}" if rnd.random() < 0.9 else None) for i in range(n)}
        yield parents
    chain = {f"c{i}": f"c{i - 1}" for i in range(1, 70)} | {"c0": "absent", "x/%;": "c35", "": "c69"}
    yield chain
    yield {"a": "b", "b": "c", "c": "a", "d": "a", "e": "d", "f": "f", "g": "f", "r": None, "s": "r"}
    star = {f"s{i}": "s0" for i in range(1, 60)} | {"s0": None}
    yield star


@pytest.mark.parametrize("number", range(7))
def test_forest(spark, number):
    parents = list(forests())[number]
    data = [(n, p, 1) for n, p in parents.items()]
    data += data[: len(data) // 3] + [(None, "c1", 1)]
    # keys are spread in some of the forests, whatever their size
    f = Forest(spark.createDataFrame(data, "id string, parent string, _code int"), spread_from=1 if number in (3, 4, 6) else 1_000_000)
    got = {r["id"]: r for r in f.nodes().collect()}
    want = expected(parents)
    assert {n: (r["root_id"], r["depth"]) for n, r in got.items()} == want
    trees = {n for n, (_, k) in want.items() if k >= 0}
    below = Counter(a for n in trees for a in walk(parents, n)[1])
    assert {n: got[n]["descendants"] for n in trees} == {n: below[n] - 1 for n in trees}
    for n in trees:  # the interval of a node holds its descendants and nobody else
        r = got[n]
        inside = {m for m in trees if got[m]["root_id"] == r["root_id"] and r["first"] <= got[m]["first"] <= r["last"]}
        assert inside == {m for m in trees if n in walk(parents, m)[1]}
    paths = {r["id"]: r["path"] for r in f.paths("|", block=7).collect()}
    assert paths == {n: "|".join(reversed(walk(parents, n)[1])) for n in trees}
    pieces = Counter(r["_code"] for r in f.segments().collect())
    assert not trees or max(pieces.values()) <= len(trees).bit_length()
    if number in (2, 4, 5):
        above = sorted((r["id"], r["depth"], r["ancestor"]) for r in f.ancestry().collect())
        assert above == sorted((n, k, a) for n in trees for k, a in enumerate(reversed(walk(parents, n)[1])))


def test_empty_forest(spark):
    f = Forest(spark.createDataFrame([], "id string, parent string"))
    assert rows(f.nodes()) == rows(f.paths()) == []


def test_parents(spark):
    cases = [
        ("exon", "ID=a;Parent=b", "b"), ("exon", "ID=a; Parent = b%3Bc ;", "b;c"), ("exon", "Note=see Parent=x;Parent=b", "b"), ("exon", "parent=b", None),
        ("gene", "Parent=;ID=x", None), ("x", "Parent=a=b", "a=b"), ("x", "Parent=a%2541", "a%41"), ("x", "Parent=a+b%zz", "a+b%zz"), ("exon", None, None), ("exon", "", None),
        ("exon", 'gene_id "g"; transcript_id "t"', "t"), ("CDS", 'note "gene_id x; y"; transcript_id "t";', "t"), ("gene", 'gene_id "g"', None),
        ("mRNA", 'exon_number 9; gene_id " g "; transcript_id "t"', "g"), (None, 'gene_id "g"', "g"), ("exon", 'gene_id "g"; transcript_id ""', None),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, type string, attributes string, want string")
    for r in df.withColumn("got", parent_of(F.col("attributes"), F.col("type"))).collect():
        assert r["got"] == r["want"], r


# --------------------------------------------------------------------------------------------- hot keys


def test_tree_aggregate(spark):
    rnd = random.Random(2)
    data = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), rnd.choice([None, 1, 2, 3]), 0) for _ in range(2000)]
    df = spark.createDataFrame(data, "k string, v int, _node int").repartition(23)
    aggs = {"n": ("count", F.lit(1)), "nv": ("count", F.col("v")), "s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v")), "m": ("avg", F.col("v"))}
    plain = df.groupBy("k").agg(F.count(F.lit(1)), F.count("v"), F.sum("v"), F.min("v"), F.max("v"), F.avg("v"))
    for fan_in in (2, 3, 100):
        assert rows(hotkeys.tree_aggregate(df, ["k"], aggs, fan_in)) == rows(plain)
    assert rows(hotkeys.hot_keys(df, "k", 0.2)) == [("hot", sum(k == "hot" for k, _, _ in data))]
    assert rows(hotkeys.hot_keys(df.where("false"), "k")) == []
    with pytest.raises(ValueError):
        hotkeys.tree_aggregate(df, ["k"], {"x": ("mode", F.col("v"))})


def test_more_partitions_than_counted(spark):
    df = spark.range(1000).selectExpr("id % 3 as k").repartition(40)
    for leaves in (1, 3, 40):
        assert rows(hotkeys.tree_aggregate(df, ["k"], {"n": ("count", F.lit(1))}, 2, leaves)) == [(0, 334), (1, 333), (2, 333)]


def test_a_merge_reads_few_states(spark):
    df = spark.range(0, 10_000, 1, 64).selectExpr("id % 2 as k")
    plan = hotkeys.tree_aggregate(df, ["k"], {"n": ("count", F.lit(1))}, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3  # 64 leaves, 16, 4, 1


# ------------------------------------------------------------------------------------------ strict load


def test_cnvs_reasons(spark):
    good = ("1", "2", "0.5", "NA\r")
    cases = {
        good: None, ("0", "2", "1", "1"): "start", ("²", "2", "1", "1"): "start", (None, "2", "1", "1"): "start", ("1" * 19, "2", "1", "1"): "start", ("1\n", "2", "1", "1"): "start",
        ("1", "0", "1", "1"): "end", ("1", "", "1", "1"): "end", ("3", "2", "1", "1"): "order", ("x", "y", "z", "w"): "start", ("007", "9", "1", "1"): None,
        ("1", "2", None, "1"): "number", ("1", "2", "1", None): "number", ("1", "2", "1\r", "1"): "number", ("1", "2", "1", "1\r\r"): "number", ("1", "2", "1", "\r"): "number",
        ("1", "2", "+1.e5", ".5E-3\r"): None, ("1", "2", ".", "1"): "number", ("1", "2", "1e", "1"): "number", ("1", "2", "--1", "1"): "number", ("1", "2", "1e999", "NaN"): "number",
        ("1", "2", "na", "1"): "number", ("1", "2", "٣", "1"): "number", ("1", "2", "1" * 20000, "1"): None,
    }
    data = [(i, *c, 0, "s") for i, c in enumerate(cases)] + [(100, *good, 0, "s"), (100, "bad", "2", "1", "1", 0, "s"), (None, *good, 0, "s")]
    df = spark.createDataFrame(data, "row_id long, start string, end string, copynumber string, segmented string, reason int, _digest string")
    bad = [(i, r) for i, r in enumerate(cases.values()) if r] + [(100, "start")]
    assert rows(strict_load.reject_cnvs(df)) == sorted(bad, key=repr)
    loaded = strict_load.load_cnvs(df, keep=("_digest",))
    assert loaded.count() + len(bad) == len(data) and loaded.where("row_id = 0").first()["segmented"] is None
    assert rows(strict_load.reject_cnvs(df.where("false"))) == []


def test_value_lines(spark):
    cases = {
        "chr1\t1\t2\t0.5": None, 'chr1 1  2\t"NA" \r': None, '"chr ""1"" x"\t1\t2\t3': None, "# comment": "-", "#": "-", " \t\r": "-", "": "-", None: "-", " # 1 2 3": None,
        'chr1\t1\t2\t"3': "quoting", 'chr"1"\t1\t2\t3': "quoting", '"chr1"x\t1\t2\t3': "quoting", '"a"\t"b" "c""': "quoting", '"""\t1\t2\t3': "quoting", '""\t1\t2\t3': None, '""""\t1\t2\t3': None,
        "chr1 1 2": "columns", "chr1 1 2 3 4": "columns", "chr1,1,2,3": "columns", "chr1 x 2 3": "start", "chr1 1 2.0 3": "end", "chr1 2 2 3": "order", "chr1 0 1 x": "number", 'chr1 "1" "2" "-.5e1"': None,
        'chr1 1 2 " 3"': "number", '"' + '""' * 30000 + '" 1 2 3': None, '"' + '""' * 30000 + " 1 2 3": "quoting", "a" * 100000: "columns", 'c\n1 1 2 3': None, 'chr1 1 "" 3': "end",
    }
    df = spark.createDataFrame([(i, t, "f") for i, t in enumerate(cases)], "line_id long, raw_line string, _f string")
    assert rows(strict_load.reject_values(df)) == sorted([(i, r) for i, r in enumerate(cases.values()) if r not in (None, "-")], key=repr)
    loaded = {r["line_id"]: tuple(r)[1:] for r in strict_load.load_values(df).collect()}
    assert set(loaded) == {i for i, r in enumerate(cases.values()) if r is None}
    assert loaded[1] == ("chr1", 1, 2, None) and loaded[2] == ('chr "1" x', 1, 2, 3.0)


# ----------------------------------------------------------------------------------------------- orphans


def test_orphans(spark):
    rnd = random.Random(3)
    when = lambda: datetime(2025, rnd.randint(1, 6), rnd.randint(1, 28), rnd.randint(0, 23))
    keys = [f"k{i}" for i in range(150)] + [""]
    parents = [(rnd.choice(keys[:100] + [""]), when(), when() if rnd.random() < 0.3 else None) for _ in range(160)] + [(None, when(), None)]
    refs = [(i, rnd.choice(keys + ["k1"] * 60 + [None]), when() if rnd.random() < 0.97 else None) for i in range(1500)]
    p = spark.createDataFrame(parents, "name string, since timestamp_ntz, until timestamp_ntz")
    r = spark.createDataFrame(refs, "id long, ref string, loaded timestamp_ntz")
    got = orphans.orphan_references([orphans.references(r, "t", "f", 0, "ref", "id", "loaded")], [orphans.targets(p, 0, "name", "since", "until")])
    known = {}
    for k, a, z in parents:
        if k is not None:
            known.setdefault(k, []).append((a, z))
    want = []
    for i, k, at in refs:
        if k is None:
            continue
        since = min(a for a, _ in known[k]) if k in known else None
        until = max(z for _, z in known[k]) if k in known and all(z for _, z in known[k]) else None
        reason = "missing" if k not in known else at and ("late" if since > at else "deleted" if until and until <= at else None)
        if reason:
            want.append(("t", "f", i, at and f"{at:%Y-%m}", reason))
    assert rows(got) == sorted(want, key=repr) and {w[4] for w in want} == {"missing", "late", "deleted"}
    empty = orphans.orphan_references([orphans.references(r.where("false"), "t", "f", 0, "ref", "id", "loaded")], [orphans.targets(p, 0, "name", "since", "until")])
    assert rows(empty) == []
    lost = orphans.orphan_references([orphans.references(r, "t", "f", 0, "ref", "id", "loaded")], [orphans.targets(p.where("false"), 0, "name", "since", "until")])
    assert lost.count() == sum(k is not None for _, k, _ in refs)


def test_bitmaps_are_stored_short_and_equal():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 5, 4095, 4096, 4097, 60_000, 65_536):
        low = rnd.permutation(1 << 16)[:n]
        stored = orphans.packed(low)
        assert len(stored) == min(2 * n, 8192) and np.flatnonzero(np.unpackbits(orphans.bits_of(stored))).tolist() == sorted(low.tolist())


def test_doubt_of_many_months_is_one_array_a_column():
    refs = pd.DataFrame([("a" * (k % 3), "f", k, 5, orphans.packed(np.arange(k, 60_000))) for k in range(40)], columns=["table_name", "ref_field", "_month", "_range", "_map"])
    parents = pd.DataFrame([(10, False, orphans.packed(np.arange(0, 65_536))), (20, True, orphans.packed(np.array([30_000])))], columns=["_month", "_gone", "_map"])
    out = orphans._doubtful(refs, parents)
    assert all(isinstance(pa.array(out[c]), pa.Array) for c in out.columns)
    want = {k: 60_000 - k if k < 10 else k >= 20 for k in range(40)}
    assert {k: int((out["_month"] == k).sum()) for k in want} == want and set(out.loc[out["_month"] > 20, "_code"]) == {(5 << 16) + 30_000}
    assert len(orphans._doubtful(refs[:0], parents)) == 0


# ----------------------------------------------------------------------------------------------- periods


def brute_periods(spans):
    out, by = [], {}
    for g, a, b in spans:
        if a is not None and b is not None:
            by.setdefault(g, []).append((a, b))
    for g, iv in by.items():
        iv.sort()
        lo, hi = iv[0]
        for a, b in iv[1:]:
            if a > hi:
                out += [(g, "period", lo, hi), (g, "gap", hi, a)]
                lo = a
                hi = b
            hi = max(hi, b)
        out.append((g, "period", lo, hi))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_periods(spark, bits):
    rnd = random.Random(bits)
    data = []
    for g in ["a", "b", "", None]:
        for _ in range(120):
            a = rnd.randint(-50, 900)
            data.append((g, a, a + rnd.choice([0, 1, 2, 5, 30])))
    data += data[:40] + [("a", None, 3), ("b", 5, None), ("one", 7, 7), ("far", 0, 10**17), ("far", 10**17 + 1, 10**17 + 2)]
    df = spark.createDataFrame([(*d, 1) for d in data], "g string, lo long, hi long, kind int")
    assert rows(periods_and_gaps(df, ["g"], "lo", "hi", bits)) == brute_periods(data)
    assert rows(periods_and_gaps(df.where("false"), ["g"], "lo", "hi")) == []


def test_blocks(spark):
    rnd = random.Random(5)
    data = [(g, o, rnd.randint(0, 9)) for g in "ab" for o in rnd.sample(range(-40, 400), 90)]
    df = spark.createDataFrame(data, "g string, o long, v long")
    want_sum, want_lead = [], []
    for g in "ab":
        own = sorted((o, v) for h, o, v in data if h == g)
        for i, (o, v) in enumerate(own):
            want_sum.append((g, o, v, sum(x for _, x in own[: i + 1])))
            want_lead.append((g, o, v, own[i + 1][1] if i + 1 < len(own) else None))
    assert rows(block_running_sum(df, ["g"], "o", "v", "s", 3)) == sorted(want_sum, key=repr)
    assert rows(block_lead(df, ["g"], "o", "v", "n", 3)) == sorted(want_lead, key=repr)


def test_parents_in_long_texts(spark):
    pad = 'k "v; gene_id no";' * 20000
    rows_ = [("x", pad + 'gene_id "g"', "g"), ("x", "a=b;" * 50000 + "Parent=p", "p"), ("x", '"' * 50001, None), ("x", "tag;;" * 20000 + ' gene_id  g ; x "y"', "g"), ("x", 'gene_ids "no"; gene_id "yes"', "yes")]
    df = spark.createDataFrame(rows_, "type string, attributes string, want string").withColumn("got", parent_of(F.col("attributes"), F.col("type")))
    assert [r["got"] for r in df.collect()] == [w for _, _, w in rows_]
