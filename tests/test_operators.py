import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_problems import rows
from tilewright.functions import columns as C
from tilewright.functions import encode, reads
from tilewright.model.coords import Chromsizes, GenomicRange
from tilewright.model.policies import LinkPolicy, drops
from tilewright.operators import contacts, overlap, pairs, placement, ranking, signal
from tilewright.plans import signals

TINY = Chromsizes([("c1", 1000), ("c2", 200)])


def greedy(records, tiles, cap):
    """Sequential placement: records by importance, each at the first zoom whose tiles all have room."""
    count, out = Counter(), {}
    for imp, i in sorted(records, key=lambda r: (-r[0], r[1])):
        for z, of in enumerate(tiles[i]):
            if of and all(count[z, t] < cap for t in of):
                out[i] = z
                count.update((z, t) for t in of)
                break
            if not of:
                break
    return out


@pytest.mark.parametrize("seed,cap,stride", [(1, 1, False), (2, 3, False), (3, 5, True)])
def test_greedy_placement(spark, seed, cap, stride):
    rnd = random.Random(seed)
    width, zooms = 1024, 4
    data = [(i, float(rnd.randint(0, 9)), a := rnd.randint(0, 900), min(1024, a + rnd.choice([1, 30, 200]))) for i in range(70)]
    tiles = {}
    for i, _, a, b in data:
        tiles[i] = []
        for z in range(zooms + 1):
            w = width >> z
            met = list(range(a // w, (b - 1) // w + 1))
            tiles[i].append(met[: -(-(b - a) // w)] if stride else met)
    df = spark.createDataFrame(data + [(900, None, 1, 2), (901, float("nan"), 1, 2)], "id long, imp double, a long, b long")
    want = greedy([(imp, i) for i, imp, _, _ in data], tiles, cap)
    for at_once in {1: (500_000,), 2: (40, 500_000), 3: (0,)}[seed]:  # one by one, after some rounds too, by rounds only
        got = placement.place(df, "id", "imp", placement.interval_tiles(F.col("a"), F.col("b"), zooms, width, stride), cap, at_once)
        assert dict(map(tuple, got.collect())) == want


def test_placement_of_a_chain(spark):
    """10,000 records of falling importance, each of which meets the tile of the one before: as many rounds as for two."""
    n = 10_000
    data = [(i, float(n - i), 10 * i + 5, 10 * i + 15) for i in range(n)]
    df = spark.createDataFrame(data, "id long, imp double, a long, b long")
    tiles = F.sequence(F.floor(F.col("a") / 10), F.floor(F.col("b") / 10))
    began = time.time()
    got = {r["id"] for r in placement.place(df, "id", "imp", [tiles], 1).collect()}
    assert got == set(range(0, n, 2)) and time.time() - began < 120


def test_promotion(spark):
    rnd = random.Random(4)
    entries = [("c", z := rnd.randint(0, 4), rnd.randrange(1 << z), i, f"line{rnd.randint(0, 40)}") for i in range(120)]
    cap, count, seen, want = 3, Counter(), defaultdict(set), []
    for _, z, t, i, line in entries:
        gone = False
        while z > 0 and count[z - 1, t // 2] < cap:
            z, t = z - 1, t // 2
            if line in seen[z, t]:
                gone = True
                break
        if not gone:
            want.append((i, z, t))
            count[z, t] += 1
            seen[z, t].add(line)
    got = placement.promote(spark.createDataFrame(entries, "chrom string, zoom int, tile long, seq long, line string"), cap)
    got = rows(got.select("seq", "zoom", "tile"))
    # entries that begin in a full tile are kept where they are, as above
    assert [g for g in got] == sorted(want, key=repr)


def test_link_policies(spark):
    data = [("straddle", 10, 20, 180, 190), ("spanner", 10, 20, 300, 310), ("near", 140, 150, 200, 210)]
    df = spark.createDataFrame([(n, "c1", a, b, "c1", x, y) for n, a, b, x, y in data], "n string, chrom1 string, start1 int, end1 int, chrom2 string, start2 int, end2 int")
    at = [GenomicRange(0, "c1", 128, 256)]
    shown = {p: [r[0] for r in rows(df.where(overlap.links_meet(at, p)).select("n"))] for p in LinkPolicy}
    assert shown == {LinkPolicy.BOTH: ["near"], LinkPolicy.EITHER: ["near", "straddle"], LinkPolicy.HULL: ["near", "spanner", "straddle"]}


def test_overlap_of_nothing_and_everything(spark):
    df = spark.createDataFrame([("c1", 0, 5), ("c2", 7, 9), ("c9", 1, 2)], "chrom string, start int, end int")
    assert df.where(overlap.overlaps([], TINY)).count() == 0
    assert df.where(overlap.overlaps([GenomicRange(0, "c1", 5, 9)], TINY)).count() == 0
    assert df.where(overlap.overlaps(TINY.invert(0, 1200), TINY)).count() == 3
    assert df.where(overlap.overlaps(TINY.invert(0, 1100), TINY)).count() == 2
    known = overlap.known_contigs(df, TINY.frame(spark)).limit(2)
    assert known.count() == 2


def test_interval_join_is_an_equi_join(spark):
    df = spark.range(200).selectExpr("id * 37 as x_start", "id * 37 + id % 90 as x_end", "id")
    tiles = spark.range(80).selectExpr("2 as z", "id as x")
    joined = overlap.join_tiles(df, tiles, {2: 100})
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()
    want = [(x, i) for i in range(200) for x in range(80) if i % 90 and i * 37 < (x + 1) * 100 and i * 37 + i % 90 > x * 100]
    assert rows(joined.select("x", "id")) == sorted(want, key=repr)


def test_caps(spark):
    df = spark.createDataFrame([("g", i, i % 3) for i in range(9)], "g string, i int, v int")
    assert ranking.cap_per_group(df, ["g"], None, F.col("i")).count() == 9 and ranking.cap_per_group(df, ["g"], 0, F.col("i")).count() == 0
    assert [r["i"] for r in ranking.cap_per_group(df, ["g"], 2, F.col("v").desc(), F.col("i")).orderBy("i").collect()] == [2, 5]
    page, more = ranking.page(df, ["i"], 3, 4)
    assert [r["i"] for r in page.collect()] == [3, 4, 5, 6] and df.limit(1).select(more).first()[0]


def test_matrix_pyramid_pins(spark):
    df = spark.createDataFrame([(r, c, float(c)) for r in range(8) for c in range(8)], "r int, c int, v double")
    levels = {(r["level"], r["row"], r["col"]): r["value"] for r in signal.matrix_pyramid(df, "r", "c", "v", 3).collect()}
    assert [levels[1, 0, c] for c in range(4)] == [2, 10, 18, 26] and [levels[2, 1, c] for c in range(2)] == [24, 88]


def test_vector_pyramid_tail(spark):
    df = spark.createDataFrame([("a", i, float(i + 1)) for i in range(5)], "g string, i long, v double")
    level = lambda **k: [r["v"] for r in signal.vector_pyramid(df, ["g"], "i", "v", "sum", 2, **k).where("level = 1").orderBy("i").collect()]
    assert level() == [3, 7, 5] and level(duplicate_tail=True) == [3, 7, 10]
    lse = signal.vector_pyramid(df, ["g"], "i", "v", "logsumexp", 2).where("level = 1").orderBy("i").collect()
    assert np.allclose([r["v"] for r in lse], [np.logaddexp(1, 2), np.logaddexp(3, 4), 5])


def test_nan_sums(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, 1.0), (0, nan), (1, nan), (2, None), (2, 2.0)], "b int, v double")
    got = [r[1] for r in df.groupBy("b").agg(C.nan_sum(F.col("v"))).orderBy("b").collect()]
    assert got[0] == 1 and np.isnan(got[1]) and got[2] == 2


def test_reconcile_equals_the_driver_form(spark):
    rnd = random.Random(6)
    tiles = {t: [rnd.randint(1, 5000) for _ in range(rnd.randint(1, 9))] for t in range(40)}
    data = [(t, i, s, -(-s // 1000), 1000) for t, spans in tiles.items() for i, s in enumerate(spans)]
    df = spark.createDataFrame(data, "t int, i int, span long, n long, size long")
    got = defaultdict(list)
    for r in signal.reconcile(df, ["t"], "i", "span", "n", "size").orderBy("t", "i").collect():
        got[r["t"]].append(r["drop"])
    assert got == {t: drops(s, [-(-x // 1000) for x in s], 1000) for t, s in tiles.items()}


def test_cigar_and_md(spark):
    df = spark.createDataFrame([("3S10M2D5M1I4X2H",), ("",), (None,)], "cigar string")
    ops = [r[0] for r in df.select(reads.cigar_ops(F.col("cigar"))).collect()]
    assert [(o["op"], o["len"]) for o in ops[0]] == [("S", 3), ("M", 10), ("D", 2), ("M", 5), ("I", 1), ("X", 4), ("H", 2)] and ops[1] == ops[2] == []
    subs = df.limit(1).select(reads.cigar_substitutions(F.lit(100), F.lit(20), reads.cigar_ops(F.col("cigar")))).first()[0]
    assert [tuple(s) for s in subs] == [(110, "D", 2), (117, "I", 1), (117, "X", 4), (97, "S", 3), (120, "H", 2)]
    assert reads.rebuild_reference("ACGTACGT", "3A4", "8M") == ("ACGAACGT", "ACGTACGT")
    assert reads.rebuild_reference("ACGTTACG", "4^GG4", "4M2D4M") == ("ACGTGGTACG", "ACGT--TACG")
    assert reads.mismatches(*reads.rebuild_reference("TTACGGGTAC", "2T3", "2S3M2I3M")) == [(2, 2, "G", "T")]


def test_substitutions_of_cigars_and_difference_strings(spark):
    rows = [("2=1X2=", "TTTTT", "TTATT"), ("3=3X", "ACGTT", "ACGAAA"), ("2=2I1X3D1=", "ACGTTTT", "ACGGCT"), (None, "A", "A"), ("", "A", "A"), ("4M", "AAAA", "TTTT")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, cigar string, ref string, query string")
    got = {r["i"]: [tuple(s) for s in r["s"]] for r in df.select("i", reads.extended_cigar_substitutions(F.col("cigar"), F.col("ref"), F.col("query")).alias("s")).collect()}
    assert got[0] == [(2, 1, "X", "T", "A")] and [s[0] for s in got[1]] == [3, 4] and got[3] == got[4] == got[5] == []
    assert got[2] == [(2, 2, "I", None, None), (2, 1, "X", "G", "C"), (3, 3, "D", None, None)]
    cs = [(":10*at:5+cc-gg", 2, 1, "NNAAAT"), (None, None, 0, None), ("*ga*ga", None, None, "AA"), ("", 3, 0, "ACGT")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(cs)], "i int, cs string, lead int, tail int, seq string")
    got = {r["i"]: [tuple(s) for s in r["s"]] for r in df.select("i", reads.difference_string_substitutions(F.col("cs"), F.col("lead"), F.col("tail"), F.col("seq")).alias("s")).collect()}
    assert got[0] == [(-2, 2, "S", None, "NN"), (10, 1, "X", "A", "T"), (16, 2, "I", "", "CC"), (16, 2, "D", "GG", ""), (18, 1, "S", None, "T")]
    assert got[1] == [] and [s[0] for s in got[2]] == [0, 1] and got[3] == [(-3, 3, "S", None, "ACG")]


def plain_alignment(a, b, match=1, mismatch=-4, gap_open=-6, gap_extend=-1):
    """Cell by cell: the best score and any one of its alignments' score by its own columns."""
    none, n, m = float("-inf"), len(a), len(b)
    h = [[[none] * (m + 1) for _ in range(n + 1)] for _ in range(3)]
    h[0][0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                h[0][i][j] = max(t[i - 1][j - 1] for t in h) + (match if a[i - 1] == b[j - 1] else mismatch)
            if i:
                h[1][i][j] = max(t[i - 1][j] + (gap_extend if k == 1 else gap_open) for k, t in enumerate(h))
            if j:
                h[2][i][j] = max(t[i][j - 1] + (gap_extend if k == 2 else gap_open) for k, t in enumerate(h))
    return max(t[n][m] for t in h)


def scored(a, b, match=1, mismatch=-4, gap_open=-6, gap_extend=-1):
    total, before = 0, None
    for x, y in zip(a, b):
        now = "b" if y == "-" else "a" if x == "-" else None
        total += (match if x == y else mismatch) if now is None else gap_extend if now == before else gap_open
        before = now
    return total


def test_distances_of_all_pairs():
    rnd = random.Random(9)
    seqs = ["".join(rnd.choice("ACG") for _ in range(rnd.choice((0, 1, 7, 20)))) for _ in range(12)]

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        return row[-1]

    def _next(row, x, b):
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(row[j], new[j - 1], row[j - 1] + (x == y)))
        return new

    got = reads.distance_matrix(seqs)
    assert all(got[i, j] == (0 if i == j else 150 - common(seqs[i], seqs[j])) for i in range(12) for j in range(12))
    with pytest.raises(ValueError):
        reads.distance_matrix(seqs, most=3)


def test_alignments_of_a_batch():
    rnd = random.Random(5)
    a, b = (["".join(rnd.choice("ACGN") for _ in range(rnd.choice((0, 1, 2, 9, 24)))) for _ in range(150)] for _ in range(2))
    a[:20] = ["".join(c for c in t if rnd.random() > 0.1) + "AC" for t in b[:20]]
    for cells in (100, 8_000_000):
        for (score, x, y), s, t in zip(reads.global_alignments(a, b, cells=cells), a, b):
            assert score == plain_alignment(s, t) == scored(x, y) and (x.replace("-", ""), y.replace("-", "")) == (s, t)


def test_alignment():
    assert reads.global_alignment("ACGT", "ACGT")[0] == 4
    score, a, b = reads.global_alignment("ACGTTT", "ACTTT")
    assert score == 5 - 6 and a == "ACGTTT" and b.replace("-", "") == "ACTTT" and b.count("-") == 1
    assert reads.global_alignment("", "AC") == (-7.0, "--", "AC")
    assert [(s["pos"], s["type"], s["length"]) for s in reads.aligned_substitutions("AC--GTA", "ATGG--A")] == [(2, "X", 1), (3, "I", 2), (3, "D", 2)]


def test_alignment_scores_equal_the_sequential_form():
    rnd = random.Random(6)
    a, b = (["".join(rnd.choice("ACGN") for _ in range(rnd.choice((0, 1, 2, 9, 24)))) for _ in range(120)] for _ in range(2))
    want = [reads.global_alignment(x, y)[0] for x, y in zip(a, b)]
    assert reads.alignment_scores(a, b).tolist() == reads.alignment_scores(a, b, cells=60).tolist() == want
    assert reads.alignment_scores([], []).tolist() == []


def test_all_successive_sequences_are_scored(spark, tmp_path):
    parts = [(k, f"part {k}") for k in (*range(195, 206), 5000, 5001, 5003)] + [(5004, None)]
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    seq = {r["p_partkey"]: r["seq"] for r in signals.sequences(spark, tmp_path).collect()}
    want = {k: None if None in (seq[k], seq[k + 1]) else reads.global_alignment(seq[k], seq[k + 1])[0] for k in seq if k + 1 in seq}
    assert {r["p_partkey"]: r["score"] for r in signals.sequence_distances(spark, tmp_path).collect()} == want
    assert len(want) == 12 and want[5003] is None and want[5000] is not None


def test_dense_payload():
    p = encode.dense_payload(np.array([1.0, 2.5]))
    assert p["dtype"] == "float16" and encode.decode_dense(p).tolist() == [1, 2.5] and (p["min_value"], p["max_value"]) == (1, 2.5)
    assert encode.dense_payload(np.array([np.nan, 1]))["dtype"] == "float32" and encode.dense_payload(np.array([65504.0]))["dtype"] == "float32"
    assert np.isnan(encode.dense_payload(np.array([np.nan]))["max_value"])


def test_contacts(spark):
    px = spark.createDataFrame([(0, 0, 4), (0, 1, 2), (1, 3, 5)], "bin1_id long, bin2_id long, count long")
    assert rows(contacts.block(px, (0, 2), (0, 4))) == [(0, 0, 4), (0, 1, 2), (1, 0, 2), (1, 3, 5)]
    w = spark.createDataFrame([(0, 2.0), (1, 4.0)], "bin_id long, KR double")
    got = {(r["bin1_id"], r["bin2_id"]): r["balanced"] for r in contacts.balanced(px, w, "KR").collect()}
    assert got == {(0, 0): 1.0, (0, 1): 0.25, (1, 3): None}


def test_mates_and_codes(spark):
    r = spark.createDataFrame([("a", 64, 1), ("a", 128, 900), ("b", 64, 2), ("b", 128, 3), ("c", 0, 4)], "qname string, flag int, pos int")
    assert rows(pairs.with_mates(r, r.where("pos < 10")).select("qname", "pos")) == [("a", 1), ("a", 900), ("b", 2), ("b", 3), ("c", 4)]
    names = spark.createDataFrame([(f"v{i % 37:02d}",) for i in range(200)] + [(None,)], "v string")
    assert rows(pairs.dictionary_codes(names, "v")) == [(f"v{i:02d}", i) for i in range(37)]
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate([1, 5, 3, None, 9, 2])], "f string, n long, v long")
    assert rows(pairs.is_sorted(lines, ["f"], "n", "v")) == [("f", 2)]
