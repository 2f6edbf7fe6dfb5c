"""Cases that once gave wrong answers."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tests.test_problems import rows
from tilewright.functions import columns as C
from tilewright.model.policies import drops
from tilewright.operators import genes, signal
from tilewright.runtime import shared_folder
from tilewright.sources import text
from tilewright.streaming import bins


def test_fasta_headers_with_signs_and_splits(spark, tmp_path):
    rnd = random.Random(1)
    want, lines = {}, ["; before any header", "ACGT"]
    for k in range(30):
        seq = "".join(rnd.choice("ACGTN") for _ in range(rnd.choice((0, 1, 59, 60, 61, 3000))))
        lines += [f">c{k} 5'->3' strand > x"] + [seq[i : i + 60] + ("\r" if k % 2 else "") for i in range(0, len(seq), 60)] + [""]
        want[f"c{k}"] = seq
    (tmp_path / "a.fa").write_text("\n".join(lines))
    (tmp_path / "b.fa").write_text(">other\nAC\nGT\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")  # sequences run over many splits
    try:
        chunks = text.read_fasta(spark, str(tmp_path), 100)
        got = {}
        for r in sorted(chunks.collect(), key=lambda r: (r["chrom"], r["chunk_no"])):
            assert r["chunk_no"] * 100 == len(got.get(r["chrom"], "")) and 0 < len(r["seq"]) <= 100
            got[r["chrom"]] = got.get(r["chrom"], "") + r["seq"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {k: v for k, v in want.items() if v} | {"other": "ACGT"}


def test_escaped_ids_and_noncoding_rna(spark, tmp_path):
    lines = ["gene\t1\t100\t.\t+\t.\tID=gene%2C1;note=x", "ncRNA\t1\t100\t.\t+\t.\tID=tx%3B1;Parent=gene%2C1", "exon\t11\t20\t.\t+\t.\tID=e1;Parent=tx%3B1", "CDS\t12\t15\t.\t+\t0\tParent=tx%3B1"]
    (tmp_path / "a.gff3").write_text("".join(f"c1\tsrc\t{x}\n" for x in lines))
    gff = text.read_gff(spark, str(tmp_path / "a.gff3"))
    assert {r["id"] for r in gff.collect()} == {"gene,1", "tx;1", "e1", None}
    parts = genes.parts_with_genes(genes.features(gff))
    assert rows(parts) == [("gene,1", "tx;1", "CDS", 11, 15), ("gene,1", "tx;1", "exon", 10, 20)]


def test_powers_of_two(spark):
    ns = sorted({m for k in range(1, 62) for m in ((1 << k) - 1, 1 << k, (1 << k) + 1)} | {1})
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    got = df.select("n", C.next_power_of_two(F.col("n")).alias("p"), C.quadtree_depth(F.col("n"), F.lit(1)).alias("d")).collect()
    assert all(r["p"] == 1 << (r["n"] - 1).bit_length() and r["d"] == (r["n"] - 1).bit_length() for r in got if r["n"] < 1 << 52)


def test_drops_with_spans_without_bins(spark):
    rnd = random.Random(8)
    tiles = {0: [(400, 1), (800, 0), (200, 1)]}
    for t in range(1, 60):
        tiles[t] = [(rnd.randint(1, 4000), rnd.choice((0, 0, 1, 2, 3, 4, 5))) for _ in range(rnd.randint(1, 9))]
    want = {}
    for t, spans in tiles.items():
        walked = claimed = 0
        want[t] = []
        for s, n in spans:
            walked += s
            hit = n > 0 and claimed + 1000 * n - walked >= 500
            claimed += 1000 * n - 1000 * hit
            want[t].append(hit)
    assert all(drops([s for s, _ in v], [n for _, n in v], 1000) == want[t] for t, v in tiles.items())
    df = spark.createDataFrame([(t, i, s, n, 1000) for t, v in tiles.items() for i, (s, n) in enumerate(v)], "t int, i int, span long, n long, size long")
    got = {}
    for r in signal.reconcile(df, ["t"], "i", "span", "n", "size").orderBy("t", "i").collect():
        got.setdefault(r["t"], []).append(r["drop"])
    assert got == want and want[0] == [True, False, False]


def test_late_rows_of_a_stream_are_ignored(spark):
    base = f"{shared_folder(spark)}/late-test"
    at = lambda h, m=0: dt.datetime(2024, 1, 1 + h // 24, h % 24, m)

    def put(*events):
        spark.createDataFrame(events, "ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{base}/in")

    def run():
        events = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{base}/in")
        bins.run_to_end(bins.tumbling_bins(events, "ts", ["event_type"], "value", "1 hour", "2 hours"), f"{base}/out", f"{base}/checkpoint")
        return {(r["bin_start"].hour + 24 * (r["bin_start"].day - 1), r["n"]) for r in spark.read.parquet(f"{base}/out").collect()}

    put((at(0, 5), "a", 1.0), (at(0, 50), "a", 2.0), (at(5), "a", 3.0))
    assert run() == {(0, 2)}  # the bin of hour 5 is open
    put((at(0, 30), "a", 9.0), (at(4), "a", 4.0), (at(5, 30), "a", 5.0), (at(30), "a", 6.0))
    assert run() == {(0, 2), (4, 1), (5, 2)}  # the row of hour 0 came too late, that of hour 4 did not
