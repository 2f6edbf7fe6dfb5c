import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_problems import rows
from tests.test_sources import SIZES, put  # noqa: F401
from tilewright import cli
from tilewright.functions import columns as C
from tilewright.functions import reads
from tilewright.functions.encode import decode_dense
from tilewright.operators import genes
from tilewright.sources import stores, text
from tilewright.tilesets import more


def test_stored_signal(spark, put, tmp_path):
    sizes = put("sizes", "c1\t3000\nc2\t1500\n")
    cli.main(["aggregate", "bedgraph", put("g.bg", "c1 0 100 1\nc1 100 200 3\nc1 200 300 NA\n"), "--output", str(tmp_path / "g"), "--chromsizes", sizes, "--zoom-step", "2", "--tile-size", "64"])
    t = more.StoredSignalTileset(spark, *stores.read_store(spark, str(tmp_path / "g")))
    z = t.info().max_zoom
    assert decode_dense(t.tiles([f"u.{z}.1"])[0][1]).tolist() == [1] * 36 + [3] * 28
    coarse = decode_dense(t.tiles([f"u.{z - 3}.0"])[0][1])  # bins of 8 bases
    assert coarse[:12].tolist() == [1] * 12 and coarse[12] == 2 and coarse[13] == 3 and np.isnan(coarse[25:38]).all()


def test_matrix_density_and_labels(spark, tmp_path):
    m = spark.createDataFrame([(r, c, float(c)) for r in range(8) for c in range(8)], "row long, col int, value double")
    info = stores.matrix_to_store(m, str(tmp_path / "m"), 8, 4)
    t = more.MatrixTileset(spark, *stores.read_store(spark, str(tmp_path / "m")))
    assert info.max_zoom == 1 and decode_dense(t.tiles(["u.0.0.0"])[0][1]).reshape(4, 4)[0].tolist() == [2, 10, 18, 26]
    assert decode_dense(t.tiles(["u.1.1.0"])[0][1]).reshape(4, 4)[2].tolist() == [4, 5, 6, 7]
    zero = more.MatrixTileset(spark, *stores.read_store(spark, str(tmp_path / "m")), zero_is_nan=True)
    assert np.isnan(decode_dense(zero.tiles(["u.1.0.0"])[0][1])[0])
    p = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (1.0, 1.0), (0.3, 0.9)], "x double, y double")
    d = decode_dense(more.DensityTileset(spark, p, 5, 4).tiles(["u.0.0.0"])[0][1]).reshape(4, 4)
    assert d[0, 0] == 1 and d[3, 3] == 2 and d[3, 1] == 1 and np.isnan(d).sum() == 13
    with pytest.raises(ValueError):
        more.DensityTileset(spark, p.where("false"))
    labels = spark.createDataFrame([(i, f"l{i}", float(i % 7)) for i in range(40)], "index long, label string, importance double")
    top = more.LabelTileset(spark, labels, 40, 4).tiles(["u.0.0"])[0][1]
    assert [x["importance"] for x in top] == [6.0] * 4
    even = more.LabelTileset(spark, labels.drop("importance"), 40, 4).tiles(["u.0.0", "u.4.9", "u.4.15"])
    assert [x["x"] for x in even[0][1]] == [0, 13, 26, 39] and [x["x"] for x in even[1][1]] == [36, 37, 38, 39] and even[2][1] == []


def test_geo_images_and_logos(spark, put, tmp_path):
    features = ",".join(f'{{"geometry":{{"type":"Point","coordinates":[{i * 3 - 150},{i - 40}]}},"properties":{{"i":{i}}}}}' for i in range(90))
    cli.main(["aggregate", "geojson", put("g.json", f'{{"type":"FeatureCollection","features":[{features}]}}'), "--output", str(tmp_path / "g"), "--max-per-tile", "3", "--max-zoom", "5"])
    data, info = stores.read_store(spark, str(tmp_path / "g"))
    t = more.GeoTileset(spark, data, 5)
    assert len(t.tiles(["u.0.0.0"])[0][1]) == 4 and {r["zoom_level"] for r in t.tiles(["u.1.0.0"])[0][1]} <= {0, 1}
    images = spark.createDataFrame([(0, 0, 0, bytearray(b"png"))], "z int, x long, y long, image binary")
    assert dict(more.ImageTileset(spark, images, 2).tiles(["u.0.0.0", "u.1.1.1"])) == {"u.0.0.0": b"png", "u.1.1.1": None}
    seqs = spark.createDataFrame([("AC",), ("AG",), ("A-",)], "seq string")
    ((name, payload),) = more.LogoTileset(spark, seqs, 2, tile_size=2).all_tiles("u")
    w = decode_dense(payload).reshape(4, 2)
    assert name == "u.0.0" and w[0, 0] == 1 and w[1, 1] == 0.5 and w[2, 1] == 0.5


def test_pileup(spark):
    seqs = spark.createDataFrame([("b", "ACGTACGT"), ("a", "ACTTACGT"), ("c", "ACGTTACGT")], "id string, seq string")
    tile, other = (p for _, p in more.PileupTileset(spark, seqs, "ACGTACGT").tiles(["u.0.0", "u.1.0"]))
    assert [r["id"] for r in tile] == ["a", "b", "c"] and tile[0]["substitutions"] == [{"pos": 3, "type": "X", "length": 1, "base": "G", "variant": "T"}] and tile[1]["substitutions"] == []
    assert tile[2]["substitutions"][0]["type"] == "I" and other["error_type"] == "TileOutOfBounds"
    more_seqs = seqs.unionByName(spark.range(9000).selectExpr("concat('n', id) as id", "'ACGTACGA' as seq")).withColumn("extra", F.lit("v"))
    ((_, tile),) = more.PileupTileset(spark, more_seqs, [("r1", "ACGTACGT"), ("r2", "ACGTACGA")]).tiles(["u.0.0"])
    assert len(tile) == 2 * 9003 and {(r["id"], r["from"], r["to"]) for r in tile} >= {("n1_r1", 1, 8), ("n1_r2", 9, 16)} and tile[0]["extra"] == "v"
    at = {r["id"]: [s["pos"] for s in r["substitutions"]] for r in tile}
    assert at["n1_r1"] == [8] and at["n1_r2"] == [] and at["b_r2"] == [16]


def test_depths_and_promotion_stores(spark, put, tmp_path):
    sam = text.read_sam(spark, put("r.sam", "r1\t0\tc1\t11\t60\t2S3M1D2M1I\t*\t0\t0\tTTACGTAC\t*\n"))
    depth = {(r["row"], r["lo"]): r["hi"] for r in reads.base_depths(sam).collect()}
    assert depth == {("S", 10): 11, ("M", 10): 13, ("D", 13): 14, ("M", 14): 16, ("I", 16): 17, ("A", 10): 11, ("C", 11): 12, ("G", 12): 13, ("T", 14): 15, ("A", 15): 16}
    sizes = put("sizes", "c1\t3000\nc2\t1500\n")
    cli.main(["convert", "bamfile_to_multivec", put("q.sam", "r1\t0\tc1\t11\t60\t3M\t*\t0\t0\tACG\t*\n"), "--output", str(tmp_path / "d"), "--chromsizes", sizes, "--base-resolution", "10"])
    assert rows(stores.read_store(spark, str(tmp_path / "d"))[0].where("level = 0").select("row", "bin", "value")) == [(0, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0), (5, 1, 3.0)]
    bed = put("b.bed", "".join(f"c1\t{i * 20}\t{i * 20 + 15}\tn{i}\n" for i in range(60)))
    cli.main(["convert", "bedfile_to_hibed", bed, "--output", str(tmp_path / "h"), "--chromsizes", sizes, "--importance-column", "size", "--max-per-tile", "5"])
    data, info = stores.read_store(spark, str(tmp_path / "h"))
    t = more.PromotedTileset(spark, data, info.max_zoom)
    assert len(t.tiles(["u.0.0"])[0][1]) == 5 and len(t.tiles([f"u.{info.max_zoom}.0"])[0][1]) >= 5 and {r["zoom"] for r in t.tiles(["u.1.0"])[0][1]} == {0, 1}


def test_index_bins(spark):
    df = spark.createDataFrame([(0, 1), (16383, 16385), (5, 5)], "a long, b long")
    got = [r[0] for r in df.select(C.index_bins(F.col("a"), F.col("b"))).collect()]
    assert got == [[0, 1, 9, 73, 585, 4681], [0, 1, 9, 73, 585, 4681, 4682], []]


def test_clustering_and_gene_lines(spark, put):
    d = [[0, 9, 1, 8], [9, 0, 9, 2], [1, 9, 0, 8], [8, 2, 8, 0]]
    assert reads.cluster_order(np.array(d)) == [0, 2, 1, 3] and reads.cluster_order(np.zeros((1, 1))) == [0]
    gff = put("a.gff", "c1\ts\tgene\t1\t100\t.\t-\t.\tID=g\nc1\ts\tmRNA\t1\t90\t.\t-\t.\tID=t;Parent=g\nc1\ts\texon\t11\t20\t.\t-\t.\tParent=t\nc1\ts\texon\t31\t40\t.\t-\t.\tParent=t\nc1\ts\tCDS\t15\t35\t.\t-\t.\tParent=t\nc1\ts\tCDS\t51\t60\t.\t+\t.\tParent=lost\n")
    f = text.read_gff(spark, gff)
    assert [r["line"] for r in genes.gene_predictions(f).collect()] == ["t\tc1\t-\t0\t90\t14\t35\t2\t10,30,\t20,40,"]
    made = genes.with_missing_owners(genes.features(f)).where("parent = 'lost' or id in ('lost', 'gene:lost')")
    assert rows(made.select("type", "id", "parent")) == sorted([("CDS", "CDS_51_60", "lost"), ("exon", None, "lost"), ("gene", "gene:lost", None), ("mRNA", "lost", "gene:lost")], key=repr)
    (r,) = genes.transcript_records(f, SIZES.frame(spark)).collect()
    assert (r["start_codon"], r["stop_codon"], r["exon_starts"]) == ("33", "15", "11,31")
