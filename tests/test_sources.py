import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.oracle import differences
from tests.test_problems import rows
from tilewright import cli
from tilewright.functions.encode import decode_dense
from tilewright.model.coords import Chromsizes
from tilewright.model.errors import MalformedTileId, TileOutOfBounds, TileTooLarge
from tilewright.model.info import TilesetInfo
from tilewright.model.policies import LinkPolicy, TilePolicy
from tilewright.plans import files
from tilewright.sources import stores, text
from tilewright.tilesets.dense import ContactTileset, SignalTileset, VectorTileset
from tilewright.tilesets.records import AnnotationTileset, LinkTileset, PairTileset, ReadsTileset, SequenceTileset, StoredTileset

SIZES = Chromsizes([("c1", 3000), ("c2", 1500)])


@pytest.fixture
def put(tmp_path):
    def write(name, content):
        p = tmp_path / name
        p.write_bytes(gzip.compress(content.encode()) if name.endswith(".gz") else content.encode())
        return str(p)

    return write


def test_bed_and_vcf_and_gff(spark, put):
    bed = text.read_bed(spark, put("a.bed.gz", "track x\nchrom\tstart\tend\nc1\t1\t5\tn\t7\r\n\nc2\t3\t4\n# z\n"))
    assert rows(bed) == [("c1", 1, 5, "n\t7"), ("c2", 3, 4, None)]
    vcf = put("a.vcf", "##contig=<ID=c2,length=500>\n##contig=<ID=c1,length=1000>\n#CHROM\tPOS\nc1\t5\t.\tACG\tT,C\t30\tPASS\tEND=20\tGT\nc1\t9\ta;b\tA\t.\t.\t.\tXEND=3\n")
    assert [(r["pos"], r["ids"], r["alts"], r["qual"], r["end"]) for r in text.read_vcf(spark, vcf).orderBy("pos").collect()] == [(5, [], ["T", "C"], 30.0, 20), (9, ["a", "b"], [], None, 9)]
    assert text.vcf_chromsizes(spark, vcf).names == ("c2", "c1")
    gff = text.read_gff(spark, put("a.gff", "c1\ts\tregion\t1\t900\t.\t.\t.\tID=c1\nc1\ts\tgene\t1\t100\t.\t+\t.\tID=g\nc1\ts\texon\t11\t20\t2.5\t?\t0\tParent=g\n"))
    assert rows(gff.select("type", "id", "strand", "score", "phase")) == [("exon", None, None, 2.5, 0), ("gene", "g", "+", None, None), ("region", "c1", ".", None, None)]
    assert text.gff_chromsizes(gff).names == ("c1",)


def test_sam_and_fasta(spark, put):
    sam = text.read_sam(spark, put("a.sam", "@SQ\tSN:c1\nr1\t99\tc1\t10\t60\t2S4M1D3M\t=\t1\t1\tAAACGTACG\t*\tMD:Z:1T2^A3\tHP:i:2\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*\n"))
    assert rows(sam.select("qname", "pos", "end", "md", "hp")) == [("r1", 10, 17, "1T2^A3", 2)]
    fa = text.read_fasta(spark, put("a.fa", ">c1 first\nACGTA\nCGT\n>c2\nTTTTT\n"), 4)
    assert rows(fa) == [("c1", 0, "ACGT"), ("c1", 1, "ACGT"), ("c2", 0, "TTTT"), ("c2", 1, "T")]
    assert rows(text.fasta_lengths(fa)) == [("c1", 8), ("c2", 5)]
    t = SequenceTileset(spark, fa, Chromsizes([("c1", 8), ("c2", 5)]), 4, tile_size=4)
    got = dict(t.tiles(["u.2.0", "u.2.1", "u.2.2", "u.2.3", "u.0.0", "u.2.9"]))
    assert [got[i]["sequence"] for i in ("u.2.0", "u.2.1", "u.2.2", "u.2.3", "u.0.0")] == ["ACGT", "ACGT", "TTTT", "T", "ACGTACGTTTTTT"]
    assert got["u.2.9"]["error_type"] == "TileOutOfBounds"


def test_bedgraph_vectors_points_matrix_geo(spark, put):
    g = text.read_bedgraph(spark, put("a.bg", "c1 0 10 2\nc1\t10\t20\tNA\n"), exp2=True)
    assert [r["value"] for r in g.orderBy("start").collect()][0] == 4 and np.isnan(g.orderBy("start").collect()[1]["value"])
    v = text.read_vectors(spark, [put("v1", "c1\t0\t10\t1\tNA\n"), put("v2", "c1\t0\t10\t3\nc1\t10\t20\t4\t5\n")], 2)
    got = {r["start"]: r["values"] for r in v.collect()}
    assert got[0][0] == 1 and np.isnan(got[0][1]) and got[0][2] == 3 and np.isnan(got[10][0]) and got[10][2:] == [4, 5]
    assert rows(text.read_points(spark, put("p.csv", "k,y,x\na,2,1\nb,z,3\n"))) == [(1.0, 2.0)]
    assert rows(text.read_sequences(spark, put("s.csv", "n,s\na,ACG\n"), 2)) == rows(text.read_sequences(spark, put("s2.csv", "n,s\na,ACG\n"), "s")) == [("ACG",)]
    with pytest.raises(ValueError):
        text.read_sequences(spark, put("s3.csv", "n,s\na,ACG\n"), 0)
    m = text.read_matrix(spark, put("m.tsv", "x\ta\tb\nr0\t1\t2\nr1\t3\t\nr2\t5\t6\n"))
    assert [(r["row"], r["col"]) for r in m.orderBy("row", "col").collect()] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    geo = text.read_geojson(spark, put("g.json", '{"type":"FeatureCollection","features":[{"geometry":{"type":"Polygon","coordinates":[[[0,1],[2.5,1],[0,-3],[0,1]]]},"properties":{"a":1}}]}'))
    assert rows(geo.select("min_lng", "min_lat", "max_lng", "max_lat", "properties")) == [(0.0, -3.0, 2.5, 1.0, '{"a":1}')]


def test_options_of_bed_and_vector_files(spark, put):
    bed = text.read_bed(spark, put("d.bed", "name;start;end;chrom\na;5;9;c1\nb;x;9;c1\n"), ";", (3, 1, 2), -1)
    assert rows(bed) == [("c1", 4, 8, "a")]
    v = text.read_vectors(spark, [put("e", "c1\t0\t10\tid:1,qcat:[[0.5,2],[1.5,0],[-1,1]]\n")], 3, "epilogos")
    assert [r["values"] for r in v.collect()] == [[1.5, -1, 0.5]]
    v = text.read_vectors(spark, [put("s", "c1\t0\t10\tB\nc1\t10\t20\tX\n")], kind="states", states=["A", "B"])
    assert {r["start"]: r["values"] for r in v.collect()} == {0: [0, 1], 10: [0, 0]}
    v = text.read_vectors(spark, [put("o", "c1\t0\t10\t3|4\n")], 2, parse=lambda f: F.split(f[0], "\\|").cast("array<double>"))
    assert [r["values"] for r in v.collect()] == [[3, 4]]
    with pytest.raises(ValueError):
        text.read_vectors(spark, [], kind="other")


def test_annotation_tiles(spark, put):
    bed = put("b.bed", "".join(f"c1\t{i * 10}\t{i * 10 + 15}\tn{i}\n" for i in range(200)) + "cX\t1\t2\n")
    t = AnnotationTileset.from_bed(spark, bed, SIZES, TilePolicy(max_records=5), tile_size=512)
    got = t.tiles(["u.0.0", "u.4.1", "u.4.7"])
    assert [i for i, _ in got] == ["u.0.0", "u.4.1", "u.4.7"] and len(got[0][1]) == 5 and got[2][1] == []
    starts = [r["xStart"] for r in got[1][1]]
    assert starts == sorted(starts) and all(r["xStart"] < 1024 and r["xEnd"] > 512 for r in got[1][1])
    page, more = t.regions(2, 3)
    assert [r["xStart"] for r in page] == [20, 30, 40] and more
    with pytest.raises(MalformedTileId):
        t.tiles(["u.0"])


def test_pair_and_link_tiles(spark, put):
    p = put("p.bedpe", "c1\t10\t20\tc1\t180\t190\tstraddle\nc1\t10\t20\tc1\t300\t310\tspanner\nc1\t140\t150\tc1\t200\t210\tnear\ncX\t1\t2\tc1\t3\t4\n")
    sizes = Chromsizes([("c1", 1000)])
    two = PairTileset.from_bedpe(spark, p, sizes, tile_size=128)
    assert [r["fields"][6] for r in two.tiles(["u.3.0.1"])[0][1]] == ["straddle"] and len(two.tiles(["u.0.0.0"])[0][1]) == 3
    for policy, want in ((LinkPolicy.BOTH, {"near"}), (LinkPolicy.EITHER, {"near", "straddle"}), (LinkPolicy.HULL, {"near", "spanner", "straddle"})):
        one = LinkTileset.from_bedpe(spark, p, sizes, tile_size=128, links=policy)
        assert {r["fields"][6] for r in one.tiles(["u.3.1"])[0][1]} == want


def test_reads_tiles(spark, put):
    sam = put("r.sam", "r1\t99\tc1\t10\t60\t4M1X3M\t=\t1\t1\tAAACGTAC\t*\tMD:Z:4T3\nr2\t256\tc1\t10\t60\t8M\t=\t1\t1\tAAACGTAC\t*\n")
    t = ReadsTileset.from_sam(spark, sam, SIZES)
    tile, none = (p for _, p in t.tiles(["u.0.0", "u.3.4"]))
    assert tile["id"] == ["r1_1"] and tile["start"] == [9] and tile["variants"][0][0]["ref"] == "T" and {len(v) for v in tile.values()} == {1} and {len(v) for v in none.values()} == {0}


def test_signal_tiles(spark, put):
    g = put("s.bg", "c1 0 10 2\nc1 10 30 5\nc2 0 1500 1\n")
    t = SignalTileset.from_bedgraph(spark, g, SIZES, tile_size=64)
    z = t.info().max_zoom
    for mode, n in (("mean", 1), ("minMax", 2), ("whisker", 4)):
        for where in (f"u.0.0.{mode}", f"u.{z}.0.{mode}", f"u.{z}.{(4500 // 64)}.{mode}"):
            assert len(decode_dense(t.tiles([where])[0][1])) == 64 * n
    first = decode_dense(t.tiles([f"u.{z}.0"])[0][1])
    assert first[:10].tolist() == [2] * 10 and first[10:30].tolist() == [5] * 20 and first[30] == 0
    last = decode_dense(t.tiles([f"u.{z}.{4500 // 64}"])[0][1])
    assert last[4499 % 64] == 1 and np.isnan(last[4500 % 64])


def test_stores_round_trip(spark, put, tmp_path):
    bed = put("b.bed", "".join(f"c{1 + i % 2}\t{i * 7}\t{i * 7 + 9}\tn{i}\t{i}\n" for i in range(150)))
    sizes = put("sizes", "c1\t3000\nc2\t1500\n")
    cli.main(["aggregate", "bedfile", bed, "--output", str(tmp_path / "o"), "--chromsizes", sizes, "--importance-column", "5", "--max-per-tile", "4", "--tile-size", "256"])
    data, info = stores.read_store(spark, str(tmp_path / "o"))
    t = StoredTileset(spark, data, info)
    shown = {z: {r["uid"] for x in range(1 << z) for _, p in t.tiles([f"u.{z}.{x}"]) for r in p} for z in range(info.max_zoom + 1)}
    assert len(shown[0]) == 4 and all(shown[z] <= shown[z + 1] for z in range(info.max_zoom))
    top = {r["fields"][4] for r in t.tiles(["u.0.0"])[0][1]}
    assert top == {"149", "148", "147", "146"}
    cli.main(["aggregate", "bedgraph", put("g.bg", "c1 0 100 1\nc2 0 50 2\n"), "--output", str(tmp_path / "g"), "--chromsizes", sizes, "--zoom-step", "2", "--tile-size", "64"])
    levels = {r[0]: r[1] for r in stores.read_store(spark, str(tmp_path / "g"))[0].groupBy("level").sum("total").collect()}
    assert set(levels.values()) == {200.0} and len(levels) > 2


def test_vector_and_matrix_stores(spark, put, tmp_path):
    v = put("v.bed", "".join(f"c1\t{i * 100}\t{i * 100 + 100}\t{i}\t{2 * i}\n" for i in range(30)))
    cli.main(["convert", "bedfile_to_multivec", v, "--output", str(tmp_path / "v"), "--chromsizes", put("sizes", "c1\t3000\nc2\t1500\n"), "--base-resolution", "100", "--num-rows", "2", "--tile-size", "8"])
    data, info = stores.read_store(spark, str(tmp_path / "v"))
    t = VectorTileset(spark, data, info, 2)
    z = len(info.resolutions) - 1
    tile = decode_dense(t.tiles([f"u.{z}.1"])[0][1]).reshape(2, 8)
    assert tile[0].tolist() == list(range(8, 16)) and tile[1].tolist() == [2 * i for i in range(8, 16)]
    both = decode_dense(t.tiles([f"u.{z}.1"], {"aggGroups": [[0, 1], 1], "aggFunc": "mean"})[0][1]).reshape(2, 8)
    assert both[0].tolist() == [1.5 * i for i in range(8, 16)]
    with pytest.raises(MalformedTileId):
        t.tiles([f"u.{z}.1"], {"aggGroups": [[9]], "aggFunc": "mean"})
    cli.main(["convert", "tsv_to_mrmatrix", put("m.tsv", "x\t" + "\t".join(map(str, range(8))) + "\n" + "".join(f"r{i}\t" + "\t".join(map(str, range(8))) + "\n" for i in range(8))), "--output", str(tmp_path / "m")])
    assert stores.read_store(spark, str(tmp_path / "m"))[0].count() == 64


def test_contact_tiles(spark, tmp_path):
    px = spark.createDataFrame([(0, 0, 4), (0, 1, 2), (1, 3, 5), (3, 3, 1)], "bin1_id long, bin2_id long, count long")
    sizes = Chromsizes([("c1", 300), ("c2", 100)])
    stores.pixels_to_store(px, str(tmp_path / "c"), [100, 200], 100, sizes)
    data, info = stores.read_store(spark, str(tmp_path / "c"))
    info = TilesetInfo(**{**vars(info), "tile_size": 3})
    t = ContactTileset(spark, data, None, info)
    tile = decode_dense(t.tiles(["u.1.0.0.none"])[0][1]).reshape(3, 3)
    assert tile.tolist() == [[4, 2, 0], [2, 0, 0], [0, 0, 0]]
    edge = decode_dense(t.tiles(["u.1.1.0"])[0][1]).reshape(3, 3)
    assert edge[1, 0] == 5 and np.isnan(edge[:, 1:]).all()


def test_scan_limit(spark, put):
    from tilewright.model.errors import TileTooLarge

    bed = put("b.bed", "c1\t1\t2\n" * 50)
    with pytest.raises(TileTooLarge):
        AnnotationTileset.from_bed(spark, bed, SIZES, TilePolicy(max_scan_bytes=10)).tiles(["u.0.0"])
    assert AnnotationTileset.from_bed(spark, bed, SIZES).tiles(["u.0.0"])[0][1]


def test_too_many_contigs_are_refused(spark, put, monkeypatch):
    fai = put("a.fai", "c1\t10\t4\t60\t61\nc2\t20\t30\t60\t61\nc3\t5\t90\t60\t61\n")
    vcf = put("a.vcf", "".join(f"##contig=<ID=c{k},length={k}>\n" for k in (3, 1, 2)))
    gff = put("a.gff", "".join(f"c{k}\ts\tregion\t1\t{k}0\t.\t+\t.\tID=r{k}\n" for k in (3, 1, 2)))
    ways = [lambda: text.read_fai(spark, fai), lambda: text.vcf_chromsizes(spark, vcf), lambda: text.gff_chromsizes(text.read_gff(spark, gff))]
    monkeypatch.setattr(text, "MOST", 3)
    assert [w().names for w in ways] == [("c1", "c2", "c3"), ("c3", "c1", "c2"), ("c1", "c2", "c3")]
    monkeypatch.setattr(text, "MOST", 2)
    for w in ways:
        with pytest.raises(ValueError, match="more than 2 contigs"):
            w()


def test_rows_of_tiles_are_what_tiles_show(spark, put):
    def same(t, ids):
        keep = lambda r: {k: v for k, v in r.asDict().items() if k != "tile" and v is not None}
        got = sorted(((r["tile"], keep(r)) for r in t.rows(ids).collect()), key=repr)
        assert got == sorted(((i, r) for i, p in t.tiles(ids) for r in p), key=repr)
        return len(got)

    bed = put("b.bed", "".join(f"c1\t{i * 10}\t{i * 10 + 15}\tn{i}\n" for i in range(200)) + "cX\t1\t2\n")
    t = AnnotationTileset.from_bed(spark, bed, SIZES, TilePolicy(max_records=5, max_scan_bytes=None), tile_size=512)
    assert same(t, ["u.0.0", "u.4.1", "v.4.1", "u.4.7", "u.0.0"]) == 20 and t.rows([]).count() == 0
    with pytest.raises(TileOutOfBounds):
        t.rows(["u.0.0", "u.4.99"])
    with pytest.raises(MalformedTileId):
        t.rows(["u.0"])
    with pytest.raises(TileTooLarge):
        AnnotationTileset.from_bed(spark, bed, SIZES, TilePolicy(max_scan_bytes=10)).rows(["u.0.0"])
    p, sizes = put("p.bedpe", "c1\t10\t20\tc1\t180\t190\ta\nc1\t10\t20\tc1\t300\t310\tb\nc1\t140\t150\tc1\t200\t210\tc\n"), Chromsizes([("c1", 1000)])
    assert same(PairTileset.from_bedpe(spark, p, sizes, tile_size=128), ["u.3.0.1", "u.0.0.0"]) == 4
    assert [same(LinkTileset.from_bedpe(spark, p, sizes, tile_size=128, links=k), ["u.3.1"]) for k in (LinkPolicy.BOTH, LinkPolicy.EITHER, LinkPolicy.HULL)] == [1, 2, 3]
    stored = spark.createDataFrame([("a", 0, 0, 10), ("b", 1, 5, 9), ("c", 1, 600, 700)], "uid string, zoom_level int, x_start long, x_end long")
    assert same(StoredTileset(spark, stored, TilesetInfo.quadtree(SIZES, 512)), ["u.0.0", "u.1.0"]) == 4


def test_variants_of_a_tile_stay_with_the_executors(spark, con, monkeypatch):
    def refused(*_):
        raise AssertionError("records came to the driver")

    monkeypatch.setattr(AnnotationTileset, "grouped", refused)
    df = files.vcf_tiles(spark, SMALL)
    assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    assert differences(df, con, files.SQL["vcf_tiles"]) == ""
