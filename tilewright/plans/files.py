"""Queries of the readers, stores and tilesets: files are written from the test tables, read and served, and compared with SQL over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.encode import decode_dense
from tilewright.model.info import TilesetInfo
from tilewright.model.policies import LinkPolicy, TilePolicy
from tilewright.operators import genes
from tilewright.plans.genome import _LINK_LIST, _LINKS, _PARENTED, _PLACED, _islands, chromsizes, contigs, links, placed
from tilewright.plans.signals import _PIXELS, _READS, _SEQ, _SIGNAL, _VECTORS, _halved, _vectors, aligned, pixels, sequences, values
from tilewright.runtime import shared_folder, table
from tilewright.sources import stores, text
from tilewright.tilesets import dense, more, records

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}-{name}"


def written(lines: DataFrame, name: str, head: list[str] | None = None, **options) -> str:
    """The path of text files with these lines (one column); ``head``: a file of header lines beside them."""
    path = folder(lines.sparkSession, name)
    if head:
        lines.sparkSession.createDataFrame([(h,) for h in head], "value string").coalesce(1).write.options(**options).text(path)
    lines.toDF("value").write.mode("append").options(**options).text(path)
    return path


def tabbed(*columns: Column | str) -> Column:
    """Columns as the fields of a line; nulls are empty."""
    return F.concat_ws("\t", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns])


def cells_of(spark: SparkSession, tiles: list[tuple[str, object]]) -> DataFrame:
    """(tile, i, value): the cells of dense payloads; NaN stays NaN."""
    rows = [(i, k, float(v)) for i, p in tiles for k, v in enumerate(decode_dense(p))]
    return spark.createDataFrame(rows, "tile string, i int, value double")


# ------------------------------------------------------------------------------------------- readers


@query("""SELECT chrom, start - 1 AS start, "end", type || chr(9) || row_id AS rest FROM basegffentity WHERE chrom IS NOT NULL""")
def read_bed(spark, d):
    """Compressed, with header and comment lines and carriage returns."""
    g = table(spark, d, "basegffentity").where("chrom is not null")
    line = F.concat(tabbed("chrom", F.col("start") - 1, "end", "type", "row_id"), F.when(F.col("row_id") % 5 == 0, "\r").otherwise(""))
    return text.read_bed(spark, written(g.select(line), "bed", ["track name=x", "# comment", "chrom\tstart\tend", ""], compression="gzip"))


@query(f"WITH {_LINKS} SELECT chrom1, start1, end1, chrom2, start2, end2, l_orderkey || chr(9) || l_linenumber AS rest FROM links")
def read_bedpe(spark, d):
    line = tabbed("chrom1", "start1", "end1", "chrom2", "start2", "end2", "l_orderkey", "l_linenumber")
    return text.read_bedpe(spark, written(links(spark, d).select(line), "bedpe"))


def _gff_lines(spark, d) -> DataFrame:
    g = table(spark, d, "basegffentity")
    own = F.concat(F.lit("ID="), F.replace(F.url_encode("id"), F.lit("+"), F.lit("%20")))
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return g.select(tabbed(dot("chrom"), F.lit("src"), dot("type"), "start", "end", dot("score"), dot("strand"), dot("phase"), F.concat_ws(";", F.concat(F.lit("row="), "row_id"), own)))


@query("""SELECT type, nullif(id, '') AS id, chrom, start, "end", coalesce(strand, '.') AS strand, score, phase, CAST(row_id AS VARCHAR) AS row FROM basegffentity""")
def read_gff(spark, d):
    """GFF3 with escaped ids; tags that are no id are left in the attributes."""
    g = text.read_gff(spark, written(_gff_lines(spark, d), "gff3", ["##gff-version 3"]))
    return g.select("type", "id", "chrom", "start", "end", "strand", "score", "phase", F.regexp_extract("attributes", "row=([0-9]+)", 1).alias("row"))


@query("SELECT chrom, len FROM chromsizes WHERE len > 0")
def gff_contigs(spark, d):
    """Contigs of region features."""
    c = chromsizes(spark, d).where("len > 0")
    g = text.read_gff(spark, written(c.select(tabbed("chrom", F.lit("s"), F.lit("region"), F.lit(1), "len", F.lit("."), F.lit("."), F.lit("."), F.concat(F.lit("ID="), "chrom"))), "gff3"))
    return text.gff_chromsizes(g).frame(spark).select("chrom", "len")


def _vcf(spark, d, **options) -> str:
    li = table(spark, d, "lineitem")
    info = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("AC=1;END="), (F.col("l_partkey") + 100).cast("string"))).otherwise("AC=1;XEND=5")
    ids = F.when(F.col("l_linenumber") % 3 == 0, ".").otherwise(F.concat(F.lit("rs"), "l_orderkey", F.lit(";ln"), "l_linenumber"))
    ref = F.repeat(F.lit("A"), F.col("l_quantity").cast("int"))
    alt = F.when(F.col("l_suppkey") % 4 == 0, ".").otherwise("T,C")
    line = tabbed(F.concat(F.lit("p"), F.col("l_partkey") % 4), F.col("l_partkey") + 1, ids, ref, alt, F.when(F.col("l_linenumber") == 1, ".").otherwise(F.col("l_quantity").cast("string")), F.lit("PASS"), info, F.lit("GT"), F.lit("0/1"))
    return written(li.select(line), "vcf", ["##fileformat=VCFv4.2", "##contig=<ID=p1,length=900000>", "##contig=<ID=p0,length=800000>", "##contig=<ID=p2,length=700000,assembly=x>", "##contig=<ID=p3,length=600000>", "#CHROM\tPOS\tID"], **options)


_VCF = """
v AS (SELECT 'p' || (l_partkey % 4) AS chrom, l_partkey + 1 AS pos, CASE WHEN l_linenumber % 3 = 0 THEN [] ELSE ['rs' || l_orderkey, 'ln' || l_linenumber] END AS ids,
  repeat('A', CAST(l_quantity AS INTEGER)) AS ref, CASE WHEN l_suppkey % 4 = 0 THEN [] ELSE ['T', 'C'] END AS alts, CASE WHEN l_linenumber <> 1 THEN l_quantity END AS qual, ['PASS'] AS filters,
  CASE WHEN l_linenumber % 2 = 0 THEN l_partkey + 100 ELSE l_partkey + CAST(l_quantity AS BIGINT) END AS "end" FROM lineitem)"""


@query(f"WITH {_VCF} SELECT * FROM v")
def read_vcf(spark, d):
    return text.read_vcf(spark, _vcf(spark, d))


@query("SELECT * FROM (VALUES (0, 'p1', 900000), (1, 'p0', 800000), (2, 'p2', 700000), (3, 'p3', 600000)) v(cid, chrom, len)")
def vcf_contigs(spark, d):
    """In the order of the header."""
    return text.vcf_chromsizes(spark, _vcf(spark, d)).frame(spark).select("cid", "chrom", F.col("len").cast("int").alias("len"))


def _sam(spark, d) -> str:
    seq = F.expr("translate(substr(md5(cast(l_orderkey as string)), 1, 16), '0123456789abcdef', 'ACGTACGTACGTACGT')")
    line = tabbed("qname", "flag", F.concat(F.lit("p"), F.col("l_linenumber") % 3), "pos", F.lit(60), "cigar", F.lit("*"), F.lit(0), F.lit(0), seq, F.lit("*"), F.concat(F.lit("NM:i:1\tHP:i:"), F.col("l_linenumber")), F.concat(F.lit("MD:Z:"), "l_suppkey"))
    return written(aligned(spark, d).select(line), "sam", ["@HD\tVN:1.6", "@SQ\tSN:p0\tLN:900000"])


@query(f"""WITH {_READS} SELECT qname, flag, 'p' || (l_linenumber % 3) AS chrom, pos, 60 AS mapq, cigar, translate(substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 16), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq,
  CAST(l_suppkey AS VARCHAR) AS md, l_linenumber AS hp, pos + 2 * q + l_suppkey % 5 + 1 + l_partkey % 7 + 1 - 1 AS "end" FROM rd""")
def read_sam(spark, d):
    return text.read_sam(spark, _sam(spark, d))


def _fasta(spark, d, chunk: int) -> DataFrame:
    """Sequences of several lines with misleading headers, one record a line of the table."""
    s = sequences(spark, d).select("p_partkey", F.repeat("seq", (F.col("p_partkey") % 5 + 1).cast("int")).alias("s"))
    body = F.regexp_replace("s", "(.{10})", "$1\n")
    return text.read_fasta(spark, written(s.select(F.concat(F.lit(">p"), "p_partkey", F.lit(" 5'->3' strand >x\n"), body)), "fa"), chunk)


_FASTA = f"fa AS (SELECT 'p' || p_partkey AS chrom, repeat({_SEQ}, CAST(p_partkey % 5 + 1 AS INTEGER)) AS s FROM part)"


@query(f"WITH {_FASTA} SELECT chrom, CAST(k AS INTEGER) AS chunk_no, substr(s, CAST(k * 32 + 1 AS BIGINT), 32) AS seq FROM (SELECT *, unnest(range((len(s) - 1) // 32 + 1)) AS k FROM fa)")
def read_fasta(spark, d):
    return _fasta(spark, d, 32)


@query(f"WITH {_FASTA} SELECT chrom, CAST(len(s) AS BIGINT) AS len FROM fa")
def fasta_lengths(spark, d):
    return text.fasta_lengths(_fasta(spark, d, 32))


@query(f"WITH {_FASTA} SELECT chrom, substr(s, 21, 50) AS seq FROM fa")
def fasta_slices(spark, d):
    """Bases 20 to 70 of every sequence, short at its end."""
    chunks = _fasta(spark, d, 32)
    wanted = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("chrom"), F.lit(20).alias("start"), F.lit(70).alias("end"))
    return text.read_slices(chunks, wanted, 32).select("chrom", "seq")


def _bedgraph(spark, d) -> str:
    v = values(spark, d)
    return written(v.select(F.concat_ws(" ", F.regexp_replace("chrom", r"\s", "_"), "start", "end", F.coalesce(F.col("value").cast("string"), F.lit("NA")))), "bg", ["track type=bedGraph"])


@query(rf"""WITH {_SIGNAL} SELECT regexp_replace(chrom, '\s', '_', 'g') AS chrom, lo AS start, hi AS "end", coalesce(value, 'NaN'::DOUBLE) AS value FROM sig""")
def read_bedgraph(spark, d):
    return text.read_bedgraph(spark, _bedgraph(spark, d))


@query(rf"""WITH {_SIGNAL} SELECT regexp_replace(chrom, '\s', '_', 'g') AS chrom, lo AS start, hi + 1 AS "end", CAST(lo AS DOUBLE) AS value FROM sig""")
def read_bedgraph_closed(spark, d):
    """Ends included, and the start as the value column."""
    return text.read_bedgraph(spark, _bedgraph(spark, d), closed=True, columns=(0, 1, 2, 1))


@query("""SELECT 'c' AS chrom, p_partkey * 10 AS start, p_partkey * 10 + 10 AS "end", [CAST(p_size AS DOUBLE), p_retailprice,
  CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS DOUBLE) ELSE 'NaN'::DOUBLE END, 'NaN'::DOUBLE] AS values FROM part""")
def read_vectors(spark, d):
    """Two files of two columns side by side; the second lacks every other interval and its last column."""
    p = table(spark, d, "part")
    at = [F.lit("c"), F.col("p_partkey") * 10, F.col("p_partkey") * 10 + 10]
    a = written(p.select(tabbed(*at, "p_size", "p_retailprice")), "bed")
    b = written(p.where("p_partkey % 2 = 0").select(tabbed(*at, "p_partkey", F.lit("NA"))), "bed")
    return text.read_vectors(spark, [a, b], 2)


@query("""SELECT CAST(n_nationkey AS DOUBLE) AS min_lng, CAST(-n_regionkey - 1 AS DOUBLE) AS min_lat, CAST(n_nationkey + 2.5 AS DOUBLE) AS max_lng, CAST(n_regionkey AS DOUBLE) AS max_lat, n_name AS name FROM nation""")
def read_geojson(spark, d):
    n = table(spark, d, "nation")
    shape = '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[%s,%s],[%s.5,%s],[%s,-%s],[%s,%s]]]},"properties":{"name":"%s"}}'
    x, y = F.col("n_nationkey"), F.col("n_regionkey")
    feature = F.format_string(shape, x, y, x + 2, y, x, y + 1, x, y, "n_name")
    whole = n.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list(feature), ","), F.lit("]}")))  # nations are few
    g = text.read_geojson(spark, written(whole, "json"))
    return g.select("min_lng", "min_lat", "max_lng", "max_lat", F.get_json_object("properties", "$.name").alias("name"))


@query("SELECT o_totalprice AS x, CAST(o_orderkey AS DOUBLE) AS y FROM orders")
def read_points(spark, d):
    path = folder(spark, "csv")
    table(spark, d, "orders").select("o_orderstatus", F.col("o_orderkey").alias("b"), F.col("o_totalprice").alias("a")).write.option("header", True).csv(path)
    return text.read_points(spark, path, "a", "b")


@query(f"SELECT {_SEQ} AS seq FROM part")
def read_sequences(spark, d):
    path = folder(spark, "csv")
    sequences(spark, d).write.option("header", True).csv(path)
    return text.read_sequences(spark, path, 2)


@query("""SELECT n_nationkey AS row, CAST(col AS INTEGER) AS col, CASE WHEN (n_nationkey + col) % 7 = 0 THEN 'NaN'::DOUBLE ELSE n_nationkey * 10.0 + col END AS value FROM nation, range(25) r(col) WHERE n_nationkey < 25""")
def read_matrix(spark, d):
    """A labelled square matrix with empty cells."""
    k = F.col("n_nationkey")
    cells = [F.when((k + j) % 7 != 0, (k * 10 + j).cast("string")) for j in range(25)]
    rows = table(spark, d, "nation").coalesce(1).orderBy(k).select(tabbed("n_name", *cells))
    head = spark.createDataFrame([("\t".join(["x", *map(str, range(25))]),)], "value string")
    one = head.unionByName(rows.toDF("value")).coalesce(1)
    m = text.read_matrix(spark, written(one, "tsv"))
    return m.select(F.col("row").cast("int").alias("row"), "col", "value")


@query("SELECT cid, chrom, len, chrom_offset FROM chromsizes")
def read_fai(spark, d):
    path = folder(spark, "fai")
    chromsizes(spark, d).select("chrom", "len", F.col("chrom_offset") * 2 + 7, F.lit(60), F.lit(61)).write.csv(path, sep="\t")
    return text.read_fai(spark, path).frame(spark)


_MODELS = f"""{_PARENTED}, {_islands('transcript_id')},
e AS (SELECT transcript_id, count(*) AS n, string_agg(CAST(lo AS VARCHAR), ',' ORDER BY lo, hi) AS s, string_agg(CAST(hi AS VARCHAR), ',' ORDER BY lo, hi) AS t FROM exons_transcript_id GROUP BY transcript_id),
c AS (SELECT transcript_id, min(lo) AS cds_lo, max(hi) AS cds_hi FROM part WHERE kind = 'CDS' GROUP BY transcript_id)"""


@query(f"""WITH {_MODELS} SELECT concat_ws(chr(9), t.transcript_id, g.chrom, coalesce(g.strand, '.'), t.lo, t.hi, coalesce(cds_lo, t.hi), coalesce(cds_hi, t.hi), coalesce(e.n, 1),
  coalesce(e.s, CAST(t.lo AS VARCHAR)) || ',', coalesce(e.t, CAST(t.hi AS VARCHAR)) || ',') AS line
FROM tx t JOIN gene g ON g.gene_id = t.parent LEFT JOIN e ON e.transcript_id = t.transcript_id LEFT JOIN c ON c.transcript_id = t.transcript_id""")
def gene_predictions(spark, d):
    return genes.gene_predictions(table(spark, d, "basegffentity"))


# --------------------------------------------------------------------------------- tilesets of records

_DEEP = 23  # the zoom levels of the test genome: 2^33 bases are 1,024 at the deepest
_SHOW = 20


def _tile_rows(spark, tiles, names: str) -> DataFrame:
    """(tile, names...) of record payloads; ``fields`` is tab-joined."""
    keys = [n.split()[0] for n in names.split(", ")]
    rows = [(i, *["\t".join(r[k]) if k == "fields" else r.get(k) for k in keys]) for i, p in tiles for r in p]
    return spark.createDataFrame(rows, f"tile string, {names}")


def _wanted(z: int) -> list[str]:
    return [f"u.{z}.{x}" for x in range(1 << z)]


def _best(source: str, z: int, order: str = "importance DESC, uid DESC") -> str:
    """SQL for the records (x_start, x_end) a tile of zoom ``z`` shows."""
    w = 1 << (33 - z)
    return f"""SELECT * FROM (SELECT *, 'u.{z}.' || x AS tile, row_number() OVER (PARTITION BY x ORDER BY {order}) AS _r
  FROM (SELECT *, unnest(range(x_start // {w}, (x_end - 1) // {w} + 1)) AS x FROM {source} WHERE x_end > x_start)) WHERE _r <= {_SHOW}"""


_HASHED = "md5(fields) AS uid, ('0x' || substr(md5(md5(fields)), 1, 8))::BIGINT / 4294967296.0 AS importance"


@query(f"""WITH b AS (SELECT *, {_HASHED} FROM (SELECT concat_ws(chr(9), chrom, start - 1, "end", type, row_id) AS fields, chrom_offset, chrom_offset + start - 1 AS x_start, chrom_offset + "end" AS x_end
  FROM basegffentity JOIN chromsizes USING (chrom)))
SELECT tile, uid, x_start AS "xStart", x_end AS "xEnd", chrom_offset AS "chrOffset", importance, fields FROM ({_best('b', 3)})""")
def bed_tiles(spark, d):
    g = table(spark, d, "basegffentity").where("chrom is not null")
    path = written(g.select(tabbed("chrom", F.col("start") - 1, "end", "type", "row_id")), "bed")
    t = records.AnnotationTileset.from_bed(spark, path, contigs(spark, d), TilePolicy(max_records=_SHOW, max_scan_bytes=None))
    return _tile_rows(spark, t.tiles(_wanted(3)), "uid string, xStart bigint, xEnd bigint, chrOffset bigint, importance double, fields string")


@query(f"""WITH {_PARENTED}, g AS (SELECT gene_id AS uid, CAST(hi - lo AS DOUBLE) AS importance, chrom_offset + lo AS x_start, chrom_offset + hi AS x_end FROM gene JOIN chromsizes USING (chrom))
SELECT tile, uid, x_start AS "xStart", x_end AS "xEnd", importance FROM ({_best('g', 3)})""")
def gene_tiles(spark, d):
    t = records.AnnotationTileset.from_genes(spark, table(spark, d, "basegffentity"), contigs(spark, d), TilePolicy(max_records=_SHOW, max_scan_bytes=None))
    return _tile_rows(spark, t.tiles(_wanted(3)), "uid string, xStart bigint, xEnd bigint, importance double")


@query(f"""WITH {_VCF}, o(chrom, off) AS (VALUES ('p1', 0), ('p0', 900000), ('p2', 1700000), ('p3', 2400000)),
r AS (SELECT concat_ws(chr(9), chrom, pos, CASE WHEN len(ids) = 0 THEN '.' ELSE array_to_string(ids, ';') END, ref, CASE WHEN len(alts) = 0 THEN '.' ELSE array_to_string(alts, ',') END,
  coalesce(CAST(qual AS VARCHAR), ''), 'PASS') AS fields, off + pos - 1 AS x_start, off + "end" AS x_end FROM v JOIN o USING (chrom)),
h AS (SELECT *, md5(fields) AS uid FROM r)
SELECT 'u.2.0' AS tile, uid, CAST(x_start AS BIGINT) AS "xStart", CAST(x_end AS BIGINT) AS "xEnd", fields FROM h WHERE x_start < 1048576 AND x_end > 0""")
def vcf_tiles(spark, d):
    """All variants of a tile of a compressed file, as no cap is set; they never come to the driver."""
    t = records.AnnotationTileset.from_vcf(spark, _vcf(spark, d, compression="gzip"), policy=TilePolicy(max_records=None, max_scan_bytes=None))
    return t.rows(["u.2.0"]).select("tile", "uid", "xStart", "xEnd", F.array_join("fields", "\t").alias("fields"))


_PAIR_CONTIGS = [("p0", 30_000_000), ("p1", 30_000_000), ("p2", 30_000_000), ("p3", 30_000_000)]
_ABS_LINKS = f"""{_LINKS}, ab AS (SELECT *, CAST(substr(chrom1, 2) AS BIGINT) * 30000000 + start1 AS xs, CAST(substr(chrom1, 2) AS BIGINT) * 30000000 + end1 AS xe,
  CAST(substr(chrom2, 2) AS BIGINT) * 30000000 + start2 AS ys, CAST(substr(chrom2, 2) AS BIGINT) * 30000000 + end2 AS ye, concat_ws(chr(9), {_LINK_LIST.replace('l_orderkey, l_linenumber, ', '')}, l_orderkey, l_linenumber) AS fields FROM links)"""


def _pairs(spark, d, kind, **more_):
    from tilewright.model.coords import Chromsizes

    path = written(links(spark, d).select(tabbed("chrom1", "start1", "end1", "chrom2", "start2", "end2", "l_orderkey", "l_linenumber")), "bedpe")
    return kind.from_bedpe(spark, path, Chromsizes(_PAIR_CONTIGS), TilePolicy(max_records=None, max_scan_bytes=None), **more_)


@query(f"""WITH {_ABS_LINKS} SELECT 'u.9.' || x || '.' || y AS tile, fields, xs AS "xStart", xe AS "xEnd", ys AS "yStart", ye AS "yEnd" FROM ab, (VALUES (0), (114)) a(x), (VALUES (114), (228)) b(y)
WHERE xs < (x + 1) * 262144 AND xe > x * 262144 AND ys < (y + 1) * 262144 AND ye > y * 262144""")
def bedpe_tiles_2d(spark, d):
    t = _pairs(spark, d, records.PairTileset)
    return _tile_rows(spark, t.tiles([f"u.9.{x}.{y}" for x in (0, 114) for y in (114, 228)]), "fields string, xStart bigint, xEnd bigint, yStart bigint, yEnd bigint")


def _link_tiles(spark, d, policy: LinkPolicy) -> DataFrame:
    t = _pairs(spark, d, records.LinkTileset, links=policy)
    return _tile_rows(spark, t.tiles(["u.9.0", "u.9.114"]), "fields string, xStart bigint, yStart bigint")


_LO, _HI = "t.x * 262144", "(t.x + 1) * 262144"
_MEETS_X, _MEETS_Y = f"(xs < {_HI} AND xe > {_LO})", f"(ys < {_HI} AND ye > {_LO})"
_LINK_TILES = f"""WITH {_ABS_LINKS} SELECT 'u.9.' || x AS tile, fields, xs AS "xStart", ys AS "yStart" FROM ab, (VALUES (0), (114)) t(x) WHERE """


@query(_LINK_TILES + f"{_MEETS_X} AND {_MEETS_Y}")
def link_tiles_both(spark, d):
    return _link_tiles(spark, d, LinkPolicy.BOTH)


@query(_LINK_TILES + f"({_MEETS_X} OR {_MEETS_Y})")
def link_tiles_either(spark, d):
    return _link_tiles(spark, d, LinkPolicy.EITHER)


@query(_LINK_TILES + f"CASE WHEN chrom1 = chrom2 THEN least(xs, ys) < {_HI} AND greatest(xe, ye) > {_LO} ELSE {_MEETS_X} OR {_MEETS_Y} END")
def link_tiles_hull(spark, d):
    return _link_tiles(spark, d, LinkPolicy.HULL)


@query(f"""WITH {_READS}, r AS (SELECT *, pos - 1 AS s, pos + 2 * q + l_suppkey % 5 + 1 + l_partkey % 7 + 1 - 1 AS e FROM rd WHERE l_linenumber % 3 = 1 AND flag & 2304 = 0)
SELECT 'u.14.' || x AS tile, CASE WHEN flag & 1 <> 0 THEN qname || CASE WHEN flag & 64 <> 0 THEN '_1' ELSE '_2' END ELSE qname END AS id, s AS start, e AS "end",
  CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand, l_linenumber AS hp, CAST(l_suppkey AS VARCHAR) AS md FROM r, range(4) t(x) WHERE s < (x + 1) * 1024 AND e > x * 1024""")
def reads_tiles(spark, d):
    """All primary reads of some tiles of one contig."""
    from tilewright.model.coords import Chromsizes

    t = records.ReadsTileset.from_sam(spark, _sam(spark, d), Chromsizes([("p1", 1 << 24)]))
    rows = [(i, *r) for i, p in t.tiles([f"u.14.{x}" for x in range(4)]) for r in zip(p["id"], p["start"], p["end"], p["strand"], p["hp"], p["md"])]
    return spark.createDataFrame(rows, "tile string, id string, start bigint, `end` bigint, strand string, hp int, md string")


@query(f"""WITH {_FASTA}, o AS (SELECT *, coalesce(sum(len(s)) OVER (ORDER BY CAST(substr(chrom, 2) AS BIGINT) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM fa WHERE CAST(substr(chrom, 2) AS BIGINT) < 100),
w AS (SELECT string_agg(s, '' ORDER BY off) AS g FROM o)
SELECT 'u.3.' || x AS tile, substr(g, CAST(x * 1024 + 1 AS BIGINT), 1024) AS sequence FROM w, range(8) t(x)""")
def sequence_tiles(spark, d):
    """The bases of the first hundred sequences, contig after contig."""
    from tilewright.model.coords import Chromsizes

    sizes = Chromsizes([(f"p{k}", 24 * (k % 5 + 1)) for k in range(100)])
    t = records.SequenceTileset(spark, _fasta(spark, d, 32), sizes, 32)
    return spark.createDataFrame([(i, p["sequence"]) for i, p in t.tiles(_wanted(3))], "tile string, sequence string")


# ------------------------------------------------------------------------------------ stores and their tiles


@query(f"""WITH {_PLACED} SELECT 'u.6.' || x AS tile, id, x_start AS "xStart", x_end AS "xEnd" FROM placed, range(4, 8) t(x) WHERE zoomLevel <= 6 AND x_start < (x + 1) * {1 << 27} AND x_end > x * {1 << 27}""")
def stored_tiles(spark, d):
    """A store by zoom level, sorted by position; a tile shows what is placed at its zoom or a coarser one."""
    path, sizes = folder(spark, "store"), contigs(spark, d)
    p = placed(spark, d).where("zoomLevel is not null and x_end > x_start").withColumns({"zoom_level": F.col("zoomLevel"), "uid": F.col("id").cast("string")})
    stores.write_store(p.select("uid", "zoom_level", "x_start", "x_end"), path, TilesetInfo.quadtree(sizes, 1024), "zoom_level", ["x_start", "x_end"])
    t = records.StoredTileset(spark, *stores.read_store(spark, path))
    rows = _tile_rows(spark, t.tiles([f"u.6.{x}" for x in range(4, 8)]), "uid string, xStart bigint, xEnd bigint")
    return rows.select("tile", F.col("uid").cast("bigint").alias("id"), "xStart", "xEnd")


@query(f"""WITH {_PLACED} SELECT 'u.2.' || x || '.' || y AS tile, id FROM placed, range(4) a(x), range(4) b(y)
WHERE zoomLevel <= 2 AND x_end > x_start AND y_end > y_start AND x_start < (x + 1) * {1 << 31} AND x_end > x * {1 << 31} AND y_start < (y + 1) * {1 << 31} AND y_end > y * {1 << 31}""")
def stored_tiles_2d(spark, d):
    path, sizes = folder(spark, "store"), contigs(spark, d)
    p = placed(spark, d).where("zoomLevel is not null and x_end > x_start and y_end > y_start").withColumns({"zoom_level": F.col("zoomLevel"), "uid": F.col("id").cast("string")})
    stores.write_store(p.select("uid", "zoom_level", "x_start", "x_end", "y_start", "y_end"), path, TilesetInfo.quadtree(sizes, 1024, ndim=2), "zoom_level", ["x_start", "y_start"])
    t = records.StoredPairTileset(spark, *stores.read_store(spark, path))
    rows = _tile_rows(spark, t.tiles([f"u.2.{x}.{y}" for x in range(4) for y in range(4)]), "uid string")
    return rows.select("tile", F.col("uid").cast("bigint").alias("id"))


_ABS_SIGNAL = f"{_SIGNAL}, sa AS (SELECT chrom_offset + lo AS lo, chrom_offset + hi AS hi, value FROM sig JOIN chromsizes USING (chrom))"
_BIN = 1 << 23  # bases of a bin of the tile at zoom 0


@query(f"""WITH {_ABS_SIGNAL}, h AS (SELECT bin, value, least(hi, (bin + 1) * {_BIN}) - greatest(lo, bin * {_BIN}) AS n FROM (SELECT *, unnest(range(lo // {_BIN}, (hi - 1) // {_BIN} + 1)) AS bin FROM sa WHERE value IS NOT NULL)),
s AS (SELECT bin, sum(value * n) / sum(n) AS mean, min(value) AS min, max(value) AS max FROM h GROUP BY bin),
total AS (SELECT CAST(sum(len) AS BIGINT) AS n FROM chromsizes),
c AS (SELECT mode, CAST(bin * k + j AS INTEGER) AS i, CASE WHEN bin * {_BIN} >= n THEN 'NaN'::DOUBLE ELSE coalesce(CASE j + off WHEN 0 THEN mean WHEN 1 THEN min ELSE max END, 0.0) END AS v
  FROM total, range(1024) b(bin) LEFT JOIN s USING (bin), (VALUES ('mean', 1, 0, 0), ('minMax', 2, 0, 1), ('minMax', 2, 1, 1)) m(mode, k, j, off))
SELECT 'u.0.0.' || mode AS tile, i, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 3) AS value FROM c""")
def signal_tiles(spark, d):
    """Means, and minima beside maxima, of the whole genome in one tile; NaN past its end and 0 in holes."""
    v = values(spark, d).join(chromsizes(spark, d), "chrom").select((F.col("chrom_offset") + F.col("start")).alias("x_start"), (F.col("chrom_offset") + F.col("end")).alias("x_end"), "value")
    t = dense.SignalTileset(spark, v, contigs(spark, d))
    return cells_of(spark, t.tiles(["u.0.0.mean", "u.0.0.minMax"])).withColumn("value", F.round("value", 3))


@query(f"""WITH {_ABS_SIGNAL}, l AS (SELECT bin, sum(value * n) AS total, sum(CASE WHEN value IS NULL THEN n ELSE 0 END) AS nan_bases, sum(n) AS bases
  FROM (SELECT *, least(hi, (bin + 1) * 1024) - greatest(lo, bin * 1024) AS n FROM (SELECT *, unnest(range(lo // 1024, (hi - 1) // 1024 + 1)) AS bin FROM sa)) GROUP BY bin),
all_levels AS (SELECT 0 AS level, bin, total, nan_bases, bases FROM l UNION ALL SELECT 1, bin // 256, sum(total), sum(nan_bases), sum(bases) FROM l GROUP BY bin // 256
  UNION ALL SELECT 2, bin // 65536, sum(total), sum(nan_bases), sum(bases) FROM l GROUP BY bin // 65536 UNION ALL SELECT 3, bin // 16777216, sum(total), sum(nan_bases), sum(bases) FROM l GROUP BY bin // 16777216)
SELECT level, bin, round(total + 1e-9, 4) AS total, CAST(nan_bases AS BIGINT) AS nan_bases, CAST(bases AS BIGINT) AS bases FROM all_levels""")
def bedgraph_store(spark, d):
    path = folder(spark, "store")
    stores.bedgraph_to_store(values(spark, d), contigs(spark, d), path, base=1024)
    data, _ = stores.read_store(spark, path)
    return data.select("level", "bin", F.round(F.col("total") + 1e-9, 4).alias("total"), "nan_bases", "bases")


@query(f"""WITH {_ABS_SIGNAL}, l AS (SELECT bin, sum(value * n) AS t, sum(CASE WHEN value IS NULL THEN n ELSE 0 END) AS m, sum(n) AS b
  FROM (SELECT *, least(hi, (bin + 1) * {_BIN}) - greatest(lo, bin * {_BIN}) AS n FROM (SELECT *, unnest(range(lo // {_BIN}, (hi - 1) // {_BIN} + 1)) AS bin FROM sa)) GROUP BY bin)
SELECT 'u.0.0' AS tile, CAST(bin AS INTEGER) AS i, round(CAST(CAST(coalesce(CASE WHEN b > m THEN t / (b - m) END, 'NaN'::DOUBLE) AS FLOAT) AS DOUBLE), 3) AS value FROM range(1024) r(bin) LEFT JOIN l USING (bin)""")
def stored_signal_tiles(spark, d):
    path = folder(spark, "store")
    stores.bedgraph_to_store(values(spark, d), contigs(spark, d), path, base=1024)
    t = more.StoredSignalTileset(spark, *stores.read_store(spark, path))
    return cells_of(spark, t.tiles(["u.0.0"])).withColumn("value", F.round("value", 3))


_GROUPED = f"{_VECTORS} {_halved('sum(value)', 6)}"


@query(f"WITH {_GROUPED} " + " UNION ALL ".join(f"SELECT chrom, row, {k} AS level, bin, round(value, 3) AS value FROM v{k} JOIN chromsizes USING (chrom)" for k in range(6)))
def vectors_store(spark, d):
    """Rows of copy number and segment at doubling resolutions, the first six of them."""
    v = _vectors(spark, d).join(chromsizes(spark, d).select("chrom"), "chrom")
    wide = v.groupBy("chrom", "bin").pivot("row", [0, 1]).agg(F.first("value"))
    path = folder(spark, "store")
    stores.vectors_to_store(wide.select("chrom", (F.col("bin") * 10_000).alias("start"), F.array("0", "1").alias("values")), contigs(spark, d), path, 10_000)
    data, _ = stores.read_store(spark, path)
    return data.where("level < 6 and value is not null and not isnan(value)").select("chrom", F.col("row").cast("int").alias("row"), "level", "bin", F.round("value", 3).alias("value"))


@query("""WITH v AS (SELECT p_partkey // 3 AS bin, CAST(p_partkey % 3 AS INTEGER) AS row, p_size AS value FROM part WHERE p_partkey < 192)
SELECT 'u.1.' || x AS tile, CAST(r * 32 + b AS INTEGER) AS i, CAST(coalesce(value, 0) AS DOUBLE) AS value FROM range(2) t(x), range(3) g(r), range(32) c(b) LEFT JOIN v ON v.bin = x * 32 + b AND v.row = r""")
def vector_tiles(spark, d):
    """Both tiles of the finest level of a contig of 64 bins with three rows."""
    from tilewright.model.coords import Chromsizes

    p = table(spark, d, "part").where("p_partkey < 192")
    rows = p.select(F.lit(0).alias("level"), F.lit("c").alias("chrom"), F.floor(F.col("p_partkey") / 3).alias("bin"), (F.col("p_partkey") % 3).cast("int").alias("row"), F.col("p_size").cast("double").alias("value"))
    info = TilesetInfo(tile_size=32, resolutions=(10, 20), chromsizes=(("c", 640),))
    assert Chromsizes(info.chromsizes).total_length == 640
    return cells_of(spark, dense.VectorTileset(spark, rows, info, 3).tiles(["u.1.0", "u.1.1"]))


@query(f"""WITH {_PIXELS}, w AS (SELECT bin_id, 1 / sqrt(sum(c)) AS weight FROM (SELECT bin1_id AS bin_id, "count" AS c FROM px UNION ALL SELECT bin2_id, "count" FROM px) GROUP BY bin_id),
s AS (SELECT bin1_id AS a, bin2_id AS b, "count" AS c FROM px UNION ALL SELECT bin2_id, bin1_id, "count" FROM px WHERE bin1_id <> bin2_id),
v AS (SELECT a, b, c, c * p.weight * q.weight AS balanced FROM s JOIN w p ON p.bin_id = a JOIN w q ON q.bin_id = b)
SELECT 'u.0.1.0.' || kind AS tile, CAST(y * 200 + x AS INTEGER) AS i,
  round(CAST(CAST(CASE WHEN x + 200 >= 256 OR kind = 'default' AND (wy.weight IS NULL OR wx.weight IS NULL) THEN 'NaN'::DOUBLE ELSE coalesce(CASE kind WHEN 'none' THEN c ELSE balanced END, 0) END AS FLOAT) AS DOUBLE), 6) AS value
FROM (VALUES ('none'), ('default')) k(kind), range(200) r(y), range(200) t(x) LEFT JOIN v ON a = y AND b = x + 200
LEFT JOIN w wy ON wy.bin_id = y LEFT JOIN w wx ON wx.bin_id = x + 200""")
def contact_tiles(spark, d):
    """Counts and balanced contacts of a tile that the matrix does not fill."""
    path, px = folder(spark, "store"), pixels(spark, d)
    from tilewright.model.coords import Chromsizes

    stores.pixels_to_store(px, path, [1000], 1000, Chromsizes([("c", 256_000)]))
    data, info = stores.read_store(spark, path)
    info = TilesetInfo(tile_size=200, resolutions=info.resolutions, chromsizes=info.chromsizes)
    t = dense.ContactTileset(spark, data, spark.read.parquet(f"{path}/weights"), info)
    return cells_of(spark, t.tiles(["u.0.1.0.none", "u.0.1.0.default"])).withColumn("value", F.round("value", 6))


@query(f"""WITH {_PIXELS} SELECT r AS resolution, bin1_id // (r // 1000) AS bin1_id, bin2_id // (r // 1000) AS bin2_id, CAST(sum("count") AS BIGINT) AS "count" FROM px, (VALUES (1000), (4000), (16000)) l(r) GROUP BY ALL""")
def contacts_store(spark, d):
    from tilewright.model.coords import Chromsizes

    path = folder(spark, "store")
    stores.pixels_to_store(pixels(spark, d), path, [1000, 4000, 16_000], 1000, Chromsizes([("c", 256_000)]))
    return stores.read_store(spark, path)[0].select("resolution", "bin1_id", "bin2_id", "count")


@query("""WITH m AS (SELECT vec_id AS row, unnest(range(len(embedding))) AS col, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings WHERE vec_id < 64),
h AS (SELECT row // 2 AS row, col // 2 AS col, sum(value) AS value FROM m GROUP BY ALL)
SELECT 'u.0.0.0' AS tile, CAST(r * 48 + c AS INTEGER) AS i, round(CAST(CAST(coalesce(value, 'NaN'::DOUBLE) AS FLOAT) AS DOUBLE), 3) AS value FROM range(48) a(r), range(48) b(c) LEFT JOIN h ON h.row = r AND h.col = c""")
def matrix_tiles(spark, d):
    """The coarse level of a stored square matrix, NaN outside."""
    e = table(spark, d, "embeddings").where("vec_id < 64")
    m = e.select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "value")).withColumn("value", F.col("value").cast("double"))
    path = folder(spark, "store")
    stores.matrix_to_store(m, path, 64, 48)
    return cells_of(spark, more.MatrixTileset(spark, *stores.read_store(spark, path)).tiles(["u.0.0.0"])).withColumn("value", F.round("value", 3))


@query("""WITH e AS (SELECT min(o_totalprice) AS x0, min(CAST(o_orderkey AS DOUBLE)) AS y0, greatest(max(o_totalprice) - min(o_totalprice), CAST(max(o_orderkey) - min(o_orderkey) AS DOUBLE)) AS w FROM orders),
n AS (SELECT CAST(least(floor((o_totalprice - x0) / (w / 128)), 127) AS BIGINT) AS i, CAST(least(floor((CAST(o_orderkey AS DOUBLE) - y0) / (w / 128)), 127) AS BIGINT) AS j, count(*) AS n FROM orders, e GROUP BY ALL)
SELECT 'u.1.' || x || '.0' AS tile, CAST(r * 64 + c AS INTEGER) AS i, coalesce(CAST(n AS DOUBLE), 'NaN'::DOUBLE) AS value FROM range(2) t(x), range(64) a(r), range(64) b(c) LEFT JOIN n ON n.j = r AND n.i = x * 64 + c""")
def density_tiles(spark, d):
    o = table(spark, d, "orders").select(F.col("o_totalprice").alias("x"), F.col("o_orderkey").cast("double").alias("y"))
    return cells_of(spark, more.DensityTileset(spark, o, bins=64).tiles(["u.1.0.0", "u.1.1.0"]))


@query("""SELECT 'u.3.' || (p_partkey // 25) AS tile, p_partkey AS x, p_name AS label FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey // 25 ORDER BY p_retailprice DESC, p_partkey DESC) AS r
  FROM part WHERE p_partkey < 200) WHERE r <= 25""")
def label_tiles(spark, d):
    labels = table(spark, d, "part").where("p_partkey < 200").select(F.col("p_partkey").alias("index"), F.col("p_name").alias("label"), F.col("p_retailprice").alias("importance"))
    t = more.LabelTileset(spark, labels, 200, 25)
    return spark.createDataFrame([(i, r["x"], r["label"]) for i, p in t.tiles(_wanted(3)) for r in p], "tile string, x bigint, label string")


_GEO_LNG, _GEO_LAT = "(o_orderkey * 7919 % 36000) / 100.0 - 180", "(o_orderkey * 104729 % 16000) / 100.0 - 80"


@query(f"""WITH f AS (SELECT o_orderkey, {_GEO_LNG} AS x0, {_GEO_LAT} AS y0, o_orderkey % 7 AS zoom_level FROM orders),
t AS (SELECT x, y, x / 8.0 * 360 - 180 AS w, (x + 1) / 8.0 * 360 - 180 AS e, degrees(atan(exp(radians(180.0 - y / 8.0 * 360))) * 2 - pi() / 2) AS n, degrees(atan(exp(radians(180.0 - (y + 1) / 8.0 * 360))) * 2 - pi() / 2) AS s FROM range(2, 4) a(x), range(8) b(y))
SELECT 'u.3.' || x || '.' || y AS tile, o_orderkey FROM f, t WHERE zoom_level <= 3 AND x0 <= e AND x0 + 1.5 >= w AND y0 <= n AND y0 + 0.75 >= s""")
def geo_tiles(spark, d):
    """Boxes on the map in two columns of tiles, those placed at their zoom or a coarser one."""
    x, y = F.expr(_GEO_LNG).cast("double"), F.expr(_GEO_LAT).cast("double")
    f = table(spark, d, "orders").select("o_orderkey", x.alias("min_lng"), y.alias("min_lat"), (x + 1.5).alias("max_lng"), (y + 0.75).alias("max_lat"), (F.col("o_orderkey") % 7).cast("int").alias("zoom_level"))
    tiles = more.GeoTileset(spark, f).tiles([f"u.3.{i}.{j}" for i in (2, 3) for j in range(8)])
    return spark.createDataFrame([(i, r["o_orderkey"]) for i, p in tiles for r in p], "tile string, o_orderkey bigint")


@query(f"""WITH s AS (SELECT CAST(pos AS INTEGER) AS pos, substr({_SEQ}, CAST(pos AS INTEGER) + 1, 1) AS base FROM part, range(24) r(pos)), c AS (SELECT pos, base, count(*) AS n FROM s WHERE base IN ('A', 'C', 'G', 'T') GROUP BY ALL),
w AS (SELECT pos, base, n / sum(n) OVER (PARTITION BY pos) AS w FROM c)
SELECT 'u.0.0' AS tile, CAST(r * 32 + p AS INTEGER) AS i, round(CAST(CAST(CASE WHEN p >= 24 THEN 'NaN'::DOUBLE ELSE coalesce(w, 0) END AS FLOAT) AS DOUBLE), 5) AS value
FROM (VALUES (0, 'A'), (1, 'C'), (2, 'G'), (3, 'T')) l(r, base), range(32) q(p) LEFT JOIN w ON w.pos = p AND w.base = l.base""")
def logo_tiles(spark, d):
    return cells_of(spark, more.LogoTileset(spark, sequences(spark, d), 24, tile_size=32).tiles(["u.0.0"])).withColumn("value", F.round("value", 5))


@query("""SELECT 'u.' || z || '.' || x || '.' || y AS tile, n_name AS image FROM nation, (VALUES (1, 0, 0), (1, 1, 0), (1, 0, 1), (0, 0, 0)) t(z, x, y) WHERE n_nationkey = z * 4 + x * 2 + y""")
def image_tiles(spark, d):
    n = table(spark, d, "nation").where("n_nationkey < 8")
    z = F.floor(F.col("n_nationkey") / 4).cast("int")
    images = n.select(z.alias("z"), (F.floor(F.col("n_nationkey") / 2) % 2).alias("x"), (F.col("n_nationkey") % 2).cast("bigint").alias("y"), F.col("n_name").cast("binary").alias("image"))
    t = more.ImageTileset(spark, images, 1)
    return spark.createDataFrame([(i, p.decode()) for i, p in t.tiles(["u.1.0.0", "u.1.1.0", "u.1.0.1", "u.0.0.0"]) if p], "tile string, image string")
