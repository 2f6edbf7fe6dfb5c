"""Queries of the coordinate, filter, join, ranking and placement operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tilewright.functions import columns as C
from tilewright.model.coords import Chromsizes, GenomicRange, quadtree_depth
from tilewright.model.info import TilesetInfo
from tilewright.model.policies import LinkPolicy
from tilewright.model.tileid import parsed
from tilewright.operators import genes, overlap, pairs, placement, ranking
from tilewright.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --------------------------------------------------------------------------- views on the test tables


def chromsizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chromsizes").select("cid", "chrom", "len", "chrom_offset")


def placed(spark: SparkSession, d: str) -> DataFrame:
    """Placed intervals with their ends in order, on absolute coordinates."""
    iv = table(spark, d, "intervals").where("fromX is not null and toX is not null")
    xs, ys = (F.least("fromX", "toX"), F.greatest("fromX", "toX")), (F.least("fromY", "toY"), F.greatest("fromY", "toY"))
    return iv.select(
        "id", "tileset", "zoomLevel", "importance", "uid", "fields", "chrOffset", xs[0].alias("x_start"), xs[1].alias("x_end"), ys[0].alias("y_start"), ys[1].alias("y_end")
    )


_PLACED = """
placed AS (SELECT id, tileset, zoomLevel, importance, uid, fields, chrOffset, least(fromX, toX) AS x_start, greatest(fromX, toX) AS x_end,
  least(fromY, toY) AS y_start, greatest(fromY, toY) AS y_end FROM intervals WHERE fromX IS NOT NULL AND toX IS NOT NULL)"""


def links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of anchors on contigs p0 to p3."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.concat(F.lit("p"), (F.col("l_partkey") % 4).cast("string")).alias("chrom1"), (F.col("l_partkey") * 50).alias("start1"), (F.col("l_partkey") * 50 + 40).alias("end1"),
        F.concat(F.lit("p"), (F.col("l_suppkey") % 4).cast("string")).alias("chrom2"), (F.col("l_suppkey") * 1000).alias("start2"), (F.col("l_suppkey") * 1000 + 900).alias("end2"),
        "l_orderkey", "l_linenumber",
    )


_LINKS = """
links AS (SELECT 'p' || (l_partkey % 4) AS chrom1, l_partkey * 50 AS start1, l_partkey * 50 + 40 AS end1,
  'p' || (l_suppkey % 4) AS chrom2, l_suppkey * 1000 AS start2, l_suppkey * 1000 + 900 AS end2, l_orderkey, l_linenumber FROM lineitem)"""
_LINK_COLUMNS = ["l_orderkey", "l_linenumber", "chrom1", "start1", "end1", "chrom2", "start2", "end2"]
_LINK_LIST = ", ".join(_LINK_COLUMNS)


def contigs(spark: SparkSession, d: str) -> Chromsizes:
    return Chromsizes.from_frame(chromsizes(spark, d))


# ------------------------------------------------------------------------------------- coordinates


@query("""SELECT cid, chrom, CAST(coalesce(sum(len) OVER (ORDER BY cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset,
  CAST(sum(len) OVER () AS BIGINT) AS total FROM chromsizes""")
def chromsizes_offsets(spark, d):
    cs = contigs(spark, d)
    return cs.frame(spark).select("cid", "chrom", F.col("chrom_offset").alias("start_offset"), F.lit(cs.total_length).cast("bigint").alias("total"))


@query("""SELECT row_id, chrom_offset + start - 1 AS x_start, chrom_offset + "end" AS x_end FROM basegffentity JOIN chromsizes USING (chrom)""")
def to_absolute(spark, d):
    gff = table(spark, d, "basegffentity").select("row_id", "chrom", (F.col("start") - 1).alias("start"), "end")
    return overlap.to_absolute(gff, chromsizes(spark, d)).select("row_id", "x_start", "x_end")


_ZOOM = 8


@query(f"""
WITH total AS (SELECT CAST(sum(len) AS BIGINT) AS n FROM chromsizes),
extent AS (SELECT n, CAST(1024 * power(2, ceil(log2(ceil(n / 1024.0)))) AS BIGINT) AS w FROM total),
tile AS (SELECT x, x * (w // {1 << _ZOOM}) AS lo, (x + 1) * (w // {1 << _ZOOM}) AS hi, n FROM extent, range({1 << _ZOOM}) t(x))
SELECT CAST(x AS BIGINT) AS x, chrom, greatest(lo, chrom_offset) - chrom_offset AS start_pos, least(hi, chrom_offset + len) - chrom_offset AS end_pos
FROM tile JOIN chromsizes ON chrom_offset < hi AND chrom_offset + len > lo
UNION ALL SELECT CAST(x AS BIGINT), NULL, greatest(lo, n) - n, hi - n FROM tile WHERE hi > n""")
def invert_tile_spans(spark, d):
    """All tiles of a zoom level as pieces of contigs, what lies past the genome without a name."""
    cs = contigs(spark, d)
    width = (1024 << quadtree_depth(cs.total_length, 1024)) >> _ZOOM
    tiles = spark.range(1 << _ZOOM).select(F.col("id").alias("x"), F.lit(0).alias("z"))
    spans = cs.frame(spark).select("chrom", "chrom_offset", F.col("chrom_offset").alias("lo"), (F.col("chrom_offset") + F.col("len")).alias("hi"))
    beyond = spark.createDataFrame([(None, cs.total_length, cs.total_length, width << _ZOOM)], "chrom string, chrom_offset bigint, lo bigint, hi bigint")
    met = overlap.join_tiles(spans.unionByName(beyond), tiles, {0: width}, "lo", "hi")
    lo, hi = F.col("x") * width, (F.col("x") + 1) * width
    return met.select("x", "chrom", (F.greatest(lo, F.col("lo")) - F.col("chrom_offset")).alias("start_pos"), (F.least(hi, F.col("hi")) - F.col("chrom_offset")).alias("end_pos"))


@query(f"""WITH {_PLACED} SELECT id, unnest(range(x_start // 65536, (x_end - 1) // 65536 + 1)) AS x FROM placed WHERE x_end > x_start""")
def tile_positions(spark, d):
    return placed(spark, d).select("id", F.explode(C.tile_range(F.col("x_start"), F.col("x_end"), 65536)).alias("x"))


@query(f"""WITH {_PLACED} SELECT id, CAST(power(2, zoomLevel) AS BIGINT) - 1 + x_start // CAST(power(2, 33 - zoomLevel) AS BIGINT) AS tile
FROM placed WHERE zoomLevel IS NOT NULL""")
def linear_tile_id(spark, d):
    p = placed(spark, d).where("zoomLevel is not null")
    x = F.floor(F.col("x_start") / F.pow(F.lit(2), 33 - F.col("zoomLevel")))
    return p.select("id", C.linear_tile_id(F.col("zoomLevel"), x).alias("tile"))


@query("""
WITH t AS (SELECT CAST(sum(len) AS BIGINT) AS n FROM chromsizes), e AS (SELECT CAST(ceil(log2(ceil(n / 1024.0))) AS INTEGER) AS depth FROM t)
SELECT CAST(z AS INTEGER) AS z, CAST(power(2, depth - z) AS BIGINT) AS binsize, CAST(1024 * power(2, depth - z) AS BIGINT) AS tile_width, CAST(power(2, z) AS BIGINT) AS n_tiles
FROM e, range(depth + 1) r(z)""")
def quadtree_levels(spark, d):
    info = TilesetInfo.quadtree(contigs(spark, d), 1024)
    rows = [(z, info.resolution_for(z), info.tile_width(z), info.canvas(z).n_tiles) for z in range(info.num_zoom_levels)]
    return spark.createDataFrame(rows, "z int, binsize bigint, tile_width bigint, n_tiles bigint")


@query("""
SELECT row_id, CASE WHEN "end" > start - 1 AND CAST(floor((start - 1) / 1000.0 + 0.5) AS BIGINT) >= CAST(ceil("end" / 1000.0) AS BIGINT)
    THEN CAST(ceil("end" / 1000.0) AS BIGINT) - 1 ELSE CAST(floor((start - 1) / 1000.0 + 0.5) AS BIGINT) END AS first_bin,
  CAST(ceil("end" / 1000.0) AS BIGINT) AS last_bin FROM basegffentity""")
def nearest_bin_slice(spark, d):
    gff = table(spark, d, "basegffentity")
    lo, hi = F.col("start") - 1, F.col("end")
    return gff.select("row_id", C.nearest_first_bin(lo, hi, 1000).alias("first_bin"), F.ceil(hi / 1000).alias("last_bin"))


_LNG, _LAT = "(o_orderkey * 7919 % 36000) / 100.0 - 180", "(o_orderkey * 104729 % 16000) / 100.0 - 80"


@query(f"""
WITH p AS (SELECT o_orderkey, {_LNG} AS lng, {_LAT} AS lat FROM orders)
SELECT o_orderkey, CAST(floor((lng + 180) / 360 * 1024) AS BIGINT) AS x,
  CAST(floor((1 - ln(tan((radians(lat) + pi() / 2) / 2)) / pi()) / 2 * 1024) AS BIGINT) AS y, round(degrees(ln(tan(pi() / 4 + radians(lat) / 2))), 6) AS mercator_y FROM p""")
def mercator_tiles(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr(_LNG).cast("double").alias("lng"), F.expr(_LAT).cast("double").alias("lat"))
    x, y = C.mercator_tile(F.col("lng"), F.col("lat"), 10)
    return o.select("o_orderkey", F.floor(x).alias("x"), F.floor(y).alias("y"), F.round(C.lat_to_y(F.col("lat")), 6).alias("mercator_y"))


@query("""SELECT CAST(z AS INTEGER) AS z, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, round(x / 16.0 * 360 - 180, 6) AS lng,
  round(degrees(2 * atan(exp((1 - 2 * y / 16.0) * pi())) - pi() / 2), 6) AS lat FROM range(4, 5) a(z), range(16) b(x), range(16) c(y)""")
def mercator_corners(spark, d):
    t = spark.range(256).select(F.lit(4).alias("z"), (F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    lng, lat = C.mercator_lng_lat(F.col("x"), F.col("y"), 4)
    return t.select("z", "x", "y", F.round(lng, 6).alias("lng"), F.round(lat, 6).alias("lat"))


@query("""SELECT cid, CAST(power(2, ceil(log2(len))) AS BIGINT) AS width, chrom || ':' || 1 || '-' || len AS region FROM chromsizes WHERE len > 0""")
def contig_widths(spark, d):
    return chromsizes(spark, d).where("len > 0").select("cid", C.next_power_of_two(F.col("len")).alias("width"), C.ucsc(F.col("chrom"), F.lit(0).cast("bigint"), F.col("len")).alias("region"))


@query("""SELECT chrom, CAST(coalesce(sum(n) OVER (ORDER BY cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_bin, n AS n_bins
FROM (SELECT cid, chrom, CAST(ceil(len / 10000.0) AS BIGINT) AS n FROM chromsizes)""")
def contig_bin_offsets(spark, d):
    from tilewright.operators.contacts import bin_offsets

    return bin_offsets(chromsizes(spark, d), 10_000)


# ------------------------------------------------------------------------------------------ filters

_RANGES = [("chr1", 1_000_000, 60_000_000), ("chr7", 0, 900_000_000), ("chr12", 5_000_000, 5_000_000)]


def _ranges() -> list[GenomicRange]:
    return [GenomicRange(i, *r) for i, r in enumerate(_RANGES)]


@query("""SELECT row_id FROM basegffentity WHERE chrom = 'chr1' AND "end" > 1000000 AND start - 1 < 60000000 OR chrom = 'chr7' AND "end" > 0 AND start - 1 < 900000000""")
def overlap_1d(spark, d):
    gff = table(spark, d, "basegffentity").select("row_id", "chrom", (F.col("start") - 1).alias("start"), "end")
    return gff.where(overlap.overlaps(_ranges(), contigs(spark, d))).select("row_id")


@query("""SELECT row_id FROM basegffentity WHERE chrom = 'chr1' AND "end" > 1000000 AND start <= 60000000 OR chrom = 'chr7' AND "end" > 0 AND start <= 900000000""")
def overlap_1based(spark, d):
    return table(spark, d, "basegffentity").where(overlap.overlaps_1based(_ranges())).select("row_id")


@query("""
SELECT row_id, start - 1 + length(strand) AS stop FROM basegffentity
WHERE chrom = 'chr1' AND start - 1 < 60000000 AND start - 1 + length(strand) > 1000000 OR chrom = 'chr7' AND start - 1 < 900000000 AND start - 1 + length(strand) > 0""")
def overlap_variant(spark, d):
    """Features taken as variants whose REF is the strand sign."""
    v = table(spark, d, "basegffentity").select("row_id", "chrom", F.col("start").alias("pos"), C.variant_end(F.col("start"), F.col("strand")).alias("stop"))
    return v.where(overlap.overlaps_variant(_ranges(), end="stop")).select("row_id", "stop")


_X, _Y = [GenomicRange(0, "p1", 1000, 40000)], [GenomicRange(0, "p2", 2000, 60000), GenomicRange(0, "p3", 0, 9000)]
_IN_X = "(chrom1 = 'p1' AND end1 > 1000 AND start1 < 40000)"


@query(f"""WITH {_LINKS} SELECT {_LINK_LIST} FROM links WHERE {_IN_X}
  AND (chrom2 = 'p2' AND end2 > 2000 AND start2 < 60000 OR chrom2 = 'p3' AND end2 > 0 AND start2 < 9000)""")
def overlap_2d(spark, d):
    return links(spark, d).where(overlap.anchors_meet(_X, _Y)).select(_LINK_COLUMNS)


_IN_X2 = "(chrom2 = 'p1' AND end2 > 1000 AND start2 < 40000)"


@query(f"WITH {_LINKS} SELECT {_LINK_LIST} FROM links WHERE {_IN_X} AND {_IN_X2}")
def links_both(spark, d):
    return links(spark, d).where(overlap.links_meet(_X, LinkPolicy.BOTH)).select(_LINK_COLUMNS)


@query(f"WITH {_LINKS} SELECT {_LINK_LIST} FROM links WHERE {_IN_X} OR {_IN_X2}")
def links_either(spark, d):
    return links(spark, d).where(overlap.links_meet(_X, LinkPolicy.EITHER)).select(_LINK_COLUMNS)


@query(f"""WITH {_LINKS} SELECT {_LINK_LIST} FROM links WHERE CASE WHEN chrom1 = chrom2
  THEN chrom1 = 'p1' AND least(start1, start2) < 40000 AND greatest(end1, end2) > 1000 ELSE {_IN_X} OR {_IN_X2} END""")
def links_hull(spark, d):
    return links(spark, d).where(overlap.links_meet(_X, LinkPolicy.HULL)).select(_LINK_COLUMNS)


@query(f"""WITH {_PLACED} SELECT id FROM placed WHERE zoomLevel <= 9 AND least(x_start, y_start) < 1500000000 AND greatest(x_end, y_end) > 1450000000""")
def stored_links_hull(spark, d):
    p = placed(spark, d).where("zoomLevel <= 9")
    return p.where(overlap.absolute_links_meet(1_450_000_000, 1_500_000_000, LinkPolicy.HULL, ("x_start", "x_end"), ("y_start", "y_end"))).select("id")


@query(f"""WITH {_PLACED} SELECT id FROM placed WHERE zoomLevel <= 9 AND x_start < 1500000000 AND x_end > 1450000000
UNION SELECT id FROM placed WHERE zoomLevel <= 9 AND y_start < 1500000000 AND y_end > 1450000000""")
def stored_links_either(spark, d):
    p = placed(spark, d).where("zoomLevel <= 9")
    return p.where(overlap.absolute_links_meet(1_450_000_000, 1_500_000_000, LinkPolicy.EITHER, ("x_start", "x_end"), ("y_start", "y_end"))).select("id")


@query("""SELECT row_id, chrom FROM cnvs_hw WHERE chrom IN (SELECT chrom FROM chromsizes)""")
def known_contig_semi(spark, d):
    return overlap.known_contigs(table(spark, d, "cnvs_hw"), chromsizes(spark, d)).select("row_id", "chrom")


@query("""SELECT row_id, chrom FROM cnvs_hw c WHERE NOT EXISTS (SELECT 1 FROM chromsizes s WHERE s.chrom = c.chrom)""")
def unknown_contig_anti(spark, d):
    return overlap.unknown_contigs(table(spark, d, "cnvs_hw"), chromsizes(spark, d)).select("row_id", "chrom")


@query("""SELECT o_orderkey FROM orders WHERE o_totalprice > 50000 AND o_totalprice < 150000 AND o_orderkey > 100 AND o_orderkey < 5000""")
def points_in_rect(spark, d):
    o = table(spark, d, "orders")
    return o.where((F.col("o_totalprice") > 50000) & (F.col("o_totalprice") < 150000) & (F.col("o_orderkey") > 100) & (F.col("o_orderkey") < 5000)).select("o_orderkey")


# ---------------------------------------------------------------------------------- tiles and ranking

_W = 1 << 24
_CAP = 20


@query(f"""
WITH {_PLACED},
hit AS (SELECT id, uid, x_start, x_end, unnest(range(x_start // {_W}, (x_end - 1) // {_W} + 1)) AS x FROM placed WHERE x_end > x_start),
ranked AS (SELECT *, ('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 AS importance FROM hit)
SELECT x, id, uid, x_start, x_end, importance FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY importance DESC, id) AS r FROM ranked) WHERE r <= {_CAP}""")
def tile_top_k(spark, d):
    """A batch of all tiles of one zoom in one job: the most important records of each."""
    tiles = spark.range((1 << 33) // _W).select(F.lit(9).alias("z"), F.col("id").alias("x"))
    hit = overlap.join_tiles(placed(spark, d), tiles, {9: _W}).withColumn("importance", C.stable_importance(F.col("id").cast("string")))
    best = ranking.cap_per_group(hit.select("z", "x", "id", "uid", "x_start", "x_end", "importance"), ["z", "x"], _CAP, F.col("importance").desc(), F.col("id"))
    return best.select("x", "id", "uid", "x_start", "x_end", "importance")


_W2 = 1 << 29


@query(f"""
WITH {_PLACED},
across AS (SELECT id, y_start, y_end, unnest(range(x_start // {_W2}, (x_end - 1) // {_W2} + 1)) AS x FROM placed WHERE x_end > x_start AND y_end > y_start),
hit AS (SELECT id, x, unnest(range(y_start // {_W2}, (y_end - 1) // {_W2} + 1)) AS y FROM across),
ranked AS (SELECT *, ('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 AS importance FROM hit)
SELECT x, y, id FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY importance DESC, id) AS r FROM ranked) WHERE r <= {_CAP}""")
def tile_top_k_2d(spark, d):
    n = (1 << 33) // _W2
    tiles = spark.range(n * n).select(F.lit(4).alias("z"), (F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("y"))
    hit = overlap.join_tiles_2d(placed(spark, d), tiles, {4: _W2}, ("x_start", "x_end"), ("y_start", "y_end"))
    hit = hit.select("x", "y", "id", C.stable_importance(F.col("id").cast("string")).alias("importance"))
    return ranking.cap_per_group(hit, ["x", "y"], _CAP, F.col("importance").desc(), F.col("id")).select("x", "y", "id")


@query(f"""WITH {_PLACED} SELECT id, uid, chrOffset, x_start, x_end, fields FROM placed WHERE zoomLevel <= 6 AND x_start < 900000000 AND x_end > 700000000""")
def stored_tile_serve(spark, d):
    """A stored tile shows every record of its zoom or a coarser one that meets it."""
    p = placed(spark, d).where((F.col("zoomLevel") <= 6) & (F.col("x_start") < 900_000_000) & (F.col("x_end") > 700_000_000))
    return p.select("id", "uid", "chrOffset", "x_start", "x_end", "fields")


@query("""SELECT id, string_split(fields, chr(9)) AS parts FROM intervals WHERE fields IS NOT NULL""")
def record_fields(spark, d):
    return table(spark, d, "intervals").where("fields is not null").select("id", F.split("fields", "\t").alias("parts"))


@query("""SELECT row_id, chrom, start FROM cnvs_hw WHERE chrom IN (SELECT chrom FROM chromsizes) ORDER BY row_id LIMIT 50 OFFSET 100""")
def regions_page(spark, d):
    """A page: unknown contigs are filtered before it is cut."""
    known = overlap.known_contigs(table(spark, d, "cnvs_hw"), chromsizes(spark, d)).select("row_id", "chrom", "start")
    return ranking.page(known, ["row_id"], 100, 50)[0]


@query("""SELECT p_partkey // 64 AS tile, p_name, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey // 64 ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 16""")
def labels_top(spark, d):
    p = table(spark, d, "part").withColumn("tile", F.floor(F.col("p_partkey") / 64))
    return ranking.cap_per_group(p, ["tile"], 16, F.col("p_retailprice").desc(), F.col("p_partkey")).select("tile", "p_name", "p_retailprice")


@query("""SELECT CAST(slot AS INTEGER) AS slot, p_partkey, p_name FROM part JOIN range(16) t(slot) ON p_partkey = CAST(floor(16 + slot * (160 - 1 - 16) / 15.0) AS BIGINT)""")
def labels_linspace(spark, d):
    return ranking.evenly_spaced(table(spark, d, "part"), "p_partkey", 16, 160, 16).select("slot", "p_partkey", "p_name")


@query(f"""
WITH {_PLACED},
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY id) AS k FROM placed WHERE importance IS NOT NULL AND NOT isnan(importance)) WHERE k = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY x_start // {_W2} ORDER BY importance DESC, id) AS r FROM one)
SELECT x_start // {_W2} AS x, id, uid, importance FROM ranked WHERE r <= 25""")
def arcs_top25_distinct(spark, d):
    p = placed(spark, d).where("importance is not null and not isnan(importance)")
    one = ranking.first_per_key(p, ["uid"], F.col("id")).withColumn("x", F.floor(F.col("x_start") / _W2))
    return ranking.cap_per_group(one, ["x"], 25, F.col("importance").desc(), F.col("id")).select("x", "id", "uid", "importance")


@query("""SELECT chrom FROM (SELECT chrom, ln(greatest(('0x' || substr(md5(chrom), 1, 8))::BIGINT / 4294967296.0, power(2, -33))) / len AS w FROM chromsizes WHERE len > 0) ORDER BY w DESC LIMIT 128""")
def contig_sample(spark, d):
    return ranking.weighted_sample(chromsizes(spark, d), F.col("chrom"), F.col("len"), 128).select("chrom")


# ---------------------------------------------------------------------------------------- gene models

_PARENTED = r"""
feat AS (
  SELECT DISTINCT type, coalesce(id, type || '_' || start || '_' || "end") AS id, nullif(CASE
    WHEN regexp_matches(attributes, '^[\s;]*[^;="]*=')
      THEN url_decode(split_part(trim(regexp_extract(attributes, '(?:^|;)\s*Parent\s*=([^;]*)', 1), ' ' || chr(9) || chr(10) || chr(13)), ',', 1))
    WHEN type IN ('exon', 'CDS') THEN regexp_extract(attributes, '(?:^|;)\s*transcript_id\s+"([^"]*)"', 1)
    WHEN type IN ('gene', 'pseudogene') THEN NULL
    ELSE regexp_extract(attributes, '(?:^|;)\s*gene_id\s+"([^"]*)"', 1) END, '') AS parent,
    chrom, start - 1 AS lo, "end" AS hi, strand FROM basegffentity),
entity AS (
  SELECT *, row_number() OVER (PARTITION BY id, CASE WHEN type IN ('gene', 'pseudogene') THEN 0 WHEN type = 'miRNA' THEN 2 ELSE 1 END
    ORDER BY lo, hi, chrom NULLS FIRST, strand NULLS FIRST, type, parent NULLS FIRST) AS k FROM feat
  WHERE type IN ('gene', 'pseudogene', 'miRNA', 'mRNA', 'transcript', 'lnc_RNA', 'ncRNA', 'primary_transcript', 'antisense_RNA', 'snoRNA', 'snRNA', 'tRNA', 'rRNA', 'SRP_RNA', 'RNase_P_RNA', 'RNase_MRP_RNA')
    AND (type <> 'miRNA' OR parent IS NOT NULL)),
gene AS (SELECT id AS gene_id, chrom, lo, hi, strand FROM entity WHERE k = 1 AND type IN ('gene', 'pseudogene')),
tx AS (SELECT id AS transcript_id, parent, lo, hi FROM entity WHERE k = 1 AND type NOT IN ('gene', 'pseudogene', 'miRNA')),
mi AS (SELECT id, parent AS via FROM entity WHERE k = 1 AND type = 'miRNA'),
part AS (
  SELECT gene_id, transcript_id, kind, p.lo, p.hi FROM (
    SELECT f.type AS kind, f.lo, f.hi, t.transcript_id, CASE WHEN t.transcript_id IS NOT NULL THEN t.parent ELSE coalesce(m.via, f.parent) END AS of
    FROM feat f LEFT JOIN mi m ON f.parent = m.id LEFT JOIN tx t ON t.transcript_id = coalesce(m.via, f.parent) WHERE f.type IN ('exon', 'CDS') AND f.parent IS NOT NULL) p
  JOIN gene g ON g.gene_id = p.of)"""


def _islands(key: str) -> str:
    return f"""
reach_{key} AS (SELECT {key}, lo, hi, max(hi) OVER (PARTITION BY {key} ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM part WHERE kind = 'exon' AND {key} IS NOT NULL),
isl_{key} AS (SELECT *, sum(CASE WHEN lo > b THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS i FROM reach_{key}),
exons_{key} AS (SELECT {key}, min(lo) AS lo, max(hi) AS hi FROM isl_{key} GROUP BY {key}, i)"""


@query(f"WITH {_PARENTED} SELECT gene_id, transcript_id, kind, lo, hi FROM part")
def gene_parts(spark, d):
    return genes.parts_with_genes(genes.features(table(spark, d, "basegffentity")))


@query(f"WITH {_PARENTED}, {_islands('gene_id')} SELECT gene_id, lo, hi FROM exons_gene_id")
def exon_union(spark, d):
    return genes.exon_unions(genes.parts_with_genes(genes.features(table(spark, d, "basegffentity"))), "gene_id")


@query(f"""WITH {_PARENTED}, {_islands('gene_id')},
e AS (SELECT gene_id, string_agg(CAST(lo AS VARCHAR), ',' ORDER BY lo, hi) AS s, string_agg(CAST(hi AS VARCHAR), ',' ORDER BY lo, hi) AS t FROM exons_gene_id GROUP BY gene_id),
c AS (SELECT gene_id, min(lo) AS cds_lo, max(hi) AS cds_hi FROM part WHERE kind = 'CDS' GROUP BY gene_id)
SELECT g.gene_id AS uid, o.chrom_offset + g.lo AS x_start, o.chrom_offset + g.hi AS x_end, o.chrom_offset, CAST(g.hi - g.lo AS DOUBLE) AS importance, g.strand,
  [g.chrom, CAST(g.lo AS VARCHAR), CAST(g.hi AS VARCHAR), g.gene_id, (g.hi - g.lo) || '.0', coalesce(g.strand, '.'), g.gene_id, g.gene_id,
   CAST(coalesce(cds_lo, g.lo) AS VARCHAR), CAST(coalesce(cds_hi, g.lo) AS VARCHAR), coalesce(e.s, CAST(g.lo AS VARCHAR)), coalesce(e.t, CAST(g.hi AS VARCHAR))] AS fields
FROM gene g JOIN chromsizes o ON g.chrom = o.chrom LEFT JOIN e ON e.gene_id = g.gene_id LEFT JOIN c ON c.gene_id = g.gene_id""")
def gene_records(spark, d):
    return genes.gene_records(table(spark, d, "basegffentity"), chromsizes(spark, d))


@query(f"""WITH {_PARENTED}, {_islands('transcript_id')},
e AS (SELECT transcript_id, string_agg(CAST(lo + 1 AS VARCHAR), ',' ORDER BY lo, hi) AS s, string_agg(CAST(hi AS VARCHAR), ',' ORDER BY lo, hi) AS t FROM exons_transcript_id GROUP BY transcript_id),
c AS (SELECT transcript_id, min(lo) AS cds_lo, max(hi) AS cds_hi FROM part WHERE kind = 'CDS' GROUP BY transcript_id)
SELECT t.transcript_id AS uid, t.parent AS gene_id, o.chrom_offset + t.lo AS x_start, o.chrom_offset + t.hi AS x_end, g.strand,
  coalesce(e.s, CAST(t.lo + 1 AS VARCHAR)) AS exon_starts, coalesce(e.t, CAST(t.hi AS VARCHAR)) AS exon_ends,
  coalesce(CASE WHEN g.strand = '-' THEN CAST(cds_hi - 2 AS VARCHAR) ELSE CAST(cds_lo + 1 AS VARCHAR) END, '.') AS start_codon,
  coalesce(CASE WHEN g.strand = '-' THEN CAST(cds_lo + 1 AS VARCHAR) ELSE CAST(cds_hi - 2 AS VARCHAR) END, '.') AS stop_codon
FROM tx t JOIN gene g ON g.gene_id = t.parent JOIN chromsizes o ON g.chrom = o.chrom LEFT JOIN e ON e.transcript_id = t.transcript_id LEFT JOIN c ON c.transcript_id = t.transcript_id""")
def transcript_records(spark, d):
    return genes.transcript_records(table(spark, d, "basegffentity"), chromsizes(spark, d))


@query(f"""WITH {_PARENTED} SELECT gene_id, kind, lo, hi FROM part WHERE gene_id IN (SELECT gene_id FROM gene ORDER BY hi - lo DESC, gene_id DESC LIMIT 100)""")
def genes_top_k_with_children(spark, d):
    return genes.top_genes_with_parts(table(spark, d, "basegffentity"), 100)


# ------------------------------------------------------------------------------------------ placement

_LEVELS, _ROOM = 4, 30
_POINT_STEPS = "\n".join(
    f""", l{z} AS (SELECT *, row_number() OVER (PARTITION BY x_start // {(1 << 33) >> z} ORDER BY importance DESC, id) AS r FROM {'points' if z == 0 else f'rest{z}'}),
rest{z + 1} AS (SELECT id, importance, x_start FROM l{z} WHERE r > {_ROOM})"""
    for z in range(_LEVELS)
)


@query(
    f"""WITH {_PLACED}, points AS (SELECT id, importance, x_start FROM placed WHERE importance IS NOT NULL AND NOT isnan(importance)) {_POINT_STEPS} """
    + " UNION ALL ".join(f"SELECT id, {z} AS zoom_level FROM l{z} WHERE r <= {_ROOM}" for z in range(_LEVELS))
)
def placement_points(spark, d):
    """Starts of intervals as points: each meets one tile a zoom."""
    p = placed(spark, d)
    tiles = placement.interval_tiles(F.col("x_start"), F.col("x_start") + 1, _LEVELS - 1, 1 << 33)
    return placement.place(p, "id", "importance", tiles, _ROOM)


@query()
def placement_intervals(spark, d):
    p = placed(spark, d)
    return placement.place(p, "id", "importance", placement.interval_tiles(F.col("x_start"), F.col("x_end"), 5, 1 << 33), 100)


@query()
def placement_2d(spark, d):
    """Rectangles; by this operator's rule a tile takes one record more than ``max_per_tile``."""
    p = placed(spark, d)
    tiles = placement.rectangle_tiles((F.col("x_start"), F.col("x_end")), (F.col("y_start"), F.col("y_end")), 3, float(1 << 33))
    return placement.place(p, "id", "importance", tiles, 100 + 1)


@query()
def placement_geo(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.expr(_LNG).cast("double").alias("lng"), F.expr(_LAT).cast("double").alias("lat"))
    keys = []
    for z in range(5):
        x, y = C.mercator_tile(F.col("lng"), F.col("lat"), z)
        keys.append(F.array(F.concat_ws(":", F.floor(x), F.floor(y))))
    return placement.place(o, "o_orderkey", "o_totalprice", keys, 20 + 1)


@query()
def hibed(spark, d):
    """Feature lines that climb from their own zoom to coarser tiles with room, most important first."""
    gff = table(spark, d, "basegffentity").join(chromsizes(spark, d), "chrom")
    line = F.concat_ws("\t", "chrom", "start", "end", "type", F.coalesce("id", F.lit("")))
    lines = gff.select("chrom", F.col("start") - 1, "end", "len", line.alias("line"), F.struct((-C.stable_importance(F.col("row_id").cast("string"))).alias("i"), "row_id").alias("o"))
    lines = lines.toDF("chrom", "start", "end", "len", "line", "o")
    entries = placement.chrom_level_entries(lines, "start", "end", "len", "o")
    return placement.promote(entries, 50).select("chrom", "zoom", "tile", F.col("seq.o.row_id").alias("row_id"))


@query(f"""WITH {_PLACED} SELECT id, CAST(zoomLevel - k AS INTEGER) AS z, x_start // CAST(power(2, 33 - zoomLevel + k) AS BIGINT) AS x
FROM (SELECT *, unnest(range(zoomLevel + 1)) AS k FROM placed WHERE zoomLevel IS NOT NULL)""")
def ancestor_tiles(spark, d):
    """A record's tile at its zoom and all tiles above it."""
    p = placed(spark, d).where("zoomLevel >= 0").withColumn("k", F.explode(F.sequence(F.lit(0), "zoomLevel")))
    x = F.floor(F.col("x_start") / F.pow(F.lit(2), 33 - F.col("zoomLevel") + F.col("k")))
    return p.select("id", (F.col("zoomLevel") - F.col("k")).alias("z"), x.alias("x"))


# --------------------------------------------------------------------------------- sets and sequences


@query("""SELECT o_custkey AS customer, min(day) AS lo, max(day) AS hi FROM (
  SELECT o_custkey, day, day - row_number() OVER (PARTITION BY o_custkey ORDER BY day) AS g FROM (
    SELECT DISTINCT o_custkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders)) GROUP BY o_custkey, g""")
def adjacent_runs(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), F.unix_date(F.to_date("o_orderdate")).alias("day"))
    return pairs.adjacent_runs(o, ["customer"], "day")


@query("""SELECT tileset, count_if(nxt < fromX) AS out_of_order FROM (
  SELECT tileset, fromX, lead(fromX) OVER (PARTITION BY tileset ORDER BY id) AS nxt FROM intervals) GROUP BY tileset""")
def sortedness(spark, d):
    return pairs.is_sorted(table(spark, d, "intervals"), ["tileset"], "id", "fromX")


@query("SELECT chrom FROM cnvs_hw WHERE chrom IS NOT NULL UNION SELECT chrom FROM basegffentity WHERE chrom IS NOT NULL")
def union_distinct(spark, d):
    a, b = (table(spark, d, t).select("chrom").where("chrom is not null") for t in ("cnvs_hw", "basegffentity"))
    return a.union(b).distinct()


@query("""SELECT sample_id FROM cnvs_hw WHERE sample_id IS NOT NULL AND chrom IN ('chr1', 'chr7', 'chr12') GROUP BY sample_id HAVING count(DISTINCT chrom) = 3""")
def intersect_all_levels(spark, d):
    """Samples present on each of the given chromosomes."""
    from tilewright.operators.contacts import transforms_everywhere

    c = table(spark, d, "cnvs_hw").where(F.col("chrom").isin("chr1", "chr7", "chr12") & F.col("sample_id").isNotNull())
    return transforms_everywhere(c, "chrom", "sample_id")


@query("""(SELECT chrom FROM cnvs_hw EXCEPT SELECT chrom FROM basegffentity) UNION (SELECT chrom FROM basegffentity EXCEPT SELECT chrom FROM cnvs_hw)""")
def symmetric_difference(spark, d):
    return pairs.symmetric_difference(table(spark, d, "cnvs_hw").select("chrom"), table(spark, d, "basegffentity").select("chrom"))


@query("SELECT uid, dense_rank() OVER (ORDER BY uid) - 1 AS code FROM (SELECT DISTINCT uid FROM intervals WHERE uid IS NOT NULL)")
def dictionary_codes(spark, d):
    return pairs.dictionary_codes(table(spark, d, "intervals"), "uid")


@query("""SELECT p_partkey, p_name, coalesce(m, 0.0) AS p_retailprice FROM part LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS m FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON l_partkey = p_partkey""")
def importance_replace(spark, d):
    other = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), F.col("l_extendedprice").alias("p_retailprice"))
    return pairs.replaced_importance(table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"), "p_partkey", "p_retailprice", other)


@query(r"""
WITH t AS (SELECT p_name, max(p_retailprice) AS imp, regexp_replace(trim(replace(lower(p_name), '/', ' ')), '\s+', '_', 'g') AS s FROM part GROUP BY p_name),
c AS (SELECT DISTINCT p_name, imp, substr(s, i, j) AS substr FROM (SELECT p_name, imp, s, i, unnest(range(1, length(s) - i + 2)) AS j FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM t)))
SELECT substr, p_name, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY substr ORDER BY imp DESC, p_name) AS place FROM c) WHERE place <= 5""")
def substring_index_top_k(spark, d):
    names = table(spark, d, "part").groupBy("p_name").agg(F.max("p_retailprice").alias("imp"))
    return ranking.substring_index(names, "p_name", "imp", 5).select("substr", "p_name", "place")


@query("""
SELECT tile_id, CASE WHEN ok THEN string_split(tile_id, '.')[1] END AS uid, CASE WHEN ok THEN CAST(string_split(tile_id, '.')[2] AS INTEGER) END AS z,
  CASE WHEN ok THEN CAST(string_split(tile_id, '.')[3] AS BIGINT) END AS x, CASE WHEN ok THEN CAST(split_part(string_split(tile_id, '.')[4], ',', 1) AS BIGINT) END AS y
FROM (SELECT tile_id, regexp_full_match(tile_id, '[^.,]*([.][0-9]+){3}(,[^,:]*:[^,]*)*') AS ok
  FROM (SELECT tileset || '.' || coalesce(CAST(zoomLevel AS VARCHAR), '-1') || '.' || (fromX // 1000) || '.' || (fromY // 1000) || CASE WHEN id % 3 = 0 THEN ',cos:abc' ELSE '' END AS tile_id FROM intervals))""")
def tile_id_parse(spark, d):
    iv = table(spark, d, "intervals")
    text = F.concat(
        F.concat_ws(".", "tileset", F.coalesce(F.col("zoomLevel").cast("string"), F.lit("-1")), F.floor(F.col("fromX") / 1000), F.floor(F.col("fromY") / 1000)),
        F.when(F.col("id") % 3 == 0, F.lit(",cos:abc")).otherwise(F.lit("")),
    )
    t = iv.select(text.alias("tile_id")).withColumn("t", parsed(F.col("tile_id"), 2))
    return t.select("tile_id", "t.uid", "t.z", F.col("t.pos")[0].alias("x"), F.col("t.pos")[1].alias("y"))
