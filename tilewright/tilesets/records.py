"""Tilesets of records: intervals, pairs, genes, variants, reads and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import reads as R
from tilewright.functions.columns import is_primary, joined_or_dot, read_id, stable_importance
from tilewright.model.coords import Chromsizes
from tilewright.model.info import TilesetInfo
from tilewright.model.policies import LinkPolicy, TilePolicy
from tilewright.model.tileid import TileId
from tilewright.operators import genes, overlap
from tilewright.operators.ranking import cap_per_group
from tilewright.runtime import local_frame
from tilewright.sources import text
from tilewright.tilesets.base import Tileset, page_of, scan_bytes

_SHOWN = ["uid", "xStart", "xEnd", "chrOffset", "importance", "fields", "strand", "name", "yStart", "yEnd", "xChrOffset", "yChrOffset"]


class AnnotationTileset(Tileset):
    """Intervals (x_start, x_end, x_offset, uid, importance, fields): each tile shows its most important ones, sorted by start."""

    def __init__(self, spark: SparkSession, records: DataFrame, info: TilesetInfo, policy: TilePolicy | None = None):
        super().__init__(spark, info, policy)
        self.records = records

    @classmethod
    def from_bed(cls, spark: SparkSession, path: str, chromsizes: Chromsizes, policy: TilePolicy | None = None, tile_size: int = 1024) -> AnnotationTileset:
        bed = overlap.to_absolute(text.read_bed(spark, path), chromsizes.frame(spark))
        own = F.array(F.col("chrom"), F.col("start").cast("string"), F.col("end").cast("string"))
        fields = F.when(F.coalesce("rest", F.lit("")) == "", own).otherwise(F.concat(own, F.split("rest", "\t")))
        return cls(spark, _identified(bed.withColumn("fields", fields)), TilesetInfo.quadtree(chromsizes, tile_size), policy)

    @classmethod
    def from_vcf(cls, spark: SparkSession, path: str, chromsizes: Chromsizes | None = None, policy: TilePolicy | None = None, tile_size: int = 1024) -> AnnotationTileset:
        chromsizes = chromsizes or text.vcf_chromsizes(spark, path)
        v = overlap.to_absolute(text.read_vcf(spark, path).withColumn("start", F.col("pos") - 1), chromsizes.frame(spark, sized=True))
        fields = F.array(
            F.col("chrom"), F.col("pos").cast("string"), joined_or_dot(F.col("ids"), ";"), F.col("ref"), joined_or_dot(F.col("alts"), ","), F.coalesce(F.col("qual").cast("string"), F.lit("")), joined_or_dot(F.col("filters"), ";")
        )
        return cls(spark, _identified(v.withColumn("fields", fields)), TilesetInfo.quadtree(chromsizes, tile_size), policy)

    @classmethod
    def from_genes(cls, spark: SparkSession, features: DataFrame, chromsizes: Chromsizes, policy: TilePolicy | None = None, tile_size: int = 1024, transcripts: bool = False) -> AnnotationTileset:
        """Genes (or transcripts) of a feature table, the longest ones first."""
        make = genes.transcript_records if transcripts else genes.gene_records
        rows = make(features, chromsizes.frame(spark))
        if transcripts:
            rows = rows.withColumns({"chrom_offset": F.lit(None).cast("bigint"), "importance": (F.col("x_end") - F.col("x_start")).cast("double"), "fields": F.array("uid", "gene_id", "exon_starts", "exon_ends", "start_codon", "stop_codon")})
        return cls(spark, rows.withColumnRenamed("chrom_offset", "x_offset"), TilesetInfo.quadtree(chromsizes, tile_size), policy)

    def fetch(self, places, widths, modifier, settings):
        return self.grouped(self.shown(places, widths), "xStart")

    def rows(self, ids: list[str]) -> DataFrame:
        """(tile, columns of a record payload): what ``tiles`` shows, in no order and left to the executors, so that a tile may hold any
        number of records. A tile that cannot be served raises its error."""
        parsed = [TileId.parse(i, self.ndim, self.modifiers, self.options) for i in ids]
        for t in parsed:
            self._screen(t)
        kinds = "z int, x bigint" + ", y bigint" * (self.ndim == 2)
        places = sorted({(t.z, *t.pos) for t in parsed}) or [(0,) * (1 + self.ndim)]  # no ids, no rows
        names = local_frame(self.spark, [(t.raw, t.z, *t.pos) for t in parsed], f"tile string, {kinds}")
        hit = self.shown(local_frame(self.spark, places, kinds), self._widths(places))
        return hit.join(names, self.key).select("tile", *[c for c in hit.columns if c not in self.key])

    def shown(self, places: DataFrame, widths: dict[int, int]) -> DataFrame:
        """The records of all places, by place, with the columns of a payload."""
        if self.policy.max_scan_bytes is not None:
            self.policy.check_scan(scan_bytes(self.records))
        runs = self.runs(places)
        hit = overlap.join_tiles(self.source([(a * widths[z], (b + 1) * widths[z]) for z, r in runs.items() for a, b in r]), places, widths, runs=runs)
        return _wire(cap_per_group(hit, self.key, self.policy.max_records, F.col("importance").desc(), F.col("uid").desc()))

    def source(self, spans: list[tuple[int, int]]) -> DataFrame:
        """The records; those outside the absolute ``spans`` may be missing."""
        return self.records

    def empty(self, t: TileId):
        return []

    def regions(self, offset: int, limit: int) -> tuple[list[dict], bool]:
        return page_of(_wire(self.records), ["xStart", "xEnd", "uid"], offset, limit)


def _identified(df: DataFrame) -> DataFrame:
    """Adds a uid and an importance that are fixed by the record."""
    uid = F.md5(F.array_join("fields", "\t"))
    return df.withColumn("uid", uid).withColumn("importance", stable_importance(F.col("uid")))


def _wire(df: DataFrame) -> DataFrame:
    """The columns of a record payload under their wire names."""
    names = {"x_start": "xStart", "x_end": "xEnd", "y_start": "yStart", "y_end": "yEnd"}
    df = df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
    if "x_offset" in df.columns:
        df = df.withColumn("chrOffset", F.col("x_offset"))
    if "y_offset" in df.columns:
        df = df.withColumnsRenamed({"x_offset": "xChrOffset", "y_offset": "yChrOffset"})
    return df.select(*[c for c in ("z", "x", "y") if c in df.columns], *[c for c in _SHOWN if c in df.columns])


class BigBedTileset(AnnotationTileset):
    """A bigBed file, of which a batch of tiles reads the blocks that its index names for them."""

    def __init__(self, spark: SparkSession, path: str, chromsizes: Chromsizes | None = None, policy: TilePolicy | None = None, tile_size: int = 1024):
        from tilewright.sources.binary import bbi_chromsizes

        self.path, self.sizes = path, chromsizes or bbi_chromsizes(path)
        super().__init__(spark, None, TilesetInfo.quadtree(self.sizes, tile_size), policy)
        self.records = self._read(None)

    def _read(self, ranges: list | None) -> DataFrame:
        from tilewright.sources.binary import read_bbi

        bed = overlap.to_absolute(read_bbi(self.spark, self.path, ranges=ranges), self.sizes.frame(self.spark))
        own = F.array(F.col("chrom"), F.col("start").cast("string"), F.col("end").cast("string"))
        return _identified(bed.withColumn("fields", F.when(F.coalesce("rest", F.lit("")) == "", own).otherwise(F.concat(own, F.split("rest", "\t")))))

    def source(self, spans):
        return self._read([(g.name, g.start, g.end) for lo, hi in spans for g in self.sizes.invert(lo, hi) if not g.is_out_of_bounds])


class PairTileset(AnnotationTileset):
    """Pairs in two dimensions: a tile shows those whose anchors meet its columns and rows."""

    ndim = 2

    @classmethod
    def from_bedpe(cls, spark: SparkSession, path: str, chromsizes: Chromsizes, policy: TilePolicy | None = None, tile_size: int = 1024, **more):
        frame = chromsizes.frame(spark)
        p = overlap.to_absolute(text.read_bedpe(spark, path), frame, "chrom1", "start1", "end1", "x")
        p = overlap.to_absolute(p, frame, "chrom2", "start2", "end2", "y")
        own = F.array(*[F.col(c).cast("string") for c in ("chrom1", "start1", "end1", "chrom2", "start2", "end2")])
        p = p.withColumn("fields", F.when(F.coalesce("rest", F.lit("")) == "", own).otherwise(F.concat(own, F.split("rest", "\t"))))
        return cls(spark, _identified(p), TilesetInfo.quadtree(chromsizes, tile_size, ndim=cls.ndim), policy, **more)

    def shown(self, places, widths):
        hit = overlap.join_tiles_2d(self.records, places, widths, ("x_start", "x_end"), ("y_start", "y_end"), (self.runs(places), self.runs(places, "y")))
        return _wire(cap_per_group(hit, self.key, self.policy.max_records, F.col("importance").desc(), F.col("uid").desc()))


class LinkTileset(PairTileset):
    """The same pairs along one axis, by a link policy."""

    ndim = 1

    def __init__(self, spark, records, info, policy=None, links: LinkPolicy = LinkPolicy.EITHER):
        super().__init__(spark, records, info, policy)
        self.links = links

    def shown(self, places, widths):
        r, runs = self.records, self.runs(places)
        r = r.withColumns({"_a": F.least("x_start", "y_start"), "_b": F.greatest("x_end", "y_end")})
        side = overlap.near(runs, widths, "x_start", "x_end") | overlap.near(runs, widths, "y_start", "y_end")
        at = r.where(overlap.near(runs, widths, "_a", "_b") if self.links is LinkPolicy.HULL else side).withColumn("_l", overlap.levels(widths, runs))
        x, y, hull = (overlap.tiles_met(*c, True) for c in (("x_start", "x_end"), ("y_start", "y_end"), ("_a", "_b")))
        if self.links is LinkPolicy.BOTH:
            met = F.array_intersect(x, y)
        elif self.links is LinkPolicy.EITHER:
            met = F.array_union(x, y)
        else:  # pairs between contigs have no span
            met = F.when(F.col("x_offset") == F.col("y_offset"), hull).otherwise(F.array_union(x, y)) if "x_offset" in r.columns else hull
        hit = at.withColumn("x", F.explode(met)).withColumn("z", F.col("_l.z")).drop("_l", "_a", "_b").join(places, ["z", "x"])
        return _wire(cap_per_group(hit, self.key, self.policy.max_records, F.col("importance").desc(), F.col("uid").desc()))


class StoredTileset(AnnotationTileset):
    """A stratified store: a tile shows all records placed at its zoom or a coarser one, without a further cap."""

    def shown(self, places, widths):
        deepest = max(widths)
        rows = self.records.where(F.col("zoom_level") <= deepest)
        return _wire(overlap.join_tiles(rows, places, widths, runs=self.runs(places)).where(F.col("zoom_level") <= F.col("z")))


class StoredPairTileset(PairTileset):
    def shown(self, places, widths):
        rows = self.records.where(F.col("zoom_level") <= max(widths))
        hit = overlap.join_tiles_2d(rows, places, widths, ("x_start", "x_end"), ("y_start", "y_end"), (self.runs(places), self.runs(places, "y"))).where(F.col("zoom_level") <= F.col("z"))
        return _wire(hit)


class ReadsTileset(Tileset):
    """All primary alignments of a tile as parallel arrays, on absolute coordinates. A tile is refused by its width (``max_span``), never cut."""

    def __init__(self, spark: SparkSession, alignments: DataFrame, chromsizes: Chromsizes, policy: TilePolicy | None = None, tile_size: int = 1024):
        super().__init__(spark, TilesetInfo.quadtree(chromsizes, tile_size), policy)
        rows = alignments.where(is_primary(F.col("flag"))).withColumn("start", F.col("pos") - 1)
        self.records = overlap.to_absolute(rows, chromsizes.frame(spark))

    @classmethod
    def from_sam(cls, spark: SparkSession, path: str, chromsizes: Chromsizes, policy: TilePolicy | None = None) -> ReadsTileset:
        return cls(spark, text.read_sam(spark, path), chromsizes, policy)

    def fetch(self, places, widths, modifier, settings):
        hit = overlap.join_tiles(self.records, places, widths, runs=self.runs(places))
        flag = F.col("flag")
        bit = lambda n: flag.bitwiseAND(n)
        subs = R.cigar_substitutions(F.col("start"), F.col("end") - F.col("pos"), R.cigar_ops(F.col("cigar")))
        one = F.struct(
            F.col("x_start").alias("start"), F.col("qname").alias("readName"), read_id(F.col("qname"), flag).alias("id"), F.col("x_end").alias("end"), F.col("chrom").alias("chrName"),
            F.col("x_offset").alias("chrOffset"), "mapq", F.when(bit(16) != 0, "-").otherwise("+").alias("strand"), bit(1).alias("is_paired"), bit(64).alias("first_seq"), bit(128).alias("last_seq"),
            F.coalesce("hp", F.lit(0)).alias("hp"), F.coalesce("md", F.lit("")).alias("md"), subs.alias("cigars"), R.md_variants("seq", "md", "cigar").alias("variants"),
        )
        rows = hit.select(*self.key, one.alias("_r"))
        out = {}
        for r in rows.groupBy(*self.key).agg(F.array_sort(F.collect_list("_r")).alias("_l")).collect():
            names = r["_l"][0].__fields__
            out[tuple(r[k] for k in self.key)] = {n: [one[n] for one in r["_l"]] for n in names}
        return out

    def empty(self, t: TileId):
        names = "start readName id end chrName chrOffset mapq strand is_paired first_seq last_seq hp md cigars variants".split()
        return {n: [] for n in names}


class SequenceTileset(Tileset):
    """The bases of a tile, contig after contig; short at the end of the genome."""

    def __init__(self, spark: SparkSession, chunks: DataFrame, chromsizes: Chromsizes, chunk: int = 1 << 16, policy: TilePolicy | None = None, tile_size: int = 1024):
        super().__init__(spark, TilesetInfo.quadtree(chromsizes, tile_size), policy or TilePolicy(max_span=1_000_000, max_scan_bytes=None))
        self.chunks, self.chunk, self.chromsizes = chunks, chunk, chromsizes

    def fetch(self, places, widths, modifier, settings):
        spans = self.chromsizes.frame(self.spark).select("chrom", "chrom_offset", F.col("chrom_offset").alias("lo"), (F.col("chrom_offset") + F.col("len")).alias("hi"))
        width = F.create_map(*[F.lit(v) for z, w in widths.items() for v in (z, w)])[F.col("z")].cast("bigint")
        met = overlap.join_tiles(spans, places, widths, "lo", "hi")
        start, end = F.greatest("lo", F.col("x") * width) - F.col("chrom_offset"), F.least("hi", (F.col("x") + 1) * width) - F.col("chrom_offset")
        pieces = text.read_slices(self.chunks, met.select("z", "x", "chrom_offset", "chrom", start.alias("start"), end.alias("end")), self.chunk)
        whole = pieces.groupBy("z", "x").agg(F.array_sort(F.collect_list(F.struct("chrom_offset", "seq"))).alias("_l"))
        rows = whole.select("z", "x", F.array_join(F.transform("_l", lambda s: s["seq"]), "").alias("sequence"))
        return {place: found[0] for place, found in self.grouped(rows).items()}

    def empty(self, t: TileId):
        return {"sequence": ""}
