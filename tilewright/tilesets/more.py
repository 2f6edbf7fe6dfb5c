"""Further tilesets: stored signals and matrices, point density, labels, images, map features, promoted lines, logos and pileups."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions import reads as R
from tilewright.functions.columns import lat_to_y, y_to_lat
from tilewright.functions.encode import dense_payload
from tilewright.model.errors import TileOutOfBounds
from tilewright.model.info import TilesetInfo
from tilewright.model.policies import TilePolicy
from tilewright.model.tileid import TileId
from tilewright.operators.overlap import with_tiles
from tilewright.operators.pairs import position_weights
from tilewright.operators.ranking import cap_per_group
from tilewright.tilesets.base import Tileset
from tilewright.tilesets.dense import DenseTileset


class StoredSignalTileset(DenseTileset):
    """A store of ``bedgraph_to_store``: the stored level just finer than a zoom is summed up to it; means leave NaN bases out.

    Bins without any value are NaN.
    """

    def __init__(self, spark: SparkSession, store: DataFrame, info: TilesetInfo, policy: TilePolicy | None = None):
        super().__init__(spark, info, policy)
        self.records = store

    def fetch(self, places, widths, modifier, settings):
        size, step, base, parts = self._info.tile_size, self._info.extra["zoom_step"], self._info.extra["base"], []
        stored = sorted(r["level"] for r in self.records.select("level").distinct().collect())
        for z, width in widths.items():
            binsize = width // size
            level = max((k for k in stored if base << (step * k) <= binsize), default=stored[0])
            k = max(1, binsize // (base << (step * level)))
            at = reduce(or_, [F.col("bin").between(a * size * k, (b + 1) * size * k - 1) for a, b in self.runs(places)[z]])
            rows = self.records.where((F.col("level") == level) & at).groupBy(F.floor(F.col("bin") / k).alias("_b"))
            rows = rows.agg(F.sum("total").alias("t"), F.sum("nan_bases").alias("n"), F.sum("bases").alias("b")).where("b > n")
            rows = rows.withColumn("x", F.floor(F.col("_b") / size)).join(places.where(F.col("z") == z), "x")
            parts.append(rows.select("z", "x", (F.col("_b") - F.col("x") * size).cast("int").alias("_at"), (F.col("t") / (F.col("b") - F.col("n"))).alias("_v")))
        return self.filled(parts, (size,), np.nan, {(r["z"], r["x"]): (1, size) for r in places.collect()})

    def empty(self, t: TileId):
        return dense_payload(np.full(self._info.tile_size, np.nan))


class MatrixTileset(DenseTileset):
    """A store of ``matrix_to_store``: cells outside the matrix are NaN. ``zero_is_nan`` shows sums of 0 as NaN."""

    ndim = 2

    def __init__(self, spark: SparkSession, store: DataFrame, info: TilesetInfo, zero_is_nan: bool = False, policy: TilePolicy | None = None):
        super().__init__(spark, info, policy)
        self.records, self.zero_is_nan = store, zero_is_nan

    def fetch(self, places, widths, modifier, settings):
        size, parts = self._info.tile_size, []
        for z in widths:
            level = self._info.max_zoom - z
            here = places.where(F.col("z") == z)
            near = [reduce(or_, [F.col(c).between(a * size, (b + 1) * size - 1) for a, b in self.runs(places, axis)[z]]) for c, axis in (("col", "x"), ("row", "y"))]
            rows = self.records.where((F.col("level") == level) & near[0] & near[1]).withColumns({"x": F.floor(F.col("col") / size), "y": F.floor(F.col("row") / size)}).join(here, ["x", "y"])
            at = ((F.col("row") - F.col("y") * size) * size + F.col("col") - F.col("x") * size).cast("int")
            value = F.nullif("value", F.lit(0.0)) if self.zero_is_nan else F.col("value")
            parts.append(rows.select("z", "x", "y", at.alias("_at"), value.cast("double").alias("_v")))
        return self.filled(parts, (size, size), np.nan, {(r["z"], r["x"], r["y"]): (size, size) for r in places.collect()})

    def empty(self, t: TileId):
        size = self._info.tile_size
        return dense_payload(np.full(size * size, np.nan)) | {"shape": [size, size]}


class DensityTileset(DenseTileset):
    """Counts of points (x, y) in the cells of a tile; empty cells are NaN. The extent is the square around all points."""

    ndim = 2

    def __init__(self, spark: SparkSession, points: DataFrame, max_zoom: int = 30, bins: int = 256, policy: TilePolicy | None = None):
        r = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
        if r[0] is None:
            raise ValueError("there are no points")
        self.corner, self.width = (float(r[0]), float(r[1])), max(float(r[2]) - float(r[0]), float(r[3]) - float(r[1])) or 1.0
        info = TilesetInfo(tile_size=bins, max_zoom=max_zoom, max_width=bins << max_zoom, min_pos=self.corner, max_pos=(float(r[2]), float(r[3])))
        super().__init__(spark, info, policy)
        self.points = points

    def fetch(self, places, widths, modifier, settings):
        size, parts = self._info.tile_size, []
        for z in widths:
            cell = self.width / ((1 << z) * size)
            top = (size << z) - 1  # the far edge belongs to the last cell
            place = lambda c, lo, cell=cell, top=top: F.least(F.floor((F.col(c) - lo) / cell), F.lit(top))
            cells = self.points.groupBy(place("x", self.corner[0]).alias("_i"), place("y", self.corner[1]).alias("_j")).agg(F.count(F.lit(1)).alias("_n"))
            rows = cells.withColumns({"x": F.floor(F.col("_i") / size), "y": F.floor(F.col("_j") / size)}).join(places.where(F.col("z") == z), ["x", "y"])
            at = ((F.col("_j") - F.col("y") * size) * size + F.col("_i") - F.col("x") * size).cast("int")
            parts.append(rows.select("z", "x", "y", at.alias("_at"), F.col("_n").cast("double").alias("_v")))
        return self.filled(parts, (size, size), np.nan, {(r["z"], r["x"], r["y"]): (size, size) for r in places.collect()})

    def empty(self, t: TileId):
        size = self._info.tile_size
        return dense_payload(np.full(size * size, np.nan)) | {"shape": [size, size]}


class LabelTileset(Tileset):
    """Labels (index, label, importance?) along an axis: a tile shows its most important ones, or evenly spaced ones without importances."""

    def __init__(self, spark: SparkSession, labels: DataFrame, n: int, tile_size: int = 16, policy: TilePolicy | None = None):
        depth = max(0, (-(-n // tile_size) - 1).bit_length())
        super().__init__(spark, TilesetInfo(tile_size=tile_size, max_zoom=depth, max_width=tile_size << depth), policy)
        self.labels, self.n = labels, n

    def fetch(self, places, widths, modifier, settings):
        size = self._info.tile_size
        width = F.create_map(*[F.lit(v) for z, w in widths.items() for v in (z, w)])[F.col("z")].cast("bigint")
        spans = places.select("z", "x", (F.col("x") * width).alias("_lo"), F.least(F.lit(self.n), (F.col("x") + 1) * width).alias("_hi")).where("_lo < _hi")
        if "importance" in self.labels.columns:
            hit = with_tiles(self.labels.withColumn("_end", F.col("index") + 1), widths, "index", "_end").join(spans, ["z", "x"])
            best = cap_per_group(hit, ["z", "x"], size, F.col("importance").desc(), F.col("index").desc(), rank="slot")
        else:  # both ends and evenly between, a label more than once if there are few
            step = (F.col("_hi") - 1 - F.col("_lo")) / max(1, size - 1)
            picks = spans.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("index", F.floor(F.col("_lo") + F.col("slot") * step))
            best = picks.join(self.labels, "index").withColumn("importance", F.lit(0.0))
        found = self.grouped(best.select("z", "x", "slot", "index", "label", "importance"), "slot")
        return {p: [{"x": r["index"], "label": r["label"], "importance": r["importance"]} for r in rows] for p, rows in found.items()}

    def empty(self, t: TileId):
        return []


class ImageTileset(Tileset):
    """Stored images (z, y, x, image)."""

    ndim = 2

    def __init__(self, spark: SparkSession, images: DataFrame, max_zoom: int, tile_size: int = 256, policy: TilePolicy | None = None):
        super().__init__(spark, TilesetInfo(tile_size=tile_size, max_zoom=max_zoom, max_width=tile_size << max_zoom), policy)
        self.images = images

    def fetch(self, places, widths, modifier, settings):
        rows = self.images.join(places, ["z", "x", "y"]).select("z", "x", "y", "image")
        return {(r["z"], r["x"], r["y"]): bytes(r["image"]) for r in rows.toLocalIterator()}

    def empty(self, t: TileId):
        return None


class GeoTileset(Tileset):
    """Placed map features (min_lng, min_lat, max_lng, max_lat, zoom_level, ...): a tile shows those of its zoom or a coarser one whose box meets it."""

    ndim = 2

    def __init__(self, spark: SparkSession, features: DataFrame, max_zoom: int = 19, policy: TilePolicy | None = None):
        super().__init__(spark, TilesetInfo(tile_size=256, max_zoom=max_zoom, max_width=256 << max_zoom), policy)
        self.features = features

    def fetch(self, places, widths, modifier, settings):
        n = F.pow(F.lit(2.0), F.col("z"))
        lng = lambda x: x / n * 360 - 180
        lat = lambda y: y_to_lat(F.lit(180.0) - y / n * 360)
        boxes = places.withColumns({"_w": lng(F.col("x")), "_e": lng(F.col("x") + 1), "_n": lat(F.col("y")), "_s": lat(F.col("y") + 1)})
        # the tile numbers of a feature at each requested zoom, one more to the west and north, as edges count for both neighbours
        zooms = F.explode(F.array(*[F.struct(F.lit(z).alias("z"), *[F.lit(v).cast("bigint").alias(k) for k, v in zip("abcd", self._hull(places, z))]) for z in widths]))
        mine = self.features.drop("z", "x", "y").withColumn("_l", zooms).where(F.col("zoom_level") <= F.col("_l.z"))
        size = F.pow(F.lit(2.0), F.col("_l.z"))
        x0, x1 = ((F.col(c) + 180) / 360 * size for c in ("min_lng", "max_lng"))
        y0, y1 = ((F.lit(180.0) - lat_to_y(F.greatest(F.least(F.col(c), F.lit(89.9)), F.lit(-89.9)))) / 360 * size for c in ("max_lat", "min_lat"))
        numbers = lambda a, b, lo, hi: F.filter(F.sequence(F.greatest(F.floor(a) - 1, lo), F.greatest(F.least(F.floor(b) + 1, hi), F.greatest(F.floor(a) - 1, lo))), lambda i: i <= hi)
        placed = mine.withColumn("x", F.explode(numbers(x0, x1, F.col("_l.a"), F.col("_l.b")))).withColumn("y", F.explode(numbers(y0, y1, F.col("_l.c"), F.col("_l.d"))))
        meets = (F.col("min_lng") <= F.col("_e")) & (F.col("max_lng") >= F.col("_w")) & (F.col("min_lat") <= F.col("_n")) & (F.col("max_lat") >= F.col("_s"))
        hit = placed.withColumn("z", F.col("_l.z")).drop("_l").join(boxes, self.key).where(meets)
        return self.grouped(hit.drop("_w", "_e", "_n", "_s"))

    @staticmethod
    def _hull(places: DataFrame, z: int) -> tuple[int, int, int, int]:
        here = [r for r in places.collect() if r["z"] == z]
        return min(r["x"] for r in here), max(r["x"] for r in here), min(r["y"] for r in here), max(r["y"] for r in here)

    def empty(self, t: TileId):
        return []


class PromotedTileset(Tileset):
    """Promoted lines (zoom, tile, seq, line) of one contig: a tile shows what it and its ancestors hold, coarse ones first, up to ``cap``."""

    def __init__(self, spark: SparkSession, entries: DataFrame, max_zoom: int, cap: int = 4096, policy: TilePolicy | None = None):
        super().__init__(spark, TilesetInfo(tile_size=1, max_zoom=max_zoom, max_width=1 << max_zoom), policy)
        self.entries, self.cap = entries, cap

    def fetch(self, places, widths, modifier, settings):
        above = places.withColumn("_k", F.explode(F.sequence(F.lit(0), "z")))
        above = above.select("z", "x", (F.col("z") - F.col("_k")).alias("zoom"), F.floor(F.col("x") / F.pow(F.lit(2), F.col("_k"))).alias("tile"))
        hit = above.join(self.entries, ["zoom", "tile"])
        best = cap_per_group(hit, ["z", "x"], self.cap, F.col("zoom"), F.col("seq"))
        return self.grouped(best.select("z", "x", "zoom", "seq", "line"), "zoom")

    def empty(self, t: TileId):
        return []


class LogoTileset(DenseTileset):
    """Position weights of aligned sequences: a row a letter, a column a position; NaN past the end."""

    def __init__(self, spark: SparkSession, sequences: DataFrame, length: int, seq: str = "seq", alphabet: str = "ACGT", tile_size: int = 256, policy: TilePolicy | None = None):
        depth = max(0, (-(-length // tile_size) - 1).bit_length())
        super().__init__(spark, TilesetInfo(tile_size=tile_size, max_zoom=depth, max_width=tile_size << depth, extra={"row_infos": list(alphabet)}), policy)
        self.weights, self.alphabet = position_weights(sequences, seq, alphabet), alphabet

    def fetch(self, places, widths, modifier, settings):
        size, parts = self._info.tile_size, []
        row = F.instr(F.lit(self.alphabet), F.col("base")) - 1
        for z, width in widths.items():
            k = width // size
            bins = self.weights.groupBy("base", F.floor(F.col("pos") / k).alias("_b")).agg(F.avg("weight").alias("w"))
            rows = bins.withColumn("x", F.floor(F.col("_b") / size)).join(places.where(F.col("z") == z), "x")
            parts.append(rows.select("z", "x", (row * size + F.col("_b") - F.col("x") * size).cast("int").alias("_at"), F.col("w").cast("double").alias("_v")))
        return self.filled(parts, (len(self.alphabet), size), np.nan, {(r["z"], r["x"]): (len(self.alphabet), size) for r in places.collect()})

    def empty(self, t: TileId):
        return dense_payload(np.full(len(self.alphabet) * self._info.tile_size, np.nan))


class PileupTileset(Tileset):
    """Sequences (id, seq, more columns) aligned to references laid end to end: the whole pileup is the tile at zoom 0; other places are out of bounds.

    ``references``: one sequence, or (id, sequence) pairs, to each of which every sequence is aligned; records are then called by both ids.
    Positions are 1-based on the references, and a further column ``extra`` is passed on. No record is left out.
    """

    def __init__(self, spark: SparkSession, sequences: DataFrame, references: str | list[tuple[str, str]], policy: TilePolicy | None = None):
        self.named = not isinstance(references, str)
        self.references = list(references) if self.named else [("", references)]
        total = sum(len(r) for _, r in self.references)
        width = 1 << max(0, (total - 1).bit_length())
        super().__init__(spark, TilesetInfo(tile_size=width, max_zoom=0, max_width=width), policy)
        self.sequences = sequences

    def _screen(self, t: TileId) -> None:
        if t.z or t.pos[0]:
            raise TileOutOfBounds("a pileup has one tile")

    def records(self) -> DataFrame:
        """(id, from, to, substitutions, extra) of every sequence and reference; ``substitutions`` as JSON."""
        offset, rows = 0, []
        for k, (name, seq) in enumerate(self.references):
            rows.append((k, name, seq, offset))
            offset += len(seq)
        refs = self.spark.createDataFrame(rows, "_k int, _name string, _ref string, _at int")
        extra = F.col("extra").cast("string") if "extra" in self.sequences.columns else F.lit(None).cast("string")
        mine = self.sequences.select(F.col("id").cast("string").alias("id"), F.coalesce("seq", F.lit("")).alias("seq"), extra.alias("extra"))
        pairs = mine.withColumn("_k", F.explode(F.lit([k for k, *_ in rows]))).join(refs, "_k")  # as many rows a sequence as there are references
        named = F.concat_ws("_", "id", "_name") if self.named else F.col("id")
        return pairs.select(
            named.alias("id"), (F.col("_at") + 1).alias("from"), (F.col("_at") + F.length("_ref")).alias("to"), _substitutions("_ref", "seq", "_at").alias("substitutions"), "extra"
        )

    def fetch(self, places, widths, modifier, settings):
        import json

        found = [r.asDict() for r in self.records().orderBy("id").toLocalIterator()]
        return {(0, 0): [{k: json.loads(v) if k == "substitutions" else v for k, v in r.items() if v is not None} for r in found]}

    def empty(self, t: TileId):
        return []


@F.pandas_udf(T.StringType())
def _substitutions(refs: pd.Series, seqs: pd.Series, at: pd.Series) -> pd.Series:
    import json

    out = []
    for (_, ref, query), offset in zip(R.global_alignments(refs.tolist(), seqs.tolist()), at):
        out.append(json.dumps([{**s, "pos": s["pos"] + int(offset)} for s in R.aligned_substitutions(ref, query)]))
    return pd.Series(out)
