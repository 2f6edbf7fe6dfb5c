"""Tilesets of dense values: signals, multi-row vectors and contact matrices."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.encode import dense_payload, tile_of_cells
from tilewright.model.coords import Chromsizes
from tilewright.model.errors import MalformedTileId, UnsupportedOption
from tilewright.model.info import TilesetInfo
from tilewright.model.policies import TilePolicy
from tilewright.model.tileid import ModifierSpec, TileId
from tilewright.operators import contacts, overlap, signal
from tilewright.tilesets.base import Tileset

#: what each mode of a signal tile shows of a bin, in order
MODES = {"mean": ("mean",), "min": ("min",), "max": ("max",), "std": ("std",), "sum": ("sum",), "minMax": ("min", "max"), "whisker": ("min", "max", "mean", "std")}


class DenseTileset(Tileset):
    def filled(self, parts: list[DataFrame], shape: tuple[int, ...], fill: float, inside: dict[tuple[int, ...], tuple[int, int]]) -> dict:
        """Payloads of the places of ``inside`` from rows (place, _at, _v), the values of a tile's cells, all in one job.

        ``inside``: how many rows and columns of a place lie within the data's extent; beyond it cells are NaN, within it ``fill`` if they
        have no value. Tiles are put together and encoded by the executors, and only their texts come back.
        """
        rows, columns = (1, shape[0]) if len(shape) == 1 else shape
        kinds = "z int, x bigint" + ", y bigint" * (self.ndim == 2)
        corners = self.spark.createDataFrame([(*p, *i) for p, i in inside.items()], f"{kinds}, _r int, _c int")
        cells = reduce(DataFrame.unionByName, parts).groupBy(*self.key).agg(F.collect_list(F.struct("_at", F.coalesce("_v", F.lit(float("nan"))).alias("_v"))).alias("_l"))
        tile = tile_of_cells(rows, columns, fill)("_l._at", "_l._v", "_r", "_c")
        out = {}
        for r in corners.join(cells, self.key, "left").select(*self.key, tile.alias("_p")).toLocalIterator():
            out[tuple(r[k] for k in self.key)] = r["_p"].asDict() | {"shape": list(shape)}
        return out


class SignalTileset(DenseTileset):
    """Intervals with values (x_start, x_end, value): holes within the genome are 0, bins past its end NaN."""

    modifiers = ModifierSpec(frozenset(MODES), "mean")

    def __init__(self, spark: SparkSession, values: DataFrame, chromsizes: Chromsizes, tile_size: int = 1024, policy: TilePolicy | None = None):
        super().__init__(spark, TilesetInfo.quadtree(chromsizes, tile_size, aggregation_modes=sorted(MODES)), policy)
        self.records, self.total = values, chromsizes.total_length

    @classmethod
    def from_bedgraph(cls, spark: SparkSession, path: str, chromsizes: Chromsizes, **more) -> SignalTileset:
        from tilewright.sources.text import read_bedgraph

        return cls(spark, overlap.to_absolute(read_bedgraph(spark, path), chromsizes.frame(spark)), chromsizes, **more)

    def fetch(self, places, widths, modifier, settings):
        shown, size, parts, inside = MODES[modifier], self._info.tile_size, [], {}
        for z, width in widths.items():
            binsize = width // size
            here = places.where(F.col("z") == z)
            runs = self.runs(places)[z]
            hit = overlap.join_tiles(self.values(binsize, [(a * width, (b + 1) * width) for a, b in runs]), here, {z: width}, runs={z: runs})
            stats = self.stats(hit.withColumns({"_a": F.greatest("x_start", F.col("x") * width), "_b": F.least("x_end", (F.col("x") + 1) * width)}), binsize)
            cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(s).alias("v")) for i, s in enumerate(shown)]))
            rows = stats.select("z", "x", "bin", cells.alias("_c"))
            parts.append(rows.select("z", "x", ((F.col("bin") - F.col("x") * size) * len(shown) + F.col("_c.i")).cast("int").alias("_at"), F.col("_c.v").alias("_v")))
            for r in here.collect():
                inside[z, r["x"]] = (1, self._inside(r["x"], width, binsize, len(shown)))
        return self.filled(parts, (size * len(shown),), 0.0, inside)

    def values(self, binsize: int, spans: list[tuple[int, int]]) -> DataFrame:
        """The intervals from which bins of this size are made; those outside the absolute ``spans`` may be missing."""
        return self.records

    def stats(self, hit: DataFrame, binsize: int) -> DataFrame:
        """What the modes show of each bin, from intervals cut to their tile (_a, _b)."""
        return signal.bin_stats(hit.select("z", "x", "_a", "_b", "value"), ["z", "x"], "_a", "_b", "value", binsize)

    def _inside(self, x: int, width: int, binsize: int, per_bin: int) -> int:
        return min(self._info.tile_size, -(-max(0, self.total - x * width) // binsize)) * per_bin

    def _blank(self, x: int, width: int, binsize: int, per_bin: int) -> np.ndarray:
        cells = np.zeros(self._info.tile_size * per_bin)
        cells[self._inside(x, width, binsize, per_bin) :] = np.nan
        return cells

    def empty(self, t: TileId):
        width = self._info.tile_width(t.z)
        return dense_payload(self._blank(t.pos[0], width, width // self._info.tile_size, len(MODES[t.modifier])))


class BigWigTileset(SignalTileset):
    """A bigWig file: of the file's index only what the requested tiles meet is followed, and wide bins are made from the stored
    summaries, the widest of which is at most half a bin. Deviations of summaries are those of their bases.

    The option ``cos`` of a tile id names another order of contigs among ``alternates``, by which that tile is served.
    """

    options = frozenset({"cos"})

    def __init__(
        self, spark: SparkSession, path: str, chromsizes: Chromsizes | None = None, tile_size: int = 1024, policy: TilePolicy | None = None, alternates: dict[str, Chromsizes] | None = None
    ):
        from tilewright.sources import binary

        super().__init__(spark, None, chromsizes or binary.bbi_chromsizes(path), tile_size, policy)
        self.path, self.sizes, self.reductions = path, Chromsizes(self._info.chromsizes), binary.bbi_reductions(path)
        self.alternates = {k: BigWigTileset(spark, path, c, tile_size, policy) for k, c in (alternates or {}).items()}

    def tiles(self, ids, options=None):
        by: dict[str | None, list[str]] = {}
        for i in ids:
            by.setdefault(TileId.parse(i, self.ndim, self.modifiers, self.options).option("cos"), []).append(i)
        if unknown := set(by) - {None} - set(self.alternates):
            raise UnsupportedOption(f"no coordinates are called {sorted(unknown)}")
        out = dict(super().tiles(by.pop(None, []), options))
        for name, some in by.items():
            other = self.alternates[name]
            plain = [i.partition(",")[0] for i in some]
            got = dict(other.tiles(plain, options))
            out |= {i: got[p] for i, p in zip(some, plain)}
        return [(i, out[i]) for i in ids]

    def _reduction(self, binsize: int) -> int | None:
        return max((r for r in self.reductions if 2 * r <= binsize), default=None)

    def values(self, binsize, spans):
        from tilewright.sources.binary import read_bbi

        ranges = [(g.name, g.start, g.end) for lo, hi in spans for g in self.sizes.invert(lo, hi) if not g.is_out_of_bounds]
        return overlap.to_absolute(read_bbi(self.spark, self.path, ranges=ranges, reduction=self._reduction(binsize)), self.sizes.frame(self.spark))

    def stats(self, hit, binsize):
        if self._reduction(binsize) is None:
            return super().stats(hit, binsize)
        parts = signal.spread(hit.where("covered > 0"), "_a", "_b", binsize)
        share = F.col("bases") / (F.col("x_end") - F.col("x_start"))
        sums = parts.groupBy("z", "x", "bin").agg(F.sum(F.col("covered") * share).alias("_n"), F.sum(F.col("sum") * share).alias("_s"), F.sum(F.col("squares") * share).alias("_q"), F.min("min").alias("min"), F.max("max").alias("max"))
        mean = F.col("_s") / F.col("_n")
        return sums.select("z", "x", "bin", mean.alias("mean"), "min", "max", F.sqrt(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0))).alias("std"), F.col("_s").alias("sum"))


class VectorTileset(DenseTileset):
    """Multi-row vectors (level, chrom, bin, row, value) at doubling resolutions; cells without a value are 0.

    The batch options ``aggGroups`` and ``aggFunc`` combine rows. Source bins go to the tile bin whose start is nearest.
    """

    def __init__(self, spark: SparkSession, store: DataFrame, info: TilesetInfo, n_rows: int, policy: TilePolicy | None = None):
        super().__init__(spark, info, policy)
        self.records, self.n_rows, self.chromsizes = store, n_rows, Chromsizes(info.chromsizes)

    def batch_options(self, options):
        if not options:
            return {}
        groups, function = options.get("aggGroups"), options.get("aggFunc")
        if set(options) - {"aggGroups", "aggFunc"} or groups is None or function not in signal.ROW_FUNCTIONS:
            raise MalformedTileId("row aggregation takes aggGroups and an aggFunc of " + ", ".join(sorted(signal.ROW_FUNCTIONS)))
        groups = [[g] if isinstance(g, int) else list(g) for g in groups]
        if any(not g or any(not isinstance(r, int) or not 0 <= r < self.n_rows for r in g) for g in groups):
            raise MalformedTileId(f"groups hold rows from 0 to {self.n_rows - 1}")
        return {"groups": groups, "function": function}

    def fetch(self, places, widths, modifier, settings):
        size, parts = self._info.tile_size, []
        ladder = sorted(self._info.resolutions, reverse=True)
        frame = self.chromsizes.frame(self.spark).select("chrom", "chrom_offset")
        groups = settings.get("groups")
        n = len(groups) if groups else self.n_rows
        for z, width in widths.items():
            binsize = ladder[z]
            level = len(ladder) - 1 - z
            at = F.floor((F.col("chrom_offset") + F.col("bin") * binsize) / binsize + 0.5)
            rows = self.records.where((F.col("level") == level) & self._meets(binsize, self.runs(places)[z])).join(frame, "chrom").withColumn("_b", at)
            rows = rows.withColumn("x", F.floor(F.col("_b") / size)).withColumn("z", F.lit(z)).join(places, ["z", "x"])
            rows = rows.groupBy("z", "x", "_b", "row").agg(F.max_by("value", F.struct("chrom_offset", "bin")).alias("value"))
            if groups:
                rows = signal.aggregate_row_groups(rows.withColumn("row", F.col("row").cast("bigint")), "row", ["z", "x", "_b"], "value", groups, settings["function"]).withColumnRenamed("group_no", "row")
            parts.append(rows.select("z", "x", (F.col("row") * size + F.col("_b") - F.col("x") * size).cast("int").alias("_at"), F.col("value").cast("double").alias("_v")))
        return self.filled(parts, (n, size), 0.0, {(r["z"], r["x"]): (n, size) for r in places.collect()})

    def _meets(self, binsize: int, runs: list[tuple[int, int]]):
        """The bins of each contig that the requested tiles may show, as comparisons for the scan."""
        width, terms = binsize * self._info.tile_size, []
        for a, b in runs:
            for g in self.chromsizes.invert(max(0, a * width - binsize), (b + 1) * width + binsize):
                if not g.is_out_of_bounds:
                    terms.append((F.col("chrom") == g.name) & (F.col("bin") >= g.start // binsize) & (F.col("bin") <= g.end // binsize))
        return reduce(or_, terms, F.lit(False))

    def empty(self, t: TileId):
        return dense_payload(np.zeros(self.n_rows * self._info.tile_size)) | {"shape": [self.n_rows, self._info.tile_size]}


class ContactTileset(DenseTileset):
    """Contacts (resolution, bin1_id, bin2_id, count) with optional weights (resolution, bin_id, weight): x are columns, y rows.

    The modifier ``default`` balances, ``none`` shows counts; cells past the genome and, if balanced, those of bins without a weight are NaN,
    absent contacts 0.
    """

    ndim = 2
    modifiers = ModifierSpec(frozenset({"default", "none"}), "default")

    def __init__(self, spark: SparkSession, pixels: DataFrame, weights: DataFrame | None, info: TilesetInfo, policy: TilePolicy | None = None):
        super().__init__(spark, info, policy)
        self.pixels, self.weights = pixels, weights
        self.total = Chromsizes(info.chromsizes).total_length

    def fetch(self, places, widths, modifier, settings):
        size, parts, inside = self._info.tile_size, [], {}
        for z in widths:
            binsize = self._info.resolution_for(z)
            xs, ys = ({z: self.runs(places, axis)[z]} for axis in "xy")
            at = lambda c, runs, z=z: reduce(or_, [F.col(c).between(a * size, (b + 1) * size - 1) for a, b in runs[z]])
            wanted = (at("bin1_id", ys) & at("bin2_id", xs)) | (at("bin1_id", xs) & at("bin2_id", ys))
            px = self.pixels.where((F.col("resolution") == binsize) & wanted).select("bin1_id", "bin2_id", "count")
            if modifier == "default" and self.weights is not None:
                px = contacts.balanced(px, self.weights.where(F.col("resolution") == binsize)).select("bin1_id", "bin2_id", F.col("balanced").alias("count"))
            full = contacts.mirrored(px).withColumns({"x": F.floor(F.col("bin2_id") / size), "y": F.floor(F.col("bin1_id") / size), "z": F.lit(z)})
            here = places.where(F.col("z") == z)
            at = ((F.col("bin1_id") - F.col("y") * size) * size + F.col("bin2_id") - F.col("x") * size).cast("int")
            parts.append(full.join(here, self.key).select(*self.key, at.alias("_at"), F.col("count").cast("double").alias("_v")))
            n = -(-self.total // binsize)
            if modifier == "default" and self.weights is not None:
                parts += self._weightless(here, binsize, n)
            for r in here.collect():
                inside[z, r["x"], r["y"]] = tuple(min(size, max(0, n - r[axis] * size)) for axis in "yx")
        return self.filled(parts, (size, size), 0.0, inside)

    def _weightless(self, here: DataFrame, binsize: int, n: int) -> list[DataFrame]:
        """NaN for every cell of the rows and columns whose bin has no weight."""
        size, out = self._info.tile_size, []
        known = self.weights.where((F.col("resolution") == binsize) & F.col("weight").isNotNull() & ~F.isnan("weight")).select(F.col("bin_id").alias("_bin"))
        for axis, other in ("yx", "xy"):
            last = lambda c: F.least((F.col(c) + 1) * size, F.lit(n)) - 1
            bins = here.where(F.col(axis) * size < n).where(F.col(other) * size < n).withColumn("_bin", F.explode(F.sequence(F.col(axis) * size, last(axis))))
            lost = bins.join(known, "_bin", "left_anti").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), last(other) - F.col(other) * size)))
            place = F.col("_bin") - F.col(axis) * size
            at = place * size + F.col("_i") if axis == "y" else F.col("_i") * size + place
            out.append(lost.select(*self.key, at.cast("int").alias("_at"), F.lit(float("nan")).alias("_v")))
        return out

    def _blank(self, x: int, y: int, binsize: int) -> np.ndarray:
        size = self._info.tile_size
        n = -(-self.total // binsize)
        cells = np.zeros((size, size))
        cells[max(0, n - y * size) :, :] = np.nan
        cells[:, max(0, n - x * size) :] = np.nan
        return cells.ravel()

    def empty(self, t: TileId):
        size = self._info.tile_size
        return dense_payload(self._blank(t.pos[0], t.pos[1], self._info.resolution_for(t.z))) | {"shape": [size, size]}
