"""Parquet stores of multi-resolution data: written once, then served by partition pruning.

A store is a folder with one table ``data``, partitioned by its zoom or level, and one-row metadata in ``info``.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.columns import stable_importance
from tilewright.model.coords import Chromsizes
from tilewright.model.info import TilesetInfo
from tilewright.operators import contacts, overlap, placement, signal


def write_store(df: DataFrame, path: str, info: TilesetInfo, level: str, order: list[str]) -> None:
    """Rows of a level lie together and sorted, so that Parquet statistics skip what a tile does not meet."""
    df.repartitionByRange(level, *order).sortWithinPartitions(level, *order).write.mode("overwrite").partitionBy(level).parquet(f"{path}/data")
    df.sparkSession.createDataFrame([(info.to_json(),)], "info string").coalesce(1).write.mode("overwrite").parquet(f"{path}/info")


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame, TilesetInfo]:
    d = json.loads(spark.read.parquet(f"{path}/info").first()["info"])
    known = {k: d.pop(k) for k in ("tile_size", "max_zoom", "max_width", "resolutions", "chromsizes", "min_pos", "max_pos") if k in d}
    for k in ("resolutions", "min_pos", "max_pos"):
        known[k] = tuple(known[k]) if known.get(k) else None
    if known.get("chromsizes"):
        known["chromsizes"] = tuple((n, length) for n, length in known["chromsizes"])
    return spark.read.parquet(f"{path}/data"), TilesetInfo(**known, extra=d)


def importance_of(df: DataFrame, rule: str | int | None, size: str, key: list[str], fields: str = "fields") -> DataFrame:
    """Adds ``importance``: ``size`` (also the default), ``random`` (fixed by the record), or the 1-based number of a field."""
    if rule in (None, "size"):
        value = F.expr(size).cast("double")
    elif rule == "random":
        value = stable_importance(F.concat_ws("\t", *key))
    else:
        value = F.get(F.col(fields), F.lit(int(rule) - 1)).try_cast("double")
    return df.withColumn("importance", value)


def bed_to_store(bed: DataFrame, chromsizes: Chromsizes, path: str, importance: str | int | None = None, max_per_tile: int = 100, tile_size: int = 1024, chromosome: str | None = None) -> TilesetInfo:
    """Places bed records (chrom, start, end, rest) in zoom levels by importance. Ends in the wrong order are swapped."""
    spark = bed.sparkSession
    rows = bed.where(F.col("chrom") == chromosome) if chromosome else bed
    rows = rows.withColumns({"start": F.least("start", "end"), "end": F.greatest("start", "end")})
    placed = overlap.to_absolute(rows, chromsizes.frame(spark))
    own = F.array(F.col("chrom"), F.col("start").cast("string"), F.col("end").cast("string"))
    placed = placed.withColumn("fields", F.when(F.coalesce("rest", F.lit("")) == "", own).otherwise(F.concat(own, F.split("rest", "\t"))))
    placed = importance_of(placed, importance, "x_end - x_start", ["chrom", "start", "end", "rest"])
    info = TilesetInfo.quadtree(chromsizes, tile_size, version=3)
    return _stratify(placed, path, info, ["x_start", "x_end"], placement.interval_tiles(F.col("x_start"), F.greatest(F.col("x_end"), F.col("x_start") + 1), info.max_zoom, info.max_width), max_per_tile)


def bedpe_to_store(pairs: DataFrame, chromsizes: Chromsizes, path: str, importance: str | int | None = "random", max_per_tile: int = 100, tile_size: int = 1024, chromosome: str | None = None) -> TilesetInfo:
    """Places pairs (chrom1, start1, ..., rest) in zoom levels; a tile takes one more than ``max_per_tile``. ``None``: by the longer side."""
    spark = pairs.sparkSession
    rows = pairs.where((F.col("chrom1") == chromosome) | (F.col("chrom2") == chromosome)) if chromosome else pairs
    frame = chromsizes.frame(spark)
    placed = overlap.to_absolute(rows, frame, "chrom1", "start1", "end1", "x")
    placed = overlap.to_absolute(placed, frame, "chrom2", "start2", "end2", "y")
    own = F.array(*[F.col(c).cast("string") for c in ("chrom1", "start1", "end1", "chrom2", "start2", "end2")])
    placed = placed.withColumn("fields", F.when(F.coalesce("rest", F.lit("")) == "", own).otherwise(F.concat(own, F.split("rest", "\t"))))
    placed = importance_of(placed, importance, "greatest(x_end - x_start, y_end - y_start)", ["chrom1", "start1", "end1", "chrom2", "start2", "end2", "rest"])
    info = TilesetInfo.quadtree(chromsizes, tile_size, ndim=2, version=1)
    tiles = placement.rectangle_tiles((F.col("x_start"), F.col("x_end")), (F.col("y_start"), F.col("y_end")), info.max_zoom, float(info.max_width))
    return _stratify(placed, path, info, ["x_start", "y_start"], tiles, max_per_tile + 1)


def geo_to_store(features: DataFrame, path: str, max_per_tile: int = 20, tile_size: int = 256, max_zoom: int = 19) -> TilesetInfo:
    """Places GeoJSON features in Mercator tiles by the area of their boxes; a tile takes one more than ``max_per_tile``."""
    from tilewright.functions.columns import mercator_tile

    rows = features.withColumn("importance", (F.col("max_lng") - F.col("min_lng")) * (F.col("max_lat") - F.col("min_lat")))
    tiles = []
    for z in range(max_zoom + 1):
        x0, y1 = mercator_tile(F.col("min_lng"), F.col("min_lat"), z)
        x1, y0 = mercator_tile(F.col("max_lng"), F.col("max_lat"), z)
        tiles.append(placement._crossed(F.sequence(F.floor(x0), F.floor(x1)), F.sequence(F.floor(y0), F.floor(y1))))
    info = TilesetInfo(tile_size=tile_size, max_zoom=max_zoom, max_width=360, extra={"projection": "mercator"})
    return _stratify(rows, path, info, ["min_lng", "min_lat"], tiles, max_per_tile + 1)


def _stratify(rows: DataFrame, path: str, info: TilesetInfo, order: list[str], tiles: list, cap: int) -> TilesetInfo:
    from tilewright.runtime import Cut

    known = Cut(rows.withColumn("uid", F.monotonically_increasing_id()), "rows").df
    zooms = placement.place(known, "uid", "importance", tiles, cap)
    write_store(known.join(zooms, "uid"), path, info, "zoom_level", order)
    return info


def bedgraph_to_store(values: DataFrame, chromsizes: Chromsizes, path: str, tile_size: int = 1024, zoom_step: int = 8, base: int = 1) -> TilesetInfo:
    """Sums, NaN counts and means of a signal, a level every ``zoom_step`` zooms; levels between are made when read."""
    placed = overlap.to_absolute(values, chromsizes.frame(values.sparkSession))
    info = TilesetInfo.quadtree(chromsizes, tile_size, zoom_step=zoom_step, base=base)
    levels = max(1, -(-info.max_zoom // zoom_step) + 1)
    write_store(signal.signal_pyramid(placed, [], "x_start", "x_end", "value", base, 1 << zoom_step, levels), path, info, "level", ["bin"])
    return info


def vectors_to_store(vectors: DataFrame, chromsizes: Chromsizes, path: str, base: int, tile_size: int = 256, how: str = "sum", row_infos: list[str] | None = None) -> TilesetInfo:
    """Multi-row vectors (chrom, start, values) at resolutions ``base * 2**k`` contig by contig: (chrom, row, bin, value) a level."""
    long = vectors.select("chrom", F.floor(F.col("start") / base).alias("bin"), F.posexplode("values").alias("row", "value"))
    widest = max(chromsizes.lengths)
    levels = max(1, (-(-widest // (base * tile_size)) - 1).bit_length() + 1)
    resolutions = tuple(base << k for k in range(levels))
    info = TilesetInfo(tile_size=tile_size, resolutions=resolutions, chromsizes=tuple(zip(chromsizes.names, chromsizes.lengths)), extra={"row_infos": row_infos})
    write_store(signal.vector_pyramid(long, ["chrom", "row"], "bin", "value", how, levels), path, info, "level", ["chrom", "bin"])
    return info


def matrix_to_store(cells: DataFrame, path: str, size: int, tile_size: int = 256) -> TilesetInfo:
    """A dense matrix and its 2 x 2 sums."""
    levels = max(1, (-(-size // tile_size) - 1).bit_length() + 1)
    info = TilesetInfo(tile_size=tile_size, max_zoom=levels - 1, max_width=tile_size << (levels - 1), extra={"shape": [size, size]})
    write_store(signal.matrix_pyramid(cells, "row", "col", "value", levels), path, info, "level", ["row", "col"])
    return info


def pixels_to_store(pixels: DataFrame, path: str, resolutions: list[int], base: int, chromsizes: Chromsizes) -> TilesetInfo:
    """Contacts (bin1_id, bin2_id, count) at coarser resolutions, each a multiple of ``base``; bins are counted over the whole genome."""
    from functools import reduce

    parts = []
    for r in resolutions:
        k = r // base
        parts.append(pixels.groupBy(F.floor(F.col("bin1_id") / k).alias("bin1_id"), F.floor(F.col("bin2_id") / k).alias("bin2_id")).agg(F.sum("count").alias("count")).withColumn("resolution", F.lit(r)))
    info = TilesetInfo(tile_size=256, resolutions=tuple(resolutions), chromsizes=tuple(zip(chromsizes.names, chromsizes.lengths)))
    all_levels = reduce(DataFrame.unionByName, parts)
    weights = reduce(DataFrame.unionByName, [contacts.marginal_weights(p).withColumn("resolution", F.lit(r)) for p, r in zip(parts, resolutions)])
    write_store(all_levels, path, info, "resolution", ["bin1_id", "bin2_id"])
    weights.write.mode("overwrite").parquet(f"{path}/weights")
    return info


#: rows of a depth store
DEPTH_ROWS = ("A", "T", "G", "C", "S", "M", "I", "D")


def depths_to_store(alignments: DataFrame, chromsizes: Chromsizes, path: str, base: int = 1, tile_size: int = 256) -> TilesetInfo:
    """Summed depths of bases and operations of aligned reads, as multi-row vectors. Stretches of equal depth are binned without expanding bases."""
    from tilewright.functions.reads import base_depths
    from tilewright.functions.columns import is_primary

    depths = base_depths(alignments.where(is_primary(F.col("flag"))).where(F.col("chrom").isin(*chromsizes.names)))
    number = F.create_map(*[F.lit(v) for i, r in enumerate(DEPTH_ROWS) for v in (r, i)])
    hit = signal.spread(depths, "lo", "hi", base)
    long = hit.groupBy("chrom", number[F.col("row")].alias("row"), "bin").agg(F.sum(F.col("depth") * F.col("bases")).cast("double").alias("value"))
    widest = max(chromsizes.lengths)
    levels = max(1, (-(-widest // (base * tile_size)) - 1).bit_length() + 1)
    info = TilesetInfo(tile_size=tile_size, resolutions=tuple(base << k for k in range(levels)), chromsizes=tuple(zip(chromsizes.names, chromsizes.lengths)), extra={"row_infos": list(DEPTH_ROWS)})
    write_store(signal.vector_pyramid(long, ["chrom", "row"], "bin", "value", "sum", levels), path, info, "level", ["chrom", "bin"])
    return info


def bed_to_promoted_store(bed: DataFrame, chromsizes: Chromsizes, path: str, importance: str | int | None = "random", max_per_tile: int = 256) -> TilesetInfo:
    """Lines that climb from their own zoom to coarser tiles with room, contig by contig, most important first."""
    from tilewright.runtime import Cut

    rows = bed.join(chromsizes.frame(bed.sparkSession), "chrom").withColumn("line", F.concat_ws("\t", "chrom", "start", "end", "rest"))
    rows = importance_of(rows.withColumn("fields", F.split("line", "\t")), importance, "end - start", ["line"])
    rows = Cut(rows.withColumn("_n", F.monotonically_increasing_id()), "lines").df
    order = F.struct((-F.col("importance")).alias("i"), F.col("_n").alias("n"))
    entries = placement.chrom_level_entries(rows.withColumn("_o", order), "start", "end", "len", "_o")
    found = Cut(placement.promote(entries, max_per_tile).select("chrom", "zoom", "tile", F.col("seq._o.i").alias("rank"), F.col("seq._o.n").alias("seq"), "line"), "promoted").df
    info = TilesetInfo(tile_size=1, max_zoom=found.agg(F.max("zoom")).first()[0] or 0, chromsizes=tuple(zip(chromsizes.names, chromsizes.lengths)), extra={"max_per_tile": max_per_tile})
    write_store(found.drop("rank"), path, info, "zoom", ["chrom", "tile"])
    return info
