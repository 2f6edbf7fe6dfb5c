"""Overlap predicates and interval joins.

A range predicate between two tables plans as a nested loop. Tiles partition the axis, so an interval meets a tile exactly
if the tile's number is among those the interval covers: records are exploded to tile numbers and joined by equality.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.columns import tile_range
from tilewright.model.coords import Chromsizes, GenomicRange
from tilewright.model.policies import LinkPolicy


def any_of(ranges: list[GenomicRange], one: Callable[[GenomicRange], Column]) -> Column:
    """The alternatives for all ranges that hold anything; no range at all selects nothing, which is not the same as everything."""
    terms = [one(r) for r in ranges if not r.is_out_of_bounds and r.end > r.start]
    return reduce(or_, terms) if terms else F.lit(False)


def overlaps(ranges: list[GenomicRange], chromsizes: Chromsizes | None = None, chrom: str = "chrom", start: str = "start", end: str = "end") -> Column:
    """Half-open records that meet any of the ranges. A wholly covered contig needs no position test, a covered genome no test."""
    whole = dict(zip(chromsizes.names, chromsizes.lengths)) if chromsizes else {}
    covered = {r.name for r in ranges if r.name in whole and r.start <= 0 and r.end >= whole[r.name]}
    if whole and covered == set(whole):
        return F.lit(True)

    def one(r: GenomicRange) -> Column:
        same = F.col(chrom) == r.name
        return same if r.name in covered else same & (F.col(end) > r.start) & (F.col(start) < r.end)

    return any_of(ranges, one)


def overlaps_1based(ranges: list[GenomicRange], chrom: str = "chrom", start: str = "start", end: str = "end") -> Column:
    """Records with a 1-based start and an included end."""
    return any_of(ranges, lambda r: (F.col(chrom) == r.name) & (F.col(end) > r.start) & (F.col(start) <= r.end))


def overlaps_variant(ranges: list[GenomicRange], chrom: str = "chrom", pos: str = "pos", end: str = "end") -> Column:
    """Variants with a 1-based position and a 0-based exclusive end."""
    return any_of(ranges, lambda r: (F.col(chrom) == r.name) & (F.col(pos) - 1 < r.end) & (F.col(end) > r.start))


def anchors_meet(x: list[GenomicRange], y: list[GenomicRange]) -> Column:
    """Pairs whose first anchor meets x and whose second meets y; the rectangle is not mirrored."""
    return overlaps(x, None, "chrom1", "start1", "end1") & overlaps(y, None, "chrom2", "start2", "end2")


def links_meet(ranges: list[GenomicRange], policy: LinkPolicy) -> Column:
    """Pairs shown in a 1D tile. Pairs between contigs have no span, so HULL treats them as EITHER."""
    a = overlaps(ranges, None, "chrom1", "start1", "end1")
    b = overlaps(ranges, None, "chrom2", "start2", "end2")
    if policy is LinkPolicy.BOTH:
        return a & b
    if policy is LinkPolicy.EITHER:
        return a | b
    lo, hi = F.least("start1", "start2"), F.greatest("end1", "end2")
    hull = any_of(ranges, lambda r: (F.col("chrom1") == r.name) & (lo < r.end) & (hi > r.start))
    return F.when(F.col("chrom1") == F.col("chrom2"), hull).otherwise(a | b)


def absolute_links_meet(lo: int, hi: int, policy: LinkPolicy, x: tuple[str, str] = ("fromX", "toX"), y: tuple[str, str] = ("fromY", "toY")) -> Column:
    """The same on absolute coordinates, where any two anchors have a span."""
    meets = lambda s, e: (F.col(s) < hi) & (F.col(e) > lo)
    if policy is LinkPolicy.BOTH:
        return meets(*x) & meets(*y)
    if policy is LinkPolicy.EITHER:
        return meets(*x) | meets(*y)
    return (F.least(x[0], y[0]) < hi) & (F.greatest(x[1], y[1]) > lo)


def known_contigs(df: DataFrame, chromsizes: DataFrame, *columns: str) -> DataFrame:
    """Rows all of whose contigs are known; to be applied before any cap or page."""
    names = chromsizes.select(F.col("chrom").alias("_known")).distinct()
    for c in columns or ("chrom",):
        df = df.join(names, F.col(c) == F.col("_known"), "left_semi")
    return df


def unknown_contigs(df: DataFrame, chromsizes: DataFrame, column: str = "chrom") -> DataFrame:
    names = chromsizes.select(F.col("chrom").alias("_known")).distinct()
    return df.join(names, F.col(column) == F.col("_known"), "left_anti")


def to_absolute(df: DataFrame, chromsizes: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end", prefix: str = "x") -> DataFrame:
    """Adds ``{prefix}_start``, ``{prefix}_end`` and ``{prefix}_offset``; rows on unknown contigs are dropped."""
    offsets = chromsizes.select(F.col("chrom").alias("_c"), F.col("chrom_offset").alias(f"{prefix}_offset"))
    joined = df.join(offsets, F.col(chrom) == F.col("_c")).drop("_c")
    return joined.withColumns({f"{prefix}_start": F.col(f"{prefix}_offset") + F.col(start), f"{prefix}_end": F.col(f"{prefix}_offset") + F.col(end)})


#: (zoom -> first and last requested tile, by runs of successive ones) along one axis
Runs = dict[int, list[tuple[int, int]]]


def runs_of(places: list[tuple[int, int]], most: int = 64) -> Runs:
    """The requested (zoom, position) as runs of successive tiles; with more than ``most`` runs at a zoom, the whole stretch is one."""
    out: Runs = {}
    for z, x in sorted(set(places)):
        own = out.setdefault(z, [])
        if own and x == own[-1][1] + 1:
            own[-1] = (own[-1][0], x)
        else:
            own.append((x, x))
    return {z: r if len(r) <= most else [(r[0][0], r[-1][1])] for z, r in out.items()}


def near(runs: Runs, widths: dict[int, int], start: str, end: str) -> Column:
    """Records that meet one of the runs: plain comparisons, which a scan can use to skip data."""
    return reduce(or_, [(F.col(start) < (b + 1) * widths[z]) & (F.col(end) > a * widths[z]) for z, r in runs.items() for a, b in r], F.lit(False))


def with_tiles(df: DataFrame, widths: dict[int, int], start: str, end: str, runs: Runs | None = None, name: str = "x") -> DataFrame:
    """A row per record, zoom and tile met, with z and the position ``name``. ``widths``: tile width of each zoom. ``runs``: only
    positions between the first and the last requested one of a zoom."""
    at = df.withColumn("_l", levels(widths, runs))
    return at.withColumn(name, F.explode(tiles_met(start, end, runs is not None))).withColumn("z", F.col("_l.z")).drop("_l")


def _level(z: int, w: int, runs: Runs | None) -> Column:
    ends = (runs[z][0][0], runs[z][-1][1]) if runs else ()
    return F.struct(F.lit(z).alias("z"), *[F.lit(v).cast("bigint").alias(n) for n, v in zip("wab", (w, *ends))])


def levels(widths: dict[int, int], runs: Runs | None) -> Column:
    """A row a zoom: its number ``z``, tile width ``w`` and, with ``runs``, the first and the last requested tile ``a`` and ``b``."""
    return F.explode(F.array(*[_level(z, w, runs) for z, w in widths.items()]))


def tiles_met(start: str, end: str, cut: bool) -> Column:
    """The tiles of [start, end) at the level in the column ``_l``, with ``cut`` only those from ``a`` to ``b``."""
    lo, hi, width = F.col(start), F.col(end), F.col("_l.w")
    if cut:
        lo, hi = F.greatest(lo, F.col("_l.a") * width), F.least(hi, (F.col("_l.b") + 1) * width)
    return tile_range(lo, hi, width)


def join_tiles(records: DataFrame, tiles: DataFrame, widths: dict[int, int], start: str = "x_start", end: str = "x_end", runs: Runs | None = None) -> DataFrame:
    """Records with each requested tile (columns z, x) that they meet, as an equi-join. With the ``runs`` of the requested tiles, the
    scan is cut to them and no record is expanded beyond them."""
    if runs is not None:
        records = records.where(near(runs, widths, start, end))
    return with_tiles(records, widths, start, end, runs).join(tiles, ["z", "x"])


def join_tiles_2d(
    records: DataFrame, tiles: DataFrame, widths: dict[int, int], xs: tuple[str, str], ys: tuple[str, str], runs: tuple[Runs, Runs] | None = None
) -> DataFrame:
    """The same for rectangles and tiles (z, x, y)."""
    if runs is not None:
        records = records.where(near(runs[0], widths, *xs) & near(runs[1], widths, *ys))
    across = with_tiles(records, widths, *xs, runs[0] if runs else None)
    level = F.create_map(*[x for z, w in widths.items() for x in (F.lit(z), _level(z, w, runs[1] if runs else None))])
    both = across.withColumn("_l", level[F.col("z")]).withColumn("y", F.explode(tiles_met(*ys, runs is not None))).drop("_l")
    return both.join(tiles, ["z", "x", "y"])
