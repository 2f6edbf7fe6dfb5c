"""Binned signals and their pyramids, in run-length form: an interval counts by the bases it shares with a bin."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tilewright.functions.columns import nan_free, nan_sum, tile_range
from tilewright.operators.blocks import block_lead, block_running_sum
from tilewright.operators.periods import periods_and_gaps


def spread(df: DataFrame, start: str, end: str, binsize: int) -> DataFrame:
    """A row per interval and bin met, with ``bin`` and ``bases``, the shared length."""
    hit = df.withColumn("bin", F.explode(tile_range(F.col(start), F.col(end), binsize)))
    return hit.withColumn("bases", F.least(F.col(end), (F.col("bin") + 1) * binsize) - F.greatest(F.col(start), F.col("bin") * binsize))


def bin_stats(df: DataFrame, group: list[str], start: str, end: str, value: str, binsize: int) -> DataFrame:
    """Per bin: covered bases and mean, min, max, (population) std and sum over them; NaN and null values do not count."""
    v = nan_free(F.col(value))
    hit = spread(df.withColumn("_v", v).where("_v is not null"), start, end, binsize)
    w = F.col("bases")
    sums = hit.groupBy(*group, "bin").agg(
        F.sum(w).alias("n"), F.sum(F.col("_v") * w).alias("s"), F.sum(F.col("_v") * F.col("_v") * w).alias("q"), F.min("_v").alias("min"), F.max("_v").alias("max")
    )
    mean = F.col("s") / F.col("n")
    return sums.select(*group, "bin", F.col("n").alias("covered"), mean.alias("mean"), "min", "max", F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"), F.col("s").alias("sum"))


def with_spine(df: DataFrame, group: list[str], bins: DataFrame, fill: dict[str, float]) -> DataFrame:
    """Every row of the spine ``bins`` (group columns and ``bin``), what is missing filled: 0 inside a contig, NaN outside, as given."""
    return bins.join(df, [*group, "bin"], "left").fillna(fill)


def signal_pyramid(df: DataFrame, group: list[str], start: str, end: str, value: str, base: int, step: int, levels: int) -> DataFrame:
    """Levels of sums and NaN counts over bases: level k has bins of ``base * step**k``.

    Each level is made from the one below (``total``, ``nan_bases``, ``bases``), so only the first touches the intervals;
    ``mean`` leaves NaN bases out. Gaps are simply absent.
    """
    hit = spread(df, start, end, base)
    nan = F.isnan(value) | F.col(value).isNull()
    level = hit.groupBy(*group, "bin").agg(
        F.sum(F.when(~nan, F.col(value) * F.col("bases"))).alias("total"),
        F.sum(F.when(nan, F.col("bases")).otherwise(0)).alias("nan_bases"),
        F.sum("bases").alias("bases"),
    )
    out = [level.withColumn("level", F.lit(0))]
    for k in range(1, levels):
        level = level.groupBy(*group, F.floor(F.col("bin") / step).alias("bin")).agg(F.sum("total").alias("total"), F.sum("nan_bases").alias("nan_bases"), F.sum("bases").alias("bases"))
        out.append(level.withColumn("level", F.lit(k)))
    all_levels = reduce(DataFrame.unionByName, out)
    return all_levels.withColumn("mean", F.when(F.col("bases") > F.col("nan_bases"), F.col("total") / (F.col("bases") - F.col("nan_bases"))))


#: level aggregations of vectors; each takes the column of the level below
HALVING: dict[str, Callable[[str], Column]] = {
    "sum": lambda c: nan_sum(F.col(c)),
    "min": lambda c: F.min(nan_free(F.col(c))),
    "max": lambda c: F.max(nan_free(F.col(c))),
    "logsumexp": lambda c: F.max(c) + F.log(F.sum(F.exp(F.col(c) - F.col("_top")))),
}


def vector_pyramid(df: DataFrame, group: list[str], index: str, value: str, how: str | Callable[[str], Column], levels: int, duplicate_tail: bool = False) -> DataFrame:
    """Levels that halve ``index``: (group, level, index, value). ``how``: a name of ``HALVING`` or a column builder.

    ``duplicate_tail``: an odd level repeats its last row before it is halved, instead of standing alone.
    """
    own = HALVING[how] if isinstance(how, str) else how
    level = df.select(*group, F.col(index).alias("_i"), F.col(value).alias("_v"))
    out = [level.withColumn("level", F.lit(0))]
    for k in range(1, levels):
        if duplicate_tail:
            last = level.groupBy(*group).agg(F.max("_i").alias("_i")).where(F.col("_i") % 2 == 0)
            level = level.unionByName(level.join(last, [*group, "_i"], "left_semi"))
        half = level.withColumn("_i", F.floor(F.col("_i") / 2))
        if how == "logsumexp":
            top = half.groupBy(*group, "_i").agg(F.max("_v").alias("_top"))
            half = half.join(top, [*group, "_i"])
        level = half.groupBy(*group, "_i").agg(own("_v").alias("_v"))
        out.append(level.withColumn("level", F.lit(k)))
    return reduce(DataFrame.unionByName, out).select(*group, "level", F.col("_i").alias(index), F.col("_v").alias(value))


def range_pyramid(df: DataFrame, group: list[str], index: str, value: str, step: int, levels: int) -> DataFrame:
    """Sum, true min and true max per level of ``step**k`` values."""
    level = df.groupBy(*group, F.col(index).alias("bin")).agg(nan_sum(F.col(value)).alias("sum"), F.min(nan_free(F.col(value))).alias("min"), F.max(nan_free(F.col(value))).alias("max"))
    out = [level.withColumn("level", F.lit(0))]
    for k in range(1, levels):
        level = level.groupBy(*group, F.floor(F.col("bin") / step).alias("bin")).agg(nan_sum(F.col("sum")).alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"))
        out.append(level.withColumn("level", F.lit(k)))
    return reduce(DataFrame.unionByName, out)


def matrix_pyramid(df: DataFrame, row: str, col: str, value: str, levels: int) -> DataFrame:
    """2 x 2 sums without NaN: (level, row, col, value)."""
    level = df.select(F.col(row).alias("row"), F.col(col).alias("col"), F.col(value).alias("value"))
    out = [level.withColumn("level", F.lit(0))]
    for k in range(1, levels):
        level = level.groupBy(F.floor(F.col("row") / 2).alias("row"), F.floor(F.col("col") / 2).alias("col")).agg(F.coalesce(F.sum(nan_free(F.col("value"))), F.lit(0.0)).alias("value"))
        out.append(level.withColumn("level", F.lit(k)))
    return reduce(DataFrame.unionByName, out)


#: functions over rows of a group; those of NumPy, so deviations are of the population
ROW_FUNCTIONS: dict[str, Callable[[str], Column]] = {
    "sum": F.sum, "mean": F.avg, "median": lambda c: F.percentile(c, 0.5), "std": F.stddev_pop, "var": F.var_pop, "min": F.min, "max": F.max,
}


def aggregate_row_groups(df: DataFrame, row: str, keep: list[str], value: str, groups: list[list[int]], function: str) -> DataFrame:
    """(group_no, keep..., value): rows combined by groups that may overlap, repeat and be in any order."""
    if function not in ROW_FUNCTIONS:
        raise ValueError(f"{function!r} is none of {sorted(ROW_FUNCTIONS)}")
    if any(not g for g in groups):
        raise ValueError("a group of rows is empty")
    pairs = df.sparkSession.createDataFrame([(g, r) for g, rows in enumerate(groups) for r in rows], f"group_no int, {row} bigint")
    return df.join(pairs, row).groupBy("group_no", *keep).agg(ROW_FUNCTIONS[function](value).alias(value))


def coverage(spans: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """(group, lo, hi, depth): stretches of equal depth > 0, from a running sum of starts and ends. Group columns must not be null."""
    edges = spans.select(*group, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("_e"))
    steps = edges.groupBy(*group, F.col("_e.at").alias("lo")).agg(F.sum("_e.d").alias("_d")).where("_d != 0")
    depth = block_running_sum(steps, group, "lo", "_d", "depth")
    return block_lead(depth, group, "lo", "lo", "hi").where("depth > 0").select(*group, "lo", "hi", "depth")


def histogram_2d(df: DataFrame, x: str, y: str, bounds: tuple[float, float, float, float], bins: int = 256) -> DataFrame:
    """Counts of points strictly inside ``bounds`` (x0, y0, x1, y1) in equal bins; empty bins are absent."""
    x0, y0, x1, y1 = map(float, bounds)
    inside = df.where((F.col(x) > x0) & (F.col(x) < x1) & (F.col(y) > y0) & (F.col(y) < y1))
    cell = lambda c, lo, hi: F.least(F.floor((F.col(c) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    return inside.groupBy(cell(x, x0, x1).alias("x_bin"), cell(y, y0, y1).alias("y_bin")).agg(F.count(F.lit(1)).alias("n"))


def data_extent(df: DataFrame, x: str, y: str) -> tuple[float, float, float, float]:
    r = df.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
    return tuple(map(float, r))


def fill_gaps(df: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """(group, lo, hi) of the exact half-open gaps between successive intervals sorted by start."""
    return periods_and_gaps(df, group, start, end).where("kind = 'gap'").select(*group, "lo", "hi")


def reconcile(df: DataFrame, tile: list[str], order: str, span: str, bins: str, binsize: str, threshold: float = 0.5) -> DataFrame:
    """Adds ``drop``: whether an interval gives up its last bin, so that a tile has as many bins as its width.

    With the excess E of bin widths over spans so far, floor(E / binsize - threshold) + 1 bins are too many; an interval
    drops one if more are due than were dropped before it, and none if it has no bins. The intervals of a tile are few, so they are one list.
    """
    w = W.partitionBy(*tile).orderBy(order)
    excess = F.sum(F.col(binsize) * F.col(bins) - F.col(span)).over(w.rowsBetween(W.unboundedPreceding, 0))
    due = df.withColumn("_due", F.when(F.col(bins) > 0, F.floor(excess / F.col(binsize) - threshold) + 1))
    listed = due.groupBy(*tile).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_due").alias("d"), F.struct(*df.columns).alias("r")))).alias("_l"))
    rows = F.transform("_l", lambda x: x["d"])
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast("array<boolean>").alias("out"))

    def step(acc, d):
        drop = F.coalesce(d > acc["n"], F.lit(False))
        return F.struct((acc["n"] + drop.cast("bigint")).alias("n"), F.concat(acc["out"], F.array(drop)).alias("out"))

    both = F.arrays_zip(F.transform("_l", lambda x: x["r"]).alias("r"), F.aggregate(rows, start, step, lambda acc: acc["out"]).alias("drop"))
    return listed.select(F.explode(both).alias("_b")).select("_b.r.*", "_b.drop")
