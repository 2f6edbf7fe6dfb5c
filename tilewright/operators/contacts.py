"""Sparse symmetric matrices: balancing, mirroring and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.columns import nan_free

# Balancing weights that divide instead of multiplying.
DIVISIVE = ("KR", "VC", "VC_SQRT")


def marginal_weights(pixels: DataFrame) -> DataFrame:
    """(bin_id, weight): 1 / sqrt of what the bin's pixels sum to."""
    ends = pixels.select(F.explode(F.array("bin1_id", "bin2_id")).alias("bin_id"), "count")
    return ends.groupBy("bin_id").agg((F.lit(1.0) / F.sqrt(F.sum("count"))).alias("weight"))


def balanced(pixels: DataFrame, bins: DataFrame, weight: str = "weight") -> DataFrame:
    """Adds ``balanced``: the count times (for divisive weights, over) the weights of both bins; null where one is missing."""
    factor = F.lit(1.0) / F.col(weight) if weight in DIVISIVE else F.col(weight)
    w = bins.select("bin_id", factor.alias("_w"))
    one = pixels.join(w.withColumnsRenamed({"bin_id": "bin1_id", "_w": "_w1"}), "bin1_id", "left")
    two = one.join(w.withColumnsRenamed({"bin_id": "bin2_id", "_w": "_w2"}), "bin2_id", "left")
    return two.withColumn("balanced", F.col("count") * F.col("_w1") * F.col("_w2")).drop("_w1", "_w2")


def mirrored(pixels: DataFrame) -> DataFrame:
    """Both triangles of a matrix stored as its upper one."""
    others = [c for c in pixels.columns if c not in ("bin1_id", "bin2_id")]
    swapped = pixels.where("bin1_id <> bin2_id").select(F.col("bin2_id").alias("bin1_id"), F.col("bin1_id").alias("bin2_id"), *others)
    return pixels.unionByName(swapped)


def block(pixels: DataFrame, rows: tuple[int, int], cols: tuple[int, int], value: str = "count") -> DataFrame:
    """(row, col, value) of a rectangle, relative to its corner; absent pixels are absent (they are 0)."""
    inside = mirrored(pixels).where(F.col("bin1_id").between(rows[0], rows[1] - 1) & F.col("bin2_id").between(cols[0], cols[1] - 1))
    return inside.select((F.col("bin1_id") - rows[0]).alias("row"), (F.col("bin2_id") - cols[0]).alias("col"), F.col(value).alias("value"))


def bin_offsets(chromsizes: DataFrame, binsize: int) -> DataFrame:
    """(chrom, first_bin, n_bins): bins are counted contig by contig, the last of each being short. Contigs are few."""
    from pyspark.sql import Window as W

    n = F.ceil(F.col("len") / binsize)
    before = F.coalesce(F.sum(n).over(W.orderBy("cid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return chromsizes.select("chrom", before.alias("first_bin"), n.alias("n_bins"))


def block_sums(df: DataFrame, row: str, col: str, value: str, size: int) -> DataFrame:
    """Sums of size x size blocks without NaN; a sum of 0 is null."""
    return df.groupBy(F.floor(F.col(row) / size).alias("row"), F.floor(F.col(col) / size).alias("col")).agg(F.nullif(F.sum(nan_free(F.col(value))), F.lit(0.0)).alias("value"))


def transforms_everywhere(columns: DataFrame, level: str, name: str) -> DataFrame:
    """Names present at every level."""
    levels = columns.agg(F.count_distinct(level)).scalar()
    return columns.groupBy(name).agg(F.count_distinct(level).alias("n")).where(F.col("n") == levels).select(name)


def nonempty_tiles(points: DataFrame, x: str, y: str, max_zoom: int, width: float) -> DataFrame:
    """(z, x, y, n) of all quadtree tiles that hold points; each level is made from the one below, so empty branches never appear."""
    from functools import reduce

    w = width / (1 << max_zoom)
    level = points.groupBy(F.floor(F.col(x) / w).alias("x"), F.floor(F.col(y) / w).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    out = [level.withColumn("z", F.lit(max_zoom))]
    for z in range(max_zoom - 1, -1, -1):
        level = level.groupBy(F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("y") / 2).alias("y")).agg(F.sum("n").alias("n"))
        out.append(level.withColumn("z", F.lit(z)))
    return reduce(DataFrame.unionByName, out)
