"""Caps, pages, samples and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def cap_per_group(df: DataFrame, group: list[str], cap: int | None, *order: Column, rank: str | None = None) -> DataFrame:
    """The first ``cap`` rows of every group; ``None`` keeps all, 0 none. Spark drops the others before the shuffle."""
    if cap is None:
        return df
    if cap <= 0:
        return df.limit(0)
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_rank") <= cap)
    return ranked.withColumnRenamed("_rank", rank) if rank else ranked.drop("_rank")


def first_per_key(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    return cap_per_group(df, key, 1, *order)


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> tuple[DataFrame, Column]:
    """A page of rows by ``order`` and whether more follow: one row beyond the page is asked for."""
    probe = df.orderBy(*order).offset(offset).limit(limit + 1)
    return probe.limit(limit), probe.agg((F.count(F.lit(1)) > limit).alias("more")).scalar()


def evenly_spaced(df: DataFrame, index: str, lo: int, hi: int, n: int) -> DataFrame:
    """Rows at ``n`` evenly spaced places of [lo, hi), both ends included; a place may be taken more than once."""
    step = (hi - 1 - lo) / (n - 1) if n > 1 else 0.0
    picks = df.sparkSession.range(n).select(F.floor(F.lit(float(lo)) + F.col("id") * F.lit(step)).cast("bigint").alias(index), F.col("id").cast("int").alias("slot"))
    return df.join(picks, index)


def weighted_sample(df: DataFrame, key: Column, weight: Column, n: int) -> DataFrame:
    """``n`` rows without replacement, chosen with probability by weight and fixed by the key: order by ln(u) / w."""
    from tilewright.functions.columns import stable_importance

    u = F.greatest(stable_importance(key), F.lit(2.0**-33))
    return df.where(weight > 0).withColumn("_w", F.log(u) / weight).orderBy(F.col("_w").desc()).limit(n).drop("_w")


def substring_index(df: DataFrame, name: str, importance: str, n: int) -> DataFrame:
    """For every substring of a name its ``n`` most important entries."""
    from tilewright.functions.columns import substrings

    hits = df.withColumn("substr", F.explode(substrings(F.col(name))))
    return cap_per_group(hits, ["substr"], n, F.col(importance).desc(), F.col(name), rank="place")
