"""Running totals and look-ahead over groups of any size.

A plain window puts a whole group into one task. Here a group is cut into blocks of ``2**bits`` values
of an integer order column that is distinct within the group, so a task sees one block at most; the
blocks' totals, one row each, are combined in a second, small window. Group and order columns must not be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def encoded(column: str) -> Column:
    """A group column as a string that is never null, so that joins and windows share one hash partitioning."""
    return F.when(F.col(column).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(column).cast("string")))


def decoded(column: str, kind: str) -> Column:
    return F.when(F.col(column) != "n", F.expr(f"substr({column}, 2)")).cast(kind)


def block_running_sum(df: DataFrame, group: list[str], order: str, value: str, out: str, bits: int = 16) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the group up to and including this one, by ``order``."""
    keys = [*group, "_block"]
    df = df.withColumn("_block", F.shiftright(F.col(order), bits))
    inner = df.withColumn("_in", F.sum(value).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    before = totals.withColumn(
        "_before", F.coalesce(F.sum("_total").over(W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).drop("_total")
    return (
        inner.join(before, keys, "left")
        .select(*[c for c in df.columns if c != "_block"], (F.col("_in") + F.col("_before")).alias(out))
    )


def block_lead(df: DataFrame, group: list[str], order: str, value: str, out: str, bits: int = 16) -> DataFrame:
    """Adds ``out``: ``value`` of the group's next row by ``order``, null for its last row."""
    keys = [*group, "_block"]
    df = df.withColumn("_block", F.shiftright(F.col(order), bits))
    inner = df.withColumn("_lead", F.lead(F.struct(F.col(value).alias("v"))).over(W.partitionBy(*keys).orderBy(order)))
    firsts = df.groupBy(*keys).agg(F.min_by(F.struct(F.col(value).alias("v")), F.col(order)).alias("_first"))
    after = firsts.withColumn("_after", F.lead("_first").over(W.partitionBy(*group).orderBy("_block"))).drop("_first")
    return (
        inner.join(after, keys, "left")
        .select(*[c for c in df.columns if c != "_block"], F.coalesce(F.col("_lead"), F.col("_after"))["v"].alias(out))
    )
