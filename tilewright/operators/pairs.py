"""Reads and their mates, sequences and alignments as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_mates(reads: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen reads and the mates of those whose other end was not chosen, each read (qname, flag, pos) once.

    Ends are told apart by flag bits 64 and 128.
    """
    end = F.when(F.col("flag").bitwiseAND(64) != 0, 1).when(F.col("flag").bitwiseAND(128) != 0, 2)
    have = chosen.select("qname", end.alias("_end")).where("_end is not null").distinct()
    half = have.groupBy("qname").agg(F.count(F.lit(1)).alias("_n"), F.first("_end").alias("_has")).where("_n = 1").select("qname", (3 - F.col("_has")).alias("_end"))
    mates = reads.withColumn("_end", end).join(half, ["qname", "_end"], "left_semi").drop("_end")
    return chosen.unionByName(mates).dropDuplicates(["qname", "flag", "pos"])


def one_hot(df: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, pos, a, t, g, c, n, other), case-insensitive."""
    base = F.lower(F.col("_b"))
    flags = {b: (base == b).cast("int") for b in "atgcn"}
    rows = df.select(key, F.posexplode(F.split(seq, "")).alias("pos", "_b")).where("_b <> ''")
    return rows.select(key, "pos", *[v.alias(b) for b, v in flags.items()], (~base.isin(*"atgcn")).cast("int").alias("other"))


def position_weights(df: DataFrame, seq: str, alphabet: str = "ACGT", pseudocount: float = 0) -> DataFrame:
    """(pos, base, weight): relative frequencies of the letters of the alphabet at each place of aligned sequences; others do not count."""
    letters = df.select(F.posexplode(F.split(F.upper(seq), "")).alias("pos", "base")).where(F.col("base").isin(*alphabet))
    counts = letters.groupBy("pos", "base").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("pos").agg((F.sum("n") + pseudocount * len(alphabet)).alias("total"))
    full = totals.select("pos", "total", F.explode(F.array(*map(F.lit, alphabet))).alias("base"))
    return full.join(counts, ["pos", "base"], "left").select("pos", "base", ((F.coalesce("n", F.lit(0)) + pseudocount) / F.col("total")).alias("weight"))


def dictionary_codes(df: DataFrame, column: str) -> DataFrame:
    """(column, code): distinct values numbered from 0 in their order. Ranks are summed over range partitions, so no task sorts all."""
    from tilewright.runtime import Cut

    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    sorted_ = Cut(values.repartitionByRange(column).sortWithinPartitions(column).withColumn("_id", F.monotonically_increasing_id()), "codes").df
    part = F.shiftright("_id", 33)
    sizes = sorted_.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window as W

    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return sorted_.withColumn("_part", part).join(before, "_part").select(column, (F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).alias("code"))


def is_sorted(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """(group, out_of_order): how many rows are followed by a smaller one. ``order`` is a bigint, unique in the group; nulls are in order."""
    from tilewright.operators.blocks import block_lead

    steps = block_lead(df.select(*group, order, value), group, order, value, "_next")
    return steps.groupBy(*group).agg(F.count_if(F.col("_next") < F.col(value)).alias("out_of_order"))


def adjacent_runs(df: DataFrame, group: list[str], x: str) -> DataFrame:
    """(group, lo, hi): maximal runs of successive numbers, duplicates ignored."""
    from tilewright.operators.periods import periods_and_gaps

    unit = df.select(*group, F.col(x).cast("bigint").alias("_lo"), (F.col(x).cast("bigint") + 1).alias("_hi"))
    runs = periods_and_gaps(unit, group, "_lo", "_hi").where("kind = 'period'")
    return runs.select(*group, "lo", (F.col("hi") - 1).alias("hi"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that are in exactly one of the tables."""
    return a.subtract(b).unionByName(b.subtract(a))


def replaced_importance(df: DataFrame, key: str, importance: str, other: DataFrame) -> DataFrame:
    """``importance`` taken from ``other`` (columns key, importance) by key, 0 where it has none."""
    new = other.groupBy(key).agg(F.max(importance).alias("_new"))
    return df.drop(importance).join(new, key, "left").withColumn(importance, F.coalesce("_new", F.lit(0.0))).drop("_new")
