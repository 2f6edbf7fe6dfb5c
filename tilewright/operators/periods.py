"""Continuous periods and gaps of interval sets.

Starts and ends are ranked independently per entity. With s(i) and e(i) the i-th smallest start and end, a gap
follows rank i exactly where s(i+1) > e(i); the end before and the start behind the gap are the paired
boundaries, and the periods lie between successive gaps. Ranks come from distinct boundary values with their
multiplicities: only the first row of a start value and the last row of an end value can touch a gap, so an
equi-join on the rank finds all gaps without comparing rows pairwise, and no group is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators.blocks import block_lead, block_running_sum, decoded, encoded

_NO_END = 9223372036854775807


def periods_and_gaps(df: DataFrame, group: list[str], lo: str, hi: str, bits: int = 16) -> DataFrame:
    """(group..., kind, lo, hi): ``kind`` is ``period`` or ``gap``; intervals are half-open [lo, hi).

    Intervals that overlap or touch belong to one period. Rows with a null bound are left out; a null in a group
    column is a value like any other. ``lo`` must not exceed ``hi``; an interval of length 0 is a point
    that counts as covered, so it may form a period of length 0. Repeated rows change nothing, an empty
    table gives no rows. Blocks of ``2**bits`` coordinates bound the work of a task.
    """
    names = [f"_g{i}" for i in range(len(group))]
    iv = df.where(F.col(lo).isNotNull() & F.col(hi).isNotNull()).select(
        *[encoded(g).alias(n) for g, n in zip(group, names)], F.col(lo).cast("long").alias("_lo"), F.col(hi).cast("long").alias("_hi")
    )
    ranks = {}
    for bound in ("_lo", "_hi"):
        runs = iv.groupBy(*names, F.col(bound).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        ranks[bound] = block_running_sum(runs, names, "_v", "_n", "_rank", bits)
    starts = ranks["_lo"].select(*names, (F.col("_rank") - F.col("_n")).alias("_at"), F.col("_v").alias("_s"))
    ends = ranks["_hi"].select(*names, F.col("_rank").alias("_at"), F.col("_v").alias("_e"))
    breaks = (
        starts.join(ends, [*names, "_at"])
        .where(F.col("_s") > F.col("_e"))
        .select(*names, "_e", "_s")
    )
    hull = iv.groupBy(*names).agg(F.min("_lo").alias("_first"), F.max("_hi").alias("_last"))
    outer = hull.select(
        *names,
        F.explode(
            F.array(
                F.struct(F.lit(None).cast("long").alias("e"), F.col("_first").alias("s")),
                F.struct(F.col("_last").alias("e"), F.lit(_NO_END).alias("s")),
            )
        ).alias("_b"),
    ).select(*names, F.col("_b.e").alias("_e"), F.col("_b.s").alias("_s"))
    edges = block_lead(breaks.unionByName(outer), names, "_s", "_e", "_next", bits)
    spans = edges.select(
        *names,
        F.explode(
            F.array(
                F.struct(F.lit("gap").alias("kind"), F.col("_e").alias("lo"), F.col("_s").alias("hi")),
                F.struct(F.lit("period").alias("kind"), F.col("_s").alias("lo"), F.col("_next").alias("hi")),
            )
        ).alias("_b"),
    ).where(F.col("_b.lo").isNotNull() & F.col("_b.hi").isNotNull() & (F.col("_b.lo") < _NO_END) & (F.col("_b.hi") < _NO_END))
    kinds = dict(df.dtypes)
    return spans.select(*[decoded(n, kinds[g]).alias(g) for g, n in zip(group, names)], "_b.kind", "_b.lo", "_b.hi")
