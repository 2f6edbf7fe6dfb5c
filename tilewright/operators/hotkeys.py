"""Per-key results when a few keys hold most rows: aggregation as a tree of bounded merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: aggregate kind -> its state columns (suffix, how a value enters the state, how states merge)
_STATES = {
    "count": (("n", lambda c: F.count(c), F.sum),),
    "sum": (("s", lambda c: F.sum(c), F.sum),),
    "min": (("lo", lambda c: F.min(c), F.min),),
    "max": (("hi", lambda c: F.max(c), F.max),),
    "avg": (("s", lambda c: F.sum(c), F.sum), ("n", lambda c: F.count(c), F.sum)),
}


def tree_aggregate(
    df: DataFrame, keys: list[str], aggs: dict[str, tuple[str, Column]], fan_in: int = 8, leaves: int | None = None
) -> DataFrame:
    """``groupBy(keys).agg(...)`` where no task ever receives all partial states of a hot key.

    The leaves are the input splits, chunks of a fixed size (``spark.sql.files.maxPartitionBytes``), and each
    is combined locally by the map-side half of the first aggregation. Then ``fan_in`` neighbouring leaves are
    merged per round, so ``ceil(log_fan_in(leaves))`` rounds bring any key down to one state and a merge reads
    ``fan_in`` states of a key at most. ``aggs``: output name -> (count | sum | min | max | avg, column).

    Null keys form a group of their own; null values are ignored as by SQL aggregates (``count`` counts
    non-null values, so pass ``F.lit(1)`` to count rows; ``sum``/``avg`` of nothing is null); an empty table
    gives no rows. Columns that are neither keys nor used are dropped, so clashing names do not matter.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be 2 at least")
    unknown = {kind for kind, _ in aggs.values()} - set(_STATES)
    if unknown:
        raise ValueError(f"no such aggregate: {sorted(unknown)}")
    if leaves is None:
        leaves = df.rdd.getNumPartitions()
    key_names = [f"_k{i}" for i in range(len(keys))]
    states, first, merge = [], [], []
    for i, (kind, value) in enumerate(aggs.values()):
        for suffix, enter, again in _STATES[kind]:
            name = f"_a{i}{suffix}"
            states.append(name)
            first.append(enter(F.col(f"_v{i}")).alias(name))
            merge.append(again(F.col(name)).alias(name))
    tree = df.select(
        *[F.col(k).alias(n) for k, n in zip(keys, key_names)],
        *[value.alias(f"_v{i}") for i, (_, value) in enumerate(aggs.values())],
        F.expr(f"spark_partition_id() div {fan_in}").alias("_node"),
    )
    # the last round merges by key alone, so that a key comes out once even if the input has more partitions when it is run
    nodes = -(-leaves // fan_in)
    tree = tree.groupBy(*key_names, *["_node"][: nodes > 1]).agg(*first)
    while nodes > 1:
        nodes = -(-nodes // fan_in)
        tree = tree.withColumn("_node", F.expr(f"_node div {fan_in}")).groupBy(*key_names, *["_node"][: nodes > 1]).agg(*merge)
    out = [F.col(n).alias(k) for k, n in zip(keys, key_names)]
    for i, (name, (kind, _)) in enumerate(aggs.items()):
        if kind == "avg":
            out.append(F.when(F.col(f"_a{i}n") > 0, F.col(f"_a{i}s") / F.col(f"_a{i}n")).alias(name))
        else:
            out.append(F.col(f"_a{i}{_STATES[kind][0][0]}").alias(name))
    return tree.select(*out)


def hot_keys(df: DataFrame, key: str, share: float = 0.05, fan_in: int = 8) -> DataFrame:
    """(key, rows) of every non-null key that holds more than ``share`` of all rows of the table.

    Rows with a null key count towards the total and are never reported; an empty table gives no rows.
    """
    counts = tree_aggregate(df, [key], {"rows": ("count", F.lit(1))}, fan_in)
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return counts.where(F.col(key).isNotNull() & (F.col("rows") > total * share))
