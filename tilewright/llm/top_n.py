"""The N best items of every group, by two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def top_n_per_group(
    df: DataFrame, group: list[str], score: str, tie: str, n: int = 10, salts: int = 16, place: str = "place"
) -> DataFrame:
    """(group..., ``place``, ``tie``): the ``n`` rows of highest ``score`` of each group, ties by ascending ``tie``.

    Each group is hashed by ``tie`` into ``salts`` subgroups; a subgroup keeps its best ``n``, and the survivors,
    ``salts * n`` per group at most, are ranked again. Spark drops what cannot be among the ``n`` best already before
    the first shuffle (a group limit in front of the window), so a group of any size costs a shuffle of few rows.

    Rows with a null or NaN score are left out. Null group values form a group; a null ``tie`` comes
    first among equal scores. Repeated rows each take a place, unless ``tie`` repeats too, which leaves their order open but
    not the result. Groups with fewer than ``n`` rows are given whole, an empty table gives no rows. Other columns are
    dropped, so clashing names do not matter.
    """
    if n < 1 or salts < 1:
        raise ValueError("n and salts must be 1 at least")
    names = [f"_g{i}" for i in range(len(group))]
    rows = df.select(*[F.col(g).alias(x) for g, x in zip(group, names)], F.col(score).alias("_score"), F.col(tie).alias("_tie"))
    rows = rows.where(F.col("_score").isNotNull() & ~F.isnan("_score")).withColumn("_salt", F.pmod(F.xxhash64("_tie"), F.lit(salts)).cast("int"))
    order = [F.col("_score").desc(), F.col("_tie").asc()]
    kept = rows.withColumn("_r", F.row_number().over(W.partitionBy(*names, "_salt").orderBy(*order))).where(F.col("_r") <= n).drop("_r")
    best = kept.withColumn("_r", F.row_number().over(W.partitionBy(*names).orderBy(*order))).where(F.col("_r") <= n)
    return best.select(*[F.col(x).alias(g) for g, x in zip(group, names)], F.col("_r").cast("int").alias(place), F.col("_tie").alias(tie))
