"""Equi-joins whose keys may be very uneven: frequent keys are found first and spread over several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a key with more than this share of the rows is spread
SHARE = 1 / 512


def frequent_hashes(df: DataFrame, keys: list[str], share: float = SHARE) -> list[int]:
    """Hashes of all keys that hold more than ``share`` of the rows (rows with a null key left out), and perhaps of some that hold a little less.

    A frequent-items sketch of bounded size is merged over all partitions, so at most ``2 / share`` numbers come back, however many keys there are.
    """
    most = int(2 / share)
    hashes = df.where(" and ".join(f"`{k}` is not null" for k in keys)).select(F.xxhash64(*keys).alias("_h"))
    top = F.expr(f"approx_top_k(_h, {most}, {4 * most})")
    row = hashes.agg(F.count(F.lit(1)).alias("n"), top.alias("t")).first()
    # a count may be too large by what the sketch cannot tell apart, never too small
    return [] if not row["n"] else [r["item"] for r in row["t"] if r["count"] > share * row["n"]]


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner", salts: int = 16, hot: list[int] | None = None) -> DataFrame:
    """``many.join(one, keys, how)`` for ``inner``, ``left``, ``left_semi`` and ``left_anti``, where a key may hold any share of ``many``.

    Rows of ``many`` with a frequent key are spread over ``salts`` tasks and the rows of ``one`` with it are repeated for
    each; all others are joined as they are. ``hot``: hashes of the frequent keys, by default those of ``many``. Null keys match nothing.
    """
    hot = frequent_hashes(many, keys) if hot is None else hot
    if not hot:
        return many.join(one, keys, how)
    is_hot = F.xxhash64(*keys).isin(hot)
    others = [c for c in many.columns if c not in keys]
    spread = F.pmod(F.xxhash64(*(others or keys)), F.lit(salts)).cast("int")
    zero = F.lit(0)
    left = many.withColumn("_salt", F.when(is_hot, spread).otherwise(zero))
    right = one.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(zero, F.lit(salts - 1))).otherwise(F.array(zero))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
