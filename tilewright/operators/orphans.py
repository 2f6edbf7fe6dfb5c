"""References to records that do not exist, exist too late or no longer, found with compressed bitmaps.

1. The keys of references and parents are sorted and numbered from 0 without holes. A key range is 65,536 successive codes.
2. The references of a field and month are one bitmap a key range. So are, for each month, the parents that appear in it and those
   that are withdrawn in it. A bitmap is stored as the sorted low halves of its codes where that is shorter, and as bits otherwise.
3. A parent is safe to refer to for a whole month if it appeared in an earlier one and is withdrawn in a later one or never: the union
   of the months before, without that of the withdrawals up to it. ``reference AND NOT safe`` leaves the codes in doubt, range by range.
4. The surviving bits are decoded to keys, and only references with these in their month are compared with exact times.

References are read and parsed once. Keys that many rows refer to are spread over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tilewright.operators.skew import salted_join
from tilewright.runtime import Cut

_EVER = -1_000_000
_BITS = 16
_RANGE = 1 << _BITS


def packed(low: np.ndarray) -> bytes:
    """A bitmap of one key range: the sorted 16-bit numbers if they are shorter than the bits of the range."""
    low = np.unique(np.asarray(low, np.uint16))
    if 2 * len(low) < _RANGE // 8:
        return low.tobytes()
    bits = np.zeros(_RANGE, bool)
    bits[low] = True
    return np.packbits(bits).tobytes()


def bits_of(container: bytes) -> np.ndarray:
    """The bits of a stored bitmap, eight a byte."""
    if len(container) == _RANGE // 8:
        return np.frombuffer(container, np.uint8)
    bits = np.zeros(_RANGE, bool)
    bits[np.frombuffer(container, np.uint16)] = True
    return np.packbits(bits)


@F.pandas_udf(T.BinaryType())
def _container(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(packed)


def _bitmaps(codes: DataFrame, by: list[str]) -> DataFrame:
    """(by..., _range, _map) from rows (by..., _code), which need not be distinct across tasks; a range has 65,536 codes at most."""
    low = F.collect_set(F.col("_code").bitwiseAND(_RANGE - 1).cast("int"))
    return codes.groupBy(*by, F.shiftright("_code", _BITS).alias("_range")).agg(low.alias("_l")).select(*by, "_range", _container("_l").alias("_map"))


def _doubtful(refs: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
    """The codes of one range whose parents are not safe in the month of the references."""
    events = sorted(zip(parents["_month"], parents["_gone"], parents["_map"]))
    seen, gone = np.zeros(_RANGE // 8, np.uint8), np.zeros(_RANGE // 8, np.uint8)
    at, found = 0, []
    for r in refs.sort_values("_month").itertuples(index=False):
        # withdrawals of the month itself count, appearances of it do not: those are stored as of the next one
        while at < len(events) and events[at][0] <= r[2]:
            target = gone if events[at][1] else seen
            np.bitwise_or(target, bits_of(events[at][2]), out=target)
            at += 1
        codes = np.flatnonzero(np.unpackbits(bits_of(r[4]) & ~(seen & ~gone)))
        found.append((r[0], r[1], r[2], codes + (int(r[3]) << _BITS)))
    times = [len(f[3]) for f in found]
    column = lambda i, kind: pd.Series(np.repeat(np.array([f[i] for f in found], kind), times), dtype=kind)
    return pd.DataFrame({"table_name": column(0, object), "ref_field": column(1, object), "_month": column(2, np.int32), "_code": np.concatenate([f[3] for f in found] or [np.zeros(0, np.int64)])})


def _numbered(dictionary: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``_code``: places in the order of ``by``, from 0 and without holes; range partitions are numbered each and summed up."""
    sorted_ = Cut(dictionary.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()), "dictionary").df
    part = F.shiftright("_id", 33)
    sizes = sorted_.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return sorted_.withColumn("_part", part).join(before, "_part").withColumn("_code", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_id")


def month_number(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts)


def targets(df: DataFrame, space: int, key: str, added: str, deleted: str) -> DataFrame:
    """One row per key of a referenced table: when it appeared first and, if every row of it is withdrawn, when last."""
    return df.where(F.col(key).isNotNull()).select(
        F.lit(space).alias("_space"), F.col(key).alias("_key"), F.col(added).alias("_added"), F.col(deleted).alias("_deleted")
    )


def references(df: DataFrame, table: str, field: str, space: int, key: str, rec_id: str, loaded: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).select(
        F.lit(table).alias("table_name"),
        F.lit(field).alias("ref_field"),
        F.lit(space).alias("_space"),
        F.col(key).alias("_key"),
        F.col(rec_id).alias("rec_id"),
        F.col(loaded).alias("_loaded"),
    )


def orphan_references(refs: list[DataFrame], parents: list[DataFrame]) -> DataFrame:
    """(table_name, ref_field, rec_id, load_month, reason) of every row of ``refs`` whose target is not there.

    ``refs`` come from ``references`` and ``parents`` from ``targets``; equal ``space`` numbers belong together. Reasons,
    first that applies: ``missing``, ``late`` (the target appears after the row was loaded), ``deleted`` (it
    was withdrawn by then). Null keys refer to nothing, the empty string is a key. A reference without a load time
    can only be ``missing`` and has a null ``load_month``; a target without a time of appearance was always there.
    Repeated rows are reported each by its ``rec_id``; empty tables give no rows.
    """
    where = ["table_name", "ref_field", "_key", "_month"]
    rows = Cut(reduce(DataFrame.unionByName, refs).withColumn("_month", F.coalesce(month_number(F.col("_loaded")), F.lit(_EVER))), "references").df
    asked = Cut(rows.select("_space", *where).distinct(), "asked").df
    none = F.lit(None).cast("timestamp_ntz")
    keys = asked.select("_space", "_key", none.alias("_added"), none.alias("_deleted"), F.lit(0).alias("_rows")).unionByName(
        reduce(DataFrame.unionByName, parents).select(
            "_space", "_key", F.col("_added").cast("timestamp_ntz").alias("_added"), F.col("_deleted").cast("timestamp_ntz").alias("_deleted"), F.lit(1).alias("_rows")
        )
    )
    known = keys.groupBy("_space", "_key").agg(
        F.sum("_rows").alias("_rows"),
        F.min("_added").alias("_added"),
        F.count("_added").alias("_n_added"),
        F.max("_deleted").alias("_deleted"),
        F.count("_deleted").alias("_n_deleted"),
    )
    known = known.select(
        "_space",
        "_key",
        (F.col("_rows") > 0).alias("_known"),
        F.when(F.col("_n_added") == F.col("_rows"), F.col("_added")).alias("_added"),
        F.when(F.col("_n_deleted") == F.col("_rows"), F.col("_deleted")).alias("_deleted"),
    )
    dictionary = _numbered(known, ["_space", "_key"])
    # appearances count from the month after on, and those without a time from before all months
    appears = F.coalesce(month_number(F.col("_added")) + 1, F.lit(_EVER - 1))
    events = F.array(F.struct(appears.alias("m"), F.lit(False).alias("gone")), F.struct(month_number(F.col("_deleted")).alias("m"), F.lit(True).alias("gone")))
    alive = dictionary.where("_known").select("_code", F.explode(events).alias("_e")).select("_code", F.col("_e.m").alias("_month"), F.col("_e.gone").alias("_gone")).where("_month is not null")
    referred = asked.join(dictionary.select("_space", "_key", "_code"), ["_space", "_key"]).select("table_name", "ref_field", "_month", "_code")
    left = _bitmaps(referred, ["table_name", "ref_field", "_month"]).groupBy("_range").cogroup(_bitmaps(alive, ["_month", "_gone"]).groupBy("_range"))
    codes = left.applyInPandas(_doubtful, "table_name string, ref_field string, _month int, _code bigint")
    doubt = codes.join(dictionary.drop("_space"), "_code").drop("_code")
    loaded = F.col("_loaded").cast("timestamp_ntz")
    reason = (
        F.when(~F.col("_known"), "missing").when(F.col("_added") > loaded, "late").when(F.col("_deleted") <= loaded, "deleted")
    )
    return (
        salted_join(rows.drop("_space"), doubt, where)
        .select("table_name", "ref_field", "rec_id", F.date_format("_loaded", "yyyy-MM").alias("load_month"), reason.alias("reason"))
        .where(F.col("reason").isNotNull())
    )
