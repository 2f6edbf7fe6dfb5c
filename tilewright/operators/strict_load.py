"""Strict loading of text rows, with the rejected rows and their reasons.

A table is loaded in two steps. The strict load keeps the rows that conform as a whole and types them; the raw
offsets minus the loaded offsets (an anti-join) are the remainder, and only the remainder is diagnosed. A row
is therefore in exactly one of the two outputs, whatever the diagnosis says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The lexical forms of the input.
POSITION = r"\A[0-9]{1,18}\z"
NUMBER = r"\A(?:NA|[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\z"
SEPARATORS = r"\A[ \t\r]*+\z"
QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
WELL_QUOTED = r'(?<![^ \t\r])' + QUOTED + r'(?![^ \t\r])'
FIELD = QUOTED + r'|[^ \t\r"]++'


def yes(condition: Column) -> Column:
    """A condition with null taken as false."""
    return F.coalesce(condition, F.lit(False))


def is_position(c: Column, least: int = 0) -> Column:
    ok = yes(c.rlike(POSITION))
    return ok if not least else ok & (F.coalesce(c.try_cast("long"), F.lit(-1)) >= least)


def is_number(c: Column) -> Column:
    return yes(c.rlike(NUMBER))


def as_number(c: Column) -> Column:
    """The double of a legal number; ``NA`` is null."""
    return F.when(c != "NA", c.try_cast("double"))


def without_cr(c: Column) -> Column:
    """Without one trailing carriage return."""
    return F.regexp_replace(c, r"\r\z", "")


def subtract_loaded(raw: DataFrame, loaded: DataFrame, offset: str) -> DataFrame:
    """Rows of ``raw`` whose offset the strict load did not take.

    Offsets are compared null-safe. Together with them a digest of the row is compared, so that a wrongly
    repeated (or null) offset does not let one row vouch for another.
    """
    raw = raw.withColumn("_digest", F.xxhash64(*[c for c in raw.columns if c != offset]))
    took = loaded.select(F.col(offset).alias("_o"), F.col("_digest").alias("_d"))
    return raw.join(took, raw[offset].eqNullSafe(took["_o"]) & (raw["_digest"] == took["_d"]), "left_anti").drop("_digest")


def cnvs_raw(df: DataFrame) -> DataFrame:
    return df.select("row_id", "start", "end", "copynumber", "segmented")


def _cnvs_checks() -> list[tuple[str, Column]]:
    """(reason, the row passes) in the order in which reasons apply."""
    return [
        ("start", is_position(F.col("start"), 1)),
        ("end", is_position(F.col("end"), 1)),
        ("order", yes(F.col("start").try_cast("long") <= F.col("end").try_cast("long"))),
        ("number", is_number(F.col("copynumber")) & is_number(without_cr(F.col("segmented")))),
    ]


def load_cnvs(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The readable bins with their types: row_id, start, end bigint, copynumber, segmented double (``NA`` is null).

    ``keep`` names further columns to pass through. A null in any of the four text columns makes a row
    unreadable; an empty table gives an empty table.
    """
    ok = F.lit(True)
    for _, passes in _cnvs_checks():
        ok = ok & passes
    return df.where(ok).select(
        "row_id",
        *keep,
        F.col("start").try_cast("long").alias("start"),
        F.col("end").try_cast("long").alias("end"),
        as_number(F.col("copynumber")).alias("copynumber"),
        as_number(without_cr(F.col("segmented"))).alias("segmented"),
    )


def reject_cnvs(df: DataFrame) -> DataFrame:
    """(row_id, reason) of every unreadable row; repeated rows count once per ``row_id``."""
    raw = cnvs_raw(df)
    ok = F.lit(True)
    for _, passes in _cnvs_checks():
        ok = ok & passes
    strict = raw.where(ok).select("row_id", F.xxhash64("start", "end", "copynumber", "segmented").alias("_digest"))
    reason = F.lit(None).cast("string")
    for name, passes in reversed(_cnvs_checks()):
        reason = F.when(~passes, F.lit(name)).otherwise(reason)
    return subtract_loaded(raw, strict, "row_id").select("row_id", reason.alias("reason"))


def _values_fields(df: DataFrame) -> DataFrame:
    line = F.col("raw_line")
    return df.select(
        "line_id",
        line,
        F.regexp_replace(line, WELL_QUOTED, "Q").contains('"').alias("_loose"),
        F.regexp_extract_all(line, F.lit(FIELD), F.lit(0)).alias("_f"),
    )


def unquote(c: Column) -> Column:
    return F.when(c.startswith('"'), F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)


def _value(i: int) -> Column:
    return unquote(F.get(F.col("_f"), F.lit(i)))


def is_record() -> Column:
    """Comments, blank lines and null lines are not records."""
    line = F.col("raw_line")
    return yes(~line.startswith("#") & ~line.rlike(SEPARATORS))


def _values_checks() -> list[tuple[str, Column]]:
    return [
        ("quoting", ~F.col("_loose")),
        ("columns", F.size("_f") == 4),
        ("start", is_position(_value(1))),
        ("end", is_position(_value(2))),
        ("order", yes(_value(1).try_cast("long") < _value(2).try_cast("long"))),
        ("number", is_number(_value(3))),
    ]


def load_values(df: DataFrame) -> DataFrame:
    """The readable lines as (line_id, chrom, start, end, value); ``NA`` is null, an empty table stays empty."""
    ok = is_record()
    for _, passes in _values_checks():
        ok = ok & passes
    return _values_fields(df).where(ok).select(
        "line_id",
        _value(0).alias("chrom"),
        _value(1).try_cast("long").alias("start"),
        _value(2).try_cast("long").alias("end"),
        as_number(_value(3)).alias("value"),
    )


def reject_values(df: DataFrame) -> DataFrame:
    """(line_id, reason) of every line that is a record and cannot be read."""
    raw = df.select("line_id", "raw_line").where(is_record())
    ok = is_record()
    for _, passes in _values_checks():
        ok = ok & passes
    strict = _values_fields(df).where(ok).select("line_id", F.xxhash64("raw_line").alias("_digest"))
    reason = F.lit(None).cast("string")
    for name, passes in reversed(_values_checks()):
        reason = F.when(~passes, F.lit(name)).otherwise(reason)
    return _values_fields(subtract_loaded(raw, strict, "line_id")).select("line_id", reason.alias("reason"))
