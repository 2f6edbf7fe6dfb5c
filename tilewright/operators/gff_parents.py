"""The parent named in the attributes of an annotation feature, in both attribute dialects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tags that name a parent in the quoted dialect, by feature type.
TRANSCRIPT_PARTS = ("exon", "CDS")
PARENTLESS = ("gene", "pseudogene")

_BLANK = " \t\r\n"
_EQUALS_DIALECT = r'\A[\s;]*+[^;="]*+='
_EQUALS_PARENT = r"(?:\A|;)[ \t\r\n]*+Parent[ \t\r\n]*+=([^;]*+)"


def _quoted_value(attributes: Column, tag: str) -> Column:
    """The value of the first pair with this tag; semicolons and tags inside quotes are content. Loops are possessive, so long texts need no stack."""
    pattern = rf'\A(?:(?!\s*+{tag}\s)(?:"[^"]*+"|[^;"]++)*+;)*+\s*+{tag}\s++("[^"]*+"|[^;"]*+)'
    return F.btrim(F.replace(F.regexp_extract(attributes, pattern, 1), F.lit('"'), F.lit("")), F.lit(_BLANK))


def percent_decoded(c: Column) -> Column:
    """``%XX`` stands for its byte; ``+`` and a lone ``%`` stay as they are."""
    guarded = F.regexp_replace(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.coalesce(F.try_url_decode(guarded), c)


def parent_of(attributes: Column, kind: Column, first: bool = False) -> Column:
    """The parent's id, null where the feature names none.

    A text is in the ``tag=value`` dialect if its first pair has a ``=`` before any quote. There the parent is the value of
    ``Parent`` (the first one, if it is given twice). In the other dialect it is ``transcript_id`` for exon and CDS, nothing for
    gene and pseudogene and ``gene_id`` otherwise. Null or empty attributes and an empty value name no parent; a null type
    counts as any other type. ``first``: of several parents, which the first dialect separates by commas, only the first one.
    """
    value = F.btrim(F.regexp_extract(attributes, _EQUALS_PARENT, 1), F.lit(_BLANK))
    if first:
        value = F.split_part(value, F.lit(","), F.lit(1))
    value = F.when(attributes.contains("%"), percent_decoded(value)).otherwise(value)
    other = (
        F.when(kind.isin(*TRANSCRIPT_PARTS), _quoted_value(attributes, "transcript_id"))
        .when(kind.isin(*PARENTLESS), F.lit(None).cast("string"))
        .otherwise(_quoted_value(attributes, "gene_id"))
    )
    return F.nullif(F.when(attributes.rlike(_EQUALS_DIALECT), value).otherwise(other), F.lit(""))


def with_parent(df: DataFrame) -> DataFrame:
    """(row_id, id, chrom, parent, loaded_at, deleted_at) of a feature table; other columns are dropped."""
    return df.select("row_id", "id", "chrom", parent_of(F.col("attributes"), F.col("type")).alias("parent"), "loaded_at", "deleted_at")
