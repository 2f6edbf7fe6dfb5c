"""Readers of line-based formats as DataFrames. Compressed files are decompressed by Spark; folders and globs work as paths.

Lines that do not parse give nulls in the typed columns and are dropped where a position is missing; use ``strict_load`` where
rejected lines matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tilewright.functions import reads
from tilewright.functions.columns import default_vector, epilogos_vector, states_vector, strand, variant_end
from tilewright.model.coords import Chromsizes, natural_key
from tilewright.operators.gff_parents import percent_decoded

#: contigs that a driver takes
MOST = 1_000_000


def _contigs(df: DataFrame) -> list:
    """The rows of a contig list, which are refused if there are more than ``MOST``."""
    rows = df.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} contigs")
    return rows


def lines(spark: SparkSession, path: str | list[str], comments: tuple[str, ...] = ("#", "track", "browser")) -> DataFrame:
    """Text lines without carriage returns, blank lines and lines that begin like a comment."""
    text = spark.read.text(path).select(F.regexp_replace("value", r"\r\z", "").alias("value"), F.col("_metadata.file_path").alias("file"))
    text = text.where("trim(value) <> ''")
    for c in comments:
        text = text.where(~F.col("value").startswith(c))
    return text


def _field(i: int) -> Column:
    return F.get(F.col("_f"), F.lit(i))


def _long(i: int) -> Column:
    return _field(i).try_cast("bigint")


def _dotted(i: int) -> Column:
    """Null instead of the placeholder ``.``."""
    return F.when(_field(i) != ".", _field(i))


def _placed(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df


def read_bed(spark: SparkSession, path: str | list[str], delimiter: str | None = None, columns: tuple[int, int, int] = (0, 1, 2), offset: int = 0) -> DataFrame:
    """(chrom, start, end, rest): 0-based half-open; ``rest`` holds all further columns, tab-joined. Header lines have no position and drop out.

    ``delimiter``: another separator than a tab. ``columns``: places of the three fields; all others are the rest. ``offset`` is added to both
    positions.
    """
    f = lines(spark, path)
    if delimiter is None and columns == (0, 1, 2):
        f = f.withColumn("_f", F.split("value", "\t", 4)).withColumn("_rest", _field(3))
    else:
        f = f.withColumn("_f", F.split("value", re.escape("\t" if delimiter is None else delimiter)))
        others = F.filter("_f", lambda _, i: ~i.isin(*columns))
        f = f.withColumn("_rest", F.when(F.size(others) > 0, F.array_join(others, "\t")))
    c, s, e = columns
    return _placed(f.select(_field(c).alias("chrom"), (_long(s) + offset).alias("start"), (_long(e) + offset).alias("end"), F.col("_rest").alias("rest")), "start", "end")


def read_bedpe(spark: SparkSession, path: str) -> DataFrame:
    """(chrom1, start1, end1, chrom2, start2, end2, rest)."""
    f = lines(spark, path).withColumn("_f", F.split("value", "\t", 7))
    pairs = f.select(
        _field(0).alias("chrom1"), _long(1).alias("start1"), _long(2).alias("end1"), _field(3).alias("chrom2"), _long(4).alias("start2"), _long(5).alias("end2"), _field(6).alias("rest")
    )
    return _placed(pairs, "start1", "end1", "start2", "end2")


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """(type, id, chrom, start, end, strand, score, phase, attributes) of GFF3 or GTF: 1-based, both ends included; ``.`` is null. ``%XX`` in ids stands for its character, as it does in parents."""
    f = lines(spark, path, ("#",)).withColumn("_f", F.split("value", "\t", 9))
    attributes = _field(8)
    own = F.nullif(F.btrim(F.regexp_extract(attributes, r"(?:\A|;)\s*ID\s*=([^;]*)", 1)), F.lit(""))
    own = F.when(own.contains("%"), percent_decoded(own)).otherwise(own)
    tag = F.when(_field(2).isin("gene", "pseudogene"), "gene_id").when(~_field(2).isin("exon", "CDS"), "transcript_id")
    gtf = F.when(tag == "gene_id", F.regexp_extract(attributes, r'gene_id\s+"([^"]*)"', 1)).when(tag == "transcript_id", F.regexp_extract(attributes, r'transcript_id\s+"([^"]*)"', 1))
    rows = f.select(
        _field(2).alias("type"), F.coalesce(own, F.nullif(gtf, F.lit(""))).alias("id"), _field(0).alias("chrom"), _long(3).alias("start"), _long(4).alias("end"),
        strand(_field(6)).alias("strand"), _dotted(5).try_cast("double").alias("score"), _dotted(7).try_cast("int").alias("phase"), attributes.alias("attributes"),
    )
    return _placed(rows, "start", "end")


def gff_chromsizes(features: DataFrame) -> Chromsizes:
    """Contigs from ``region`` features, which only GFF3 files have."""
    found = {r["chrom"]: r["end"] for r in _contigs(features.where("type = 'region'").groupBy("chrom").agg(F.max("end").alias("end")))}
    if not found:
        raise ValueError("there are no region features")
    return Chromsizes(sorted(found.items(), key=lambda p: natural_key(p[0])))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, ids, ref, alts, qual, filters, end): 1-based ``pos``, 0-based exclusive ``end`` from INFO/END or REF; genotypes are not read."""
    f = lines(spark, path, ("#",)).withColumn("_f", F.split("value", "\t", 9))
    listed = lambda i, sep: F.when(_field(i) == ".", F.array().cast("array<string>")).otherwise(F.split(_field(i), sep))
    info_end = F.nullif(F.regexp_extract(_field(7), r"(?:\A|;)END=([0-9]+)", 1), F.lit("")).try_cast("bigint")
    rows = f.select(
        _field(0).alias("chrom"), _long(1).alias("pos"), listed(2, ";").alias("ids"), _field(3).alias("ref"), listed(4, ",").alias("alts"), _dotted(5).try_cast("double").alias("qual"),
        listed(6, ";").alias("filters"), variant_end(_long(1), _field(3), info_end).alias("end"),
    )
    return _placed(rows, "pos")


def vcf_chromsizes(spark: SparkSession, path: str) -> Chromsizes:
    """Contigs of the header in its order."""
    head = spark.read.text(path).where(F.col("value").startswith("##contig=")).select(
        F.regexp_extract("value", r"ID=([^,>]+)", 1).alias("n"), F.regexp_extract("value", r"length=([0-9]+)", 1).alias("l"), F.monotonically_increasing_id().alias("o")
    )
    return Chromsizes((r["n"], r["l"]) for r in _contigs(head.where("l <> ''").orderBy("o")))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """(qname, flag, chrom, pos, mapq, cigar, seq, md, hp, end): 1-based ``pos``, ``end`` included; unplaced reads are dropped."""
    f = lines(spark, path, ("@",)).withColumn("_f", F.split("value", "\t", 12))
    tag = lambda name: F.nullif(F.regexp_extract(F.coalesce(_field(11), F.lit("")), rf"(?:\A|\t){name}:[A-Za-z]:([^\t]*)", 1), F.lit(""))
    ops = reads.cigar_ops(_dotted(5))
    span = F.aggregate(ops, F.lit(0), lambda n, o: n + F.when(o["op"].isin("M", "=", "X", "D", "N"), o["len"]).otherwise(F.lit(0)))
    rows = f.select(
        _field(0).alias("qname"), _field(1).try_cast("int").alias("flag"), _dotted(2).alias("chrom"), _long(3).alias("pos"), _field(4).try_cast("int").alias("mapq"), _field(5).alias("cigar"), _field(9).alias("seq"),
        tag("MD").alias("md"), tag("HP").try_cast("int").alias("hp"), (_long(3) + F.greatest(span, F.lit(1)) - 1).alias("end"),
    )
    return rows.where("pos > 0 and chrom is not null and chrom <> '*'")


def read_fasta(spark: SparkSession, path: str, chunk: int = 1 << 16) -> DataFrame:
    """(chrom, chunk_no, seq): sequences in pieces of ``chunk`` bases, so that a slice reads few of them.

    A header is a line that begins with ``>``; its first word names the sequence, lines before the first one are left out. Lines are
    numbered within their input split and splits are summed up by file, so neither a file nor a sequence is ever in one task.
    """
    raw = spark.read.text(path).select(
        F.regexp_replace("value", r"\s+\z", "").alias("_l"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_o")
    )
    head = F.col("_l").startswith(">")
    name = F.when(head, F.split_part(F.regexp_replace(F.substr("_l", F.lit(2)), r"\s", " "), F.lit(" "), F.lit(1)))
    lines = raw.select("_f", "_b", "_o", name.alias("_n"), F.when(head, "").otherwise(F.regexp_replace("_l", r"\s", "")).alias("_s"))
    # within a split: the bases up to each line and up to the header above it
    so_far = W.partitionBy("_f", "_b").orderBy("_o").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumns({"_to": F.sum(F.length("_s")).over(so_far), "_own": F.last("_n", ignorenulls=True).over(so_far)})
    lines = lines.withColumn("_from", F.last(F.when(F.col("_n").isNotNull(), F.col("_to")), ignorenulls=True).over(so_far))
    splits = lines.groupBy("_f", "_b").agg(F.max_by(F.struct("_own", (F.col("_to") - F.coalesce("_from", F.lit(0))).alias("_tail")), "_o").alias("_e"))
    # a row a split: what the splits before it leave open
    by_file = W.partitionBy("_f").orderBy("_b")
    splits = splits.select("_f", "_b", F.col("_e._own").alias("_own"), F.col("_e._tail").alias("_tail")).withColumn("_group", F.count("_own").over(by_file))
    before = splits.withColumns({"_sum": F.sum("_tail").over(W.partitionBy("_f", "_group").orderBy("_b")), "_name": F.last("_own", ignorenulls=True).over(by_file.rowsBetween(W.unboundedPreceding, 0))})
    before = before.select("_f", "_b", F.lag("_name").over(by_file).alias("_name"), F.coalesce(F.lag("_sum").over(by_file), F.lit(0)).alias("_sum"))
    placed = lines.where("_n is null and _s <> ''").join(before, ["_f", "_b"])
    at = F.col("_to") - F.length("_s") - F.coalesce("_from", -F.col("_sum"))
    placed = placed.select(F.coalesce("_own", "_name").alias("chrom"), at.alias("_at"), "_s").where("chrom is not null")
    first, last = F.floor(F.col("_at") / chunk), F.floor((F.col("_at") + F.length("_s") - 1) / chunk)
    pieces = placed.withColumn("chunk_no", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("chunk_no") * chunk - F.col("_at"), F.lit(0))
    piece = F.substr("_s", (lo + 1).cast("int"), (F.least((F.col("chunk_no") + 1) * chunk - F.col("_at"), F.length("_s")) - lo).cast("int"))
    whole = pieces.groupBy("chrom", F.col("chunk_no").cast("int").alias("chunk_no")).agg(F.array_sort(F.collect_list(F.struct("_at", piece.alias("_p")))).alias("_l"))
    return whole.select("chrom", "chunk_no", F.array_join(F.transform("_l", lambda x: x["_p"]), "").alias("seq"))


def fasta_lengths(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chrom").agg(F.sum(F.length("seq")).alias("len"))


def read_slices(chunks: DataFrame, wanted: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """Adds ``seq`` to ``wanted`` (key, chrom, start, end): the bases of [start, end), short at the end of a contig, empty for unknown contigs."""
    pieces = F.when(F.col("end") > F.col("start"), F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("end") - 1) / chunk))).otherwise(F.array(F.lit(0).cast("bigint")))
    need = wanted.withColumn("chunk_no", F.explode(pieces.cast("array<int>")))
    hit = need.join(chunks.withColumnRenamed("seq", "_seq"), ["chrom", "chunk_no"], "left")
    at = F.col("chunk_no") * chunk
    lo, hi = F.greatest(F.col("start"), at) - at, F.least(F.col("end"), at + chunk) - at
    part = F.substr("_seq", (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))
    parts = hit.withColumn("_p", F.coalesce(part, F.lit("")))
    whole = parts.groupBy(*wanted.columns).agg(F.array_sort(F.collect_list(F.struct("chunk_no", "_p"))).alias("_l"))
    return whole.select(*wanted.columns, F.array_join(F.transform("_l", lambda s: s["_p"]), "").alias("seq"))


def read_fai(spark: SparkSession, path: str) -> Chromsizes:
    """Contigs of a FASTA index, in the file's order."""
    rows = _contigs(spark.read.csv(path, sep="\t", schema="chrom string, len long, at long, width int, bytes int").orderBy("at"))
    return Chromsizes((r["chrom"], r["len"]) for r in rows)


def read_bedgraph(spark: SparkSession, path: str, nan_value: str = "NA", exp2: bool = False, closed: bool = False, columns: tuple[int, int, int, int] = (0, 1, 2, 3)) -> DataFrame:
    """(chrom, start, end, value) of blank- or tab-separated lines; ``nan_value`` and unreadable values are NaN.

    ``closed``: the end is included. ``exp2``: values are logarithms to base 2. ``columns``: places of the four fields.
    """
    f = lines(spark, path).withColumn("_f", F.split(F.trim("value"), r"[ \t]+"))
    c, s, e, v = columns
    raw = F.coalesce(F.when(_field(v) != nan_value, _field(v).try_cast("double")), F.lit(float("nan")))
    value = F.pow(F.lit(2.0), raw) if exp2 else raw
    return _placed(f.select(_field(c).alias("chrom"), _long(s).alias("start"), (_long(e) + int(closed)).alias("end"), value.alias("value")), "start", "end")


def read_vectors(spark: SparkSession, paths: list[str], width: int = 1, kind: str = "values", states: list[str] | None = None, parse: Callable[[Column], Column] | None = None) -> DataFrame:
    """(chrom, start, end, values): bed files put side by side by their common intervals.

    ``kind``: ``values`` are columns of numbers, ``epilogos`` a field ``...:[[value, index], ...]``, ``states`` the name of one of ``states``,
    and ``parse`` is a column builder of one's own from the array of fields to an array of ``width`` doubles.
    An interval that one of the files lacks raises no error but leaves NaN, and ``NA`` is NaN too.
    """
    if kind not in ("values", "epilogos", "states"):
        raise ValueError(f"{kind!r} is none of values, epilogos, states")
    width = len(states or []) if kind == "states" else width
    fields = F.split(F.coalesce("rest", F.lit("")), "\t")
    if parse is None:
        parse = {
            "values": lambda f: default_vector(f, width),
            "epilogos": lambda f: epilogos_vector(F.get(f, F.lit(0))),
            "states": lambda f: states_vector(F.get(f, F.lit(0)), states or []).cast("array<double>"),
        }[kind]
    out = None
    for i, p in enumerate(paths):
        one = read_bed(spark, p).select("chrom", "start", "end", parse(fields).alias(f"_v{i}"))
        out = one if out is None else out.join(one, ["chrom", "start", "end"], "full")
    empty = F.array_repeat(F.lit(float("nan")), width)
    return out.select("chrom", "start", "end", F.flatten(F.array(*[F.coalesce(f"_v{i}", empty) for i in range(len(paths))])).alias("values"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(min_lng, min_lat, max_lng, max_lat, geometry, properties): bounding boxes and JSON texts of a feature collection."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "features array<struct<geometry:string,properties:string>>").alias("d"))
    rows = doc.select(F.explode("d.features").alias("f")).select("f.geometry", "f.properties")
    numbers = F.regexp_extract_all("geometry", F.lit(r"\[\s*(-?[0-9.eE+-]+)\s*,\s*(-?[0-9.eE+-]+)"), F.lit(1)), F.regexp_extract_all("geometry", F.lit(r"\[\s*(-?[0-9.eE+-]+)\s*,\s*(-?[0-9.eE+-]+)"), F.lit(2))
    lng, lat = (F.transform(n, lambda x: x.try_cast("double")) for n in numbers)
    boxed = rows.select(F.array_min(lng).alias("min_lng"), F.array_min(lat).alias("min_lat"), F.array_max(lng).alias("max_lng"), F.array_max(lat).alias("max_lat"), "geometry", "properties")
    return _placed(boxed, "min_lng")


def read_points(spark: SparkSession, path: str, x: str = "x", y: str = "y") -> DataFrame:
    """(x, y) of a CSV file with a header."""
    df = spark.read.csv(path, header=True)
    return _placed(df.select(F.col(x).try_cast("double").alias("x"), F.col(y).try_cast("double").alias("y")), "x", "y")


def read_sequences(spark: SparkSession, path: str, column: str | int, header: bool = True, sep: str = ",") -> DataFrame:
    """(seq) of a CSV column given by name or by its number from 1."""
    df = spark.read.csv(path, header=header, sep=sep)
    if isinstance(column, int) and not 1 <= column <= len(df.columns):
        raise ValueError(f"there is no column {column}")
    return df.select(F.col(df.columns[column - 1] if isinstance(column, int) else column).alias("seq"))


def read_matrix(spark: SparkSession, path: str, top_n: int | None = None) -> DataFrame:
    """(row, col, value) of a TSV matrix with a header line and a label in front of each row, cut to a square of ``top_n`` or the header's length."""
    text = spark.read.text(path).where("value <> ''").withColumn("_o", F.monotonically_increasing_id())
    head = text.orderBy("_o").first()
    n = top_n or len(head["value"].split("\t")) - 1
    # rows are numbered by their order; files of one split keep it without a sort of all
    from tilewright.operators.pairs import dictionary_codes

    body = text.where(F.col("_o") > head["_o"])
    ranked = body.join(dictionary_codes(body, "_o"), "_o").where(F.col("code") < n)
    cells = ranked.select(F.col("code").alias("row"), F.posexplode(F.slice(F.split("value", "\t"), 2, n)).alias("col", "v"))
    return cells.select("row", "col", F.coalesce(F.col("v").try_cast("double"), F.lit(float("nan"))).alias("value"))


def read_time_interval(spark: SparkSession, path: str) -> DataFrame:
    """The JSON object of a time interval tileset, as one row."""
    return spark.read.json(path, multiLine=True)


def read_chromsizes(path: str) -> Chromsizes:
    return Chromsizes.from_file(path)


