"""Gene models from flat annotation features: genes, transcripts, exons and coding parts, linked by parent ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


# Feature types by their part in a gene model.
GENES = ("gene",)
PSEUDOGENES = ("pseudogene",)
TRANSCRIPTS = (
    "mRNA", "transcript", "lnc_RNA", "ncRNA", "primary_transcript", "antisense_RNA", "snoRNA", "snRNA", "tRNA", "rRNA", "SRP_RNA", "RNase_P_RNA", "RNase_MRP_RNA",
)
BETWEEN = ("miRNA",)
PARTS = ("exon", "CDS")


def features(df: DataFrame) -> DataFrame:
    """(type, id, parent, chrom, lo, hi, strand): 0-based half-open features with their first parent, one row per type, id and span; parsed once and written."""
    from tilewright.operators.gff_parents import parent_of
    from tilewright.runtime import Cut

    parent = parent_of(F.col("attributes"), F.col("type"), first=True)
    own = F.coalesce("id", F.concat_ws("_", "type", "start", "end"))
    rows = df.select("type", own.alias("id"), parent.alias("parent"), "chrom", (F.col("start") - 1).alias("lo"), F.col("end").alias("hi"), "strand")
    # a gene model reads them many times, and parsing the attributes is most of the work
    return Cut(rows.distinct(), "features").df


def _entities(f: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """One row per id; of several rows the one of smallest span start, then end, holds."""
    first = f.where(F.col("type").isin(*types)).groupBy("id").agg(F.min(F.struct("lo", "hi", "chrom", "strand", "type", "parent")).alias("_f"))
    return first.select("id", "_f.*")


def parts_with_genes(f: DataFrame) -> DataFrame:
    """(gene_id, transcript_id, kind, lo, hi): every exon and CDS with the gene it belongs to.

    A part's parent is a transcript, a miRNA (whose own parent is the transcript), or, for pseudogenes, the gene itself.
    Parts without a gene are dropped.
    """
    genes = _entities(f, GENES + PSEUDOGENES).select(F.col("id").alias("gene_id"))
    transcripts = _entities(f, TRANSCRIPTS).select(F.col("id").alias("transcript_id"), F.col("parent").alias("_of"))
    between = _entities(f, BETWEEN).where("parent is not null").select(F.col("id").alias("parent"), F.col("parent").alias("_via"))
    parts = f.where(F.col("type").isin(*PARTS)).where("parent is not null").select(F.col("type").alias("kind"), "parent", "lo", "hi")
    linked = parts.join(between, "parent", "left").withColumn("_to", F.coalesce("_via", "parent"))
    linked = linked.join(transcripts, F.col("_to") == F.col("transcript_id"), "left")
    linked = linked.withColumn("_gene", F.when(F.col("transcript_id").isNotNull(), F.col("_of")).otherwise(F.col("_to")))
    return linked.join(genes, F.col("_gene") == F.col("gene_id")).select("gene_id", "transcript_id", "kind", "lo", "hi")


def exon_unions(parts: DataFrame, group: str) -> DataFrame:
    """(group, lo, hi): a group's exons merged; touching ones merge too.

    Islands by a running maximum: a gene or transcript has few exons, so a window a group is cheaper than the
    ranked boundaries that ``periods`` uses for groups of any size.
    """
    w = W.partitionBy(group).orderBy("lo", "hi")
    exons = parts.where((F.col("kind") == "exon") & F.col(group).isNotNull()).select(group, "lo", "hi")
    reach = exons.withColumn("_reach", F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1)))
    island = reach.withColumn("_i", F.sum(F.when(F.col("lo") > F.col("_reach"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy(group, "_i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_i")


def _listed(c: str) -> Column:
    return F.array_join(F.transform(F.array_sort("_exons"), lambda e: e[c].cast("string")), ",")


def _models(owners: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """Owners (key, chrom, lo, hi, ...) with their merged exons (the own span if there are none) and extent of coding parts."""
    exons = exon_unions(parts, key).groupBy(key).agg(F.collect_list(F.struct("lo", "hi")).alias("_exons"))
    coding = parts.where("kind = 'CDS'").groupBy(key).agg(F.min("lo").alias("cds_lo"), F.max("hi").alias("cds_hi"))
    out = owners.join(exons, key, "left").join(coding, key, "left")
    return out.withColumn("_exons", F.coalesce("_exons", F.array(F.struct("lo", "hi"))))


def gene_records(df: DataFrame, chromsizes: DataFrame) -> DataFrame:
    """(uid, x_start, x_end, chrom_offset, importance, strand, fields): a row per gene on a known contig.

    ``fields``: chrom, start, end, name, score, strand, id, gene id, start and end of the coding extent (both the gene's start if it
    has none), and the merged exons' starts and ends.
    """
    f = features(df)
    parts = parts_with_genes(f)
    owners = _entities(f, GENES + PSEUDOGENES).select(F.col("id").alias("gene_id"), "chrom", "lo", "hi", "strand")
    m = _models(owners, parts, "gene_id").join(chromsizes.select("chrom", "chrom_offset"), "chrom")
    fields = F.array(
        "chrom", F.col("lo").cast("string"), F.col("hi").cast("string"), "gene_id", F.concat((F.col("hi") - F.col("lo")).cast("string"), F.lit(".0")),
        F.coalesce("strand", F.lit(".")), "gene_id", "gene_id", F.coalesce("cds_lo", "lo").cast("string"), F.coalesce("cds_hi", "lo").cast("string"), _listed("lo"), _listed("hi"),
    )
    return m.select(
        F.col("gene_id").alias("uid"), (F.col("chrom_offset") + F.col("lo")).alias("x_start"), (F.col("chrom_offset") + F.col("hi")).alias("x_end"),
        "chrom_offset", (F.col("hi") - F.col("lo")).cast("double").alias("importance"), "strand", fields.alias("fields"),
    )


def codon_starts(cds_lo: Column, cds_hi: Column, strand: Column) -> tuple[Column, Column]:
    """Lowest 1-based base of start and stop codon, ``.`` without coding parts; on the minus strand translation starts at the high end."""
    low, high = (cds_lo + 1).cast("string"), (cds_hi - 2).cast("string")
    dot, minus = F.lit("."), F.coalesce(strand == "-", F.lit(False))
    return F.coalesce(F.when(minus, high).otherwise(low), dot), F.coalesce(F.when(minus, low).otherwise(high), dot)


def transcript_records(df: DataFrame, chromsizes: DataFrame) -> DataFrame:
    """(uid, gene_id, x_start, x_end, strand, exon_starts, exon_ends, start_codon, stop_codon), exons 1-based; the strand is the gene's."""
    f = features(df)
    parts = parts_with_genes(f).where("transcript_id is not null")
    genes = _entities(f, GENES + PSEUDOGENES).select(F.col("id").alias("parent"), "chrom", "strand")
    owners = _entities(f, TRANSCRIPTS).select(F.col("id").alias("transcript_id"), "parent", "lo", "hi").join(genes, "parent")
    m = _models(owners, parts, "transcript_id").join(chromsizes.select("chrom", "chrom_offset"), "chrom")
    start, stop = codon_starts(F.col("cds_lo"), F.col("cds_hi"), F.col("strand"))
    starts = F.array_join(F.transform(F.array_sort("_exons"), lambda e: (e["lo"] + 1).cast("string")), ",")
    return m.select(
        F.col("transcript_id").alias("uid"), F.col("parent").alias("gene_id"), (F.col("chrom_offset") + F.col("lo")).alias("x_start"), (F.col("chrom_offset") + F.col("hi")).alias("x_end"),
        "strand", starts.alias("exon_starts"), _listed("hi").alias("exon_ends"), start.alias("start_codon"), stop.alias("stop_codon"),
    )


def top_genes_with_parts(df: DataFrame, cap: int) -> DataFrame:
    """(gene_id, kind, lo, hi): the parts of the ``cap`` genes of a table with the longest span, ties by descending id."""
    f = features(df)
    genes = _entities(f, GENES + PSEUDOGENES).select(F.col("id").alias("gene_id"), (F.col("hi") - F.col("lo")).alias("_span"))
    best = genes.orderBy(F.col("_span").desc(), F.col("gene_id").desc()).limit(cap).select("gene_id")
    return parts_with_genes(f).join(best, "gene_id", "left_semi").select("gene_id", "kind", "lo", "hi")


def gene_predictions(df: DataFrame) -> DataFrame:
    """(line): a genePred line a transcript: name, chrom, strand, span, coding span (its end twice if there is none), exon count, starts and ends."""
    f = features(df)
    parts = parts_with_genes(f).where("transcript_id is not null")
    genes = _entities(f, GENES + PSEUDOGENES).select(F.col("id").alias("parent"), "chrom", "strand")
    owners = _entities(f, TRANSCRIPTS).select(F.col("id").alias("transcript_id"), "parent", "lo", "hi").join(genes, "parent")
    m = _models(owners, parts, "transcript_id")
    coding = F.coalesce("cds_lo", "hi").cast("string"), F.coalesce("cds_hi", "hi").cast("string")
    columns = ["transcript_id", "chrom", F.coalesce("strand", F.lit(".")), F.col("lo").cast("string"), F.col("hi").cast("string"), *coding, F.size("_exons").cast("string")]
    return m.select(F.concat_ws("\t", *columns, F.concat(_listed("lo"), F.lit(",")), F.concat(_listed("hi"), F.lit(","))).alias("line"))


def with_missing_owners(df: DataFrame) -> DataFrame:
    """Features (type, id, parent, chrom, lo, hi, strand) with a gene, a transcript and exons made up for coding parts that name no known parent.

    All parts of one absent parent share them: the transcript is called like the parent, the gene like it with ``gene:`` in front.
    """
    orphans = df.where((F.col("type") == "CDS") & F.col("parent").isNotNull())
    orphans = orphans.join(df.where(F.col("id").isNotNull()).select(F.col("id").alias("parent")).distinct(), "parent", "left_anti")
    spans = orphans.groupBy("parent").agg(F.first("chrom").alias("chrom"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("strand").alias("strand"))
    gene = F.concat(F.lit("gene:"), F.col("parent"))
    shape = lambda d, kind, own, of: d.select(F.lit(kind).alias("type"), own.alias("id"), of.alias("parent"), "chrom", "lo", "hi", "strand")
    none = F.lit(None).cast("string")
    genes = shape(spans, "gene", gene, none)
    transcripts = shape(spans, "mRNA", F.col("parent"), gene)
    exons = shape(orphans, "exon", none, F.col("parent"))
    return df.select("type", "id", "parent", "chrom", "lo", "hi", "strand").unionByName(genes).unionByName(transcripts).unionByName(exons)
