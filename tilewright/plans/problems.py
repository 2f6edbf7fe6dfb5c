"""The queries of the general problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators import hotkeys, orphans, strict_load
from tilewright.operators.gff_parents import with_parent
from tilewright.operators.hierarchy import Forest
from tilewright.operators.periods import periods_and_gaps
from tilewright.runtime import table


def forest(spark: SparkSession, d: str) -> Forest:
    return Forest(with_parent(table(spark, d, "basegffentity")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return forest(spark, d).nodes().select("id", "root_id", "depth")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """The number of descendants of every node that reaches a root."""
    return forest(spark, d).nodes().where("depth >= 0").select("id", "descendants")


def p2_intervals(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every node in a row a node: those of the same root whose ``first`` lies in (first, last]."""
    return forest(spark, d).nodes().where("depth >= 0").select("id", "root_id", "first", "last")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    return forest(spark, d).paths()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, key in (("intervals", "chrOffset"), ("cnvs_hw", "chrom")):
        hot = hotkeys.hot_keys(table(spark, d, name).select(key), key, 1 / 20)
        parts.append(hot.select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("hot_key")))
    return parts[0].unionByName(parts[1])


def p3_chrom_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per chromosome, readable bins only: rows, covered length, extent and summed copy number."""
    bins = strict_load.load_cnvs(table(spark, d, "cnvs_hw"), keep=("chrom",))
    out = hotkeys.tree_aggregate(
        bins,
        ["chrom"],
        {
            "bins": ("count", F.lit(1)),
            "bases": ("sum", F.col("end") - F.col("start") + 1),
            "lo": ("min", F.col("start")),
            "hi": ("max", F.col("end")),
            "sum_cn": ("sum", F.col("copynumber")),
        },
    )
    return out.withColumn("sum_cn", F.round("sum_cn", 3))


def p3_offset_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per contig offset: rows, rows with an importance, its extremes and the summed length."""
    iv = table(spark, d, "intervals")
    imp = F.when(~F.isnan("importance"), F.col("importance"))
    return hotkeys.tree_aggregate(
        iv,
        ["chrOffset"],
        {
            "n": ("count", F.lit(1)),
            "ranked": ("count", imp),
            "least": ("min", imp),
            "most": ("max", imp),
            "bases": ("sum", F.abs(F.col("toX") - F.col("fromX"))),
        },
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    cnvs = strict_load.reject_cnvs(table(spark, d, "cnvs_hw"))
    values = strict_load.reject_values(table(spark, d, "dm3_values"))
    return cnvs.select(F.lit("cnvs_hw").alias("table_name"), F.col("row_id").alias("rec_id"), "reason").unionByName(
        values.select(F.lit("dm3_values").alias("table_name"), F.col("line_id").alias("rec_id"), "reason")
    )


def p4_loaded_cnvs(spark: SparkSession, d: str) -> DataFrame:
    return strict_load.load_cnvs(table(spark, d, "cnvs_hw"))


def p4_loaded_values(spark: SparkSession, d: str) -> DataFrame:
    return strict_load.load_values(table(spark, d, "dm3_values"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    cnvs, chroms = table(spark, d, "cnvs_hw"), table(spark, d, "chromsizes")
    gff = with_parent(table(spark, d, "basegffentity"))
    return orphans.orphan_references(
        [
            orphans.references(cnvs, "cnvs_hw", "chrom", 0, "chrom", "row_id", "loaded_at"),
            orphans.references(gff, "basegffentity", "chrom", 0, "chrom", "row_id", "loaded_at"),
            orphans.references(gff, "basegffentity", "attributes", 1, "parent", "row_id", "loaded_at"),
        ],
        [orphans.targets(chroms, 0, "chrom", "added_at", "deleted_at"), orphans.targets(gff, 1, "id", "loaded_at", "deleted_at")],
    )


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, field, month and reason."""
    return p5_found(spark, d).groupBy("table_name", "ref_field", "load_month", "reason").agg(F.count(F.lit(1)).alias("refs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    iv = table(spark, d, "intervals").where("fromX is not null and toX is not null and chrOffset is not null")
    iv = iv.select("tileset", F.col("chrOffset").cast("string").alias("contig"), F.least("fromX", "toX").alias("lo"), F.greatest("fromX", "toX").alias("hi"))
    bins = strict_load.load_cnvs(table(spark, d, "cnvs_hw"), keep=("sample_id", "chrom")).where("sample_id is not null and chrom is not null")
    bins = bins.select("sample_id", "chrom", "start", (F.col("end") + 1).alias("stop"))
    a = periods_and_gaps(iv, ["tileset", "contig"], "lo", "hi")
    b = periods_and_gaps(bins, ["sample_id", "chrom"], "start", "stop")
    return a.select(F.lit("intervals").alias("table_name"), F.col("tileset").alias("entity"), "contig", "kind", "lo", "hi").unionByName(
        b.select(F.lit("cnvs_hw").alias("table_name"), F.col("sample_id").alias("entity"), F.col("chrom").alias("contig"), "kind", "lo", (F.col("hi") - 1).alias("hi"))
    )


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_descendants, p2_intervals, p2_paths, p3_found, p3_chrom_stats, p3_offset_stats, p4_found, p4_loaded_cnvs, p4_loaded_values, p5_found, p5_report, p6_found)
}

# ---------------------------------------------------------------------------------------------- SQL

_PARENTS = r"""
feature AS (
  SELECT row_id, id, chrom, loaded_at, deleted_at, nullif(CASE
    WHEN regexp_matches(attributes, '^[\s;]*[^;="]*=')
      THEN url_decode(trim(regexp_extract(attributes, '(?:^|;)\s*Parent\s*=([^;]*)', 1), ' ' || chr(9) || chr(10) || chr(13)))
    WHEN type IN ('exon', 'CDS') THEN regexp_extract(attributes, '(?:^|;)\s*transcript_id\s+"([^"]*)"', 1)
    WHEN type IN ('gene', 'pseudogene') THEN NULL
    ELSE regexp_extract(attributes, '(?:^|;)\s*gene_id\s+"([^"]*)"', 1) END, '') AS parent
  FROM basegffentity)"""

_FOREST = f"""
WITH RECURSIVE {_PARENTS},
named AS (SELECT id, min(parent) AS parent FROM feature WHERE id IS NOT NULL GROUP BY id),
node AS (SELECT a.id, b.id AS up FROM named a LEFT JOIN named b ON a.parent = b.id),
tree AS (
  SELECT id, id AS root_id, 0 AS depth, id AS path FROM node WHERE up IS NULL
  UNION ALL
  SELECT n.id, t.root_id, t.depth + 1, t.path || '/' || n.id FROM tree t JOIN node n ON n.up = t.id),
lost AS (SELECT id, up FROM node WHERE id NOT IN (SELECT id FROM tree)),
climb AS (SELECT id, up AS cur FROM lost UNION SELECT c.id, l.up FROM climb c JOIN lost l ON l.id = c.cur)
"""

_NUMBER = r"(?:NA|[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"

_CNVS = rf"""
cnvs_read AS (
  SELECT *, CASE
    WHEN NOT coalesce(regexp_full_match(start, '[0-9]{{1,18}}') AND try_cast(start AS BIGINT) >= 1, false) THEN 'start'
    WHEN NOT coalesce(regexp_full_match("end", '[0-9]{{1,18}}') AND try_cast("end" AS BIGINT) >= 1, false) THEN 'end'
    WHEN try_cast(start AS BIGINT) > try_cast("end" AS BIGINT) THEN 'order'
    WHEN NOT coalesce(regexp_full_match(copynumber, '{_NUMBER}') AND regexp_full_match(regexp_replace(segmented, '\r\z', ''), '{_NUMBER}'), false) THEN 'number'
  END AS reason FROM cnvs_hw)"""

_QUOTED_FIELD = '"(?:[^"]|"")*"'
_BARE_FIELD = '[^ \\t\\r"]+'
_VALUES = rf"""
value_lines AS (
  SELECT line_id, CASE WHEN regexp_full_match(raw_line, '(?s)[ \t\r]*(?:(?:{_QUOTED_FIELD}|{_BARE_FIELD})(?:[ \t\r]+(?:{_QUOTED_FIELD}|{_BARE_FIELD}))*)?[ \t\r]*')
      THEN list_transform(regexp_extract_all(raw_line, '(?s){_QUOTED_FIELD}|{_BARE_FIELD}'),
        lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:length(x) - 1], '""', '"') ELSE x END) END AS f
  FROM dm3_values WHERE NOT starts_with(raw_line, '#') AND NOT regexp_full_match(raw_line, '[ \t\r]*')),
values_read AS (
  SELECT *, CASE
    WHEN f IS NULL THEN 'quoting'
    WHEN len(f) <> 4 THEN 'columns'
    WHEN NOT regexp_full_match(f[2], '[0-9]{{1,18}}') THEN 'start'
    WHEN NOT regexp_full_match(f[3], '[0-9]{{1,18}}') THEN 'end'
    WHEN try_cast(f[2] AS BIGINT) >= try_cast(f[3] AS BIGINT) THEN 'order'
    WHEN NOT regexp_full_match(f[4], '{_NUMBER}') THEN 'number'
  END AS reason FROM value_lines)"""

_ORPHANS = f"""
WITH {_PARENTS},
target AS (
  SELECT 'chrom' AS space, chrom AS key, added_at AS since, deleted_at AS until FROM chromsizes
  UNION ALL
  SELECT 'id', id, min(loaded_at), CASE WHEN count(deleted_at) = count(*) THEN max(deleted_at) END
  FROM feature WHERE id IS NOT NULL GROUP BY id),
reference AS (
  SELECT 'cnvs_hw' AS table_name, 'chrom' AS ref_field, 'chrom' AS space, chrom AS key, row_id AS rec_id, loaded_at FROM cnvs_hw
  UNION ALL SELECT 'basegffentity', 'chrom', 'chrom', chrom, row_id, loaded_at FROM feature
  UNION ALL SELECT 'basegffentity', 'attributes', 'id', parent, row_id, loaded_at FROM feature),
judged AS (
  SELECT r.table_name, r.ref_field, r.rec_id, strftime(r.loaded_at, '%Y-%m') AS load_month,
    CASE WHEN t.key IS NULL THEN 'missing' WHEN t.since > r.loaded_at THEN 'late' WHEN t.until <= r.loaded_at THEN 'deleted' END AS reason
  FROM reference r LEFT JOIN target t ON r.space = t.space AND r.key = t.key WHERE r.key IS NOT NULL)
"""

_PERIODS = f"""
WITH {_CNVS},
spans AS (
  SELECT 'intervals' AS table_name, tileset AS entity, CAST(chrOffset AS VARCHAR) AS contig, least(fromX, toX) AS lo, greatest(fromX, toX) AS hi, 0 AS closed
  FROM intervals WHERE fromX IS NOT NULL AND toX IS NOT NULL AND chrOffset IS NOT NULL
  UNION ALL
  SELECT 'cnvs_hw', sample_id, chrom, CAST(start AS BIGINT), CAST("end" AS BIGINT) + 1, 1
  FROM cnvs_read WHERE reason IS NULL AND sample_id IS NOT NULL AND chrom IS NOT NULL),
reach AS (
  SELECT *, max(hi) OVER (PARTITION BY table_name, entity, contig ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans),
island AS (
  SELECT *, sum(CASE WHEN lo > before THEN 1 ELSE 0 END) OVER (PARTITION BY table_name, entity, contig ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS i FROM reach),
period AS (SELECT table_name, entity, contig, closed, i, min(lo) AS lo, max(hi) AS hi FROM island GROUP BY ALL),
gap AS (
  SELECT table_name, entity, contig, closed, hi AS lo, lead(lo) OVER (PARTITION BY table_name, entity, contig ORDER BY i) AS hi FROM period)
SELECT table_name, entity, contig, 'period' AS kind, lo, CAST(hi - closed AS BIGINT) AS hi FROM period
UNION ALL SELECT table_name, entity, contig, 'gap', lo, CAST(hi - closed AS BIGINT) FROM gap WHERE hi IS NOT NULL
"""

SQL = {
    "p2_found": _FOREST
    + """SELECT id, root_id, CAST(depth AS INTEGER) AS depth FROM tree
UNION ALL SELECT id, '', CASE WHEN EXISTS (SELECT 1 FROM climb c WHERE c.id = lost.id AND c.cur = lost.id) THEN -1 ELSE -2 END FROM lost""",
    "p2_descendants": _FOREST
    + """, above AS (SELECT id, up FROM node WHERE id IN (SELECT id FROM tree) UNION ALL SELECT a.id, n.up FROM above a JOIN node n ON n.id = a.up)
SELECT t.id, CAST(coalesce(n, 0) AS BIGINT) AS descendants FROM tree t LEFT JOIN (SELECT up, count(*) AS n FROM above GROUP BY up) d ON d.up = t.id""",
    "p2_paths": _FOREST + "SELECT id, path FROM tree",
    "p3_found": """
SELECT 'intervals' AS table_name, CAST(chrOffset AS VARCHAR) AS hot_key FROM intervals WHERE chrOffset IS NOT NULL
GROUP BY chrOffset HAVING count(*) * 20 > (SELECT count(*) FROM intervals)
UNION ALL
SELECT 'cnvs_hw', chrom FROM cnvs_hw WHERE chrom IS NOT NULL
GROUP BY chrom HAVING count(*) * 20 > (SELECT count(*) FROM cnvs_hw)""",
    "p3_chrom_stats": f"""WITH {_CNVS}
SELECT chrom, count(*) AS bins, CAST(sum(CAST("end" AS BIGINT) - CAST(start AS BIGINT) + 1) AS BIGINT) AS bases,
  min(CAST(start AS BIGINT)) AS lo, max(CAST("end" AS BIGINT)) AS hi,
  round(sum(CASE WHEN copynumber <> 'NA' THEN CAST(copynumber AS DOUBLE) END), 3) AS sum_cn
FROM cnvs_read WHERE reason IS NULL GROUP BY chrom""",
    "p3_offset_stats": """
SELECT chrOffset, count(*) AS n, count(CASE WHEN NOT isnan(importance) THEN 1 END) AS ranked,
  min(CASE WHEN NOT isnan(importance) THEN importance END) AS least, max(CASE WHEN NOT isnan(importance) THEN importance END) AS most,
  CAST(sum(abs(toX - fromX)) AS BIGINT) AS bases
FROM intervals GROUP BY chrOffset""",
    "p4_found": f"""WITH {_CNVS}, {_VALUES}
SELECT 'cnvs_hw' AS table_name, row_id AS rec_id, reason FROM cnvs_read WHERE reason IS NOT NULL
UNION ALL SELECT 'dm3_values', line_id, reason FROM values_read WHERE reason IS NOT NULL""",
    "p4_loaded_cnvs": rf"""WITH {_CNVS}
SELECT row_id, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end",
  CASE WHEN copynumber <> 'NA' THEN CAST(copynumber AS DOUBLE) END AS copynumber,
  CASE WHEN regexp_replace(segmented, '\r\z', '') <> 'NA' THEN CAST(regexp_replace(segmented, '\r\z', '') AS DOUBLE) END AS segmented
FROM cnvs_read WHERE reason IS NULL""",
    "p4_loaded_values": f"""WITH {_VALUES}
SELECT line_id, f[1] AS chrom, CAST(f[2] AS BIGINT) AS start, CAST(f[3] AS BIGINT) AS "end",
  CASE WHEN f[4] <> 'NA' THEN CAST(f[4] AS DOUBLE) END AS value
FROM values_read WHERE reason IS NULL""",
    "p5_found": _ORPHANS + "SELECT table_name, ref_field, rec_id, load_month, reason FROM judged WHERE reason IS NOT NULL",
    "p5_report": _ORPHANS
    + "SELECT table_name, ref_field, load_month, reason, count(*) AS refs FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
    "p6_found": _PERIODS,
}
