"""Queries of the signal, matrix, sequence and record operators, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import columns as C
from tilewright.functions import encode, reads
from tilewright.operators import contacts, pairs, signal, strict_load
from tilewright.plans.genome import _LAT, _LNG, chromsizes, links, placed
from tilewright.plans.problems import _CNVS, _VALUES
from tilewright.runtime import table
from tilewright.streaming import bins as stream_bins

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def near(c: str) -> Column:
    """Rounded to 6 digits, a little above the ties of short decimals, so that the order of summation does not show."""
    return F.round(F.col(c) + 1e-9, 6)


def values(spark, d) -> DataFrame:
    """The readable lines of the value files."""
    return strict_load.load_values(table(spark, d, "dm3_values")).select("chrom", "start", "end", "value")


_SIGNAL = f"""{_VALUES},
sig AS (SELECT f[1] AS chrom, CAST(f[2] AS BIGINT) AS lo, CAST(f[3] AS BIGINT) AS hi, CASE WHEN f[4] <> 'NA' THEN CAST(f[4] AS DOUBLE) END AS value FROM values_read WHERE reason IS NULL)"""


def _spread(size: int) -> str:
    return f"""hit AS (SELECT chrom, value, bin, least(hi, (bin + 1) * {size}) - greatest(lo, bin * {size}) AS bases
  FROM (SELECT *, unnest(range(lo // {size}, (hi - 1) // {size} + 1)) AS bin FROM sig))"""


@query(f"""WITH {_SIGNAL}, {_spread(1000)}
SELECT chrom, bin, CAST(sum(bases) AS BIGINT) AS covered, round(sum(value * bases) / sum(bases) + 1e-9, 6) AS mean, min(value) AS min, max(value) AS max,
  round(sqrt(greatest(sum(value * value * bases) / sum(bases) - power(sum(value * bases) / sum(bases), 2), 0)) + 1e-5, 3) AS std, round(sum(value * bases) + 1e-9, 6) AS sum
FROM hit WHERE value IS NOT NULL GROUP BY chrom, bin""")
def signal_bins_mean_min_max_std_sum(spark, d):
    out = signal.bin_stats(values(spark, d), ["chrom"], "start", "end", "value", 1000)
    return out.withColumns({"mean": near("mean"), "std": F.round(F.col("std") + 1e-5, 3), "sum": near("sum")})


@query("""SELECT fromX // 16777216 AS bin, round(coalesce(sum(CASE WHEN NOT isnan(importance) THEN importance END), 'NaN'::DOUBLE), 4) AS total,
  min(CASE WHEN NOT isnan(importance) THEN importance END) AS least, max(CASE WHEN NOT isnan(importance) THEN importance END) AS most FROM intervals GROUP BY fromX // 16777216""")
def nansum_bins(spark, d):
    iv = table(spark, d, "intervals")
    seen = C.nan_free(F.col("importance"))
    return iv.groupBy(F.floor(F.col("fromX") / 16777216).alias("bin")).agg(F.round(C.nan_sum(F.col("importance")), 4).alias("total"), F.min(seen).alias("least"), F.max(seen).alias("most"))


def _levels(step: int, n: int) -> str:
    first = """l0 AS (SELECT chrom, bin, sum(value * bases) AS total, sum(CASE WHEN value IS NULL THEN bases ELSE 0 END) AS nan_bases, sum(bases) AS bases FROM hit GROUP BY chrom, bin)"""
    rest = "".join(
        f", l{k} AS (SELECT chrom, bin // {step} AS bin, sum(total) AS total, sum(nan_bases) AS nan_bases, sum(bases) AS bases FROM l{k - 1} GROUP BY chrom, bin // {step})" for k in range(1, n)
    )
    return first + rest


@query(
    f"WITH {_SIGNAL}, {_spread(64)}, {_levels(8, 4)} "
    + " UNION ALL ".join(
        f"SELECT chrom, {k} AS level, bin, round(total + 1e-9, 6) AS total, CAST(nan_bases AS BIGINT) AS nan_bases, CAST(bases AS BIGINT) AS bases, round(CASE WHEN bases > nan_bases THEN total / (bases - nan_bases) END + 1e-9, 6) AS mean FROM l{k}"
        for k in range(4)
    )
)
def bedgraph_pyramid(spark, d):
    out = signal.signal_pyramid(values(spark, d), ["chrom"], "start", "end", "value", 64, 8, 4)
    return out.withColumns({"total": near("total"), "mean": near("mean")}).select("chrom", "level", "bin", "total", "nan_bases", "bases", "mean")


@query(f"""WITH {_SIGNAL} SELECT chrom, lo AS "start", hi AS "end", round(CASE WHEN value > 1023.9999999 THEN 'Infinity'::DOUBLE ELSE power(2, value) END, 6) AS value FROM sig""")
def exp2_transform(spark, d):
    """All values; ``NA`` stays null, and what is beyond the largest double is infinity."""
    return values(spark, d).withColumn("value", F.round(F.pow(F.lit(2.0), F.col("value")), 6))


@query(f"""WITH {_SIGNAL} SELECT chrom, b AS lo, lo AS hi FROM (
  SELECT chrom, lo, max(hi) OVER (PARTITION BY chrom ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM sig) WHERE lo > b""")
def signal_gaps(spark, d):
    return signal.fill_gaps(values(spark, d), ["chrom"], "start", "end")


@query(f"""WITH {_SIGNAL} SELECT chrom, CAST(bin AS BIGINT) AS bin, coalesce(round(s, 4), 0.0) AS sum FROM (SELECT chrom, unnest(range(greatest((max(hi) - 1) // 1000, 199) + 1)) AS bin FROM sig GROUP BY chrom) c
LEFT JOIN (SELECT chrom, bin, sum(value * (least(hi, (bin + 1) * 1000) - greatest(lo, bin * 1000))) AS s FROM (
  SELECT *, unnest(range(lo // 1000, (hi - 1) // 1000 + 1)) AS bin FROM sig WHERE value IS NOT NULL) GROUP BY chrom, bin) v USING (chrom, bin)""")
def signal_on_spine(spark, d):
    """The bins of every contig up to its last one, the first 200 at least, holes filled with 0."""
    v = values(spark, d)
    last = v.groupBy("chrom").agg(F.greatest(F.floor((F.max("end") - 1) / 1000), F.lit(199)).cast("bigint").alias("last"))
    spine = last.select("chrom", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("bin"))
    stats = signal.bin_stats(v, ["chrom"], "start", "end", "value", 1000).select("chrom", "bin", F.round("sum", 4).alias("sum"))
    return signal.with_spine(stats, ["chrom"], spine, {"sum": 0.0})


def _vectors(spark, d) -> DataFrame:
    """Copy number (row 0) and segment (row 1) summed in bins of 10 kb."""
    bins = strict_load.load_cnvs(table(spark, d, "cnvs_hw"), keep=("chrom",)).where("chrom is not null")
    rows = bins.select("chrom", F.floor(F.col("start") / 10000).alias("bin"), F.posexplode(F.array("copynumber", "segmented")).alias("row", "value"))
    return rows.where("value is not null").groupBy("chrom", "bin", "row").agg(F.round(F.sum("value"), 3).alias("value"))


_VECTORS = rf"""{_CNVS},
v0 AS (SELECT chrom, bin, row, round(sum(value), 3) AS value FROM (
  SELECT chrom, CAST(start AS BIGINT) // 10000 AS bin, 0 AS row, CASE WHEN copynumber <> 'NA' THEN CAST(copynumber AS DOUBLE) END AS value FROM cnvs_read WHERE reason IS NULL AND chrom IS NOT NULL
  UNION ALL
  SELECT chrom, CAST(start AS BIGINT) // 10000, 1, CASE WHEN regexp_replace(segmented, '\r\z', '') <> 'NA' THEN CAST(regexp_replace(segmented, '\r\z', '') AS DOUBLE) END FROM cnvs_read WHERE reason IS NULL AND chrom IS NOT NULL)
  WHERE value IS NOT NULL GROUP BY chrom, bin, row)"""


def _halved(value: str, n: int) -> str:
    return "".join(f", v{k} AS (SELECT chrom, row, bin // 2 AS bin, {value} AS value FROM v{k - 1} GROUP BY chrom, row, bin // 2)" for k in range(1, n))


def _shown(n: int, digits: int) -> str:
    return " UNION ALL ".join(f"SELECT chrom, row, {k} AS level, bin, round(value, {digits}) AS value FROM v{k}" for k in range(n))


@query(f"WITH {_VECTORS} {_halved('sum(value)', 6)} {_shown(6, 3)}")
def multivec_pyramid(spark, d):
    out = signal.vector_pyramid(_vectors(spark, d), ["chrom", "row"], "bin", "value", "sum", 6)
    return out.withColumn("value", F.round("value", 3))


@query()
def multivec_logsumexp(spark, d):
    out = signal.vector_pyramid(_vectors(spark, d), ["chrom", "row"], "bin", "value", "logsumexp", 4)
    return out.withColumn("value", F.round("value", 5))


SQL["multivec_logsumexp"] = f"WITH {_VECTORS}" + "".join(
    f""", m{k} AS (SELECT chrom, row, bin // 2 AS bin, value, max(value) OVER (PARTITION BY chrom, row, bin // 2) AS top FROM v{k - 1}),
v{k} AS (SELECT chrom, row, bin, max(top) + ln(sum(exp(value - top))) AS value FROM m{k} GROUP BY chrom, row, bin)"""
    for k in range(1, 4)
) + " " + _shown(4, 5)


@query(
    "WITH v0 AS (SELECT event_type, event_id AS bin, coalesce(CASE WHEN NOT isnan(value) THEN value END, 'NaN'::DOUBLE) AS sum, value AS min, value AS max FROM events)"
    + "".join(f", v{k} AS (SELECT event_type, bin // 16 AS bin, sum(sum) AS sum, min(min) AS min, max(max) AS max FROM v{k - 1} GROUP BY event_type, bin // 16)" for k in range(1, 4))
    + " "
    + " UNION ALL ".join(f"SELECT event_type, {k} AS level, bin, round(sum, 3) AS sum, min, max FROM v{k}" for k in range(4))
)
def hitile_min_max(spark, d):
    out = signal.range_pyramid(table(spark, d, "events"), ["event_type"], "event_id", "value", 16, 4)
    return out.withColumn("sum", F.round("sum", 3)).select("event_type", "level", "bin", "sum", "min", "max")


def matrix(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "value")).withColumn("value", F.col("value").cast("double"))


_MATRIX = "m AS (SELECT vec_id AS row, unnest(range(len(embedding))) AS col, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"


@query(
    f"WITH {_MATRIX}, v0 AS (SELECT * FROM m)"
    + "".join(f", v{k} AS (SELECT row // 2 AS row, col // 2 AS col, sum(value) AS value FROM v{k - 1} GROUP BY row // 2, col // 2)" for k in range(1, 6))
    + " "
    + " UNION ALL ".join(f"SELECT {k} AS level, row, CAST(col AS BIGINT) AS col, round(value, 4) AS value FROM v{k}" for k in range(6))
)
def matrix_coarsen(spark, d):
    out = signal.matrix_pyramid(matrix(spark, d), "row", "col", "value", 6)
    return out.select("level", "row", F.col("col").cast("bigint").alias("col"), F.round("value", 4).alias("value"))


_GROUPS = [[0, 1, 2, 3], [3, 7, 5], [11], [40, 2]]
_FUNCTIONS = {"sum": "sum(value)", "mean": "avg(value)", "median": "median(value)", "std": "stddev_pop(value)", "var": "var_pop(value)", "min": "min(value)", "max": "max(value)"}


@query(
    f"WITH {_MATRIX}, g(group_no, row) AS (VALUES {', '.join(f'({i}, {r})' for i, rows in enumerate(_GROUPS) for r in rows)}) "
    + " UNION ALL ".join(f"SELECT '{n}' AS function, group_no, CAST(col AS INTEGER) AS col, round({e}, 5) AS value FROM m JOIN g USING (row) GROUP BY group_no, col" for n, e in _FUNCTIONS.items())
)
def row_group_agg(spark, d):
    m = matrix(spark, d)
    parts = [signal.aggregate_row_groups(m, "row", ["col"], "value", _GROUPS, n).select(F.lit(n).alias("function"), "group_no", "col", F.round("value", 5).alias("value")) for n in signal.ROW_FUNCTIONS]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT event_id // 32 AS bin, round(sum(value) / (count(value) + 1), 5) AS value FROM events WHERE NOT isnan(value) GROUP BY event_id // 32")
def vector_mean_n_plus_1(spark, d):
    """The vector tile's mean, which divides by one more than there are values."""
    v = C.nan_free(F.col("value"))
    e = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 32).alias("bin"))
    return e.agg(F.round(F.sum(v) / (F.count(v) + 1), 5).alias("value")).where("value is not null")


@query(f"WITH {_MATRIX} SELECT row // 16 AS row, CAST(col // 16 AS BIGINT) AS col, round(nullif(sum(value), 0), 4) AS value FROM m GROUP BY row // 16, col // 16")
def matrix_block_sum_null_zero(spark, d):
    out = contacts.block_sums(matrix(spark, d), "row", "col", "value", 16)
    return out.withColumn("value", F.round("value", 4))


@query("""SELECT CAST(least(floor((o_totalprice - 0.0) / 500000.0 * 256), 255) AS INTEGER) AS x_bin, CAST(least(floor((o_orderkey - 0.0) / 200000.0 * 256), 255) AS INTEGER) AS y_bin, count(*) AS n
FROM orders WHERE o_totalprice > 0 AND o_totalprice < 500000 AND o_orderkey > 0 AND o_orderkey < 200000 GROUP BY ALL""")
def histogram2d(spark, d):
    return signal.histogram_2d(table(spark, d, "orders"), "o_totalprice", "o_orderkey", (0, 0, 500000, 200000))


@query("""WITH b AS (SELECT min(o_totalprice) x0, max(o_totalprice) x1, min(o_orderkey) y0, max(o_orderkey) y1 FROM orders)
SELECT CAST(least(floor((o_totalprice - x0) / (x1 - x0) * 64), 63) AS INTEGER) AS x_bin, CAST(least(floor((o_orderkey - y0) / (y1 - y0) * 64), 63) AS INTEGER) AS y_bin, count(*) AS n
FROM orders, b WHERE o_totalprice > x0 AND o_totalprice < x1 AND o_orderkey > y0 AND o_orderkey < y1 GROUP BY ALL""")
def histogram2d_data_extent(spark, d):
    o = table(spark, d, "orders")
    return signal.histogram_2d(o, "o_totalprice", "o_orderkey", signal.data_extent(o, "o_totalprice", "o_orderkey"), 64)


@query(f"""WITH {_SIGNAL}, e AS (SELECT chrom, p, sum(d) AS d FROM (SELECT chrom, lo AS p, 1 AS d FROM sig UNION ALL SELECT chrom, hi, -1 FROM sig) GROUP BY chrom, p HAVING sum(d) <> 0)
SELECT chrom, lo, hi, CAST(depth AS BIGINT) AS depth FROM (SELECT chrom, p AS lo, lead(p) OVER (PARTITION BY chrom ORDER BY p) AS hi, sum(d) OVER (PARTITION BY chrom ORDER BY p) AS depth FROM e) WHERE depth > 0""")
def coverage(spark, d):
    return signal.coverage(values(spark, d), ["chrom"], "start", "end")


# ------------------------------------------------------------------------------------------- contacts


def pixels(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").select((F.col("l_partkey") % 256).alias("a"), (F.col("l_suppkey") % 256).alias("b"))
    return li.groupBy(F.least("a", "b").alias("bin1_id"), F.greatest("a", "b").alias("bin2_id")).agg(F.count(F.lit(1)).alias("count"))


_PIXELS = 'px AS (SELECT least(l_partkey % 256, l_suppkey % 256) AS bin1_id, greatest(l_partkey % 256, l_suppkey % 256) AS bin2_id, count(*) AS "count" FROM lineitem GROUP BY 1, 2)'


@query(f"""WITH {_PIXELS}, w AS (SELECT bin_id, 1 / sqrt(sum(c)) AS weight FROM (SELECT bin1_id AS bin_id, "count" AS c FROM px UNION ALL SELECT bin2_id, "count" FROM px) GROUP BY bin_id)
SELECT bin1_id, bin2_id, "count", round("count" * a.weight * b.weight, 8) AS balanced FROM px JOIN w a ON a.bin_id = bin1_id JOIN w b ON b.bin_id = bin2_id""")
def balanced_contacts(spark, d):
    px = pixels(spark, d)
    return contacts.balanced(px, contacts.marginal_weights(px)).withColumn("balanced", F.round("balanced", 8))


@query(f"""WITH {_PIXELS} SELECT bin1_id, bin2_id, "count" FROM px UNION ALL SELECT bin2_id, bin1_id, "count" FROM px WHERE bin1_id <> bin2_id""")
def symmetric_fill(spark, d):
    return contacts.mirrored(pixels(spark, d))


@query(f"""WITH {_PIXELS}, s AS (SELECT bin1_id AS a, bin2_id AS b, "count" AS c FROM px UNION ALL SELECT bin2_id, bin1_id, "count" FROM px WHERE bin1_id <> bin2_id)
SELECT a - 32 AS row, b - 64 AS col, c AS value FROM s WHERE a BETWEEN 32 AND 63 AND b BETWEEN 64 AND 127""")
def contact_block(spark, d):
    return contacts.block(pixels(spark, d), (32, 64), (64, 128))


@query(f"""WITH {_PIXELS}, s AS (SELECT bin1_id // 1 AS x, bin2_id AS y, 1 AS n FROM px)
SELECT CAST(z AS INTEGER) AS z, x // CAST(power(2, 6 - z) AS BIGINT) // 4 AS x, y // CAST(power(2, 6 - z) AS BIGINT) // 4 AS y, CAST(sum(n) AS BIGINT) AS n FROM s, range(7) r(z) GROUP BY ALL""")
def nonempty_tiles(spark, d):
    return contacts.nonempty_tiles(pixels(spark, d), "bin1_id", "bin2_id", 6, 256.0)


_RECONCILED = """
RECURSIVE b AS (SELECT row_number() OVER (ORDER BY cid) AS i, cid, len, CAST(ceil(len / 1000000.0) AS BIGINT) AS n FROM chromsizes),
walk(i, cid, n, walked, claimed, dropped) AS (
  SELECT CAST(0 AS BIGINT), CAST(-1 AS INTEGER), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), false
  UNION ALL
  SELECT b.i, b.cid, b.n, walked + b.len, claimed + 1000000 * (b.n - CASE WHEN b.n > 0 AND claimed + 1000000 * b.n - walked - b.len >= 500000 THEN 1 ELSE 0 END),
    b.n > 0 AND claimed + 1000000 * b.n - walked - b.len >= 500000
  FROM walk JOIN b ON b.i = walk.i + 1),
r AS (SELECT cid, n, dropped FROM walk WHERE i > 0)"""


def _reconciled(spark, d) -> DataFrame:
    b = chromsizes(spark, d).select(F.lit(0).alias("tile"), "cid", "len", F.ceil(F.col("len") / 1_000_000).alias("n"), F.lit(1_000_000).alias("size"))
    return signal.reconcile(b, ["tile"], "cid", "len", "n", "size").select("cid", "n", F.col("drop").alias("dropped"))


@query(f"WITH {_RECONCILED} SELECT cid, n, dropped FROM r")
def reconcile_drops(spark, d):
    return _reconciled(spark, d)


@query(f"""WITH {_RECONCILED} SELECT a.cid AS row_cid, b.cid AS col_cid, a.n - CAST(a.dropped AS INTEGER) AS rows, b.n - CAST(b.dropped AS INTEGER) AS cols
FROM r a JOIN r b ON a.cid % 8 = b.cid % 8 AND a.cid <= b.cid""")
def reconcile_2d(spark, d):
    """Shapes of the blocks of a tile whose axes are reconciled one by one (here for contigs 8 apart)."""
    r = _reconciled(spark, d).select("cid", (F.col("n") - F.col("dropped").cast("int")).alias("n"), (F.col("cid") % 8).alias("_m"))
    a, b = r.withColumnsRenamed({"cid": "row_cid", "n": "rows"}), r.withColumnsRenamed({"cid": "col_cid", "n": "cols"})
    return a.join(b, "_m").where("row_cid <= col_cid").drop("_m")


# ----------------------------------------------------------------------------------- reads and records

_CIGAR = "{l} || 'S' || {q} || 'M' || ({s} % 5 + 1) || 'X' || {l} || 'I' || ({p} % 7 + 1) || 'D' || {q} || '=' || CASE WHEN {s} % 3 = 0 THEN '2H' ELSE '' END"


def aligned(spark, d) -> DataFrame:
    """Reads with a flag, a position and a CIGAR made from line items."""
    li = table(spark, d, "lineitem")
    text = _CIGAR.format(l="l_linenumber", q="cast(l_quantity as int)", s="l_suppkey", p="l_partkey")
    return li.select(
        F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("qname"), F.expr("cast(l_partkey * 16 % 4096 as int)").alias("flag"), (F.col("l_partkey") + 1).alias("pos"),
        F.expr(text).alias("cigar"), "l_linenumber", "l_quantity", "l_suppkey", "l_partkey", "l_orderkey",
    )


_READS = f"""rd AS (SELECT 'r' || l_orderkey AS qname, CAST(l_partkey * 16 % 4096 AS INTEGER) AS flag, l_partkey + 1 AS pos,
  {_CIGAR.format(l='l_linenumber', q='CAST(l_quantity AS INTEGER)', s='l_suppkey', p='l_partkey')} AS cigar, l_linenumber, CAST(l_quantity AS INTEGER) AS q, l_suppkey, l_partkey, l_orderkey FROM lineitem)"""


@query(f"""WITH {_READS} SELECT cigar, CAST(i AS INTEGER) AS i, regexp_extract_all(cigar, '([0-9]+)([A-Z=])', 2)[i + 1] AS op, CAST(regexp_extract_all(cigar, '([0-9]+)([A-Z=])', 1)[i + 1] AS INTEGER) AS len
FROM (SELECT DISTINCT cigar, unnest(range(len(regexp_extract_all(cigar, '[0-9]+')))) AS i FROM rd)""")
def cigar_ops(spark, d):
    r = aligned(spark, d).select("cigar").distinct()
    return r.select("cigar", F.posexplode(reads.cigar_ops(F.col("cigar"))).alias("i", "o")).select("cigar", "i", "o.op", "o.len")


@query(f"""WITH {_READS}, s AS (SELECT qname, l_linenumber, pos - 1 AS p0, q, l_suppkey % 5 + 1 AS x, l_linenumber AS ins, l_partkey % 7 + 1 AS del, l_suppkey FROM rd),
t AS (SELECT *, p0 + 2 * q + x + del - 1 AS stop FROM s)
SELECT qname, p0, p0 + q AS pos, 'X' AS op, CAST(x AS INTEGER) AS len FROM t UNION ALL SELECT qname, p0, p0 + q + x, 'I', CAST(ins AS INTEGER) FROM t
UNION ALL SELECT qname, p0, p0 + q + x, 'D', CAST(del AS INTEGER) FROM t UNION ALL SELECT qname, p0, p0 - ins, 'S', CAST(ins AS INTEGER) FROM t
UNION ALL SELECT qname, p0, stop, 'H', 2 FROM t WHERE l_suppkey % 3 = 0""")
def cigar_subs(spark, d):
    at = F.col("pos") - 1
    span = 2 * F.col("l_quantity").cast("int") + F.col("l_suppkey") % 5 + 1 + F.col("l_partkey") % 7 + 1 - 1
    r = aligned(spark, d).select("qname", at.alias("p0"), F.explode(reads.cigar_substitutions(at, span, reads.cigar_ops(F.col("cigar")))).alias("o"))
    return r.select("qname", "p0", "o.pos", "o.op", "o.len")


@query(f"""WITH {_READS}, s AS (SELECT l_linenumber AS ref, pos - 1 AS p0, q, l_suppkey % 5 + 1 AS x, l_partkey % 7 + 1 AS del, l_suppkey % 3 = 0 AS clipped FROM rd),
o AS (SELECT ref, 'S' AS op, p0 AS lo, p0 + 1 AS hi FROM s UNION ALL SELECT ref, 'M', p0, p0 + q FROM s UNION ALL SELECT ref, 'X', p0 + q, p0 + q + x FROM s
  UNION ALL SELECT ref, 'I', p0 + q + x, p0 + q + x + 1 FROM s UNION ALL SELECT ref, 'D', p0 + q + x, p0 + q + x + del FROM s
  UNION ALL SELECT ref, '=', p0 + q + x + del, p0 + 2 * q + x + del FROM s UNION ALL SELECT ref, 'H', p0 + 2 * q + x + del, p0 + 2 * q + x + del + 1 FROM s WHERE clipped),
e AS (SELECT ref, op, p0, sum(d) AS d FROM (SELECT ref, op, lo AS p0, 1 AS d FROM o UNION ALL SELECT ref, op, hi, -1 FROM o) GROUP BY ref, op, p0 HAVING sum(d) <> 0)
SELECT ref, op, lo, hi, CAST(depth AS BIGINT) AS depth FROM (
  SELECT ref, op, p0 AS lo, lead(p0) OVER (PARTITION BY ref, op ORDER BY p0) AS hi, sum(d) OVER (PARTITION BY ref, op ORDER BY p0) AS depth FROM e) WHERE depth > 0""")
def pileup_coverage(spark, d):
    """Depth per reference and operation, in stretches of equal depth."""
    r = aligned(spark, d).select(F.col("l_linenumber").alias("ref"), F.explode(reads.covered_spans(F.col("pos") - 1, reads.cigar_ops(F.col("cigar")))).alias("o"))
    return signal.coverage(r.select("ref", "o.op", "o.lo", "o.hi"), ["ref", "op"], "lo", "hi")


@query(f"""WITH {_READS} SELECT DISTINCT qname, flag, CASE WHEN flag & 1 <> 0 THEN qname || CASE WHEN flag & 64 <> 0 THEN '_1' ELSE '_2' END ELSE qname END AS id,
  CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand FROM rd WHERE flag & 2304 = 0""")
def read_flags(spark, d):
    r = aligned(spark, d).where(C.is_primary(F.col("flag")))
    return r.select("qname", "flag", C.read_id(F.col("qname"), F.col("flag")).alias("id"), F.when(F.col("flag").bitwiseAND(16) != 0, "-").otherwise("+").alias("strand")).distinct()


@query(f"""WITH {_READS}, a AS (SELECT DISTINCT qname, flag, pos, CASE WHEN flag & 64 <> 0 THEN 1 WHEN flag & 128 <> 0 THEN 2 END AS e FROM rd), c AS (SELECT * FROM a WHERE pos < 500),
h AS (SELECT qname, 3 - min(e) AS e FROM (SELECT DISTINCT qname, e FROM c WHERE e IS NOT NULL) GROUP BY qname HAVING count(*) = 1)
SELECT qname, flag, pos FROM c UNION SELECT a.qname, a.flag, a.pos FROM a JOIN h ON a.qname = h.qname AND a.e = h.e""")
def read_mates(spark, d):
    r = aligned(spark, d).select("qname", "flag", "pos")
    return pairs.with_mates(r, r.where("pos < 500"))


_MD_SEQ = "translate(substr(md5(cast(l_orderkey as string)), 1, 16), '0123456789abcdef', 'ACGTACGTACGTACGT')"


@query(f"""WITH r AS (SELECT l_orderkey, l_partkey, l_linenumber, {_MD_SEQ.replace('string', 'VARCHAR')} AS seq, CAST((l_linenumber + l_suppkey) % 12 AS INTEGER) AS k, l_partkey % 2 AS kind FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(k + CASE WHEN kind = 0 AND k >= 4 THEN 2 ELSE 0 END AS INTEGER) AS query_pos, CAST(k + CASE WHEN kind = 1 AND k >= 4 THEN 3 ELSE 0 END AS INTEGER) AS ref_pos,
  substr(seq, CAST(k + CASE WHEN kind = 0 AND k >= 4 THEN 2 ELSE 0 END AS BIGINT) + 1, 1) AS base, 'N' AS ref FROM r""")
def md_variants(spark, d):
    """Reads with one mismatch, before or behind an insertion of two bases or a deletion of three."""
    at, kind = "((l_linenumber + l_suppkey) % 12)", "(l_partkey % 2)"
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.expr(_MD_SEQ).alias("seq"), F.expr(f"if({kind} = 0, '4M2I10M', '4M3D12M')").alias("cigar"),
        F.expr(f"case when {kind} = 0 then concat({at}, 'N', 13 - {at}) when {at} < 4 then concat({at}, 'N', 3 - {at}, '^GGG', 12) else concat('4^GGG', {at} - 4, 'N', 15 - {at}) end").alias("md"),
    )
    found = li.select("l_orderkey", "l_linenumber", "l_partkey", F.explode(reads.md_variants("seq", "md", "cigar")).alias("v"))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "v.query_pos", "v.ref_pos", "v.base", "v.ref")


_SEQ = "translate(substr(md5(p_name), 1, 24), '0123456789abcdef', 'ACGTACGTACGTACGN')"


def sequences(spark, d) -> DataFrame:
    """Sequences of 24 bases made from part names."""
    return table(spark, d, "part").select("p_partkey", F.expr(_SEQ).alias("seq"))


@query(f"""WITH s AS (SELECT p_partkey, pos, substr(lower({_SEQ}), CAST(pos AS INTEGER) + 1, 1) AS b FROM part, range(24) r(pos))
SELECT p_partkey, CAST(pos AS INTEGER) AS pos, CAST(b = 'a' AS INTEGER) AS a, CAST(b = 't' AS INTEGER) AS t, CAST(b = 'g' AS INTEGER) AS g, CAST(b = 'c' AS INTEGER) AS c, CAST(b = 'n' AS INTEGER) AS n,
  CAST(b NOT IN ('a', 't', 'g', 'c', 'n') AS INTEGER) AS other FROM s""")
def one_hot(spark, d):
    return pairs.one_hot(sequences(spark, d), "p_partkey", "seq")


@query(f"""WITH s AS (SELECT CAST(pos AS INTEGER) AS pos, substr({_SEQ}, CAST(pos AS INTEGER) + 1, 1) AS base FROM part, range(24) r(pos)),
c AS (SELECT pos, base, count(*) AS n FROM s WHERE base IN ('A', 'C', 'G', 'T') GROUP BY pos, base)
SELECT pos, base, round((coalesce(n, 0) + 0.5) / t, 8) AS weight FROM (SELECT pos, sum(n) + 2.0 AS t FROM c GROUP BY pos) CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) l(base) LEFT JOIN c USING (pos, base)""")
def pwm(spark, d):
    return pairs.position_weights(sequences(spark, d), "seq", pseudocount=0.5).withColumn("weight", F.round("weight", 8))


@query(f"""SELECT p_partkey, substr({_SEQ}, 5, 12) AS piece FROM part""")
def sequence_slice(spark, d):
    return sequences(spark, d).select("p_partkey", F.substring("seq", 5, 12).alias("piece"))


@query()
def sequence_distances(spark, d):
    """Alignment scores of the sequences of successive parts."""
    s = sequences(spark, d)
    other = s.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("seq").alias("next"))
    return s.join(other, "p_partkey").select("p_partkey", reads.alignment_score("seq", "next").alias("score"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey + 100 ELSE l_orderkey - 1 + CAST(l_quantity AS BIGINT) END AS stop,
  CASE WHEN l_linenumber % 3 = 0 THEN '.' ELSE 'rs' || l_partkey || ';rs' || l_suppkey END AS ids FROM lineitem""")
def vcf_end_fields(spark, d):
    li = table(spark, d, "lineitem")
    info = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey") + 100)
    stop = C.variant_end(F.col("l_orderkey"), F.repeat(F.lit("A"), F.col("l_quantity").cast("int")), info)
    names = F.when(F.col("l_linenumber") % 3 != 0, F.array(F.concat(F.lit("rs"), F.col("l_partkey").cast("string")), F.concat(F.lit("rs"), F.col("l_suppkey").cast("string"))))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", stop.alias("stop"), C.joined_or_dot(names, ";").alias("ids"))


@query("""SELECT p_partkey, CAST(i AS INTEGER) AS i, CASE i WHEN 0 THEN p_retailprice WHEN 1 THEN CAST(p_size AS DOUBLE) ELSE CAST(p_partkey AS DOUBLE) END AS v FROM part, range(3) r(i)""")
def epilogos_vector(spark, d):
    p = table(spark, d, "part")
    text = F.concat(F.lit("id:"), F.col("p_partkey").cast("string"), F.lit(",qcat:[["), F.col("p_partkey").cast("string"), F.lit(",2],["), F.col("p_retailprice").cast("string"), F.lit(",0],["), F.col("p_size").cast("string"), F.lit(",1]]"))
    return p.select("p_partkey", F.posexplode(C.epilogos_vector(text)).alias("i", "v"))


_STATES = ["A", "N", "R"]


@query("""SELECT l_orderkey, l_linenumber, l_partkey, [CAST(l_returnflag = 'A' AS INTEGER), CAST(l_returnflag = 'N' AS INTEGER), CAST(l_returnflag = 'R' AS INTEGER)] AS v FROM lineitem""")
def states_one_hot(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", C.states_vector(F.col("l_returnflag"), _STATES).alias("v"))


@query(r"""SELECT row_id, CAST(i AS INTEGER) AS i, coalesce(CASE WHEN x <> 'NA' THEN try_cast(x AS DOUBLE) END, 'NaN'::DOUBLE) AS v FROM (
  SELECT row_id, i, CASE i WHEN 0 THEN copynumber WHEN 1 THEN trim(segmented, chr(13)) END AS x FROM cnvs_hw, range(3) r(i))""")
def default_vectors(spark, d):
    """Value fields of every line; ``NA``, missing and unreadable ones as NaN."""
    c = table(spark, d, "cnvs_hw")
    return c.select("row_id", F.posexplode(C.default_vector(F.array("copynumber", F.btrim("segmented", F.lit("\r"))), 3)).alias("i", "v"))


@query(f"""WITH p AS (SELECT o_orderkey, {_LNG} AS x, {_LAT} AS y, 1 + o_orderkey % 5 AS w, 1 + o_orderkey % 3 AS h FROM orders)
SELECT o_orderkey, round(CAST(w * h AS DOUBLE) / 2, 6) AS area, round(x, 6) AS x0, round(y, 6) AS y0, round(x + w, 6) AS x1, round(y + h, 6) AS y1 FROM p""")
def shoelace_area(spark, d):
    """Right triangles."""
    o = table(spark, d, "orders").select("o_orderkey", F.expr(_LNG).cast("double").alias("x"), F.expr(_LAT).cast("double").alias("y"), (1 + F.col("o_orderkey") % 5).cast("double").alias("w"), (1 + F.col("o_orderkey") % 3).cast("double").alias("h"))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w, h = map(F.col, "xywh")
    ring = F.array(point(x, y), point(x + w, y), point(x, y + h))
    box = C.bounding_box(F.col("ring"))
    return o.withColumn("ring", ring).select("o_orderkey", F.round(C.shoelace(F.col("ring")), 6).alias("area"), *[F.round(b, 6).alias(n) for b, n in zip(box, ("x0", "y0", "x1", "y1"))])


@query("""SELECT tileset, CASE WHEN bool_or(v = 'nan') OR min(CASE WHEN v <> 'nan' THEN CAST(v AS DOUBLE) END) <= -65504 OR max(CASE WHEN v <> 'nan' THEN CAST(v AS DOUBLE) END) >= 65504
  THEN 'float32' ELSE 'float16' END AS dtype FROM (SELECT tileset, CAST(importance AS VARCHAR) AS v FROM intervals WHERE importance IS NOT NULL) GROUP BY tileset""")
def dense_dtypes(spark, d):
    iv = table(spark, d, "intervals").where("importance is not null")
    s = iv.groupBy("tileset").agg(F.min("importance").alias("a"), F.max("importance").alias("b"), F.max(F.isnan("importance")).alias("nan"))
    return s.select("tileset", C.dense_dtype(F.col("a"), F.col("b"), F.col("nan")).alias("dtype"))


@query()
def dense_payloads(spark, d):
    """Embeddings as wire tiles."""
    e = table(spark, d, "embeddings").select("vec_id", encode.dense_tile(F.col("embedding").cast("array<double>")).alias("p"))
    return e.select("vec_id", "p.*")


@query("""SELECT src_file, CASE WHEN src_file LIKE '%.tsv' OR src_file LIKE '%.tsv.gz' THEN 'tsv' END AS kind FROM (SELECT DISTINCT src_file FROM dm3_values)""")
def file_kinds(spark, d):
    return table(spark, d, "dm3_values").select("src_file").distinct().select("src_file", C.file_type(F.col("src_file")).alias("kind"))


@query("""SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS bin_start, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2""")
def stream_tumbling_bins(spark, d):
    """A stream of events in hourly bins, run to its end; equal to the batch result."""
    return stream_bins.tumbling_bins_once(spark, f"{d}/events.parquet").withColumn("total", F.round("total", 4))
