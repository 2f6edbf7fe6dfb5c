"""Column builders: coordinates, hashing, Mercator, parsing of record fields. All run inside the JVM."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_importance(key: Column) -> Column:
    """A double in [0, 1) fixed by the key: the first 32 bits of its md5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def tile_range(start: Column, end: Column, width: int | Column) -> Column:
    """Positions of the tiles that the half-open [start, end) meets; an empty array for an empty or null interval."""
    w = F.lit(width) if isinstance(width, int) else width
    first, last = F.floor(start / w), F.floor((end - 1) / w)
    return F.when(end > start, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def linear_tile_id(z: Column, x: Column) -> Column:
    """Breadth-first number of tile x at zoom z: 2^z - 1 + x."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), z) - 1 + x


def nearest_first_bin(start: Column, end: Column, binsize: int) -> Column:
    """First bin of the nearest-start rule: floor(start / size + 0.5), but never behind the last bin."""
    lo, hi = F.floor(start / binsize + 0.5), F.ceil(end / binsize)
    return F.when((end > start) & (lo >= hi), hi - 1).otherwise(lo)


def bit_length(n: Column) -> Column:
    """Binary digits of a whole number, 0 for 0. Exact where a logarithm is not."""
    return F.when(n == 0, 0).otherwise(F.length(F.bin(n)))


def next_power_of_two(length: Column) -> Column:
    """The smallest power of two that is not below a positive whole number."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bit_length(length.cast("bigint") - 1))


def ucsc(name: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s:%d-%d", name, start + 1, end)


def quadtree_depth(total: Column, tile: Column) -> Column:
    """Zoom levels above the finest until one tile covers everything."""
    return bit_length(F.greatest(F.ceil(total / tile), F.lit(1)) - 1).cast("int")


# ------------------------------------------------------------------------------------------ Mercator


def gudermannian(x: Column) -> Column:
    return F.atan(F.exp(x)) * 2 - pi / 2


def inverse_gudermannian(y: Column) -> Column:
    return F.log(F.tan((y + pi / 2) / 2))


def mercator_tile(lng: Column, lat: Column, z: int) -> tuple[Column, Column]:
    """Fractional tile position; y grows southwards."""
    n = float(1 << z)
    return (lng + 180) / 360 * n, (F.lit(1.0) - inverse_gudermannian(F.radians(lat)) / pi) / 2 * n


def mercator_lng_lat(x: Column, y: Column, z: int) -> tuple[Column, Column]:
    """The north-west corner of a tile."""
    n = float(1 << z)
    return x / n * 360 - 180, F.degrees(gudermannian((F.lit(1.0) - y * 2 / n) * pi))


def lat_to_y(lat: Column) -> Column:
    """Latitude as Mercator degrees."""
    return F.degrees(F.log(F.tan(F.lit(pi / 4) + F.radians(lat) / 2)))


def y_to_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.exp(F.radians(y))) * 2 - pi / 2)


# --------------------------------------------------------------------------------------- records


def record_fields(*columns: Column, rest: Column | None = None) -> Column:
    """The string fields of a record, followed by those of the tab-joined ``rest`` if there are any."""
    own = F.array(*[c.cast("string") for c in columns])
    return own if rest is None else F.when(F.coalesce(rest, F.lit("")) == "", own).otherwise(F.concat(own, F.split(rest, "\t")))


def strand(c: Column) -> Column:
    return F.when(c.isin("+", "-", "."), c)


def read_id(qname: Column, flag: Column) -> Column:
    """The read's name, numbered for paired reads."""
    number = F.when(flag.bitwiseAND(64) != 0, F.lit("_1")).otherwise(F.lit("_2"))
    return F.when(flag.bitwiseAND(1) != 0, F.concat(qname, number)).otherwise(qname)


def is_primary(flag: Column) -> Column:
    """Neither secondary nor supplementary."""
    return flag.bitwiseAND(0x900) == 0


def variant_end(pos: Column, ref: Column, info_end: Column | None = None) -> Column:
    """0-based exclusive end of a variant: INFO/END, else by the length of REF."""
    plain = pos - 1 + F.length(ref)
    return plain if info_end is None else F.coalesce(info_end, plain)


def joined_or_dot(values: Column, separator: str) -> Column:
    text = F.array_join(values, separator)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(".")).otherwise(text)


def default_vector(fields: Column, width: int) -> Column:
    """Value fields as doubles: ``NA``, what is missing and what cannot be read are NaN; Java's suffixes and hexadecimal numbers cannot."""
    nan = F.lit(float("nan"))
    java = lambda f: f.rlike(r"[0-9.][dDfF]\s*\z|[xX]")
    return F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: F.coalesce(F.when((F.get(fields, i) != "NA") & ~java(F.get(fields, i)), F.get(fields, i).try_cast("double")), nan),
    )


def states_vector(state: Column, states: list[str]) -> Column:
    """One-hot over the listed states."""
    return F.array(*[(F.coalesce(state == s, F.lit(False))).cast("int") for s in states])


def epilogos_vector(field: Column) -> Column:
    """``...:[[value, index], ...]`` as the values in the order of their indices."""
    pairs = F.from_json(F.substring_index(field, ":", -1), "array<array<double>>")
    return F.transform(F.array_sort(F.transform(pairs, lambda p: F.struct(p[1].alias("i"), p[0].alias("v")))), lambda s: s["v"])


def substrings(name: Column) -> Column:
    """All distinct substrings of a name in lower case, slashes and runs of blanks as one underscore."""
    text = F.regexp_replace(F.trim(F.replace(F.lower(name), F.lit("/"), F.lit(" "))), r"\s+", "_")
    n = F.length(text)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    cut = F.transform(starts, lambda i: F.transform(F.sequence(i, F.greatest(n, i)), lambda j: F.substr(text, i, j - i + 1)))
    return F.array_distinct(F.filter(F.flatten(cut), lambda s: s != ""))


def shoelace(ring: Column) -> Column:
    """Area of a polygon given as array<struct<x,y>>, closed or not."""
    n = F.size(ring)
    products = F.transform(
        ring, lambda p, i: p["x"] * F.element_at(ring, (i + 1) % n + 1)["y"] - F.element_at(ring, (i + 1) % n + 1)["x"] * p["y"]
    )
    return F.abs(F.aggregate(products, F.lit(0.0), lambda a, x: a + x)) / 2


def bounding_box(ring: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def dense_dtype(least: Column, most: Column, has_nan: Column) -> Column:
    """float16 if no value is NaN and all lie strictly inside its range, else float32."""
    return F.when(~has_nan & (least > -65504) & (most < 65504), F.lit("float16")).otherwise(F.lit("float32"))


def nan_free(c: Column) -> Column:
    """Null instead of NaN, so that aggregates skip it."""
    return F.when(~F.isnan(c), c)


def nan_sum(c: Column) -> Column:
    """Sum without NaN; NaN if nothing is left."""
    return F.coalesce(F.sum(nan_free(c)), F.lit(float("nan")))


def file_type(path: Column) -> Column:
    """Type by extension, compression suffixes aside; null if unknown."""
    name = F.regexp_replace(F.lower(path), r"\.(gz|bgz|bgzf)\z", "")
    kinds = F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair])
    return F.element_at(kinds, F.regexp_extract(name, r"\.([^./]+)\z", 1))


# Extensions and what they hold.
FILE_TYPES = {
    "bed": "bedfile", "bedpe": "bedpe", "bedgraph": "bedgraph", "bg": "bedgraph", "bb": "bigbed", "bigbed": "bigbed", "bw": "bigwig", "bigwig": "bigwig",
    "bam": "bam", "sam": "sam", "cram": "cram", "vcf": "vcf", "bcf": "bcf", "gff": "gff", "gff3": "gff", "gtf": "gtf", "fa": "fasta", "fasta": "fasta", "fna": "fasta",
    "cool": "cooler", "mcool": "cooler", "mv5": "multivec", "hitile": "hitile", "beddb": "beddb", "bed2ddb": "bed2ddb", "json": "json", "geojson": "geojson",
    "csv": "csv", "tsv": "tsv", "sizes": "chromsizes",
}


def index_bins(start: Column, end: Column) -> Column:
    """Numbers of all bins of the binning index (8 levels of 8, finest 16 kb) that [start, end) may lie in, 0 for the root."""
    last = end - 1
    # Fixed values of the format: the first bin of each level and its size in bits.
    levels = [(1, 26), (9, 23), (73, 20), (585, 17), (4681, 14)]
    parts = [F.sequence(F.lit(first) + F.shiftright(start, s), F.lit(first) + F.shiftright(last, s)) for first, s in levels]
    return F.when(end > start, F.flatten(F.array(F.array(F.lit(0).cast("bigint")), *parts))).otherwise(F.array().cast("array<bigint>"))
