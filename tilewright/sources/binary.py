"""Readers of BAM, bigWig and bigBed files as Spark data sources.

``read_bam`` and ``read_bbi`` register and load them. Files are opened by path, so on a cluster they must lie in a mounted shared
folder. A BAM file with an index (``.bai``) is split at record starts that the index names, a bigWig or bigBed file at its data blocks.
"""

from __future__ import annotations

import gzip
import json
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_BATCH = 20_000


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


# ------------------------------------------------------------------------------------------------ BAM

_BAM_SCHEMA = pa.schema(
    [("qname", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("seq", pa.string()), ("md", pa.string()), ("hp", pa.int32()), ("end", pa.int64())]
)
_BAM_DDL = "qname string, flag int, chrom string, pos bigint, mapq int, cigar string, seq string, md string, hp int, end bigint"
# Fixed values of the format: CIGAR operations, packed bases, sizes of numeric tags.
_CIGAR_OPS, _BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
_TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_TAG_CODES = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}


def _tags(raw: bytes) -> dict[str, object]:
    out, at = {}, 0
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(b"\0", at)
            out[name], at = raw[at:end].decode(), end + 1
        elif kind == "B":
            n = struct.unpack_from("<I", raw, at + 1)[0]
            at += 5 + n * _TAG_SIZES[chr(raw[at])]
        else:
            if kind in _TAG_CODES:
                out[name] = struct.unpack_from(_TAG_CODES[kind], raw, at)[0]
            at += _TAG_SIZES[kind]
    return out


def _bam_record(raw: bytes, names: list[str]) -> tuple | None:
    ref, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHI", raw)
    if ref < 0 or pos < 0:
        return None
    at = 32
    qname = raw[at : at + l_name - 1].decode()
    at += l_name
    ops = [(v >> 4, _CIGAR_OPS[v & 15]) for v in struct.unpack_from(f"<{n_cigar}I", raw, at)]
    at += 4 * n_cigar
    packed = raw[at : at + (l_seq + 1) // 2]
    seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:l_seq]
    tags = _tags(raw[at + len(packed) + l_seq :])
    span = sum(n for n, o in ops if o in "M=XDN")
    return qname, flag, names[ref], pos + 1, mapq, "".join(f"{n}{o}" for n, o in ops), seq, tags.get("MD"), tags.get("HP"), pos + max(span, 1)


def _bam_header(f) -> list[str]:
    if f.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    f.read(struct.unpack("<i", f.read(4))[0])
    names = []
    for _ in range(struct.unpack("<i", f.read(4))[0]):
        names.append(f.read(struct.unpack("<i", f.read(4))[0])[:-1].decode())
        f.read(4)
    return names


def _bai_starts(path: str) -> list[int]:
    """Virtual offsets (block << 16 | place) of record starts that a BAM index names, sorted."""
    with open(path, "rb") as f:
        raw = f.read()
    at, out = 8, set()
    for _ in range(struct.unpack_from("<i", raw, 4)[0]):
        (bins,) = struct.unpack_from("<i", raw, at)
        at += 4
        for _ in range(bins):
            number, chunks = struct.unpack_from("<Ii", raw, at)
            at += 8
            if number != 37450:  # the bin of metadata
                out.update(struct.unpack_from(f"<{2 * chunks}Q", raw, at)[::2])
            at += 16 * chunks
        (windows,) = struct.unpack_from("<i", raw, at)
        at += 4 + 8 * windows
    return sorted(out)


@dataclass
class _BamSplit(InputPartition):
    start: int | None
    end: int | None

    def __init__(self, start, end):
        super().__init__((start, end))
        self.start, self.end = start, end


class _BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.size = int(options.get("splitbytes", 64 << 20))

    def partitions(self):
        index = next((p for p in (self.path + ".bai", self.path.removesuffix(".bam") + ".bai") if os.path.exists(p)), None)
        cuts: list[int] = []
        for v in _bai_starts(index) if index else []:
            if not cuts or (v >> 16) - (cuts[-1] >> 16) >= self.size:
                cuts.append(v)
        return [_BamSplit(a, b) for a, b in zip(cuts, [*cuts[1:], None])] if cuts else [_BamSplit(None, None)]

    def read(self, split):
        yield from _batches(self._rows(split), _BAM_SCHEMA)

    def _rows(self, split):
        with gzip.open(self.path) as f:
            names = _bam_header(f)
            if split.start is None:
                while size := f.read(4):
                    if record := _bam_record(f.read(struct.unpack("<i", size)[0]), names):
                        yield record
                return
        with open(self.path, "rb") as raw:
            yield from self._indexed(raw, split, names)

    def _indexed(self, raw, split, names):
        """Records that begin in [start, end), block by block; the last one may run into later blocks."""
        raw.seek(split.start >> 16)
        held, at = b"", split.start & 0xFFFF
        # where each held block begins: (place in held, file offset)
        marks: list[tuple[int, int]] = []
        while True:
            while len(held) - at < 4 or len(held) - at < 4 + struct.unpack_from("<i", held, at)[0]:
                where = raw.tell()
                head = raw.read(18)
                if len(head) < 18:
                    return
                size = struct.unpack_from("<H", head, 16)[0] + 1
                block = zlib.decompress(head + raw.read(size - 18), 31)
                drop = at if at < len(held) else len(held)
                held, at = held[drop:], at - drop
                marks = [(p - drop, o) for p, o in marks]
                marks.append((len(held), where))
                held += block
            place, offset = max(m for m in marks if m[0] <= at)
            if split.end is not None and (offset << 16 | at - place) >= split.end:
                return
            size = struct.unpack_from("<i", held, at)[0]
            if record := _bam_record(held[at + 4 : at + 4 + size], names):
                yield record
            at += 4 + size


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tilewright_bam"

    def schema(self) -> str:
        return _BAM_DDL

    def reader(self, schema) -> DataSourceReader:
        return _BamReader(self.options)


def read_bam(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """The columns of ``text.read_sam``; unplaced reads are dropped."""
    spark.dataSource.register(BamSource)
    return spark.read.format("tilewright_bam").option("splitBytes", split_bytes).load(path)


# ---------------------------------------------------------------------------------------- bigWig, bigBed

# Fixed values of the format: magic numbers.
_BIGWIG, _BIGBED, _CONTIGS, _RTREE = 0x888FFC26, 0x8789F2EB, 0x78CA8C91, 0x2468ACE0


class Bbi:
    """The header, contigs and data blocks of a bigWig or bigBed file."""

    def __init__(self, f):
        f.seek(0)
        raw = f.read(64)
        self.order = "<" if struct.unpack_from("<I", raw)[0] in (_BIGWIG, _BIGBED) else ">"
        (self.magic,) = struct.unpack_from(self.order + "I", raw)
        if self.magic not in (_BIGWIG, _BIGBED):
            raise ValueError("neither a bigWig nor a bigBed file")
        self.tree, _, self.index = struct.unpack_from(self.order + "QQQ", raw, 8)
        self.packed = struct.unpack_from(self.order + "I", raw, 52)[0] > 0
        self.f = f
        #: reduction (bases of a summary) -> place of its index, finest first
        self.zooms = {}
        for _ in range(struct.unpack_from(self.order + "H", raw, 6)[0]):
            reduction, _, _, index = self._unpack("IIQQ")
            self.zooms[reduction] = index

    def _unpack(self, form: str) -> tuple:
        return struct.unpack(self.order + form, self.f.read(struct.calcsize(self.order + form)))

    def contigs(self) -> dict[int, tuple[str, int]]:
        self.f.seek(self.tree)
        magic, _, key, _, _, _ = self._unpack("IIIIQQ")
        if magic != _CONTIGS:
            raise ValueError("the contig tree is damaged")
        out, nodes = {}, [self.f.tell()]
        while nodes:
            self.f.seek(nodes.pop())
            leaf, _, n = self._unpack("BBH")
            for _ in range(n):
                name = self.f.read(key).rstrip(b"\0").decode()
                if leaf:
                    number, length = self._unpack("II")
                    out[number] = (name, length)
                else:
                    nodes.append(self._unpack("Q")[0])
        return out

    def blocks(self, ranges: list[tuple[int, int, int]] | None = None, reduction: int | None = None) -> list[tuple[int, int]]:
        """(offset, size) of data blocks in file order: all of them, or those that may meet one of the ``ranges`` (contig, start, end). Of the
        index only the nodes above them are read. ``reduction``: the blocks of summaries of so many bases."""
        index = self.index if reduction is None else self.zooms[reduction]
        self.f.seek(index)
        if self._unpack("I")[0] != _RTREE:
            raise ValueError("the index is damaged")
        meets = lambda i: ranges is None or any((i[0], i[1]) < (c, e) and (i[2], i[3]) > (c, s) for c, s, e in ranges)
        out, nodes = [], [index + 48]
        while nodes:
            self.f.seek(nodes.pop())
            leaf, _, n = self._unpack("BBH")
            items = [i for _ in range(n) if meets(i := self._unpack("IIIIQQ" if leaf else "IIIIQ"))]
            if leaf:
                out += [i[4:] for i in items]
            else:
                nodes += [i[4] for i in items]
        return sorted(out)

    def rows(self, offset: int, size: int, contigs: dict[int, tuple[str, int]]) -> Iterator[tuple]:
        """(chrom, start, end, value, rest) of a block; ``rest`` for bigBed, ``value`` for bigWig."""
        self.f.seek(offset)
        raw = self.f.read(size)
        raw = zlib.decompress(raw) if self.packed else raw
        if self.magic == _BIGBED:
            at = 0
            while at + 12 <= len(raw):
                number, start, end = struct.unpack_from(self.order + "III", raw, at)
                stop = raw.index(b"\0", at + 12)
                yield contigs[number][0], start, end, None, raw[at + 12 : stop].decode() or None
                at = stop + 1
            return
        number, start, _, step, span, kind, _, n = struct.unpack_from(self.order + "IIIIIBBH", raw)
        name = contigs[number][0]
        form = {1: "IIf", 2: "If", 3: "f"}[kind]
        for i, item in enumerate(struct.iter_unpack(self.order + form, raw[24 : 24 + n * struct.calcsize(self.order + form)])):
            at = start + i * step if kind == 3 else item[0]
            yield name, at, item[1] if kind == 1 else at + span, float(item[-1]), None


    def summaries(self, offset: int, size: int, contigs: dict[int, tuple[str, int]]) -> Iterator[tuple]:
        """(chrom, start, end, covered, min, max, sum, squares) of a block of summaries."""
        self.f.seek(offset)
        raw = self.f.read(size)
        for number, start, end, covered, *stats in struct.iter_unpack(self.order + "IIIIffff", zlib.decompress(raw) if self.packed else raw):
            yield contigs[number][0], start, end, covered, *map(float, stats)


@dataclass
class _BbiSplit(InputPartition):
    blocks: list

    def __init__(self, blocks):
        super().__init__(len(blocks))
        self.blocks = blocks


_BBI_ROWS = pa.schema([("chrom", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.float64()), ("rest", pa.string())])
_BBI_SUMMARIES = pa.schema([("chrom", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.int64())] + [(n, pa.float64()) for n in ("min", "max", "sum", "squares")])


class _BbiReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.size = int(options.get("splitbytes", 16 << 20))
        self.ranges = json.loads(options["ranges"]) if "ranges" in options else None
        self.reduction = int(options["reduction"]) if "reduction" in options else None

    def partitions(self):
        with open(self.path, "rb") as f:
            b = Bbi(f)
            numbers = {name: k for k, (name, _) in b.contigs().items()}
            ranges = None if self.ranges is None else [(numbers[c], s, e) for c, s, e in self.ranges if c in numbers]
            blocks = b.blocks(ranges, self.reduction)
        out, held, size = [], [], 0
        for b in blocks:
            held.append(b)
            size += b[1]
            if size >= self.size:
                out.append(_BbiSplit(held))
                held, size = [], 0
        return out + [_BbiSplit(held)] * bool(held or not out)

    def read(self, split):
        with open(self.path, "rb") as f:
            b = Bbi(f)
            contigs = b.contigs()
            rows, schema = (b.rows, _BBI_ROWS) if self.reduction is None else (b.summaries, _BBI_SUMMARIES)
            yield from _batches((row for block in split.blocks for row in rows(*block, contigs)), schema)


class BbiSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tilewright_bbi"

    def schema(self) -> str:
        if "reduction" in self.options:
            return "chrom string, start bigint, end bigint, covered bigint, min double, max double, sum double, squares double"
        return "chrom string, start bigint, end bigint, value double, rest string"

    def reader(self, schema) -> DataSourceReader:
        return _BbiReader(self.options)


def read_bbi(spark: SparkSession, path: str, split_bytes: int = 16 << 20, ranges: list[tuple[str, int, int]] | None = None, reduction: int | None = None) -> DataFrame:
    """(chrom, start, end, value, rest): the base-resolution intervals of a bigWig file or the records of a bigBed file.

    ``ranges`` (chrom, start, end): only the blocks that the file's index names for them are read, and what they hold beside the ranges
    is left in. ``reduction``: the stored summaries of so many bases, (chrom, start, end, covered, min, max, sum, squares).
    """
    spark.dataSource.register(BbiSource)
    reader = spark.read.format("tilewright_bbi").option("splitBytes", split_bytes)
    if ranges is not None:
        reader = reader.option("ranges", json.dumps(ranges))
    if reduction is not None:
        reader = reader.option("reduction", reduction)
    return reader.load(path)


def bbi_reductions(path: str) -> list[int]:
    """The bases of the stored summaries, finest first."""
    with open(path, "rb") as f:
        return sorted(Bbi(f).zooms)


def bbi_chromsizes(path: str):
    """Contigs in the order of their numbers."""
    from tilewright.model.coords import Chromsizes

    with open(path, "rb") as f:
        found = Bbi(f).contigs()
    return Chromsizes(found[i] for i in sorted(found))


# ------------------------------------------------------------------------------------------------ SQLite


@dataclass
class _RowSplit(InputPartition):
    lo: int
    hi: int

    def __init__(self, lo, hi):
        super().__init__((lo, hi))
        self.lo, self.hi = lo, hi


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema):
        self.path, self.table, self.where = options["path"], options["table"], options.get("where", "1")
        self.rows, self.schema = int(options.get("splitrows", 1_000_000)), schema

    def _open(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        con = self._open()
        lo, hi = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        con.close()
        return [_RowSplit(0, 0)] if lo is None else [_RowSplit(a, min(hi + 1, a + self.rows)) for a in range(lo, hi + 1, self.rows)]

    def read(self, split):
        con = self._open()
        names = ", ".join(f'"{f.name}"' for f in self.schema)
        kinds = {"bigint": int, "double": float, "string": str, "binary": bytes}
        casts = [kinds[f.dataType.simpleString()] for f in self.schema]
        for row in con.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ? AND ({self.where})', (split.lo, split.hi)):
            yield tuple(None if v is None else c(v) for c, v in zip(casts, row))
        con.close()


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tilewright_sqlite"

    def schema(self) -> str:
        import sqlite3

        con = sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)
        columns = con.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        con.close()
        kind = lambda t: "bigint" if "INT" in t else "double" if any(k in t for k in ("REAL", "FLOA", "DOUB")) else "binary" if "BLOB" in t else "string"
        return ", ".join(f"`{c[1]}` {kind(c[2].upper())}" for c in columns)

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options, schema)


def read_sqlite(spark: SparkSession, path: str, table: str, where: str | None = None, split_rows: int = 1_000_000) -> DataFrame:
    """A table of an SQLite file, read in ranges of row numbers. ``where``: a condition that the file answers with its own indexes."""
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("tilewright_sqlite").option("table", table).option("splitRows", split_rows)
    return (reader.option("where", where) if where else reader).load(path)


def interval_db(spark: SparkSession, path: str):
    """(records, info) of an SQLite store of placed intervals or pairs, ready for ``StoredTileset`` and ``StoredPairTileset``."""
    from tilewright.model.coords import Chromsizes
    from tilewright.model.info import TilesetInfo

    head = read_sqlite(spark, path, "tileset_info").first().asDict()
    sizes = Chromsizes(zip(head["chrom_names"].split("\t"), map(int, str(head["chrom_sizes"]).split("\t"))))
    rows = read_sqlite(spark, path, "intervals")
    names = {"startPos": "x_start", "endPos": "x_end", "fromX": "x_start", "toX": "x_end", "fromY": "y_start", "toY": "y_end", "chrOffset": "x_offset", "zoomLevel": "zoom_level"}
    rows = rows.withColumnsRenamed({k: v for k, v in names.items() if k in rows.columns})
    info = TilesetInfo(int(head["tile_size"]), int(head["max_zoom"]), int(head["max_width"]), None, tuple(zip(sizes.names, sizes.lengths)), (0,), (sizes.total_length,))
    from pyspark.sql import functions as F

    return rows.withColumn("fields", F.split("fields", "\t")), info
