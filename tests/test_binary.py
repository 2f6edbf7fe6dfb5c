import gzip
import struct
import zlib

import pytest

from tests.test_problems import rows
from tilewright.functions.encode import decode_dense
from tilewright.model.coords import Chromsizes
from tilewright.model.errors import UnsupportedOption
from tilewright.sources.binary import Bbi, bbi_chromsizes, bbi_reductions, interval_db, read_bam, read_bbi, read_sqlite
from tilewright.tilesets.dense import BigWigTileset
from tilewright.tilesets.records import BigBedTileset, StoredPairTileset, StoredTileset


def bgzf(data: bytes, size: int) -> tuple[bytes, list[int]]:
    """Blocks of ``size`` bytes and where each begins."""
    out, at = b"", []
    for i in range(0, len(data), size):
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(data[i : i + size]) + c.flush()
        at.append(len(out))
        out += b"\x1f\x8b\x08\4\0\0\0\0\0\xff\6\0BC\2\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data[i : i + size]), len(data[i : i + size]))
    return out, at


def bam_record(name, ref, pos, flag, cigar, seq, tags=b""):
    bases = "=ACMGRSVTWYHKDBN"
    codes = [bases.index(b) for b in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in cigar)
    body = struct.pack("<iiBBHHHIiii", ref, pos, len(name) + 1, 60, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + ops + packed + b"\xff" * len(seq) + tags
    return struct.pack("<i", len(body)) + body


def test_bam(spark, tmp_path):
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 2) + b"".join(struct.pack("<i", len(n) + 1) + n + b"\0" + struct.pack("<i", 1000) for n in (b"c1", b"c2"))
    records = [bam_record(f"r{i}", i % 2, 10 * i, 99, [(2, "S"), (4, "M"), (1, "D"), (3, "M")], "ACGTACGTA", b"NMC\1MDZ4^A3\0HPi\2\0\0\0XBBc\2\0\0\0ab") for i in range(50)]
    records.append(bam_record("lost", -1, -1, 4, [], "A"))
    data = head + b"".join(records)
    blob, blocks = bgzf(data, 256)
    (tmp_path / "a.bam").write_bytes(blob)
    plain = rows(read_bam(spark, str(tmp_path / "a.bam")))
    assert len(plain) == 50 and plain[0] == ("r0", 99, "c1", 1, 60, "2S4M1D3M", "ACGTACGTA", "4^A3", 2, 8)
    starts, at = [], len(head)
    for r in records:
        starts.append(blocks[at // 256] << 16 | at % 256)
        at += len(r)
    chunks = b"".join(struct.pack("<QQ", s, s + 1) for s in starts[::7])
    bai = b"BAI\1" + struct.pack("<i", 1) + struct.pack("<i", 1) + struct.pack("<Ii", 4681, len(starts[::7])) + chunks + struct.pack("<i", 0)
    (tmp_path / "a.bam.bai").write_bytes(bai)
    split = read_bam(spark, str(tmp_path / "a.bam"), 300)
    assert split.rdd.getNumPartitions() > 2 and rows(split) == plain


def bbi_file(magic, blocks, packed=True):
    """A file with two contigs; ``blocks``: (contig, start, end, bytes)."""
    tree = struct.pack("<IIIIQQ", 0x78CA8C91, 2, 2, 8, 2, 0) + struct.pack("<BBH", 1, 0, 2) + b"c1" + struct.pack("<II", 0, 1000) + b"c2" + struct.pack("<II", 1, 500)
    at, items, body = 64 + len(tree), [], b""
    for c, s, e, raw in blocks:
        raw = zlib.compress(raw) if packed else raw
        items.append(struct.pack("<IIIIQQ", c, s, c, e, at + len(body), len(raw)))
        body += raw
    index = struct.pack("<IIQIIIIQII", 0x2468ACE0, 2, len(items), 0, 0, 1, 500, 0, 1, 0)
    root = at + len(body) + 48
    leaves = root + 4 + 24 * 2
    halves = [items[:1], items[1:]]
    nodes, place = b"", leaves
    top = struct.pack("<BBH", 0, 0, 2)
    for h in halves:
        node = struct.pack("<BBH", 1, 0, len(h)) + b"".join(h)
        top += struct.pack("<IIIIQ", 0, 0, 1, 500, place)
        nodes += node
        place += len(node)
    head = struct.pack("<IHHQQQHHQQIQ", magic, 4, 0, 64, at, at + len(body), 0, 0, 0, 0, 1000 if packed else 0, 0)
    return head + tree + body + index + top + nodes


@pytest.mark.parametrize("packed", [True, False])
def test_bigwig(spark, tmp_path, packed):
    section = lambda c, s, e, step, span, kind, items: struct.pack("<IIIIIBBH", c, s, e, step, span, kind, 0, len(items)) + b"".join(items)
    blocks = [
        (0, 0, 30, section(0, 0, 30, 0, 0, 1, [struct.pack("<IIf", 0, 10, 1.5), struct.pack("<IIf", 10, 30, 2)])),
        (0, 50, 70, section(0, 50, 70, 0, 5, 2, [struct.pack("<If", 50, 3), struct.pack("<If", 60, 4)])),
        (1, 5, 25, section(1, 5, 25, 10, 2, 3, [struct.pack("<f", 5), struct.pack("<f", 6)])),
    ]
    path = tmp_path / "a.bw"
    path.write_bytes(bbi_file(0x888FFC26, blocks, packed))
    want = [("c1", 0, 10, 1.5, None), ("c1", 10, 30, 2.0, None), ("c1", 50, 55, 3.0, None), ("c1", 60, 65, 4.0, None), ("c2", 15, 17, 6.0, None), ("c2", 5, 7, 5.0, None)]
    got = read_bbi(spark, str(path), 1)
    assert rows(got) == want and got.rdd.getNumPartitions() == 3
    assert bbi_chromsizes(str(path)).offsets == {"c1": 0, "c2": 1000}
    some = read_bbi(spark, str(path), 1, ranges=[("c1", 30, 60), ("cX", 0, 9)])
    assert rows(some) == want[2:4] and some.rdd.getNumPartitions() == 1
    t = BigWigTileset(spark, str(path), tile_size=64)
    z = t.info().max_zoom
    tile = decode_dense(t.tiles([f"u.{z}.0"])[0][1])
    assert tile[:10].tolist() == [1.5] * 10
    swapped = BigWigTileset(spark, str(path), tile_size=64, alternates={"other": Chromsizes([("c2", 1000), ("c1", 1000)])})
    shown = dict(swapped.tiles([f"u.{z}.0", f"u.{z}.0,cos:other"]))
    assert decode_dense(shown[f"u.{z}.0"]).tolist() == tile.tolist() and decode_dense(shown[f"u.{z}.0,cos:other"])[:18].tolist() == [0] * 5 + [5] * 2 + [0] * 8 + [6] * 2 + [0]
    with pytest.raises(UnsupportedOption):
        swapped.tiles([f"u.{z}.0,cos:unknown"])
    assert tile[10:30].tolist() == [2] * 20 and tile[30] == 0 and tile[50:55].tolist() == [3] * 5


def with_summaries(data: bytes, reduction: int, blocks: list) -> bytes:
    """A file with a zoom level, whose summaries and index stand at its end."""
    body, items, at = b"", [], len(data) + 24
    data = data[:64] + struct.pack("<IIQQ", reduction, 0, at, at + sum(len(b[3]) for b in blocks)) + data[64:]
    for c, s, e, raw in blocks:
        items.append(struct.pack("<IIIIQQ", c, s, c, e, at + len(body), len(raw)))
        body += raw
    tree = struct.pack("<IIQIIIIQII", 0x2468ACE0, 256, len(items), 0, 0, 1, 500, 0, 1, 0) + struct.pack("<BBH", 1, 0, len(items)) + b"".join(items)
    return data + body + tree


def shifted(data: bytes, by: int) -> bytes:
    """The places in the header and the trees of a file of ``bbi_file`` moved by what is put in behind the header."""
    raw = bytearray(data)
    tree, body, index = struct.unpack_from("<QQQ", raw, 8)
    struct.pack_into("<H", raw, 6, 1)
    struct.pack_into("<QQQ", raw, 8, tree + by, body + by, index + by)
    nodes = [index + 48]
    while nodes:
        at = nodes.pop()
        leaf, _, n = struct.unpack_from("<BBH", raw, at)
        for k in range(n):
            place = at + 4 + k * (32 if leaf else 24) + 16
            (offset,) = struct.unpack_from("<Q", raw, place)
            struct.pack_into("<Q", raw, place, offset + by)
            if not leaf:
                nodes.append(offset)
    return bytes(raw)


def test_summaries_of_a_bigwig(spark, tmp_path):
    section = lambda c, s, e, items: struct.pack("<IIIIIBBH", c, s, e, 0, 0, 1, 0, len(items)) + b"".join(struct.pack("<IIf", *i) for i in items)
    blocks = [(0, 0, 60, section(0, 0, 60, [(0, 10, 1.0), (10, 30, 4.0)])), (1, 5, 25, section(1, 5, 25, [(5, 25, 2.0)]))]
    zoom = [(0, 0, 16, struct.pack("<IIIIffff", 0, 0, 16, 16, 1, 4, 34, 106)), (0, 16, 32, struct.pack("<IIIIffff", 0, 16, 32, 14, 4, 4, 56, 224)), (1, 0, 32, struct.pack("<IIIIffff", 1, 0, 32, 20, 2, 2, 40, 80))]
    path = tmp_path / "z.bw"
    path.write_bytes(with_summaries(shifted(bbi_file(0x888FFC26, blocks, False), 24), 16, zoom))
    assert bbi_reductions(str(path)) == [16] and len(rows(read_bbi(spark, str(path)))) == 3
    assert rows(read_bbi(spark, str(path), ranges=[("c1", 20, 30)], reduction=16)) == [("c1", 16, 32, 14, 4.0, 4.0, 56.0, 224.0)]
    t = BigWigTileset(spark, str(path), tile_size=32)
    z = t.info().max_zoom - 5  # bins of 32 bases
    got = {m: decode_dense(t.tiles([f"u.{z}.0.{m}"])[0][1])[0] for m in ("mean", "min", "max", "sum")}
    assert got == {"mean": 3, "min": 1, "max": 4, "sum": 90}
    fine = decode_dense(t.tiles([f"u.{z + 5}.0"])[0][1])
    assert fine[:10].tolist() == [1] * 10 and fine[10:30].tolist() == [4] * 20


def test_sqlite_stores(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "a.beddb")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE tileset_info (zoom_step INT, max_length INT, assembly TEXT, chrom_names TEXT, chrom_sizes TEXT, tile_size REAL, max_zoom INT, max_width REAL, header TEXT, version INT)")
    con.execute("INSERT INTO tileset_info VALUES (1, 4000, 'x', 'c1\tc2', '3000\t1000', 1024, 2, 4096, '', 3)")
    con.execute("CREATE TABLE intervals (id INT PRIMARY KEY, zoomLevel INT, importance REAL, startPos INT, endPos INT, chrOffset INT, uid TEXT, name TEXT, fields TEXT)")
    con.executemany("INSERT INTO intervals VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?)", [(i, i % 3, i / 7, 40 * i, 40 * i + 60, 0, f"u{i}", "", f"c1\t{40 * i}") for i in range(90)])
    con.commit()
    assert read_sqlite(spark, path, "intervals", split_rows=25).count() == 90 and read_sqlite(spark, path, "intervals", "zoomLevel = 1").count() == 30
    t = StoredTileset(spark, *interval_db(spark, path))
    got = {r["uid"] for r in t.tiles(["u.1.1"])[0][1]}
    assert got == {f"u{i}" for i in range(90) if i % 3 <= 1 and 40 * i < 4096 and 40 * i + 60 > 2048}
    con.execute("DROP TABLE intervals")
    con.execute("CREATE TABLE intervals (id INT PRIMARY KEY, zoomLevel INT, importance REAL, fromX INT, toX INT, fromY INT, toY INT, chrOffset INT, uid TEXT, fields TEXT)")
    con.execute("INSERT INTO intervals VALUES (1, 0, 1.5, 10, 20, 3000, 3010, 0, 'p', 'a\tb')")
    con.commit()
    con.close()
    pair = StoredPairTileset(spark, *interval_db(spark, path))
    assert [(i, [r["fields"] for r in p]) for i, p in pair.tiles(["u.1.0.1", "u.1.1.0"])] == [("u.1.0.1", [["a", "b"]]), ("u.1.1.0", [])]


def test_bigbed(spark, tmp_path):
    record = lambda c, s, e, rest: struct.pack("<III", c, s, e) + rest + b"\0"
    path = tmp_path / "a.bb"
    path.write_bytes(bbi_file(0x8789F2EB, [(0, 1, 9, record(0, 1, 5, b"n\t7") + record(0, 4, 9, b"")), (1, 2, 3, record(1, 2, 3, b"x"))]))
    t = BigBedTileset(spark, str(path), tile_size=64)
    assert [r["fields"] for r in t.tiles(["u.0.0"])[0][1]] == [["c1", "1", "5", "n", "7"], ["c1", "4", "9"], ["c2", "2", "3", "x"]]
    assert [r["fields"] for r in t.tiles([f"u.{t.info().max_zoom}.15"])[0][1]] == [["c2", "2", "3", "x"]]
    assert rows(read_bbi(spark, str(path))) == [("c1", 1, 5, None, "n\t7"), ("c1", 4, 9, None, None), ("c2", 2, 3, None, "x")]


def test_other_files_are_refused(tmp_path):
    (tmp_path / "x").write_bytes(gzip.compress(b"no") + b"\0" * 80)
    with pytest.raises(ValueError), open(tmp_path / "x", "rb") as f:
        Bbi(f)
