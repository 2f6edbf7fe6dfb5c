import random

import pytest

from tilewright.model.coords import Chromsizes, GenomicRange, natsorted, next_power_of_two, quadtree_depth
from tilewright.model.errors import MalformedTileId, TileOutOfBounds, TilesetUnavailable, TileTooWide, UnsupportedModifier, UnsupportedOption
from tilewright.model.info import Ladder, TilesetInfo
from tilewright.model.policies import TilePolicy, drops, stable_importance, take_most_important
from tilewright.model.tileid import ModifierSpec, TileId

TINY = Chromsizes([("c1", 100), ("c2", 200), ("c3", 50)])


def short(pieces):
    return [(p.name or p.cid, p.start, p.end) for p in pieces]


def test_invert():
    assert short(TINY.invert(90, 150)) == [("c1", 90, 100), ("c2", 0, 50)]
    assert short(TINY.invert(100, 150)) == [("c2", 0, 50)]
    assert short(TINY.invert(250, 470)) == [("c2", 150, 200), ("c3", 0, 50), (3, 0, 120)]
    assert len(TINY.invert(0, 350)) == 3 and TINY.invert(50, 50) == []


def test_transform_round_trip():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = sorted(rnd.sample(range(350), 2))
        spans = [TINY.transform(p) for p in TINY.invert(a, b)]
        assert spans[0][0] == a and spans[-1][1] == b and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    with pytest.raises(KeyError):
        TINY.transform(GenomicRange(9, "c9", 0, 1))


def test_depth_and_sorting():
    assert [quadtree_depth(n, 1024) for n in (1, 1024, 1025, 2048, 2049, 4096)] == [0, 0, 1, 1, 2, 2]
    assert natsorted("chr10 chr2 chrM chr1 chrX chrY".split()) == "chr1 chr2 chr10 chrX chrY chrM".split()
    assert natsorted(["chr1_b", "chr2", "chr1"]) == ["chr1", "chr2", "chr1_b"]
    assert [next_power_of_two(n) for n in (1, 2, 3, 1024, 1025)] == [1, 2, 4, 1024, 2048]
    assert GenomicRange(0, "c1", 4, 9).to_ucsc() == "c1:5-9" and GenomicRange(0, "c1", 4, 9).to_ucsc("01") == "c1:4-9"


def test_importance_and_cap():
    assert stable_importance("") == 0.8285759000573307 and stable_importance("chr1:100-200") == 0.14890028489753604
    rows = [("a", 1), ("b", 3), ("c", 3), ("d", 2)]
    key = lambda r: r[1]
    assert take_most_important(rows, 2, key) == rows[1:3] and take_most_important(rows, 1, key) == [rows[1]]
    assert take_most_important(rows, None, key) == rows and take_most_important(rows, 0, key) == []


def test_tile_ids():
    t = TileId.parse("u.3.4.5.mean,cos:x", 2, ModifierSpec(frozenset({"mean"})))
    assert (t.uid, t.z, t.pos, t.modifier, t.option("cos")) == ("u", 3, (4, 5), "mean", "x") and t.format() == t.raw
    for bad in ("u.3", "u.-1.2", "u.1.²", "u.1.2.m.n", "u.a.1"):
        with pytest.raises(MalformedTileId):
            TileId.parse(bad, 1, ModifierSpec(frozenset({"m"})))
    with pytest.raises(UnsupportedModifier):
        TileId.parse("u.1.2.mean", 1)
    with pytest.raises(UnsupportedOption):
        TileId.parse("u.1.2,a:b", 1, options=frozenset())
    with pytest.raises(TilesetUnavailable):
        TileId.parse("u.1", 0)


def test_canvas_and_info():
    info = TilesetInfo.quadtree(TINY, 64)
    assert (info.max_zoom, info.max_width, info.resolution_for(0), info.tile_width(3), info.ladder) == (3, 512, 8, 64, Ladder.IMPLICIT)
    canvas = info.canvas(3)
    assert canvas.n_tiles == 8 and list(canvas.transform(GenomicRange(0, "c1", 60, 70))) == [0, 1] and short(canvas.invert(5)) == [("c3", 20, 50), (3, 0, 34)]
    assert list(canvas.transform(GenomicRange(0, "c1", 60, 60))) == []
    with pytest.raises(TileOutOfBounds):
        canvas.tile_span(8)
    explicit = TilesetInfo(tile_size=4, resolutions=(10, 20), chromsizes=(("c1", 100), ("c2", 200)))
    assert explicit.canvas(0).max_width == 320 and explicit.resolution_for(1) == 10 and "max_zoom" not in explicit.to_dict()
    with pytest.raises(TileTooWide):
        TilePolicy(max_span=10).check_span(11)
    with pytest.raises(ValueError):
        TilePolicy(max_records=-1)


def test_drops_against_the_recurrence():
    rnd = random.Random(2)
    for _ in range(3000):
        size, t = rnd.choice([1, 10, 1000]), rnd.choice([0.5, 1.0])
        spans = [rnd.randint(1, 5 * size) for _ in range(rnd.randint(1, 12))]
        bins = [-(-s // size) for s in spans]
        walked = claimed = 0
        want = []
        for s, n in zip(spans, bins):
            walked += s
            claimed += n * size
            want.append(claimed - walked >= size * t)
            claimed -= size * want[-1]
        assert drops(spans, bins, size, t) == want
