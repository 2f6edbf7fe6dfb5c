"""Contigs laid end to end, and uniform bins and tiles over them.

Small, ordered things (contigs, zoom levels) live on the driver; ``Chromsizes.frame`` gives them to Spark.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import partial
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession

from tilewright.model.errors import TileOutOfBounds
from tilewright.runtime import local_frame


@dataclass(frozen=True)
class GenomicRange:
    """0-based half-open; without a name it lies past the end of the genome."""

    cid: int
    name: str | None
    start: int
    end: int

    @property
    def is_out_of_bounds(self) -> bool:
        return self.name is None

    def to_ucsc(self, coords: str = "11") -> str:
        """``name:start-end`` with a 1-based (``"11"``) or 0-based (``"01"``) start."""
        if coords not in ("01", "11"):
            raise ValueError(f"coords must be '01' or '11', not {coords!r}")
        return f"{self.name}:{self.start + (coords == '11')}-{self.end}"


def natural_key(name: str) -> tuple:
    """Sort key of contig names: numbers by value, X, Y and M last in this order, names with ``_`` after all others.

    A name with ``_`` is ordered by what follows the first one. A total order, so sorting does not depend on the input's order.
    """
    plain, bar, rest = name.partition("_")
    shown = rest.partition("_")[0] if bar else plain
    late = next((rank for rank, letter in ((3, "m"), (2, "y"), (1, "x")) if letter in shown.lower()), 0)
    runs = tuple((0, int(r), "") if r.isdigit() else (1, 0, r) for r in re.findall(r"[0-9]+|[^0-9]+", shown))
    return (bool(bar), late, runs, name)


def natsorted(names) -> list[str]:
    return sorted(names, key=natural_key)


class Chromsizes:
    """An ordered list of contigs; the order fixes all absolute coordinates."""

    def __init__(self, pairs):
        pairs = [(str(n), int(length)) for n, length in pairs]
        self.names = tuple(n for n, _ in pairs)
        self.lengths = tuple(length for _, length in pairs)
        if len(set(self.names)) != len(self.names):
            raise ValueError("contig names must be unique")
        if any(length < 0 for length in self.lengths):
            raise ValueError("contig lengths must not be negative")
        self.boundaries = (0, *accumulate(self.lengths))
        self.offsets = dict(zip(self.names, self.boundaries))

    @classmethod
    def from_pairs(cls, pairs) -> Chromsizes:
        return cls(pairs)

    @classmethod
    def from_frame(cls, df: DataFrame, name: str = "chrom", length: str = "len", order: str | None = "cid", most: int = 1_000_000) -> Chromsizes:
        """From a table of contigs, which must be a bounded one (``most`` rows)."""
        rows = df.select(name, length, *([order] if order else [])).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} contigs")
        rows.sort(key=(lambda r: r[2]) if order else (lambda r: natural_key(r[0])))
        return cls((r[0], r[1]) for r in rows)

    @classmethod
    def from_file(cls, path: str) -> Chromsizes:
        """From a two-column file, naturally sorted; lines without a name and a whole number are left out."""
        pairs = []
        with open(path) as f:
            for line in f:
                parts = line.split()
                if len(parts) > 1 and parts[1].isdecimal():
                    pairs.append((parts[0], int(parts[1])))
        return cls(sorted(pairs, key=lambda p: natural_key(p[0])))

    @property
    def total_length(self) -> int:
        return self.boundaries[-1]

    def transform(self, gr: GenomicRange) -> tuple[int, int]:
        """Absolute span of a range; unknown names raise ``KeyError``, ranges past the genome ``ValueError``."""
        if gr.is_out_of_bounds:
            raise ValueError("a range past the end of the genome has no absolute span")
        at = self.offsets[gr.name]
        return at + gr.start, at + gr.end

    def invert(self, lo: int, hi: int) -> list[GenomicRange]:
        """The pieces of an absolute span contig by contig, and what lies past the genome as a nameless piece."""
        if lo < 0 or hi < lo:
            raise ValueError(f"not a span: {lo}, {hi}")
        out, at = [], lo
        k = bisect_right(self.boundaries, lo) - 1
        while at < hi and k < len(self.names):
            end = min(hi, self.boundaries[k + 1])
            if end > at:
                out.append(GenomicRange(k, self.names[k], at - self.boundaries[k], end - self.boundaries[k]))
                at = end
            k += 1
        if at < hi:
            past = max(at, self.total_length)
            out.append(GenomicRange(len(self.names), None, past - self.total_length, hi - self.total_length))
        return out

    def frame(self, spark: SparkSession, sized: bool = False) -> DataFrame:
        """``sized``: by ``local_frame``, so that a join with few contigs needs no shuffle."""
        rows = [(i, n, length, at) for i, (n, length, at) in enumerate(zip(self.names, self.lengths, self.boundaries))]
        make = partial(local_frame, spark) if sized else spark.createDataFrame
        return make(rows, "cid int, chrom string, len bigint, chrom_offset bigint")


def quadtree_depth(total: int, tile: int) -> int:
    """Zoom levels above the finest until one tile covers everything."""
    if total <= 0 or tile <= 0:
        raise ValueError("lengths must be positive")
    return (-(-total // tile) - 1).bit_length()


def next_power_of_two(length: int) -> int:
    return 1 << max(0, (length - 1).bit_length())


@dataclass(frozen=True)
class TileCanvas:
    """The bins and tiles of one zoom level. Bins do not respect contig boundaries."""

    z: int
    binsize: int
    tile_size: int
    max_width: int
    chromsizes: Chromsizes | None = None

    @property
    def tile_width(self) -> int:
        return self.binsize * self.tile_size

    @property
    def n_bins(self) -> int:
        return self.max_width // self.binsize

    @property
    def n_tiles(self) -> int:
        return -(-self.n_bins // self.tile_size)

    def tile_span(self, x: int) -> tuple[int, int]:
        if not 0 <= x < self.n_tiles:
            raise TileOutOfBounds(f"tile {x} at zoom {self.z} is outside 0..{self.n_tiles - 1}")
        return x * self.tile_width, (x + 1) * self.tile_width

    def transform(self, gr: GenomicRange) -> range:
        """Positions of the tiles that a range meets; an empty range meets none."""
        lo, hi = self.chromsizes.transform(gr)
        if hi <= lo:
            return range(0)
        return range(max(0, lo // self.tile_width), min(self.n_tiles - 1, (hi - 1) // self.tile_width) + 1)

    def invert(self, x: int) -> list[GenomicRange]:
        return self.chromsizes.invert(*self.tile_span(x))
