"""Tileset metadata: extent, zoom ladder and canvas."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from enum import Enum

from tilewright.model.coords import Chromsizes, TileCanvas, quadtree_depth
from tilewright.model.errors import TileOutOfBounds


class Ladder(Enum):
    IMPLICIT = "implicit"
    EXPLICIT = "explicit"


@dataclass(frozen=True)
class TilesetInfo:
    """Fields that are None are absent from ``to_dict``; ``extra`` fields are added as they are."""

    tile_size: int | None = None
    max_zoom: int | None = None
    max_width: int | None = None
    resolutions: tuple[int, ...] | None = None
    chromsizes: tuple[tuple[str, int], ...] | None = None
    min_pos: tuple[int, ...] | None = None
    max_pos: tuple[int, ...] | None = None
    extra: dict = field(default_factory=dict)

    @classmethod
    def quadtree(cls, chromsizes: Chromsizes, tile_size: int, ndim: int = 1, **extra) -> TilesetInfo:
        depth = quadtree_depth(chromsizes.total_length, tile_size)
        return cls(
            tile_size, depth, tile_size << depth, None, tuple(zip(chromsizes.names, chromsizes.lengths)), (0,) * ndim, (chromsizes.total_length,) * ndim, extra
        )

    @property
    def ladder(self) -> Ladder:
        return Ladder.EXPLICIT if self.resolutions else Ladder.IMPLICIT

    @property
    def num_zoom_levels(self) -> int:
        return len(self.resolutions) if self.resolutions else self.max_zoom + 1

    def resolution_for(self, z: int) -> int:
        """Bases per bin at a zoom level."""
        if z < 0 or z >= self.num_zoom_levels:
            raise TileOutOfBounds(f"no zoom level {z} among {self.num_zoom_levels}")
        if self.resolutions:
            return sorted(self.resolutions, reverse=True)[z]
        per_bin, rest = divmod(self.max_width, self.tile_size << z)
        if rest:
            raise ValueError(f"{self.max_width} is no whole number of bins at zoom {z}")
        return per_bin

    def tile_width(self, z: int) -> int:
        return self.resolution_for(z) * self.tile_size

    def canvas(self, z: int) -> TileCanvas:
        """One extent for all levels of a quadtree; whole tiles over the genome for each level of an explicit ladder."""
        contigs, width = Chromsizes(self.chromsizes) if self.chromsizes else None, self.max_width
        if self.ladder is Ladder.EXPLICIT:
            tile = self.tile_width(z)
            width = -(-contigs.total_length // tile) * tile
        return TileCanvas(z, self.resolution_for(z), self.tile_size, width, contigs)

    def to_dict(self) -> dict:
        known = {k: v for k, v in asdict(self).items() if k != "extra" and v is not None}
        return known | {k: v for k, v in self.extra.items() if v is not None}

    def to_json(self) -> str:
        return json.dumps(self.to_dict())
