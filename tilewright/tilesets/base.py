"""Tilesets over DataFrames: a batch of tile ids is one Spark job, whatever its size."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections import defaultdict
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession

from tilewright.model.errors import MalformedTileId, TileError
from tilewright.model.info import TilesetInfo
from tilewright.model.policies import TilePolicy
from tilewright.model.tileid import ModifierSpec, TileId
from tilewright.operators.overlap import Runs, runs_of


class Tileset(ABC):
    """Answers tile ids with payloads. A request that cannot be understood fails as a whole; a tile that cannot be served becomes
    an error payload and its siblings are served."""

    ndim: ClassVar[int] = 1
    modifiers: ClassVar[ModifierSpec | None] = None
    options: ClassVar[frozenset[str]] = frozenset()

    def __init__(self, spark: SparkSession, info: TilesetInfo, policy: TilePolicy | None = None):
        # scans are distributed here, so their size is limited only on request
        self.spark, self._info, self.policy = spark, info, policy or TilePolicy(max_scan_bytes=None)

    def info(self) -> TilesetInfo:
        return self._info

    def tiles(self, ids: list[str], options: dict | None = None) -> list[tuple[str, object]]:
        """(id, payload) in the order of the request."""
        settings = self.batch_options(options)
        parsed = [TileId.parse(i, self.ndim, self.modifiers, self.options) for i in ids]
        out: dict[str, object] = {}
        wanted: dict[str | None, list[TileId]] = defaultdict(list)
        for t in parsed:
            try:
                self._screen(t)
                wanted[t.modifier].append(t)
            except TileError as e:
                out[t.raw] = e.payload()
        for modifier, group in wanted.items():
            places = sorted({(t.z, *t.pos) for t in group})
            got = self.fetch(self._places(places), self._widths(places), modifier, settings)
            for t in group:
                out[t.raw] = got.get((t.z, *t.pos), self.empty(t))
        return [(i, out[i]) for i in ids]

    def all_tiles(self, uid: str = "tile", max_zoom: int | None = None) -> list[tuple[str, object]]:
        """Every tile up to a zoom level (by default all levels), for small tilesets that are shipped whole."""
        top = self._info.num_zoom_levels - 1 if max_zoom is None else max_zoom
        ids = []
        for z in range(top + 1):
            n = self._info.canvas(z).n_tiles
            ids += [f"{uid}.{z}.{x}" for x in range(n)] if self.ndim == 1 else [f"{uid}.{z}.{x}.{y}" for x in range(n) for y in range(n)]
        return self.tiles(ids)

    def batch_options(self, options: dict | None) -> dict:
        if options:
            raise MalformedTileId(f"this tileset knows no options, not {sorted(options)}")
        return {}

    def _screen(self, t: TileId) -> None:
        canvas = self._info.canvas(t.z)
        for x in t.pos:
            canvas.tile_span(x)
        self.policy.check_span(canvas.tile_width)

    def _widths(self, places: list[tuple[int, ...]]) -> dict[int, int]:
        return {z: self._info.tile_width(z) for z, *_ in places}

    def _places(self, places: list[tuple[int, ...]]) -> DataFrame:
        return self.spark.createDataFrame(places, "z int, x bigint" + ", y bigint" * (self.ndim == 2))

    @staticmethod
    def runs(places: DataFrame, axis: str = "x") -> Runs:
        """The requested positions along an axis; ``places`` is local data, so no job is run."""
        return runs_of([(r["z"], r[axis]) for r in places.collect()])

    @abstractmethod
    def fetch(self, places: DataFrame, widths: dict[int, int], modifier: str | None, settings: dict) -> dict[tuple[int, ...], object]:
        """Payloads by place; places without data may be left out."""

    @abstractmethod
    def empty(self, t: TileId) -> object:
        """The payload of a place without data."""

    @property
    def key(self) -> list[str]:
        return ["z", "x", "y"][: 1 + self.ndim]

    def grouped(self, rows: DataFrame, sort: str | None = None) -> dict[tuple[int, ...], list[dict]]:
        """Rows of each place as dictionaries without nulls; what arrives is bounded by the policy's cap a tile."""
        out: dict[tuple[int, ...], list[dict]] = defaultdict(list)
        for r in (rows.orderBy(sort) if sort else rows).toLocalIterator():
            d = r.asDict()
            place = tuple(d.pop(k) for k in self.key)
            out[place].append({k: v for k, v in d.items() if v is not None})
        return out


def scan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of what the file scans of a plan read."""
    found = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    leaves = [found.apply(i) for i in range(found.size())]
    return sum(int(str(x.stats().sizeInBytes())) for x in leaves if x.nodeName() == "LogicalRelation")


def page_of(df: DataFrame, order: list[str], offset: int, limit: int) -> tuple[list[dict], bool]:
    """A page of records and whether more follow; filters are applied before the cut."""
    rows = df.orderBy(*order).offset(offset).limit(limit + 1).collect()
    return [r.asDict() for r in rows[:limit]], len(rows) > limit


