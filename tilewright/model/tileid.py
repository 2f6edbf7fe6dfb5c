"""Tile ids: ``uid.z.pos[.pos][.modifier][,key:value]...``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.model.errors import MalformedTileId, TilesetUnavailable, UnsupportedModifier, UnsupportedOption

_NUMBER = re.compile(r"[0-9]+")


@dataclass(frozen=True)
class ModifierSpec:
    """The modifiers a tileset knows; ``default`` stands for an absent one."""

    values: frozenset[str]
    default: str | None = None

    def validate(self, value: str | None) -> str | None:
        if value is None:
            return self.default
        if value not in self.values:
            raise UnsupportedModifier(f"{value!r} is none of {sorted(self.values)}")
        return value


@dataclass(frozen=True)
class TileId:
    uid: str
    z: int
    pos: tuple[int, ...]
    modifier: str | None = None
    options: tuple[tuple[str, str], ...] = ()
    raw: str = ""

    def option(self, key: str, default: str | None = None) -> str | None:
        return dict(reversed(self.options)).get(key, default)

    def format(self) -> str:
        parts = [self.uid, *map(str, (self.z, *self.pos)), *([self.modifier] if self.modifier is not None else [])]
        return ",".join([".".join(parts), *(f"{k}:{v}" for k, v in self.options)])

    def __str__(self) -> str:
        return self.raw or self.format()

    @classmethod
    def parse(cls, raw: str, ndim: int, modifiers: ModifierSpec | None = None, options: frozenset[str] | None = None) -> TileId:
        """Numbers are ASCII digits only, so negative ones are malformed. ``options``: known keys, ``None`` for any."""
        if ndim < 1:
            raise TilesetUnavailable(f"a tileset of {ndim} dimensions has no tiles")
        head, *chunks = raw.split(",")
        given = []
        for chunk in filter(None, chunks) if chunks == [""] else chunks:
            key, colon, value = chunk.partition(":")
            if not colon:
                raise MalformedTileId(f"{chunk!r} in {raw!r} is not key:value")
            if options is not None and key not in options:
                raise UnsupportedOption(f"unknown option {key!r} in {raw!r}")
            given.append((key, value))
        uid, *rest = head.split(".")
        numbers, tail = rest[: 1 + ndim], rest[1 + ndim :]
        if len(numbers) < 1 + ndim or not all(map(_NUMBER.fullmatch, numbers)) or len(tail) > 1:
            raise MalformedTileId(f"{raw!r} is not uid.z{'.pos' * ndim}[.modifier]")
        if tail and modifiers is None:
            raise UnsupportedModifier(f"{raw!r} has a modifier and the tileset knows none")
        modifier = modifiers.validate(tail[0] if tail else None) if modifiers else None
        z, *pos = map(int, numbers)
        return cls(uid, z, tuple(pos), modifier, tuple(given), raw)


def parsed(tile_id: Column, ndim: int) -> Column:
    """A tile id column as struct(uid, z, pos, modifier, options); null for malformed ids."""
    head = F.split_part(tile_id, F.lit(","), F.lit(1))
    parts = F.split(head, r"\.")
    shape = r"\A[^.]*(\.[0-9]{1,18}){" + str(1 + ndim) + r"}(\.[^.]*)?\z"
    rest = F.regexp_replace(tile_id, r"\A[^,]*,?", "")
    good = head.rlike(shape) & ((rest == "") | rest.rlike(r"\A[^,:]*:[^,]*(,[^,:]*:[^,]*)*\z"))
    options = F.when(rest == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(rest, F.lit(","), F.lit(":")))
    number = lambda i: F.get(parts, F.lit(i)).try_cast("bigint")
    return F.when(
        good,
        F.struct(
            F.get(parts, F.lit(0)).alias("uid"),
            number(1).cast("int").alias("z"),
            F.array(*[number(2 + i) for i in range(ndim)]).alias("pos"),
            F.get(parts, F.lit(2 + ndim)).alias("modifier"),
            options.alias("options"),
        ),
    )
