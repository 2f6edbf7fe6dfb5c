"""Placing records in zoom levels by importance: a tile shows at most so many, the most important ones first.

A record's fate at a zoom level depends only on more important ones still there, so levels are worked off one after the
other on the survivors, and the tiles of a level are made for them only. Within a level, no window ever sorts a whole tile: the order
of the capacity-th record, found with a rank limit that is applied before the shuffle, decides all others. What rounds of this leave
undecided are chains of records that wait for each other; as soon as they are few enough for a task, they are visited one by one.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.columns import tile_range
from tilewright.operators.ranking import cap_per_group
from tilewright.runtime import Cut


def _nth(pairs: DataFrame, cap: int, suffix: str) -> DataFrame:
    """Importance and ordinal of the ``cap``-th record of each tile that has so many."""
    last = cap_per_group(pairs, ["_tile"], cap, F.col("_imp").desc(), F.col("_ord").asc(), rank="_r").where(F.col("_r") == cap)
    return last.select("_tile", F.col("_imp").alias(f"_imp{suffix}"), F.col("_ord").alias(f"_ord{suffix}"))


def _after(suffix: str) -> Column:
    """Less important than the given one (false where there is none)."""
    imp, at = F.col(f"_imp{suffix}"), F.col(f"_ord{suffix}")
    return F.coalesce((F.col("_imp") < imp) | ((F.col("_imp") == imp) & (F.col("_ord") > at)), F.lit(False))


#: so many (record, tile) pairs are worth a task
AT_ONCE = 500_000


def _one_by_one(cap: int):
    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, int] = {}
        out = []
        pairs = pairs.sort_values(["_imp", "_ord", "_id"], ascending=[False, True, True], kind="stable")
        for i, fixed, tiles in zip(pairs["_id"], pairs["_fixed"], pairs["_tiles"]):
            room = fixed or all(held.get(t, 0) < cap for t in tiles)
            if room:
                for t in tiles:
                    held[t] = held.get(t, 0) + 1
            if not fixed:
                out.append((i, room))
        return pd.DataFrame(out, columns=["_id", "_placed"])

    return run


def greedy_level(pairs: DataFrame, cap: int, at_once: int = AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """(placed, left) record ids (``_id``) of a level, from (record, tile) ``pairs`` with columns _id, _tile, _imp, _ord.

    Equal to visiting records by importance (ties by ``_ord``) and placing each whose tiles all have room. In a round a
    record is placed if in each of its tiles fewer than ``cap`` placed or undecided ones come before it, and refused
    if in one of them ``cap`` placed ones do; records of one tile are decided in the first round. Once the undecided pairs and the
    placed ones in their tiles are ``at_once`` or fewer, one task visits them in order, so the rounds do not grow with chains of that length.
    """
    undecided = Cut(pairs, "undecided")
    placed: list[DataFrame] = []
    left: list[DataFrame] = []
    while n := undecided.count():
        now = undecided.df
        accepted = reduce(DataFrame.unionByName, placed) if placed else None
        if n <= at_once:
            around = accepted.join(now.select("_tile").distinct(), "_tile", "left_semi") if placed else now.limit(0)
            around = Cut(around, "around")
            if n + around.count() <= at_once:
                rest = now.withColumn("_fixed", F.lit(False)).unionByName(around.df.withColumn("_fixed", F.lit(True)))
                listed = rest.groupBy("_id", "_imp", "_ord", "_fixed").agg(F.collect_list("_tile").alias("_tiles"))
                fates = Cut(listed.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(_one_by_one(cap), "_id bigint, _placed boolean"), "fates").df
                placed.append(fates.where("_placed").select("_id"))
                left.append(fates.where("not _placed").select("_id"))
                break
        known = now.unionByName(accepted) if placed else now
        first = _nth(known, cap, "_a")
        state = now.join(first, "_tile", "left")
        state = state.join(_nth(accepted, cap, "_b"), "_tile", "left") if placed else state.withColumns({"_imp_b": F.lit(None).cast("double"), "_ord_b": F.lit(None).cast("bigint")})
        verdict = state.groupBy("_id").agg(F.max(_after("_a")).alias("_wait"), F.max(_after("_b")).alias("_no"))
        decided = Cut(verdict, "verdict").df
        placed.append(Cut(now.join(decided.where("not _wait").select("_id"), "_id", "left_semi"), "placed").df)
        left.append(decided.where("_wait and _no").select("_id"))
        undecided = Cut(now.join(decided.where("_wait and not _no").select("_id"), "_id", "left_semi"), "undecided")
    none = pairs.select("_id").limit(0)
    return (
        reduce(DataFrame.unionByName, [p.select("_id") for p in placed]).distinct() if placed else none,
        reduce(DataFrame.unionByName, left) if left else none,
    )


def place(df: DataFrame, record: str, importance: str, tiles: list[Column], cap: int, at_once: int = AT_ONCE) -> DataFrame:
    """(record, zoom_level) by greedy placement; ``tiles``: for each zoom, from coarse to fine, the array of tile keys a record meets.

    Records that no level takes are left out; so are records with a null or NaN importance or without any tile. Ties go to the smaller
    ``record``, which must be a unique bigint. Tile keys are made level by level, for the records that are left.
    """
    base = df.where(F.col(importance).isNotNull() & ~F.isnan(F.col(importance).cast("double")))
    base = Cut(base.withColumns({"_id": F.col(record).cast("bigint"), "_imp": F.col(importance).cast("double")}), "records").df
    rest, out = base, []
    for z, keys in enumerate(tiles):
        pairs = rest.select("_id", "_imp", F.col("_id").alias("_ord"), F.explode(keys.cast("array<string>")).alias("_tile"))
        placed, left = greedy_level(pairs, cap, at_once)
        out.append(placed.select(F.col("_id").alias(record), F.lit(z).alias("zoom_level")))
        survivors = Cut(left, "left")
        if not survivors.count():
            break
        rest = base.join(survivors.df, "_id", "left_semi")
    return reduce(DataFrame.unionByName, out)


def interval_tiles(start: Column, end: Column, max_zoom: int, width: int, stride: bool = False) -> list[Column]:
    """Tiles of [start, end) at zooms 0..max_zoom of an extent ``width``. ``stride``: only the tiles met by steps of a tile's
    width from ``start``, which can miss the last one."""
    out = []
    for z in range(max_zoom + 1):
        w = max(1, width >> z)
        met = tile_range(start, end, w)
        if stride:
            met = F.slice(met, 1, F.ceil((end - start) / w).cast("int"))
        out.append(met)
    return out


def rectangle_tiles(xs: tuple[Column, Column], ys: tuple[Column, Column], max_zoom: int, width: float) -> list[Column]:
    """Keys ``x:y`` of the tiles of a rectangle whose both ends count, per zoom."""
    out = []
    for z in range(max_zoom + 1):
        w = width / (1 << z)
        x = F.sequence(F.floor(xs[0] / w), F.floor(xs[1] / w))
        y = F.sequence(F.floor(ys[0] / w), F.floor(ys[1] / w))
        out.append(_crossed(x, y))
    return out


def _crossed(xs: Column, ys: Column) -> Column:
    return F.flatten(F.transform(xs, lambda i: F.transform(ys, lambda j: F.concat_ws(":", i, j))))


def promote(df: DataFrame, cap: int, keep_zoom_0: bool = True) -> DataFrame:
    """(chrom, zoom, tile, seq, line) of entries that climb to the coarsest tile with room.

    Entries (chrom, zoom, tile, seq, line) are visited by ``seq``. Each climbs while the parent tile holds fewer than ``cap``; an entry that
    meets its own line in a tile it climbs to is dropped, and one whose parent is full stays. As tiles fill from the top, a level
    is settled by the ``cap``-th distinct line of each tile. ``keep_zoom_0``: entries that begin at zoom 0 count (otherwise they are left out).
    """
    entries = df.select("chrom", F.col("zoom").alias("_from"), F.col("tile").alias("_base"), "seq", "line")
    rest = Cut(entries if keep_zoom_0 else entries.where("_from > 0"), "entries").df
    top = rest.agg(F.max("_from")).first()[0]
    out = []
    for z in range((top if top is not None else -1) + 1):
        here = rest.withColumn("_tile", F.floor(F.col("_base") / F.pow(F.lit(2), F.col("_from") - z)).cast("bigint"))
        stays = F.col("_from") == z
        # entries that climb enter once a line; those that begin here are all counted
        once = F.when(stays, F.col("seq").cast("string")).otherwise(F.concat(F.lit("l"), F.md5("line")))
        enter = here.groupBy("chrom", "_tile", once.alias("_once")).agg(F.min("seq").alias("seq"))
        full = cap_per_group(enter, ["chrom", "_tile"], cap, F.col("seq").asc(), rank="_r").where(F.col("_r") == cap).select("chrom", "_tile", F.col("seq").alias("_last"))
        judged = here.withColumn("_once", once).join(full, ["chrom", "_tile"], "left").join(enter.withColumnRenamed("seq", "_first"), ["chrom", "_tile", "_once"])
        room = F.col("_last").isNull() | (F.col("seq") <= F.col("_last"))
        judged = Cut(judged.withColumn("_fate", F.when(stays, "here").when(~room, "below").when(F.col("seq") == F.col("_first"), "here").otherwise("gone")), "judged").df
        out.append(judged.where("_fate = 'here'").select("chrom", F.lit(z).alias("zoom"), F.col("_tile").alias("tile"), "seq", "line"))
        rest = judged.where("_fate = 'below'").select("chrom", "_from", "_base", "seq", "line")
    return reduce(DataFrame.unionByName, out) if out else df.select("chrom", "zoom", "tile", "seq", "line").limit(0)


def chrom_level_entries(df: DataFrame, start: str, end: str, length: str, seq: str) -> DataFrame:
    """A row per line and tile at the line's own zoom: floor(log2(W / size)) in the next power of two W of its contig.

    The tile of the end position counts too, and lines without length are left out.
    """
    from tilewright.functions.columns import next_power_of_two

    width = next_power_of_two(F.col(length))
    zoom = F.greatest(F.lit(0), F.floor(F.log2(width / (F.col(end) - F.col(start))))).cast("int")
    tile = F.floor(width / F.pow(F.lit(2), zoom))
    lines = df.where(F.col(end) > F.col(start)).withColumns({"zoom": zoom, "_w": tile})
    lines = lines.withColumn("tile", F.explode(F.sequence(F.floor(F.col(start) / F.col("_w")), F.floor(F.col(end) / F.col("_w"))))).drop("_w")
    return lines.withColumn("seq", F.struct(F.col(seq), F.col("tile")))
