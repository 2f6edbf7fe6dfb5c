"""Command line: ``python -m tilewright.cli aggregate|convert ...`` writes Parquet stores."""

from __future__ import annotations

import argparse

from tilewright.model.coords import Chromsizes
from tilewright.runtime import local_session
from tilewright.sources import stores, text


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tilewright", description=__doc__)
    kinds = top.add_subparsers(dest="group", required=True)
    aggregate, convert = (kinds.add_parser(n).add_subparsers(dest="command", required=True) for n in ("aggregate", "convert"))

    def command(group, name: str, sizes: bool = True, many: bool = False) -> argparse.ArgumentParser:
        p = group.add_parser(name)
        p.add_argument("input", nargs="+" if many else None)
        p.add_argument("--output", required=True)
        if sizes:
            p.add_argument("--chromsizes", required=True)
        return p

    p = command(aggregate, "bedgraph")
    p.add_argument("--tile-size", type=int, default=1024)
    p.add_argument("--zoom-step", type=int, default=8)
    p.add_argument("--nan-value", default="NA")
    p.add_argument("--transform", choices=("none", "exp2"), default="none")
    p.add_argument("--closed-interval", action="store_true")
    p.add_argument("--columns", type=int, nargs=4, default=(1, 2, 3, 4))
    for name, size in (("bedfile", 1024), ("bedpe", 1024)):
        p = command(aggregate, name)
        p.add_argument("--importance-column")
        p.add_argument("--max-per-tile", type=int, default=100)
        p.add_argument("--tile-size", type=int, default=size)
        p.add_argument("--chromosome")
        if name == "bedfile":
            p.add_argument("--delimiter")
            p.add_argument("--offset", type=int, default=0, help="added to both positions")
            p.add_argument("--columns", type=int, nargs=3, default=(1, 2, 3), help="numbers of chromosome, start and end; header lines have no position and drop out")
    p = command(aggregate, "geojson", sizes=False)
    p.add_argument("--max-per-tile", type=int, default=20)
    p.add_argument("--max-zoom", type=int, default=19)
    p = command(convert, "bedfile_to_multivec", many=True)
    p.add_argument("--base-resolution", type=int, default=1)
    p.add_argument("--num-rows", type=int, default=1)
    p.add_argument("--format", choices=("values", "epilogos", "states"), default="values")
    p.add_argument("--tile-size", type=int, default=256)
    p.add_argument("--method", choices=("sum", "logsumexp", "min", "max"), default="sum")
    p.add_argument("--row-infos")
    p = command(convert, "bamfile_to_multivec")
    p.add_argument("--base-resolution", type=int, default=1)
    p.add_argument("--tile-size", type=int, default=256)
    p = command(convert, "bedfile_to_hibed")
    p.add_argument("--importance-column")
    p.add_argument("--max-per-tile", type=int, default=256)
    p = command(aggregate, "multivec")
    p.add_argument("--tile-size", type=int, default=256)
    p.add_argument("--starting-resolution", type=int, default=1)
    p.add_argument("--method", choices=("sum", "logsumexp", "min", "max"), default="sum")
    p.add_argument("--row-infos")
    command(convert, "tsv_to_mrmatrix", sizes=False).add_argument("--top-n", type=int)
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = local_session("tilewright")
    sizes = Chromsizes.from_file(a.chromsizes) if getattr(a, "chromsizes", None) else None
    if a.command == "bedgraph":
        values = text.read_bedgraph(spark, a.input, a.nan_value, a.transform == "exp2", a.closed_interval, tuple(c - 1 for c in a.columns))
        stores.bedgraph_to_store(values, sizes, a.output, a.tile_size, a.zoom_step)
    elif a.command == "bedfile":
        bed = text.read_bed(spark, a.input, a.delimiter, tuple(c - 1 for c in a.columns), a.offset)
        stores.bed_to_store(bed, sizes, a.output, a.importance_column, a.max_per_tile, a.tile_size, a.chromosome)
    elif a.command == "bedpe":
        stores.bedpe_to_store(text.read_bedpe(spark, a.input), sizes, a.output, a.importance_column or "random", a.max_per_tile, a.tile_size, a.chromosome)
    elif a.command == "geojson":
        stores.geo_to_store(text.read_geojson(spark, a.input), a.output, a.max_per_tile, max_zoom=a.max_zoom)
    elif a.command == "bedfile_to_multivec":
        infos = open(a.row_infos).read().splitlines() if a.row_infos else None
        stores.vectors_to_store(text.read_vectors(spark, a.input, a.num_rows, a.format, infos), sizes, a.output, a.base_resolution, a.tile_size, a.method, infos)
    elif a.command == "multivec":  # Parquet of chrom, start, values
        infos = open(a.row_infos).read().splitlines() if a.row_infos else None
        stores.vectors_to_store(spark.read.parquet(a.input), sizes, a.output, a.starting_resolution, a.tile_size, a.method, infos)
    elif a.command == "bamfile_to_multivec":
        from tilewright.sources.binary import read_bam

        alignments = text.read_sam(spark, a.input) if a.input.endswith(".sam") else read_bam(spark, a.input)
        stores.depths_to_store(alignments, sizes, a.output, a.base_resolution, a.tile_size)
    elif a.command == "bedfile_to_hibed":
        stores.bed_to_promoted_store(text.read_bed(spark, a.input), sizes, a.output, a.importance_column, a.max_per_tile)
    elif a.command == "tsv_to_mrmatrix":
        cells = text.read_matrix(spark, a.input, a.top_n)
        size = cells.agg({"row": "max"}).first()[0] + 1
        stores.matrix_to_store(cells, a.output, size)


if __name__ == "__main__":
    main()
