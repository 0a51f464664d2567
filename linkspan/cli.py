"""Command line: compress, filter, decompress, concat, import, index, fetch, neighbors and genome of
stored matrices."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession

from .operators import export, index, ingest, query, transform
from .operators.matrix import LDMatrix, open_matrix, save
from .plans import genome
from .schema import BITS, STATS
from .sources import text
from .sources.archive import is_archive, open_archive, read_archive_variants, write_archive
from .sources.square import read_square
from .sources.vcf import read_vcf


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="linkspan", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)
    compress = verbs.add_parser("compress").add_subparsers(dest="source", required=True)
    for name in ("plinkSquare", "plinkTabular"):
        p = compress.add_parser(name)
        p.add_argument("-l", "--ld_file", required=True)
        p.add_argument("-s", "--snp_file", required=True)
        p.add_argument("-o", "--output_prefix", required=True)
        p.add_argument("-b", "--bits", type=int, choices=BITS, default=8)
        p.add_argument("-m", "--min", type=float, default=0.01)
        if name == "plinkSquare":
            p.add_argument("-t", "--type", choices=STATS, default="PHASED_R")
        else:
            p.add_argument("-c", "--columns", nargs="*", choices=STATS)
            p.add_argument("-k", "--min_col", choices=STATS, default="PHASED_R")
    p = verbs.add_parser("filter")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output_prefix", required=True)
    which = p.add_mutually_exclusive_group(required=True)
    which.add_argument("-r", "--range")
    which.add_argument("-k", "--keep")
    p = verbs.add_parser("decompress")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output_prefix", required=True)
    p.add_argument("-t", "--type", choices=("binary", "tabular", "archive"), default="binary")
    p = verbs.add_parser("concat")
    p.add_argument("-i", "--inputs", nargs="+", required=True)
    p.add_argument("-o", "--output_prefix", required=True)
    p.add_argument("--overlapping", action="store_true")
    p = verbs.add_parser("import", help="store an archive")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output_prefix", required=True)
    p = verbs.add_parser("index", help="index of the variants, sorted by position")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output_prefix", required=True)
    p.add_argument("-s", "--snp_file")
    p = verbs.add_parser("fetch", help="values of variants by place (from 1) or identifier")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-r", "--rows", nargs="+", required=True)
    p.add_argument("-c", "--cols", nargs="+", required=True)
    p.add_argument("-t", "--types", nargs="+", choices=STATS, default=["UNPHASED_R"])
    p.add_argument("--pairwise", action="store_true")
    p.add_argument("-o", "--output", help="folder for the rows; else they are printed")
    p = verbs.add_parser("neighbors", help="variants in LD with one")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-v", "--variant", required=True)
    p.add_argument("-t", "--type", choices=STATS, default="UNPHASED_R2")
    p.add_argument("-a", "--abs_threshold", type=float, default=0.8)
    p.add_argument("-g", "--genomic_length", type=int, default=100_000)
    p.add_argument("-o", "--output", help="folder for the rows; else they are printed")
    p = verbs.add_parser("genome", help="matrix and index of all chromosomes, from calls")
    p.add_argument("--vcf_template", required=True, help="path of the calls, {CHR} for the chromosome")
    p.add_argument("--chroms", default=",".join(map(str, range(1, 23))))
    p.add_argument("-o", "--output_prefix", required=True)
    p.add_argument("-w", "--ld_window_kb", type=int, default=1000)
    p.add_argument("--ld_window_r2", type=float, default=0.01)
    p.add_argument("-b", "--bits", type=int, choices=BITS, default=8)
    p.add_argument("-m", "--min", type=float, default=0.01)
    p.add_argument("-k", "--min_col", choices=STATS, default="PHASED_R")
    p.add_argument("--extract", help="list of identifiers to use")
    p.add_argument("--exclude", help="list of identifiers to leave out")
    p.add_argument("--stage", help="folder that keeps the variants in use and the pair table")
    return top


def _genome(spark: SparkSession, args: argparse.Namespace) -> None:
    genome.check_parameters(vcf=args.vcf_template, bits=args.bits, min_col=args.min_col, window_kb=args.ld_window_kb, r2=args.ld_window_r2)
    began = time.time()
    calls = read_vcf(spark, text.expand_template(args.vcf_template, args.chroms)).drop("idx")
    listed = {k: text.read_ids(spark, p) if p else None for k, p in (("extract", args.extract), ("exclude", args.exclude))}
    save(genome.build_genome(calls, 1000 * args.ld_window_kb, args.ld_window_r2, args.bits, args.min, args.min_col, **listed, stage=args.stage), args.output_prefix)
    done = open_matrix(spark, args.output_prefix)
    index.save_index(index.build_index(done.variants), f"{args.output_prefix}/index")
    print(f"{done.summary()}\nseconds: {time.time() - began:.1f}")


def _asked(words: list[str]) -> list:
    """Places, if all words are numbers, else identifiers."""
    return [int(w) for w in words] if all(w.isdigit() for w in words) else words


def _open(spark: SparkSession, path: str) -> LDMatrix:
    """A stored matrix, or an archive if path is the prefix of one."""
    return open_archive(spark, path) if is_archive(path) else open_matrix(spark, path)


def _give(rows: DataFrame, path: str | None) -> None:
    """Rows to a folder, or printed one partition at a time."""
    if path:
        export.write_lines(rows, path)
        return
    print("\t".join(rows.columns))
    for row in rows.toLocalIterator():
        print("\t".join("" if x is None else str(x) for x in row))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("linkspan").getOrCreate()
    if args.verb == "compress":
        if args.source == "plinkSquare":
            variants = text.read_ids(spark, args.snp_file).selectExpr("idx", "cast(null as string) chrom", "cast(null as int) pos", "id", "cast(null as string) ref", "cast(null as string) alt")
            square = read_square(spark, args.ld_file, variants.count(), args.type)
            out = ingest.from_square(square, variants, args.bits, args.min, args.type)
        else:
            variants = text.read_variants(spark, args.snp_file)
            out = ingest.from_pairs(text.read_pairs(spark, args.ld_file), variants, args.bits, args.min, args.min_col, args.columns)
        save(out, args.output_prefix)
    elif args.verb == "filter":
        matrix = _open(spark, args.input)
        keep = text.read_keep(spark, args.keep) if args.keep else None
        save(transform.filter_matrix(matrix, keep=keep, between=text.parse_range(args.range) if args.range else None), args.output_prefix)
    elif args.verb == "decompress":
        matrix = _open(spark, args.input)
        if args.type == "archive":
            write_archive(matrix, args.output_prefix)
        else:
            export.decompress(matrix, args.output_prefix, args.type)
    elif args.verb == "concat":
        save(transform.concat([_open(spark, p) for p in args.inputs], args.overlapping), args.output_prefix)
    elif args.verb == "import":
        save(open_archive(spark, args.input), args.output_prefix)
    elif args.verb == "index":
        variants = read_archive_variants(spark, args.snp_file) if args.snp_file else _open(spark, args.input).variants
        index.save_index(index.build_index(variants), args.output_prefix)
    elif args.verb == "fetch":
        _give(query.fetch(_open(spark, args.input), _asked(args.rows), _asked(args.cols), args.types, args.pairwise), args.output)
    elif args.verb == "genome":
        _genome(spark, args)
    elif args.verb == "neighbors":
        _give(query.neighbors(_open(spark, args.input), *_asked([args.variant]), args.type, args.abs_threshold, args.genomic_length), args.output)


if __name__ == "__main__":
    main()
