"""Command line."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.errors import PySparkException

from strandloom.config import LOG_LEVELS, RunConfig
from strandloom.operators import grids as G
from strandloom.session import build_session, scratch

FALSE_WORDS = ("false", "0", "no", "n", "off")


def check_inputs(config: RunConfig) -> None:
    """Fail early on missing local inputs; ``-`` and remote addresses are not checked."""
    def local(path: str) -> bool:
        return bool(path) and path != "-" and "://" not in path

    for kind, path in (
        *[("VCF", p) for p in config.vcf_files],
        ("reference", config.ref_file), ("tumor", config.tumor_bam), ("normal", config.normal_bam),
    ):
        if not path:
            raise ValueError(f"{kind} path is required")
        if local(path) and not os.path.exists(path):
            raise ValueError(f"{kind} not found: {path}")
    if local(config.bed_file) and not os.path.exists(config.bed_file):
        logging.getLogger("strandloom").warning("BED not found: %s", config.bed_file)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandloom")
    top.add_argument("--overwrite", action="store_true", help="replace existing results")
    commands = top.add_subparsers(dest="command", required=True)

    run = commands.add_parser("run", help="sites and summaries from variants and alignments")
    run.add_argument("-v", "--vcfs", nargs="+", required=True)
    run.add_argument("-r", "--ref", required=True)
    run.add_argument("-t", "--tumor", required=True)
    run.add_argument("-n", "--normal", required=True)
    run.add_argument("-w", "--window", type=int, default=2000)
    run.add_argument("-b", "--bed", default="")
    run.add_argument("--meth-high", type=float, default=0.8)
    run.add_argument("--meth-low", type=float, default=0.2)
    run.add_argument("--min-allele", type=int, default=0)
    run.add_argument("--min-strand-reads", type=int, default=1)
    run.add_argument("--log-level", default="info", type=str.lower, choices=LOG_LEVELS)
    run.add_argument("--log-file", default="strandloom.log")
    run.add_argument("-j", "--threads", type=int, default=0, help="local cores, 0 for all")
    run.add_argument("-o", "--outdir", default="./results")
    run.add_argument("--gzip-output", default="true")
    run.add_argument("--max-read-depth", type=int, default=10000)
    run.add_argument("--max-ram-gb", type=int, default=32)
    run.add_argument("--pool-vcfs", action="store_true",
                     help="analyse all VCFs together and compare them in Level 3")

    def call_sets(name: str, sites: bool, help: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=help)
        p.add_argument("--tp-summary", required=True)
        p.add_argument("--fp-summary", required=True)
        if sites:
            p.add_argument("--tp-detail", required=True)
            p.add_argument("--fp-detail", required=True)
        return p

    full = call_sets("full", True, "statistics and classifier for TP against FP")
    full.add_argument("--out-dir", required=True)
    full.add_argument("--alpha", type=float, default=0.05)

    grid = call_sets("grid", True, "TPR and FPR over a threshold grid")
    grid.add_argument("--out-dir", required=True)
    grid.add_argument("--norm-ths", nargs="+", type=float, default=G.NORMAL_THS)
    grid.add_argument("--delta-ths", nargs="+", type=float, default=G.DELTA_THS)
    grid.add_argument("--read-ths", nargs="+", type=int, default=G.READ_THS)

    haplo = call_sets("haplotypes", False, "haplotype and mode distributions")
    haplo.add_argument("--out-prefix", required=True)
    haplo.add_argument("--low-threshold", type=float, default=0.2)
    haplo.add_argument("--high-threshold", type=float, default=0.8)

    keep = commands.add_parser("retention", help="rows kept over read and site minimums")
    keep.add_argument("--tp", required=True)
    keep.add_argument("--fp", required=True)
    keep.add_argument("--min-reads", default=",".join(map(str, G.MIN_READS)))
    keep.add_argument("--min-cpg", default=",".join(map(str, G.MIN_CPG)))
    keep.add_argument("--out-dir", default=".")

    features = commands.add_parser("features", help="feature tests between two tables")
    features.add_argument("--tp", required=True)
    features.add_argument("--fp", required=True)
    features.add_argument("--feature-file")
    features.add_argument("--out-dir", required=True)
    features.add_argument("--group-by")
    features.add_argument("--alpha", type=float, default=0.05)
    features.add_argument("--n-boot", type=int, default=1000)
    features.add_argument("--seed", type=int, default=0)

    passed = commands.add_parser("pass-filter", help="keep PASS records of a VCF")
    passed.add_argument("vcf")
    passed.add_argument("out")
    passed.add_argument("--keep-header", action="store_true")

    select = commands.add_parser("select-positions", help="keep listed positions of a VCF")
    select.add_argument("vcf")
    select.add_argument("positions")
    select.add_argument("out")
    select.add_argument("--chrom")

    cluster = commands.add_parser("cluster-reads", help="reads as a table that runs read in part")
    cluster.add_argument("alignments")
    cluster.add_argument("out", help="a folder that ends in .parquet")
    return top


def config_from(args: argparse.Namespace) -> RunConfig:
    return RunConfig(
        vcf_files=tuple(args.vcfs), ref_file=args.ref, tumor_bam=args.tumor,
        normal_bam=args.normal, bed_file=args.bed, outdir=args.outdir, window_size=args.window,
        meth_high_threshold=args.meth_high, meth_low_threshold=args.meth_low,
        min_allele=args.min_allele, min_strand_reads=args.min_strand_reads,
        threads=args.threads, gzip_output=args.gzip_output.lower() not in FALSE_WORDS,
        max_read_depth=args.max_read_depth, max_ram_gb=args.max_ram_gb,
        log_level=args.log_level, log_file=args.log_file, per_vcf=not args.pool_vcfs,
    )


def _set_up_logging(config: RunConfig) -> None:
    levels = {"trace": "DEBUG", "warn": "WARNING", "fatal": "CRITICAL"}
    name = config.log_level.lower()
    logging.basicConfig(
        filename=config.log_file or None, level=levels.get(name, name.upper()),
        format="%(asctime)s [%(levelname)s] %(name)s: %(message)s",
    )


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    mode = "overwrite" if args.overwrite else "errorifexists"
    try:
        with scratch():
            return _dispatch(args, mode)
    except (ValueError, KeyError, OSError, PySparkException) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


def _dispatch(args: argparse.Namespace, mode: str) -> int:
    from strandloom.plans import calling, comparisons as P, prepare
    from strandloom.sources import tables as T
    from strandloom.sources.alignments import read_alignments
    from strandloom.sources.reads_table import write_reads_table

    if args.command == "run":
        config = config_from(args)
        check_inputs(config)
        _set_up_logging(config)
        spark = build_session(master=f"local[{args.threads}]" if args.threads > 0 else None)
        for folder in calling.run(spark, config, mode):
            print(folder)
        return 0

    spark = build_session()
    if args.command in ("full", "grid", "haplotypes"):
        sets = P.CallSets(
            T.read_summary(spark, args.tp_summary), T.read_summary(spark, args.fp_summary),
            *([T.read_sites(spark, args.tp_detail), T.read_sites(spark, args.fp_detail)]
              if hasattr(args, "tp_detail") else []),
        )
        if args.command == "full":
            P.full_analysis(spark, sets, args.out_dir, args.alpha, mode)
        elif args.command == "grid":
            P.grid_analysis(sets, args.out_dir, args.norm_ths, args.delta_ths, args.read_ths, mode)
        else:
            P.haplotype_analysis(
                spark, sets, args.out_prefix, args.low_threshold, args.high_threshold, mode
            )
    elif args.command == "retention":
        P.retention_analysis(
            P.CallSets(T.read_summary(spark, args.tp), T.read_summary(spark, args.fp)),
            args.out_dir, G.parse_thresholds(args.min_reads), G.parse_thresholds(args.min_cpg), mode,
        )
    elif args.command == "features":
        tp, fp = T.read_feature_table(spark, args.tp), T.read_feature_table(spark, args.fp)
        if args.feature_file and os.path.exists(args.feature_file):
            names = T.read_feature_list(spark, args.feature_file)
        else:
            names = [c for c in T.numeric_columns(tp) if c != args.group_by]
        P.feature_comparison(tp, fp, names, args.out_dir, args.group_by, args.n_boot, args.seed, mode)
    elif args.command == "pass-filter":
        prepare.pass_filter(spark, args.vcf, args.out, not args.keep_header, mode)
    elif args.command == "cluster-reads":
        if not args.out.rstrip("/").endswith(".parquet"):
            raise ValueError("a reads table ends in .parquet")
        write_reads_table(read_alignments(spark, args.alignments), args.out, mode)
    else:
        prepare.select_positions(spark, args.vcf, args.positions, args.out, args.chrom, mode=mode)
    return 0
