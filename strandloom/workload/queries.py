"""Registered queries: each operator over whole input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandloom.config import RunConfig
from strandloom.functions import alignment as A, basemods as B, sites as S
from strandloom.operators import (
    classify as K, contrast as C, describe as D, extract as E, grids as G, overlap as O,
    reads as R, summary as M, sweep, tests as T, variants as V,
)
from strandloom.plans.analyze import analyze
from strandloom.schema import CONTRAST_KEY, FEATURES, SITE_COLUMNS, SUMMARY_COLUMNS
from strandloom.session import materialize
from strandloom.sinks import reports
from strandloom.sources.alignments import sam_reads
from strandloom.sources.variants import bed_regions, vcf_records
from strandloom.workload.views import spark_view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

WINDOW = RunConfig().window_size
CONFIG = RunConfig(min_strand_reads=1)
VCFS = ["fp", "tp"]
HIGH, LOW = 0.8, 0.2


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(f"`{c}`")) for c in columns})


# --- inputs ----------------------------------------------------------------------------------


def sites(spark: SparkSession, d: str) -> DataFrame:
    return spark_view(spark, d, "sites").withColumns({
        "meth_state": S.meth_state(F.col("meth_call"), HIGH, LOW),
        "somatic_base_at_variant": F.when(F.col("somatic_allele_type") == "ref", "A").otherwise("C"),
    }).select(*SITE_COLUMNS)


def sparse_sites(spark: SparkSession, d: str) -> DataFrame:
    return spark_view(spark, d, "sparse_sites")


def labelled_sites(spark: SparkSession, d: str) -> DataFrame:
    return sparse_sites(spark, d).withColumn("label", F.upper("vcf_source_id"))


def labelled_summary(spark: SparkSession, d: str) -> DataFrame:
    return M.level2_summary(sparse_sites(spark, d)).withColumn("label", F.upper("vcf_source_id"))


def contrast(spark: SparkSession, d: str) -> DataFrame:
    return C.pivot_delta(labelled_summary(spark, d), ["label"])


def features(
    spark: SparkSession, d: str, names=("supporting_read_count", "methyl_sites_count", "mean_methylation")
) -> DataFrame:
    details = C.detail_features(labelled_sites(spark, d), ["label"], names)
    return C.merged_features(contrast(spark, d), details, ["label"])


def stored_features(spark: SparkSession, d: str) -> DataFrame:
    """Features as a written table, for queries that pass over them several times."""
    return materialize(features(spark, d), "features")


def records(spark: SparkSession, d: str) -> DataFrame:
    return spark_view(spark, d, "records")


def reads(spark: SparkSession, d: str) -> DataFrame:
    aln = spark_view(spark, d, "aln")
    place = F.struct(F.col("ord_block").alias("block"), F.col("ord_row").alias("row"))
    return aln.withColumn("ord", place).drop("ord_block", "ord_row")


def regions(spark: SparkSession, d: str) -> DataFrame:
    r = spark_view(spark, d, "regions")
    valid = r.where((F.col("start_pos") >= 0) & (F.col("end_pos") > F.col("start_pos")))
    return valid.select("chrom", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"))


def variants(spark: SparkSession, d: str) -> DataFrame:
    return V.variants_from_records(records(spark, d))


# --- sites and summaries ---------------------------------------------------------------------


@query
def l1_state(spark, d):
    return rounded(sites(spark, d).select(
        "read_id", "chrom", "methyl_pos", "somatic_pos", "meth_call", "meth_state"
    ), "meth_call")


@query
def strand_filter(spark, d):
    kept = M.strand_covered_sites(sites(spark, d), 2)
    return rounded(kept.drop("somatic_base_at_variant", "meth_state"), "meth_call")


@query
def level2(spark, d):
    result = analyze(sites(spark, d), RunConfig(min_strand_reads=1, per_vcf=False), VCFS)
    return rounded(result.summary, "mean_methylation")


@query
def level2_per_vcf(spark, d):
    result = analyze(sparse_sites(spark, d).withColumns({
        "meth_state": S.meth_state(F.col("meth_call"), HIGH, LOW),
        "somatic_base_at_variant": F.lit("A"),
    }), RunConfig(min_strand_reads=1, per_vcf=True), VCFS)
    return rounded(result.summary, "mean_methylation")


@query
def level3_pivot(spark, d):
    stats = M.level3_statistics(M.level2_summary(sparse_sites(spark, d)), VCFS)
    return rounded(
        stats.drop("p_value"), "fp_mean_methylation", "tp_mean_methylation", "difference"
    )


@query
def level3_pvalue(spark, d):
    stats = M.level3_statistics(M.level2_summary(sparse_sites(spark, d)), VCFS)
    return rounded(stats.select(
        "haplotype_group", "bam_source", "variant_type_group", "p_value"
    ), "p_value")


@query
def global_metrics(spark, d):
    return M.global_metrics(sites(spark, d))


@query
def level2_report(spark, d):
    return reports.level2_text(M.level2_summary(sparse_sites(spark, d)))


@query
def level3_report(spark, d):
    return reports.level3_text(M.level3_statistics(M.level2_summary(sparse_sites(spark, d)), VCFS))


@query
def vcf_ids(spark, d):
    return sites(spark, d).select("vcf_source_id").distinct()


# --- contrasts, grids, counts ----------------------------------------------------------------


@query
def pivot_delta(spark, d):
    return rounded(contrast(spark, d), *C.CONTRAST)


@query
def detail_features(spark, d):
    return rounded(C.detail_features(labelled_sites(spark, d), ["label"]), "mean_methylation")


@query
def merged_features(spark, d):
    return rounded(features(spark, d), *C.CONTRAST, "mean_methylation")


@query
def threshold_filter(spark, d):
    df = features(spark, d, C.GRID_NAMES)
    kept = df.where(
        (F.col("normal") >= 0.3) & (F.abs("delta") >= 0.1) & (F.col("read_count_detail") >= 2)
    )
    return rounded(kept, *C.CONTRAST, "mean_meth_detail")


@query
def asm_mode_counts(spark, d):
    return C.crosstab(C.with_asm_mode(contrast(spark, d), LOW, HIGH), "asm_mode")


@query
def haplotype_counts(spark, d):
    return C.crosstab(contrast(spark, d), "haplotype_tag")


@query
def haplotype_chi2_stat(spark, d):
    test = C.chi_square(C.crosstab(contrast(spark, d), "haplotype_tag"))
    return rounded(test.select("chi2", "dof", "n"), "chi2")


@query
def haplotype_chi2_p(spark, d):
    test = C.chi_square(C.crosstab(contrast(spark, d), "haplotype_tag"))
    return rounded(test, "chi2", "p_value")


@query
def allele_chi2_stat(spark, d):
    """Two values only, so the continuity correction applies."""
    test = C.chi_square(C.crosstab(contrast(spark, d), "somatic_allele_type"))
    return rounded(test.select("chi2", "dof", "n"), "chi2")


@query
def asm_mode_chi2_stat(spark, d):
    test = C.chi_square(C.crosstab(C.with_asm_mode(contrast(spark, d), LOW, HIGH), "asm_mode"))
    return rounded(test.select("chi2", "dof", "n"), "chi2")


@query
def expected_counts(spark, d):
    counts = C.crosstab(contrast(spark, d), "haplotype_tag")
    return rounded(C.expected_counts(counts, "haplotype_tag"), "expected_FP", "expected_TP")


@query
def proportions(spark, d):
    counts = C.crosstab(C.with_asm_mode(contrast(spark, d), LOW, HIGH), "asm_mode")
    return rounded(
        C.proportions(counts, "asm_mode"), "FP_share", "TP_share", "FP_fraction", "TP_fraction"
    )


@query
def retention_grid(spark, d):
    grid = G.retention_grid(labelled_summary(spark, d), G.MIN_READS, G.MIN_CPG)
    return rounded(grid, "tp_rate", "fp_rate")


@query
def tpr_fpr_grid(spark, d):
    grid = G.rate_grid(features(spark, d, C.GRID_NAMES), G.NORMAL_THS, G.DELTA_THS, G.READ_THS)
    return rounded(grid, "TPR", "FPR")


# --- statistics ------------------------------------------------------------------------------


@query
def descriptive_stats(spark, d):
    return rounded(
        D.descriptive_stats(stored_features(spark, d), FEATURES), "mean", "median", "std", "min", "max"
    )


@query
def describe(spark, d):
    return rounded(
        D.describe(materialize(contrast(spark, d), "contrast"), C.CONTRAST),
        "mean", "std", "min", "q25", "q50", "q75", "max",
    )


@query
def corr_matrix(spark, d):
    return rounded(D.correlation_matrix(features(spark, d), FEATURES), "correlation")


@query
def histogram(spark, d):
    return rounded(D.histogram(stored_features(spark, d), FEATURES, 30), "left_edge")


@query
def histogram_shared(spark, d):
    stored = materialize(contrast(spark, d), "contrast")
    return rounded(D.histogram(stored, C.CONTRAST, 50, shared=True), "left_edge")


@query
def welch_t(spark, d):
    tested = T.with_welch(T.label_moments(features(spark, d), FEATURES))
    return rounded(tested.select("feature", "t_stat", "t_df"), "t_stat", "t_df")


@query
def welch_p(spark, d):
    tested = T.stat_tests(features(spark, d), FEATURES)
    return rounded(tested, "TP_mean", "FP_mean", "t_stat", "p_val", "cohen_d")


@query
def cohens_d(spark, d):
    sized = T.with_effect_sizes(T.label_moments(features(spark, d), FEATURES))
    return rounded(sized.select("feature", "d_simple", "d_weighted"), "d_simple", "d_weighted")


@query
def welch_by_group(spark, d):
    moments = T.label_moments(features(spark, d), FEATURES, ["haplotype_tag", "variant_type"])
    kept = moments.where((F.col("tp_n") >= 2) & (F.col("fp_n") >= 2))
    tested = T.with_effect_sizes(T.with_welch(kept))
    return rounded(
        tested.select("haplotype_tag", "variant_type", "feature", "t_stat", "t_df", "d_weighted"),
        "t_stat", "t_df", "d_weighted",
    )


@query
def bonferroni(spark, d):
    stats = M.level3_statistics(M.level2_summary(sparse_sites(spark, d)), VCFS)
    adjusted = T.bonferroni(stats.where("is_comparable"), "p_value")
    return rounded(adjusted.select(
        "haplotype_group", "bam_source", "variant_type_group", "p_value", "p_adj"
    ), "p_value", "p_adj")


@query
def bootstrap_p(spark, d):
    df = stored_features(spark, d).withColumn("group", F.col("variant_type"))
    return T.bootstrap_p(df, FEATURES, ["group"], seed=1)


@query
def feature_stats(spark, d):
    tested = T.feature_tests(stored_features(spark, d), FEATURES, "haplotype_tag", seed=1)
    return rounded(tested, "t_stat", "p_val", "cohens_d", "p_adj")


@query
def group_values(spark, d):
    """Group labels that occur in either call set, in order."""
    both = labelled_summary(spark, d).select("haplotype_tag").where("haplotype_tag IS NOT NULL")
    return both.distinct().orderBy("haplotype_tag")


@query
def dedup(spark, d):
    rows = sites(spark, d).select("chrom", "somatic_pos", "variant_type", "vcf_source_id", "strand")
    return C.distinct_labelled(
        rows.where("vcf_source_id = 'tp'"), rows.where("vcf_source_id = 'fp'")
    )


# --- classifier ------------------------------------------------------------------------------


@query
def median_impute_scale(spark, d):
    ready = K.standardize(K.impute_medians(stored_features(spark, d), FEATURES), FEATURES)
    return rounded(ready.select("label", *CONTRAST_KEY, *FEATURES), *FEATURES)


@query
def stratified_split(spark, d):
    split = K.stratified_split(stored_features(spark, d), [*CONTRAST_KEY, "label"])
    return split.groupBy("label", "is_test").agg(F.count("*").alias("rows"))


@query
def logreg_metrics(spark, d):
    result = K.evaluate(stored_features(spark, d), FEATURES, [*CONTRAST_KEY, "label"])
    return _rounded_metrics(result.metrics)


@query
def logreg_coefficients(spark, d):
    found = K.evaluate(stored_features(spark, d), FEATURES, [*CONTRAST_KEY, "label"]).coefficients
    return rounded(found, "coef")


def _rounded_metrics(shown: DataFrame) -> DataFrame:
    return rounded(shown, *[
        c for c in shown.columns if c not in ("tp", "fp", "fn", "tn") and "support" not in c
    ])


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return stored_features(spark, d).withColumn("score", F.round("mean_methylation", 4))


@query
def roc_points(spark, d):
    curve = K.roc_points(_scored(spark, d)).select("threshold", "cum_tp", "cum_fp", "fpr", "tpr")
    return rounded(curve, "threshold", "fpr", "tpr")


@query
def roc_auc(spark, d):
    return rounded(K.area_under_curve(K.roc_points(_scored(spark, d))), "auc")


@query
def prediction_metrics(spark, d):
    return _rounded_metrics(K.prediction_metrics(_scored(spark, d)))


# --- variants --------------------------------------------------------------------------------


@query
def vcf_text_scan(spark, d):
    names = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "sample"]
    lines = records(spark, d).select(
        F.concat_ws("\t", *[F.col(c).cast("string") for c in names]).alias("value"),
        F.concat(F.lit("call."), F.col("vcf_source_id"), F.lit(".vcf.gz")).alias("file"),
    )
    return vcf_records(lines)


@query
def bed_text_scan(spark, d):
    lines = spark_view(spark, d, "regions").select(F.concat(
        F.lit("  "), F.col("chrom"), F.lit("\t"), F.col("start_pos").cast("string"), F.lit("  "),
        F.col("end_pos").cast("string"), F.lit("\textra "),
    ).alias("value"))
    return bed_regions(lines).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


@query
def source_id(spark, d):
    names = spark.read.parquet(f"{d}/pages.parquet").select(
        "page_id", F.concat("url", F.when(F.col("page_id") % 3 == 0, ".vcf.gz")
                            .when(F.col("page_id") % 3 == 1, ".bam").otherwise("")).alias("path"),
    )
    return names.select("page_id", S.source_id(F.col("path")).alias("source_id"))


@query
def pass_filter(spark, d):
    return V.pass_records(records(spark, d)).select("vcf_source_id", "chrom", "pos", "filter")


@query
def strict_pass_filter(spark, d):
    return V.strict_pass_records(records(spark, d)).select("vcf_source_id", "chrom", "pos", "filter")


@query
def region_filter(spark, d):
    return V.records_on(records(spark, d), "chr2").select("vcf_source_id", "chrom", "pos", "ref")


@query
def alt_explode(spark, d):
    return V.split_alleles(records(spark, d)).select(
        "vcf_source_id", "chrom", "pos", "ref", "alt", "allele_index"
    )


@query
def variant_type(spark, d):
    return V.split_alleles(records(spark, d)).select(
        "vcf_source_id", "chrom", "pos", "ref", "alt", "variant_type"
    )


@query
def ad_filter(spark, d):
    alleles = V.split_alleles(V.with_sample_depths(records(spark, d)))
    return V.supported_alleles(alleles, 5).select("vcf_source_id", "chrom", "pos", "ref", "alt")


@query
def bed_filter(spark, d):
    return V.in_regions(records(spark, d), regions(spark, d)).select(
        "vcf_source_id", "chrom", "pos", "ref", "alt"
    )


@query
def bed_filter_shuffled(spark, d):
    """The same with both sides shuffled by bin and hot bins split, as for large region sets."""
    placed = records(spark, d).withColumn("pos0", F.col("pos") - 1)
    return O.points_in_regions(
        placed, regions(spark, d), "pos0", bin_size=4096, hot_rows=50, small_regions=False
    ).select("vcf_source_id", "chrom", "pos", "ref", "alt")


@query
def semi_join_positions(spark, d):
    return V.at_positions(records(spark, d), spark_view(spark, d, "positions")).select(
        "vcf_source_id", "chrom", "pos", "ref", "alt"
    )


@query
def variant_load(spark, d):
    loaded = V.variants_from_records(records(spark, d), 5, regions(spark, d))
    return rounded(loaded, "qual", "allele_freq")


@query
def variant_sort(spark, d):
    return V.sort_variants(variants(spark, d)).select("chrom", "pos", "variant_type", "alt")


# --- reads -----------------------------------------------------------------------------------


@query
def sam_text_scan(spark, d):
    src = reads(spark, d)
    text = lambda c: F.col(c).cast("string")
    tag = lambda prefix, value: F.concat(F.lit(prefix), value)
    ml = tag("ML:B:C,", F.array_join(F.transform("ml", lambda v: v.cast("string")), ","))
    lines = src.select("ord", F.concat_ws(
        "\t", "qname", text("flag"), "rname", text("pos"), text("mapq"), "cigar", F.lit("*"),
        F.lit("0"), F.lit("0"), "seq", F.lit("*"), tag("MM:Z:", F.col("mm")), ml,
        F.concat(F.lit("HP:"), F.col("hp_type"), F.lit(":"), F.col("hp_value")),
        tag("or:Z:", F.col("orig_hp")), tag("PS:i:", F.col("ps")),
    ).alias("value"))
    return sam_reads(lines).select(
        "qname", "flag", "rname", "pos", "mapq", "cigar", "seq", "mm",
        F.array_join(F.transform("ml", lambda v: v.cast("string")), ",").alias("ml"),
        "hp_type", "hp_value", "orig_hp", "ps",
    )


@query
def read_flags(spark, d):
    return reads(spark, d).select(
        "qname", "flag", "mapq",
        S.is_fetchable(F.col("flag"), F.col("mapq")).alias("fetchable"),
        S.is_usable(F.col("flag")).alias("usable"),
        S.strand(F.col("flag")).alias("strand"),
    )


@query
def haplotype_tag(spark, d):
    return R.with_haplotype(reads(spark, d)).select(
        "qname", "hp_type", "hp_value", "orig_hp", "haplotype_tag"
    )


@query
def read_span(spark, d):
    return R.with_span(reads(spark, d)).select("qname", "cigar", "start0", "end0")


@query
def cigar_blocks(spark, d):
    blocks = reads(spark, d).select(
        "qname", "pos", F.inline(A.cigar_blocks("cigar", "pos"))
    )
    return blocks.select("qname", "pos", "query_start", "ref_start", "length")


@query
def basemod_explode(spark, d):
    low, high = F.col("pos") - WINDOW, F.col("pos") + WINDOW
    called = reads(spark, d).where(F.col("mm").isNotNull()).select("qname", F.explode(
        B.methylation_calls("seq", "flag", "pos", "cigar", "mm", "ml", low, high)
    ).alias("call"))
    return called.select("qname", F.col("call.ref_pos").alias("ref_pos"), F.col("call.qual").alias("qual"))


@query
def tag_sample(spark, d):
    return R.tag_counts(reads(spark, d))


def _pairs(spark: SparkSession, d: str, **options) -> DataFrame:
    spans = R.with_span(R.fetchable_reads(reads(spark, d))).withColumnRenamed("rname", "chrom")
    # Both are read several times: for the bin size, the size of the windows, the hot bins and the join.
    narrow = materialize(
        spans.select("bam_source_id", "chrom", "qname", "pos", "start0", "end0", "ord"), "spans")
    windows = materialize(E.variant_windows(variants(spark, d), WINDOW).drop("copies"), "windows")
    if "bin_size" not in options:
        options["bin_size"] = O.bin_size_for(narrow, 2 * WINDOW)
    return O.overlap_join(narrow, windows, **options)


_PAIR_COLUMNS = [
    "bam_source_id", "qname", "start0", "end0", "chrom", "somatic_pos", "ref", "alt",
    "variant_type", "vcf_source_id",
]


@query
def interval_join(spark, d):
    return _pairs(spark, d).select(*_PAIR_COLUMNS)


@query
def interval_join_shuffled(spark, d):
    """The same with both sides shuffled by bin and hot bins split, as for large variant sets."""
    pairs = _pairs(
        spark, d, bin_size=1024, hot_rows=50, small_windows=False, spread_by=["qname", "ord"]
    )
    return pairs.select(*_PAIR_COLUMNS)


@query
def depth_cap_topn(spark, d):
    spans = R.with_span(R.fetchable_reads(reads(spark, d))).withColumnRenamed("rname", "chrom")
    windows = E.variant_windows(variants(spark, d), WINDOW).drop("copies")
    narrow = materialize(
        spans.select("bam_source_id", "chrom", "qname", "start0", "end0", "ord"), "spans")
    order = [F.col("ord.block"), F.col("ord.row")]
    return sweep.first_reads(narrow, windows, 3, order, 2 * WINDOW).select(*_PAIR_COLUMNS)


@query
def allele_call(spark, d):
    spans = R.with_span(reads(spark, d)).withColumnRenamed("rname", "chrom")
    pairs = O.overlap_join(
        spans, E.variant_windows(variants(spark, d), WINDOW), bin_size=O.bin_size_for(spans, 2 * WINDOW)
    )
    return E.allele_support(pairs).select(
        "qname", "chrom", "somatic_pos", "ref", "alt", "vcf_source_id",
        "somatic_base_at_variant", "somatic_allele_type",
    )


@query
def level1_sites(spark, d):
    found = E.methylation_sites(reads(spark, d), variants(spark, d), CONFIG)
    return rounded(found, "meth_call")


@query
def level2_from_reads(spark, d):
    found = E.methylation_sites(reads(spark, d), variants(spark, d), CONFIG)
    return rounded(M.level2_summary(found).select(*SUMMARY_COLUMNS), "mean_methylation")
