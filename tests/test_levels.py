import pytest

from strandloom import RunConfig
from strandloom.operators import summary as M
from strandloom.plans.analyze import analyze
from strandloom.sinks import reports
from tests.helpers import near, site_rows


def test_strand_coverage_counts_rows_over_all_variants(spark):
    rows = [
        dict(methyl_pos=1, strand="+", somatic_pos=1), dict(methyl_pos=1, strand="-", somatic_pos=2),
        dict(methyl_pos=2, strand="+"), dict(methyl_pos=2, strand="+"),
        dict(methyl_pos=1, strand="+", bam_source_id="normal"),
        dict(methyl_pos=3, strand="+", vcf_source_id="tp"),
        dict(methyl_pos=3, strand="-", vcf_source_id="fp"),
    ]
    df = site_rows(spark, *rows)
    positions = lambda d: sorted(r["methyl_pos"] for r in d.collect())
    assert positions(M.strand_covered_sites(df, 1)) == [1, 1, 3, 3]
    assert positions(M.strand_covered_sites(df, 1, ["vcf_source_id"])) == [1, 1]
    assert positions(M.strand_covered_sites(df, 2)) == []
    assert M.strand_covered_sites(df, 0) is df


def test_level2(spark):
    df = site_rows(
        spark,
        dict(read_id="a", meth_call=0.2, strand="+"), dict(read_id="a", meth_call=0.4, strand="+"),
        dict(read_id="b", meth_call=0.9, strand="-"),
        dict(haplotype_tag="2", read_id="c", strand="+"),
        dict(haplotype_tag="2", read_id="d", strand="-"),
    )
    rows = {r["haplotype_tag"]: r for r in M.level2_summary(df).collect()}
    one, two = rows["1"], rows["2"]
    assert (one["supporting_read_count"], one["methyl_sites_count"], one["strand"]) == (2, 3, "+")
    assert near(one["mean_methylation"], 0.5) and two["strand"] == "."


def l2(spark, *rows):
    """(haplotype, type, vcf, mean)."""
    from strandloom.schema import SUMMARY
    return spark.createDataFrame(
        [("chr1", i, t, v, "tumor", "ref", h, 1, 1, m, "+") for i, (h, t, v, m) in enumerate(rows)],
        SUMMARY,
    )


def test_level3(spark):
    df = l2(
        spark,
        ("1", "INS", "fp", 0.2), ("1", "DEL", "fp", 0.4), ("1", "INS", "tp", 0.6),
        ("1", "DEL", "tp", 0.8), ("1", "SNV", "tp", 0.5),
        ("1-1", "SNV", "fp", 0.5), ("1-1", "SNV", "tp", 0.75),
    )
    stats = M.level3_statistics(df)
    rows = {(r["haplotype_group"], r["variant_type_group"]): r for r in stats.collect()}
    indel, alone, single = rows["1", "INDEL"], rows["1", "SNV"], rows["1-1", "SNV"]
    assert near(indel["difference"], -0.4) and near(indel["p_value"], 0.261204)
    assert alone["difference"] is None and not alone["is_comparable"]
    assert single["p_value"] == 1.0 and near(single["difference"], -0.25)
    shown = [tuple(r) for r in reports.level3_text(stats).collect()]
    assert shown == [
        ("1-1", "tumor", "SNV", "0.5000", "0.7500", "-0.2500", "1.000000"),
        ("1", "tumor", "INDEL", "0.3000", "0.7000", "-0.4000", "0.261204"),
        ("1", "tumor", "SNV", "NA", "0.5000", "0.0000", "1.000000"),
    ]


def test_level3_report_keeps_the_sign_of_a_small_difference(spark):
    rows = [("1", "tumor", "SNV", 0.50897, 0.50899, 0.50897 - 0.50899, 0.5, True)]
    stats = spark.createDataFrame(rows, "haplotype_group string, bam_source string, variant_type_group string, "
                                  "fp_mean_methylation double, tp_mean_methylation double, difference double, "
                                  "p_value double, is_comparable boolean")
    shown = reports.level3_text(stats).first()
    assert shown["difference"] == f"{0.50897 - 0.50899:.4f}" == "-0.0000"
    assert (shown["fp_mean_methylation"], shown["p_value"]) == ("0.5090", "0.500000")


def test_level3_of_one_vcf_has_no_comparison(spark):
    stats = M.level3_statistics(l2(spark, ("1", "SNV", "only.v1", 0.25)))
    assert stats.columns == [
        "haplotype_group", "bam_source", "variant_type_group", "only.v1_mean_methylation"
    ]
    assert reports.level3_text(stats).first()[3] == "0.2500"


def test_metrics(spark):
    df = site_rows(
        spark,
        dict(meth_state="high", meth_call=1.0), dict(meth_state="mid", meth_call=0.5),
        dict(meth_state="low", meth_call=0.0, somatic_pos=91),
        dict(meth_state="low", meth_call=0.1, bam_source_id="normal", vcf_source_id="fp"),
    )
    got = {r["name"]: r["value"] for r in M.global_metrics(df).collect()}
    assert got == {
        "tp_total_variants": "3", "tp_site_rows": "3", "tp_processed_variants": "2",
        "fp_total_variants": "1", "fp_site_rows": "1", "fp_processed_variants": "1",
        "tumor_methylated_site_count": "2", "tumor_total_site_count": "3",
        "tumor_mean_methylation": "0.7500", "normal_methylated_site_count": "0",
        "normal_total_site_count": "1", "normal_mean_methylation": "0.0000",
    }


def test_parameter_echo():
    shown = dict(M.run_parameters(RunConfig(vcf_files=("a.vcf",), min_allele=2)))
    assert shown["meth_high_threshold"] == "0.800000" and shown["min_allele"] == "2.000000"
    assert shown["vcf_files"] == "a.vcf" and shown["bed_file"] == "None"
    assert dict(M.run_parameters(RunConfig(vcf_files=("a", "b"))))["vcf_files"] == "2 files"
    assert len(shown) == 11


def test_analysis_invariants(spark):
    rows = [
        dict(methyl_pos=i % 17, somatic_pos=i % 5, haplotype_tag=str(i % 3), read_id=f"r{i % 11}",
             strand="+-"[i % 2], bam_source_id=("tumor", "normal")[i % 7 == 0],
             vcf_source_id=("tp", "fp")[i % 4 == 0])
        for i in range(300)
    ]
    sites = site_rows(spark, *rows)
    for per_vcf in (True, False):
        result = analyze(sites, RunConfig(min_strand_reads=2, per_vcf=per_vcf))
        covered = M.strand_covered_sites(sites, 2, ["vcf_source_id"] if per_vcf else None).count()
        l2_rows = result.summary.collect()
        assert sum(r["methyl_sites_count"] for r in l2_rows) == covered > 0
        assert all(r["supporting_read_count"] <= r["methyl_sites_count"] for r in l2_rows)
        assert len({tuple(r[:7]) for r in l2_rows}) == len(l2_rows)
        assert result.sites.count() == 300


@pytest.mark.parametrize("bad", [
    dict(window_size=0), dict(window_size=100001), dict(meth_high_threshold=0.01),
    dict(meth_high_threshold=1.1), dict(meth_low_threshold=0.8), dict(meth_low_threshold=0.01),
    dict(min_allele=-1), dict(min_strand_reads=-1), dict(max_read_depth=99),
    dict(max_read_depth=1000001), dict(max_ram_gb=0), dict(max_ram_gb=1025),
    dict(log_level="loud"),
])
def test_config_ranges(bad):
    with pytest.raises(ValueError):
        RunConfig(**bad)


def test_config_presets():
    assert RunConfig().window_size == 2000 and RunConfig(log_level="INFO").min_strand_reads == 1
    assert RunConfig.struct_defaults().window_size == 100
    assert RunConfig.struct_defaults(threads=2).min_strand_reads == 3
