import glob
import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from strandloom import RunConfig, cli
from strandloom.operators import extract as E, reads as R
from strandloom.plans import calling
from strandloom.schema import SITES
from strandloom.session import work_folder
from strandloom.sources.alignments import read_sam
from strandloom.sources.bam import read_bam
from strandloom.sources.tables import read_sites, read_summary
from strandloom.streaming.landing import land_sites, site_stream
from tests.helpers import (
    READ, READ_A, READ_B, READ_C, near, read_rows, sam_line, variant_rows, write_bam,
    write_index,
)

CONFIG = RunConfig(window_size=100, max_read_depth=100)


def found(spark, reads, variants, config=CONFIG):
    df = E.methylation_sites(read_rows(spark, *reads), variant_rows(spark, *variants), config)
    assert df.columns == SITES.names and [f.dataType for f in df.schema] == [
        f.dataType for f in SITES
    ]
    return df.collect()


def test_read_with_clips_insertion_and_deletion(spark):
    rows = found(spark, [READ_A], [(107, "A", "G")])
    assert [(r["methyl_pos"], r["meth_state"], r["somatic_allele_type"]) for r in
            sorted(rows, key=lambda r: r["methyl_pos"])] == [(102, "high", "ref"), (111, "low", "ref")]
    assert near(rows[0]["meth_call"] + rows[1]["meth_call"], 1.0)
    assert {r["somatic_allele_type"] for r in found(spark, [READ_A], [(107, "C", "A")])} == {"alt"}
    assert found(spark, [READ_A], [(107, "C", "G")]) == []
    assert found(spark, [READ_A], [(110, "G", "C")]) == []


def test_reverse_read_and_double_codes(spark):
    rows = sorted(found(spark, [READ_B], [(205, "C", "T")]), key=lambda r: r["methyl_pos"])
    assert rows == [] or {r["strand"] for r in rows} == {"-"}
    rows = sorted(found(spark, [READ_B], [(204, "T", "G")]), key=lambda r: r["methyl_pos"])
    assert [(r["methyl_pos"], r["meth_state"], r["strand"]) for r in rows] == [
        (203, "low", "-"), (206, "high", "-"),
    ]
    rows = found(spark, [READ_C], [(301, "A", "T")])
    assert sorted((r["methyl_pos"], round(r["meth_call"], 4), r["meth_state"]) for r in rows) == [
        (302, 0.1569, "low"), (302, 0.7843, "mid"),
    ]


def test_decoding_runs_once_and_after_the_join(spark, capsys):
    reads, variants = read_rows(spark, READ_A), variant_rows(spark, (107, "A", "G"))
    E.methylation_sites(reads, variants, CONFIG).explain()
    plan = capsys.readouterr().out
    assert plan.count("ArrowEvalPython") == 1
    assert plan.index("ArrowEvalPython") < plan.index("BroadcastHashJoin")
    assert plan.count("SortMergeJoin") == 0


def test_window_is_inclusive(spark):
    read = dict(READ, pos=890, cigar="230M", seq="A" * 9 + "CC" + "A" * 199 + "CC" + "A" * 18,
                mm="C+m,0,0,0,0;", ml=[250, 250, 250, 250])
    rows = found(spark, [read], [(1000, "A", "T")])
    assert sorted(r["methyl_pos"] for r in rows) == [900, 1100]


def test_flags_and_depth(spark):
    """Duplicates use up depth but give no sites; secondary and low-quality reads do neither."""
    base = dict(READ, cigar="4M", seq="ACGT", mm="C+m,0;", ml=[255], pos=100)
    flags = [1024] * 60 + [512] * 30 + [256] * 10 + [4] * 10 + [0] * 30
    reads = [dict(base, qname=f"q{i}", flag=f) for i, f in enumerate(flags)]
    reads += [dict(base, qname="low", mapq=9), dict(base, qname="other", bam_source_id="normal")]
    rows = found(spark, reads, [(100, "A", "T")])
    assert sorted(r["read_id"] for r in rows if r["bam_source_id"] == "tumor") == sorted(
        f"q{i}" for i in range(110, 120)
    )
    assert [r["read_id"] for r in rows if r["bam_source_id"] == "normal"] == ["other"]


def test_repeated_variants_repeat_their_sites(spark):
    rows = found(spark, [READ_A], [(107, "A", "G"), (107, "A", "G"), (107, "A", "T"),
                                   (107, "A", "G", "fp")])
    assert len(rows) == 8 and sum(r["vcf_source_id"] == "fp" for r in rows) == 2


def sample(shift, methylated):
    reads = []
    for i in range(24):
        alt = i % 3 == 0
        reads.append(dict(
            READ, qname=f"t{shift}-{i:02}", pos=995 + shift, flag=16 * (i % 2),
            cigar="20M", seq="ACGTA" + "AT"[alt] + "CGACGTTACGCATG", mm="C+m,0,0;",
            ml=[methylated, 255 - methylated], hp_type="i", hp_value=str(i % 3), ps="7",
        ))
    return reads


@pytest.fixture
def inputs(tmp_path):
    """Tumor as BAM, normal as SAM text, two VCFs and a region file."""
    tumor, normal = sample(0, 240), sample(0, 20)
    write_bam(str(tmp_path / "tumor.bam"), tumor)
    (tmp_path / "normal.sam").write_text("@HD\tVN:1.6\n" + "\n".join(map(sam_line, normal)) + "\n")
    record = "chr1\t{}\t.\tA\tT\t9\tPASS\t.\tGT:AD\t0/1:9,9"
    (tmp_path / "tp.vcf").write_text("##x\n" + record.format(1000) + "\n" + record.format(5000) + "\n")
    (tmp_path / "fp.vcf").write_text("##x\n" + record.format(1000).replace("\tT\t", "\tC\t") + "\n")
    (tmp_path / "r.bed").write_text("chr1\t900\t1100\n")
    (tmp_path / "ref.fa").write_text(">chr1\n")
    return tmp_path


def plain(rows):
    return sorted(
        (r["qname"], r["flag"], r["rname"], r["pos"], r["mapq"], r["cigar"], r["seq"], r["mm"],
         tuple(r["ml"]), r["hp_type"], r["hp_value"], r["ps"]) for r in rows
    )


def test_bam_equals_sam(spark, tmp_path):
    reads = sample(0, 240) + [dict(READ_A, hp_type="Z", hp_value="1-1", ps=None)]
    write_bam(str(tmp_path / "x.bam"), reads)
    (tmp_path / "x.sam").write_text("@HD\n" + "\n".join(map(sam_line, reads)) + "\n")
    sam = read_sam(spark, str(tmp_path / "x.sam"), sample="tumor").collect()
    whole = read_bam(spark, str(tmp_path / "x.bam"), sample="tumor", split_bytes=1 << 40)
    cut = read_bam(spark, str(tmp_path / "x.bam"), sample="tumor", split_bytes=1)
    assert whole.rdd.getNumPartitions() == 1 and cut.rdd.getNumPartitions() == 13
    assert plain(whole.collect()) == plain(cut.collect()) == plain(sam) == plain(reads)
    assert [r["qname"] for r in cut.orderBy("ord").collect()] == [r["qname"] for r in reads]
    assert [r["qname"] for r in sorted(sam, key=lambda r: r["ord"])] == [r["qname"] for r in reads]


def test_bam_around_windows(spark, tmp_path):
    """Reads around variants: the same pairs as from the whole file, from fewer records."""
    rng = random.Random(8)
    spans = sorted((rng.choice(["chr1", "chr2"]), rng.randint(1, 900_000), rng.choice([10, 40_000]))
                   for _ in range(300))
    reads = [dict(READ, qname=f"q{i}", rname=c, pos=p, cigar="10M" if n == 10 else f"5M{n - 10}N5M")
             for i, (c, p, n) in enumerate(spans)]
    path = str(tmp_path / "x.bam")
    write_index(path, reads, write_bam(path, reads, per_block=1, index=False), [s[2] for s in spans])
    variants = variant_rows(spark, *[(p, "A", "C") for p in (50_000, 51_000, 400_000, 899_999)])
    tiles = E.window_tiles(variants, 2000)
    assert tiles["chr1"][0] == (2, 3)
    whole = read_bam(spark, path, sample="tumor", split_bytes=1 << 40)
    assert whole.count() == 300
    want = {(r["qname"], r["somatic_pos"])
            for r in E.reads_near_variants(whole, variants, 2000, 1000).collect()}
    assert len(want) > 4
    for size in (1, 500, 1 << 40):
        pruned = read_bam(spark, path, sample="tumor", split_bytes=size, tiles=tiles)
        names = [r["qname"] for r in pruned.select("qname").collect()]
        assert len(names) == len(set(names)) < 150
        got = {(r["qname"], r["somatic_pos"])
               for r in E.reads_near_variants(pruned, variants, 2000, 1000).collect()}
        assert got == want
    assert read_bam(spark, path, tiles={}).count() == 0
    assert read_bam(spark, path, tiles={"chrX": [(0, 5)]}).count() == 0
    first = read_bam(spark, path, head=7).collect()
    assert [r["qname"] for r in first] == [f"q{i}" for i in range(7)]


def test_bam_without_index(spark, tmp_path):
    write_bam(str(tmp_path / "x.bam"), sample(0, 9), index=False)
    assert read_bam(spark, str(tmp_path / "x.bam"), split_bytes=1).count() == 24


def test_legacy_tags(spark, tmp_path):
    line = sam_line(READ_A).replace("MM:Z", "Mm:Z").replace("ML:B", "Ml:B")
    (tmp_path / "x.sam").write_text(line + "\n")
    reads = read_sam(spark, str(tmp_path / "x.sam"))
    assert reads.first()["mm"] == "C+m,0,1,2;" and reads.first()["ml"] == [204, 100, 51]
    assert not R.tag_report(reads).has_methylation
    assert R.tag_report(read_rows(spark, READ_A)).has_methylation


def test_haplotype_sample_is_thinned_after_its_head(spark):
    def rows(n, tagged):
        return spark.range(n, numPartitions=4).select(
            F.col("id").alias("ord"), F.lit("C+m,0;").alias("mm"), F.lit(None).cast("string").alias("ml"),
            F.when(F.expr(tagged), 1).alias("hp_value"), F.lit(7).alias("ps"))

    drawn = [r[0] for r in spark.range(2000).where(
        R.is_thinned(F.col("id") + 1, F.col("id"))).orderBy("id").limit(100).collect()]
    assert drawn[:11] == list(range(11)) and 200 < drawn[-1] < 400
    report = R.tag_report(rows(2000, "id % 2 = 0"))
    assert (report.sampled, report.mm, report.ml, report.hp, report.ps) == (100, 100, 0, 50, 100)
    assert (report.thinned, report.thinned_ps) == (100, 100)
    assert report.thinned_hp == sum(i % 2 == 0 for i in drawn)
    late = R.tag_report(rows(2000, f"id = {drawn[-1]}"))
    assert late.hp == 0 and late.has_haplotypes
    assert R.tag_report(rows(5, "false")) == R.TagReport(5, 5, 0, 0, 5, 5, 0, 5)
    assert R.tag_report(rows(0, "true")).sampled == 0


def lines_of(path):
    lines = []
    for name in sorted(glob.glob(f"{path}/part-*")):
        with (gzip.open if name.endswith(".gz") else open)(name, "rt") as f:
            lines += f.read().splitlines()
    return lines


def test_whole_run(spark, inputs):
    args = ["run", "-v", f"{inputs}/tp.vcf", f"{inputs}/fp.vcf", "-r", f"{inputs}/ref.fa",
            "-t", f"{inputs}/tumor.bam", "-n", f"{inputs}/normal.sam", "-w", "50",
            "-b", f"{inputs}/r.bed", "-o", f"{inputs}/out", "--min-strand-reads", "0", "--log-file", f"{inputs}/run.log"]
    assert cli.main(args) == 0
    tp = f"{inputs}/out/tp"
    assert sorted(os.listdir(f"{inputs}/out")) == ["fp", "tp"]
    metrics = lines_of(f"{tp}/global_summary_metrics.tsv")
    assert "window_size\t50" in metrics and "tp_processed_variants\t1" in metrics
    level1 = read_sites(spark, f"{tp}/level1_raw_methylation_details.tsv.gz")
    assert level1.count() == 2 * 24 * 2
    assert {r[0] for r in level1.select("haplotype_tag").distinct().collect()} == {"0", "1", "2"}
    level2 = read_summary(spark, f"{tp}/level2_somatic_variant_methylation_summary.tsv.gz")
    assert level2.agg(F.sum("methyl_sites_count")).first()[0] == level1.count()
    head, *body = lines_of(f"{tp}/level3_haplotype_group_statistics.tsv")
    assert head.split("\t")[-1] == "tp_mean_methylation" and len(body) == 6
    fp = read_sites(spark, f"{inputs}/out/fp/level1_raw_methylation_details.tsv.gz")
    assert {r[0] for r in fp.select("somatic_allele_type").distinct().collect()} == {"ref"}


def test_pooled_run_compares_vcfs(spark, inputs):
    config = RunConfig(
        vcf_files=(f"{inputs}/tp.vcf", f"{inputs}/fp.vcf"), tumor_bam=f"{inputs}/tumor.bam",
        normal_bam=f"{inputs}/normal.sam", window_size=50, outdir=f"{inputs}/pooled",
        gzip_output=False, per_vcf=False, min_strand_reads=0,
    )
    folder = work_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert calling.run(spark, config) == [f"{inputs}/pooled/all"]
    assert set(os.listdir(folder)) == before  # no table of the run is left
    head, *body = lines_of(f"{inputs}/pooled/all/level3_haplotype_group_statistics.tsv")
    assert head.split("\t")[3:] == [
        "fp_mean_methylation", "tp_mean_methylation", "difference", "p_value"
    ]
    assert len(body) == 6


def test_sample_without_tags_is_skipped(spark, inputs):
    bare = [dict(r, mm=None, ml=None) for r in sample(0, 1)]
    write_bam(f"{inputs}/bare.bam", bare)
    config = RunConfig(vcf_files=(f"{inputs}/tp.vcf",), tumor_bam=f"{inputs}/bare.bam",
                       normal_bam=f"{inputs}/normal.sam", outdir=f"{inputs}/o2")
    reads = calling.load_samples(spark, config)
    assert {r[0] for r in reads.select("bam_source_id").distinct().collect()} == {"normal"}


def test_missing_input_is_an_error(inputs, capsys):
    assert cli.main(["run", "-v", f"{inputs}/no.vcf", "-r", f"{inputs}/ref.fa", "-t",
                     f"{inputs}/tumor.bam", "-n", f"{inputs}/normal.sam"]) == 1
    assert "no.vcf" in capsys.readouterr().err


def test_stream_lands_all_sites(spark, inputs, tmp_path):
    header = "\t".join(SITES.names)
    row = "chr1\t{}\t90\tSNV\ttp\ttumor\tref\tA\t1-1\t0.5000\tmid\t+\tr1"
    os.makedirs(tmp_path / "in/a")
    (tmp_path / "in/a/part-0.csv").write_text("\n".join([header, row.format(1), row.format(2)]) + "\n")
    table, mark = str(tmp_path / "table"), str(tmp_path / "mark")
    land_sites(site_stream(spark, str(tmp_path / "in")), table, mark).awaitTermination(120)
    with gzip.open(tmp_path / "in/part-1.csv.gz", "wt") as f:
        f.write("\n".join([header, row.format(3)]) + "\n")
    land_sites(site_stream(spark, str(tmp_path / "in")), table, mark).awaitTermination(120)
    stored = spark.read.parquet(table)
    assert sorted(r["methyl_pos"] for r in stored.collect()) == [1, 2, 3]
    assert stored.first()["haplotype_tag"] == "1-1"
