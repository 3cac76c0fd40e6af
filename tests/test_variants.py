import gzip

import pytest
from pyspark.sql import functions as F

from strandloom.operators import overlap as O, variants as V
from strandloom.plans import prepare
from strandloom.sources.variants import read_bed, read_positions, read_vcf
from tests.helpers import near

HEADER = [
    "##fileformat=VCFv4.2",
    '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Quality">',
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2",
]
RECORDS = [
    "chr1\t877772\t.\tG\tC\t0.9465\tPASS\t.\tGT:GQ:DP:AF:AD\t0/1:0.9465:58:0.7241:0,42\t0/0:1:1:1:9,9",
    "chr1\t1004726\t.\tAT\tA\t.\tPASS\t.\tGT:AD\t0/1:10,4\t.",
    "chr1\t1004730\t.\tA\tAT\t-3\t.\t.\tGT:AD\t0/1:10,5\t.",
    "chr2\t50\t.\tAT\tGC\t7\tPASS\t.\tGT\t0/1\t.",
    "chr2\t60\t.\tA\tG,T\t7\tPASS\t.\tGT:AD\t0/1:0,9,2\t.",
    "chr2\t70\t.\tA\t.\t7\tPASS\t.\tGT\t0/1\t.",
    "chr2\t80\t.\tA\tG\t7\tLowQual\t.\tGT\t0/1\t.",
    "chr2\t90\t.\tA\tG\t7\tPASS\t.\tGT:AD\t0/1:.\t.",
]


@pytest.fixture
def vcf(tmp_path):
    path = tmp_path / "calls.vcf"
    path.write_text("\n".join(HEADER + RECORDS) + "\n")
    return str(path)


def test_vcf_to_variants(spark, vcf):
    rows = V.variants_from_records(read_vcf(spark, vcf), 5).collect()
    got = {(r["chrom"], r["pos"], r["ref"], r["alt"], r["variant_type"]) for r in rows}
    assert got == {
        ("chr1", 877772, "G", "C", "SNV"), ("chr1", 1004730, "A", "AT", "INS"),
        ("chr2", 50, "AT", "GC", "COMPLEX"), ("chr2", 60, "A", "G", "MULTI"),
    }
    assert {r["vcf_source_id"] for r in rows} == {"calls"}
    qual = {r["pos"]: r["qual"] for r in rows}
    assert near(qual[877772], 0.9465) and qual[1004730] == 0.0 and qual[50] == 7.0


def test_no_minimum_keeps_every_allele(spark, vcf):
    rows = V.variants_from_records(read_vcf(spark, vcf)).collect()
    assert sorted((r["pos"], r["alt"]) for r in rows) == [
        (50, "GC"), (60, "G"), (60, "T"), (90, "G"), (877772, "C"), (1004726, "A"), (1004730, "AT"),
    ]
    types = {r["pos"]: r["variant_type"] for r in rows}
    assert types[60] == "MULTI" and types[1004726] == "DEL"


def test_gzip_members_and_names(spark, vcf, tmp_path):
    path = tmp_path / "more.vcf.gz"
    text = open(vcf).read().splitlines(keepends=True)
    path.write_bytes(b"".join(gzip.compress("".join(part).encode()) for part in (text[:5], text[5:])))
    both = read_vcf(spark, vcf, str(path))
    assert both.groupBy("vcf_source_id").count().orderBy("vcf_source_id").collect() == [
        ("calls", 8), ("more", 8),
    ]


def test_bed_reading(spark, tmp_path):
    path = tmp_path / "r.bed"
    path.write_text(
        "# comment\n\nchr1\t100\t110\tname\n  chr1 200   210  \nchr1\tx\t5\nchr1\t9\t9\nchr1\t-5\t4\n"
        "chr2\t7\n"
    )
    assert sorted(map(tuple, read_bed(spark, str(path)).collect())) == [
        ("chr1", 100, 110), ("chr1", 200, 210),
    ]


def test_region_edges(spark):
    records = spark.createDataFrame([("chr1", p) for p in (100, 101, 110, 111)] + [("chr2", 105)],
                                    "chrom string, pos int")
    regions = spark.createDataFrame([("chr1", 100, 110), ("chr1", 102, 108)],
                                    "chrom string, start int, end int")
    kept = V.in_regions(records, regions)
    assert sorted(map(tuple, kept.collect())) == [("chr1", 101), ("chr1", 110)]
    assert V.in_regions(records, regions.limit(0)).count() == 5
    assert V.in_regions(records, None).count() == 5


@pytest.mark.parametrize("small,hot", [(True, 100), (False, 100), (False, 3)])
def test_regions_against_all_pairs(spark, small, hot):
    points = [("chr1" if i % 3 else "chr2", (i * 7919) % 5000) for i in range(400)]
    points += [("chr1", 777)] * 200
    regions = [("chr1", s, s + w) for s, w in ((0, 3), (500, 900), (770, 10), (3000, 1), (4990, 90))]
    got = O.points_in_regions(
        spark.createDataFrame(points, "chrom string, p int"),
        spark.createDataFrame(regions, "chrom string, start int, end int"),
        "p", bin_size=64, hot_rows=hot, small_regions=small,
    )
    want = [x for x in points if any(r[0] == x[0] and r[1] <= x[1] < r[2] for r in regions)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def text_lines(folder):
    import glob
    lines = []
    for name in sorted(glob.glob(f"{folder}/part-*")):
        opener = gzip.open if name.endswith(".gz") else open
        with opener(name, "rt") as f:
            lines += f.read().splitlines()
    return lines


def test_pass_filter_file(spark, vcf, tmp_path):
    out = str(tmp_path / "pass.vcf")
    prepare.pass_filter(spark, vcf, out)
    lines = text_lines(out)
    assert lines[:3] == [HEADER[0], HEADER[1].replace("Integer", "Float"), HEADER[2]]
    assert lines[3:] == [r for r in RECORDS if r.split("\t")[6] == "PASS"]


def test_select_positions_file(spark, vcf, tmp_path):
    listed = tmp_path / "snv_tp.out"
    listed.write_text("#chrom pos\nchr1\t877772\tG\nchr2\t60\tA\nchr2\t60\tT\nchr9\t50\n")
    assert read_positions(spark, str(listed)).count() == 4
    prepare.select_positions(spark, vcf, str(listed), str(tmp_path / "tp.vcf"))
    assert text_lines(tmp_path / "tp.vcf") == HEADER + [RECORDS[0], RECORDS[4]]
    prepare.select_positions(spark, vcf, str(listed), str(tmp_path / "tp2.vcf"), "chr2", False)
    assert text_lines(tmp_path / "tp2.vcf") == HEADER + [RECORDS[4]]


def test_variant_order(spark):
    rows = spark.createDataFrame(
        [("chr2", 5, "SNV"), ("chr1", 50, "SNV"), ("chr1", 7, "SNV"), ("chr1", 7, "DEL")],
        "chrom string, pos int, variant_type string",
    )
    assert [tuple(r) for r in V.sort_variants(rows).collect()] == [
        ("chr1", 7, "DEL"), ("chr1", 7, "SNV"), ("chr1", 50, "SNV"), ("chr2", 5, "SNV"),
    ]
    assert V.records_on(rows, "chr2").select(F.count("*")).first()[0] == 1
