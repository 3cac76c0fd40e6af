"""Reads over windows in one pass, and one decode per read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom import RunConfig
from strandloom.functions import basemods as B
from strandloom.operators import extract as E, sweep
from tests.helpers import READ, read_rows, variant_rows


def _intervals(seed, reads=400, windows=40):
    rng = random.Random(seed)
    rows = []
    for i in range(reads):
        start = 900 if i % 3 == 0 else rng.randint(0, 5000)
        length = rng.choice([0, 1, 30, 400, 3000])
        chrom = rng.choice(["chr1", "chr1", "chr2", None])
        rows.append((chrom, i, start, start + length, rng.choice(["tumor", "normal", None]), rng.randint(0, 10**6)))
    wins = {(rng.choice(["chr1", "chr2", "chr3"]), low, low + rng.choice([1, 60, 120]))
            for low in (rng.randint(0, 5200) for _ in range(windows))}
    return rows, [(c, j, a, b) for j, (c, a, b) in enumerate(sorted(wins))]


def _brute(rows, wins, cap):
    out = set()
    for chrom, w, low, high in wins:
        for sample in ("tumor", "normal", None):
            over = sorted((r[2], r[5], r[1]) for r in rows if r[0] == chrom and r[4] == sample
                          and r[3] > r[2] and r[2] < high and r[3] > low)
            out |= {(i, w) for _, _, i in over[:cap]}
    return out


@pytest.mark.parametrize("cap", [1, 3, 1000])
@pytest.mark.parametrize("bits, part", [(20, 10**6), (7, 10**6), (10, 15)])
def test_first_reads_against_all_pairs(spark, cap, bits, part):
    rows, wins = _intervals(cap + bits)
    reads = spark.createDataFrame(
        rows, "chrom string, r int, start0 int, end0 int, bam_source_id string, place int")
    windows = spark.createDataFrame(wins, "chrom string, w int, low0 int, high0 int")
    got = sweep.first_reads(reads, windows, cap, [F.col("place")], 120, strip_bits=bits, part_reads=part)
    found = [(r["r"], r["w"]) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == _brute(rows, wins, cap)
    assert set(got.columns) == {"chrom", "r", "start0", "end0", "bam_source_id", "place", "w", "low0", "high0"}
    # Reads beside the point count towards the limit all the same.
    point = {j: a + 1 for _, j, a, _ in wins}
    spans = {i: (a, b) for _, i, a, b, *_ in rows}
    over = sweep.first_reads(reads, windows.withColumn("p", F.col("low0") + 1), cap, [F.col("place")], 120,
                             point="p", strip_bits=bits, part_reads=part)
    assert {(r["r"], r["w"]) for r in over.collect()} == {
        (i, w) for i, w in set(found) if spans[i][0] <= point[w] < spans[i][1]}


def test_one_join_in_the_plan(spark, capsys):
    """Admission is a cogroup of reads and windows; nothing joins or counts the pairs again."""
    rows, wins = _intervals(1)
    reads = spark.createDataFrame(
        rows, "chrom string, r int, start0 int, end0 int, bam_source_id string, place int")
    windows = spark.createDataFrame(wins, "chrom string, w int, low0 int, high0 int")
    sweep.first_reads(reads, windows, 3, [F.col("place")], 120).explain()
    plan = capsys.readouterr().out
    assert plan.count("FlatMapCoGroupsInArrow") == 1
    assert plan.count("Join") == 1 and "left_semi" not in plan.lower()  # the list of strips with windows


def test_empty_sides(spark):
    reads = spark.createDataFrame(
        [], "chrom string, r int, start0 int, end0 int, bam_source_id string, place int")
    windows = spark.createDataFrame([("chr1", 1, 0, 9)], "chrom string, w int, low0 int, high0 int")
    assert sweep.first_reads(reads, windows, 3, [F.col("place")], 120).count() == 0
    rows, _ = _intervals(2)
    some = spark.createDataFrame(rows, reads.schema)
    assert sweep.first_reads(some, windows.limit(0), 3, [F.col("place")], 120).count() == 0


@pytest.mark.parametrize("at_once", [1, 7, 10**6])
def test_steps_of_the_sweep(at_once):
    rng = np.random.default_rng(3)
    start = np.sort(rng.integers(0, 500, 300))
    end = start + rng.integers(1, 90, 300)
    low = rng.integers(0, 550, 25)
    first = np.searchsorted(np.maximum.accumulate(end), low, "right")
    last = np.searchsorted(start, low + 40)
    for cap in (1, 4, 500):
        w, r = sweep.first_hits(end, low, first, last, cap, at_once)
        want = [(i, j) for i in range(25) for j in [
            j for j in range(300) if start[j] < low[i] + 40 and end[j] > low[i]][:cap]]
        assert sorted(zip(w.tolist(), r.tolist())) == sorted(want)


def _long_read(rng, i):
    ops, seq = [], []
    for _ in range(rng.randint(3, 12)):
        op, n = rng.choice("MMMID=X"), rng.randint(1, 40)
        ops.append(f"{n}{op}")
        if op != "D":
            seq.append("".join(rng.choices("ACGTC", k=n)))
    seq = "".join(seq)
    reverse = rng.random() < 0.5
    sites = seq.count("G" if reverse else "C")
    n = rng.randint(0, max(0, sites // 2))
    mm = "C+mh" + ",0" * n + ";" if n else None
    ml = [rng.randint(0, 255) for _ in range(2 * n)] if n and rng.random() < 0.8 else None
    return dict(READ, qname=f"q{i}", pos=rng.randint(1, 400), flag=16 * reverse + rng.choice([0, 0, 0, 1024]),
                cigar="".join(ops), seq=seq or "A", mm=mm, ml=ml, bam_source_id=rng.choice(["tumor", "normal"]))


def test_many_variants_of_a_read_share_one_decode(spark):
    """The same sites as from one decode per pair, from one row per read."""
    rng = random.Random(6)
    rows = [_long_read(rng, i) for i in range(120)]
    reads = read_rows(spark, *rows)
    variants = variant_rows(spark, *[
        (p, rng.choice("ACGT"), rng.choice(["C", "G", "AT", "T"]), rng.choice(["tp", "fp"]))
        for p in rng.choices(range(1, 700), k=150)])
    config = RunConfig(window_size=60, max_read_depth=100)
    got = sorted(map(tuple, E.methylation_sites(reads, variants, config).collect()))

    pairs = E.allele_support(E.reads_near_variants(reads, variants, 60, 100).where("(flag & 1796) = 0"))
    each = pairs.where("mm is not null").select("qname", "somatic_pos", "vcf_source_id", "ref", "alt", "copies", "somatic_allele_type",
                        F.explode(B.methylation_calls(
                            "seq", "flag", "pos", "cigar", "mm", "ml",
                            F.col("somatic_pos") - 60, F.col("somatic_pos") + 60)).alias("c"))
    want = []
    for r in each.collect():
        want += [(r["qname"], r["somatic_pos"], r["vcf_source_id"], r["somatic_allele_type"], r["c"]["ref_pos"],
                  np.float32(r["c"]["qual"] / 255))] * r["copies"]
    assert len(got) > 1000
    assert sorted((r[12], r[2], r[4], r[6], r[1], np.float32(r[9])) for r in got) == sorted(want)

    table = E.reads_with_variants(reads, variants, 60, 100)
    found = table.select("qname", F.size("hits").alias("n")).collect()
    assert len(found) == len({r["qname"] for r in found})  # one row per read, hence one decode
    assert max(r["n"] for r in found) > 5


def test_reads_elsewhere_are_not_written(spark):
    rows = [dict(READ, qname=f"q{i}", pos=1 + 40_000 * i) for i in range(50)] + [dict(READ, qname="long", cigar="5M900000N5M")]
    windows = E.variant_windows(variant_rows(spark, (400_005, "A", "C"), (1_200_001, "A", "C")), 100)
    spans = E.with_span(read_rows(spark, *rows)).withColumnRenamed("rname", "chrom")
    near = {r["qname"] for r in E.touching_tiles(spans, windows).collect()}
    assert {"q10", "q30", "long"} <= near and len(near) <= 5
    assert E.touching_tiles(spans, windows.limit(0)).count() == 0
