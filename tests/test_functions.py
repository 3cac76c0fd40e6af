import math

import pytest
from pyspark.sql import functions as F

from strandloom.functions import alignment as A, basemods as B, numeric as N, sites as S
from tests.helpers import READ, READ_A, READ_B, READ_C, near, read_rows


def column(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_state_bounds_are_float32(spark):
    quals = [(q,) for q in (255, 204, 203, 52, 51, 0, -1)]
    states = column(
        spark, quals, "q int", S.meth_state(S.call_probability(F.col("q")), 0.8, 0.2)
    )
    assert states == ["high", "high", "mid", "mid", "low", "low", "low"]


@pytest.mark.parametrize("kind,value,orig,tag", [
    (None, None, None, "0"), ("i", "1", None, "1"), ("i", "2", None, "2"), ("i", "3", None, "3"),
    ("i", "7", None, "7"), ("i", "-1", None, "un"), ("i", "0", None, "0"),
    ("i", "0", "1-1", "1-1"), ("i", "0", "2-1", "2-1"), ("i", "0", "other", "0"),
    ("i", "1", "1-1", "1"), ("Z", "UN", None, "un"), ("Z", "un", None, "un"),
    ("Z", "2-1", None, "2-1"), ("Z", "x", None, "x"),
])
def test_haplotype_tag(spark, kind, value, orig, tag):
    got = column(
        spark, [(kind, value, orig)], "t string, v string, o string",
        S.haplotype_tag(F.col("t"), F.col("v"), F.col("o")),
    )
    assert got == [tag]


def test_read_flags(spark):
    flags = [0, 16, 4, 256, 2048, 512, 1024]
    fetch = column(spark, [(f, 10) for f in flags], "f int, m int",
                   S.is_fetchable(F.col("f"), F.col("m")))
    assert fetch == [True, True, False, False, False, True, True]
    use = column(spark, [(f,) for f in flags], "f int", S.is_usable(F.col("f")))
    assert use == [True, True, False, False, True, False, False]
    assert column(spark, [(0, 9)], "f int, m int", S.is_fetchable(F.col("f"), F.col("m"))) == [False]


def test_asm_mode(spark):
    pairs = [(0.2, 0.8), (0.19, 0.81), (0.9, None), (None, 0.1), (None, None), (0.81, 0.19),
             (0.5, 0.1), (0.5, 0.9), (0.1, 0.5), (0.9, 0.5), (0.1, 0.1), (0.9, 0.9)]
    got = column(spark, pairs, "n double, t double", S.asm_mode(F.col("n"), F.col("t")))
    assert got == ["mid→mid", "low→high", "high→miss", "miss→low", "miss→miss", "high→low",
                   "mid→low", "mid→high", "low→mid", "high→mid", "low→low", "high→high"]


def test_asm_mode_with_crossed_bounds(spark):
    pairs = [(0.5, 0.5), (0.1, 0.9), (0.9, 0.9), (0.8, 0.2), (None, 0.5)]
    got = column(spark, pairs, "n double, t double", S.asm_mode(F.col("n"), F.col("t"), 0.8, 0.2))
    assert got == ["low→high", "low→high", "high→high", "high→low", "miss→high"]


def test_source_id(spark):
    names = ["/d/a.vcf.gz", "b.bam", "x/c.tar.gz", "plain", ".vcf.gz", "s3://k/h.v1.vcf"]
    got = column(spark, [(n,) for n in names], "p string", S.source_id(F.col("p")))
    assert got == ["a", "b", "c.tar", "plain", ".vcf", "h.v1"]


def test_cigar_walk(spark):
    df = read_rows(spark, READ_A)
    blocks = df.select(F.inline(A.cigar_blocks("cigar", "pos"))).collect()
    assert [tuple(b) for b in blocks] == [(3, 101, 5), (10, 106, 4), (14, 111, 3)]
    assert df.select(A.reference_span(F.col("cigar"))).first()[0] == 13
    for target, index in ((100, -1), (101, 3), (105, 7), (106, 10), (107, 11), (110, -1),
                          (111, 14), (113, 16), (114, -1)):
        at = A.query_index_at(F.col("cigar"), F.col("pos"), F.lit(target))
        assert df.select(at).first()[0] == index


def calls(spark, *reads):
    df = read_rows(spark, *reads).select("qname", F.explode(B.methylation_calls(
        "seq", "flag", "pos", "cigar", "mm", "ml", F.lit(0), F.lit(10000)
    )).alias("c"))
    return sorted((r["qname"], r["c"]["ref_pos"], r["c"]["qual"]) for r in df.collect())


def test_base_modifications(spark):
    assert calls(spark, READ_A) == [("A", 102, 204), ("A", 111, 51)]
    assert calls(spark, READ_B) == [("B", 203, 0), ("B", 206, 255)]
    both = [("C", 302, 40), ("C", 302, 200)]
    assert calls(spark, READ_C) == both
    assert calls(spark, dict(READ_C, mm="C+mh,0;")) == both
    assert calls(spark, dict(READ_C, mm="C+m?,0;C+h.,0;")) == both


def test_base_modification_edge_cases(spark):
    plain = dict(READ, qname="r", seq="ACGTACGTAC")
    assert calls(spark, dict(plain, mm="A+a,0;C+m,1;", ml=[9, 77])) == [("r", 106, 77)]
    assert calls(spark, dict(plain, mm="G-m,0;C+76792,0;C+m,0;", ml=[1, 2, 3])) == [("r", 102, 3)]
    assert calls(spark, dict(plain, mm="C+m,0;", ml=None)) == [("r", 102, -1)]
    assert calls(spark, dict(plain, mm="C+m,5;", ml=[1])) == []
    assert calls(spark, dict(plain, mm="C+m,0,0;", ml=[1])) == []
    assert calls(spark, dict(plain, mm="C+m;", ml=[])) == []
    assert calls(spark, dict(plain, seq="", mm="C+m,0;", ml=[1])) == []
    lower = dict(plain, seq="acgtacgtac", mm="C+m,0;", ml=[8])
    assert calls(spark, lower) == [("r", 102, 8)]


def test_base_modifications_match_a_slow_walk(spark):
    import random
    rng = random.Random(7)
    reads, want = [], []
    for i in range(60):
        seq = "".join(rng.choice("ACGT") for _ in range(rng.randint(20, 400)))
        flag = rng.choice([0, 16])
        walk = [p for p, b in enumerate(seq) if b == ("G" if flag else "C")]
        walk = walk[::-1] if flag else walk
        picked = sorted(rng.sample(range(len(walk)), rng.randint(0, len(walk))))
        skips = [b - a - 1 for a, b in zip([-1, *picked], picked)]
        ml = [rng.randint(0, 255) for _ in picked]
        reads.append(dict(READ, qname=str(i), flag=flag, seq=seq, cigar=f"{len(seq)}M", pos=1,
                          mm="C+m" + "".join(f",{s}" for s in skips) + ";", ml=ml))
        want += [(str(i), walk[k] + 1, q) for k, q in zip(picked, ml)]
    assert calls(spark, *reads) == sorted(want)


def test_fixed_point_ties_round_to_even(spark):
    values = [0.03125, 0.09375, 0.5, 1.0, 2.0 / 3]
    got = column(spark, [(v,) for v in values], "v float", N.fixed(F.col("v"), 4))
    assert got == [f"{v:.4f}" for v in (0.03125, 0.09375, 0.5, 1.0, 0.6666666865348816)]


def test_fixed_point_text_is_that_of_c(spark):
    values = [-0.00003, -0.0, 0.0, -0.5, 0.12345, -0.12345, 0.00005, 0.03125, 0.09375, 0.99995, 1e15, -7.0]
    values += [(-1) ** n * (n * 10 + 5) / 100_000 for n in range(0, 20_000, 3)]
    values += [n / 32 for n in range(200)] + [n / 7919 - 1 for n in range(2000)]
    for digits in (4, 6):
        got = column(spark, [(v,) for v in values], "v double", N.fixed(F.col("v"), digits))
        assert got == [f"{v:.{digits}f}" for v in values]
    odd = column(spark, [(float("inf"),), (-float("inf"),), (None,)], "v double", N.fixed(F.col("v"), 4))
    assert odd == ["Infinity", "-Infinity", None]


def test_approximate_p(spark):
    def p(*values):
        row = spark.createDataFrame(
            [values], "m1 double, v1 double, n1 long, m2 double, v2 double, n2 long"
        )
        return row.select(N.approximate_p(*[F.col(c) for c in row.columns])).first()[0]

    assert near(p(0.3, 0.02, 2, 0.7, 0.02, 2), 0.261204)
    assert p(0.3, None, 1, 0.7, 0.02, 2) == 1.0
    assert p(0.3, 0.0, 2, 0.7, 0.0, 2) == 0.0
    assert p(0.3, 0.0, 2, 0.3, 0.0, 2) is None


def test_tail_probabilities():
    # Known values: t(1) is Cauchy, t(2) has a closed form, chi2(2) is exponential.
    for t in (0.1, 1.0, 5.0, 60.0):
        cauchy = 1 - 2 * math.atan(t) / math.pi
        assert near(N.incomplete_beta(0.5, 0.5, 1 / (1 + t * t)), cauchy, 1e-12)
        two = 1 - t / math.sqrt(2 + t * t)
        assert near(N.incomplete_beta(1.0, 0.5, 2 / (2 + t * t)), two, 1e-12)
    for x in (0.01, 1.0, 7.0, 50.0):
        assert near(N.upper_gamma(1.0, x / 2), math.exp(-x / 2), 1e-13)
        assert near(N.upper_gamma(0.5, x / 2), math.erfc(math.sqrt(x / 2)), 1e-13)


def test_t_tail_for_large_df_nears_the_normal(spark):
    df = spark.createDataFrame([(1.96, 1e7), (None, 3.0)], "t double, d double")
    got = [r[0] for r in df.select(N.t_two_sided_p("t", "d")).collect()]
    assert near(got[0], math.erfc(1.96 / math.sqrt(2)), 1e-6)
    assert got[1] is None
