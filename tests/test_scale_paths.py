"""The paths for large inputs, forced on small ones and compared with plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import balance as B, overlap as O, quantiles as Q, summary as M
from tests.helpers import near, site_rows


@pytest.fixture
def nothing_fits(monkeypatch):
    """No table is small enough to broadcast, and few rows make a key heavy."""
    monkeypatch.setattr(B, "fits_broadcast", lambda df, **_: False)
    monkeypatch.setattr(O, "fits_broadcast", lambda df, **_: False)
    monkeypatch.setattr(B, "HEAVY_ROWS", 50)


def skewed_rows(n=600):
    """A third of the rows has one key."""
    rng = random.Random(3)
    return [("hot" if i % 3 == 0 else f"k{rng.randint(0, 40)}", i) for i in range(n)]


def test_attach_by_key(spark, nothing_fits):
    rows = skewed_rows()
    left = spark.createDataFrame(rows + [(None, -1)], "k string, v int")
    totals = left.where("k is not null and k != 'k7'").groupBy("k").agg(
        F.count("*").alias("n"), F.sum("v").alias("s")
    )
    got = B.attach_by_key(left, totals, ["k"], "n", ["v"])
    assert got.columns == ["k", "v", "n", "s"]
    want = {}
    for k, v in rows:
        want[k] = (want.get(k, (0, 0))[0] + 1, want.get(k, (0, 0))[1] + v)
    want["k7"] = want[None] = (None, None)
    result = got.collect()
    assert len(result) == len(rows) + 1
    assert all((r["n"], r["s"]) == want[r["k"]] for r in result)


def test_heavy_rows_are_spread(spark, nothing_fits):
    """No shuffled task holds more than a fair part of the hot key."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.createDataFrame(skewed_rows(3000), "k string, v int")
        totals = left.groupBy("k").agg(F.count("*").alias("n"))
        placed = B.attach_by_key(left, totals, ["k"], "n", ["v"]).withColumn(
            "task", F.spark_partition_id()
        )
        sizes = [r["count"] for r in placed.where("k = 'hot'").groupBy("task").count().collect()]
        assert sum(sizes) == 1000 and len(sizes) == 4 and max(sizes) < 500
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_number_of_heavy_keys_is_bounded(spark, nothing_fits, monkeypatch):
    """The rows a task may hold rise where too many keys would be heavy; the result is the same."""
    monkeypatch.setattr(B, "HEAVY_ROWS", 1)
    monkeypatch.setattr(B, "MOST_HEAVY", 4)
    test_attach_by_key(spark, None)


def test_semi_join(spark, nothing_fits):
    rows = skewed_rows()
    left = spark.createDataFrame(rows, "k string, v int")
    keys = spark.createDataFrame([("hot",), ("hot",), ("k1",), ("absent",)], "k string")
    got = sorted(map(tuple, B.semi_join(left, keys, ["k"], ["v"]).collect()))
    assert got == sorted(r for r in rows if r[0] in ("hot", "k1"))


def test_size_check(spark):
    df = spark.createDataFrame([("x" * 100, i) for i in range(10)], "s string, i int")
    assert B.fits_broadcast(df)
    assert not B.fits_broadcast(df, max_rows=9)
    assert not B.fits_broadcast(df, max_bytes=500)


def intervals(spark):
    rng = random.Random(5)
    reads = []
    for i in range(300):
        start = 1000 if i % 3 == 0 else rng.randint(0, 4000)
        reads.append(("chr1" if i % 5 else "chr2", i, start, start + rng.randint(1, 300)))
    windows = [("chr1", j, s, s + 120) for j, s in enumerate(range(0, 4000, 171))]
    windows.append(("chr1", 99, 0, 5000))
    r = spark.createDataFrame(reads, "chrom string, r int, start0 int, end0 int")
    w = spark.createDataFrame(windows, "chrom string, w int, low0 int, high0 int")
    pairs = {(a[1], b[1]) for a in reads for b in windows
             if a[0] == b[0] and a[2] < b[3] and a[3] > b[2]}
    return r, w, pairs


@pytest.mark.parametrize("small,hot", [(True, 10), (False, 10), (False, 10000)])
@pytest.mark.parametrize("bin_size", [16, 100, 4096])
def test_overlap_join_against_all_pairs(spark, small, hot, bin_size):
    reads, windows, want = intervals(spark)
    got = O.overlap_join(reads, windows, bin_size=bin_size, hot_rows=hot, small_windows=small)
    rows = [(r["r"], r["w"]) for r in got.select("r", "w").collect()]
    assert len(rows) == len(want) and set(rows) == want


@pytest.mark.parametrize("cap", [1, 3, 50, 1000])
def test_depth_limit(spark, cap):
    rows = [("hot" if i % 3 == 0 else f"g{i % 20}", (i * 37) % 1009, "x") for i in range(600)]
    hits = spark.createDataFrame(rows, "g string, o int, payload string")
    got = sorted(map(tuple, O.limit_depth(hits, ["g"], "o", cap).collect()))
    want = []
    for g in {r[0] for r in rows}:
        want += sorted((r for r in rows if r[0] == g), key=lambda r: r[1])[:cap]
    assert got == sorted(want)


def test_depth_limit_without_broadcast(spark, nothing_fits):
    test_depth_limit(spark, 3)


def test_strand_filter_without_broadcast(spark, nothing_fits):
    rows = [dict(methyl_pos=1 if i % 3 == 0 else i, strand="+-"[i % 2], read_id=f"r{i}")
            for i in range(120)]
    kept = M.strand_covered_sites(site_rows(spark, *rows), 2).collect()
    assert [r["methyl_pos"] for r in kept] == [1] * len([r for r in rows if r["methyl_pos"] == 1])


@pytest.mark.parametrize("size", [1, 2, 3, 10, 999, 25000])
def test_exact_quantiles(spark, size):
    rng = random.Random(size)
    values = [rng.choice([0.25, round(rng.random(), 3), rng.random() ** 9]) for _ in range(size)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None), ("c", 1.5)],
                               "g string, v double")
    wanted = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q90": 0.9, "q100": 1.0}
    got = {r["g"]: r for r in Q.exact_quantiles(df, ["g"], "v", wanted).collect()}
    ordered = sorted(values)
    for name, q in wanted.items():
        at = (size - 1) * q
        low = int(at)
        high = min(low + 1, size - 1)
        assert near(got["a"][name], ordered[low] + (ordered[high] - ordered[low]) * (at - low), 1e-12)
        assert got["c"][name] == 1.5
    assert "b" not in got


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("buckets", [None, 2, 7, 256])
def test_running_totals(spark, descending, buckets):
    values = list({round(random.Random(1).random() * i, 4) for i in range(1, 500)})
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "o double, n long")
    got = {r["o"]: r["cum_n"] for r in
           Q.running_totals(df, "o", ["n"], descending, buckets).collect()}
    total = 0
    for v, n in sorted(zip(values, range(len(values))), reverse=descending):
        total += n
        assert got[v] == total
    assert len(got) == len(values)


@pytest.mark.parametrize("bits", [6, 22])
def test_regions_are_merged(spark, bits):
    rng = random.Random(bits)
    rows = [("chr1" if i % 4 else "chr2", a, a + rng.choice([0, 1, 5, 80])) for i, a in
            enumerate(rng.randint(0, 3000) for _ in range(200))] + [(None, 1, 9)]
    merged = O.merged_regions(spark.createDataFrame(rows, "chrom string, start int, end int"), bits=bits).collect()
    for chrom in ("chr1", "chr2"):
        covered = {p for c, a, b in rows if c == chrom for p in range(a, b)}
        own = [p for r in merged if r["chrom"] == chrom for p in range(r["start"], r["end"])]
        assert len(own) == len(set(own)) and set(own) == covered
        ends = {r["end"] for r in merged if r["chrom"] == chrom}
        starts = {r["start"] for r in merged if r["chrom"] == chrom}
        assert all(p % (1 << bits) == 0 for p in starts & ends)  # only strips are cut


def test_overlapping_whole_chromosomes_give_no_extra_rows(spark):
    regions = spark.createDataFrame([("chr1", i, 248_000_000 + i) for i in range(60)], "chrom string, start int, end int")
    assert O.merged_regions(regions).count() == -(-248_000_059 // (1 << 22))
    points = spark.createDataFrame([("chr1", 0), ("chr1", 248_000_058), ("chr1", 248_000_059), ("chr2", 5)], "chrom string, p int")
    for small in (True, False):
        got = O.points_in_regions(points, regions, "p", small_regions=small).collect()
        assert sorted(r["p"] for r in got) == [0, 248_000_058]


def test_quantiles_of_many_groups_without_broadcast(spark, nothing_fits):
    """A group column without bound: brackets meet rows by key, the large group's on many tasks."""
    rng = random.Random(4)
    rows = [("hot" if i % 3 == 0 else f"g{i % 97}", round(rng.random(), 3)) for i in range(3000)] + [(None, 0.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["q10"], r["q50"]) for r in Q.exact_quantiles(df, ["g"], "v", {"q10": 0.1, "q50": 0.5}).collect()}
    groups = {g for g, _ in rows if g}
    assert set(got) == groups
    for g in groups:
        ordered = sorted(v for h, v in rows if h == g)
        for q, value in zip((0.1, 0.5), got[g]):
            at = (len(ordered) - 1) * q
            low = int(at)
            high = min(low + 1, len(ordered) - 1)
            assert near(value, ordered[low] + (ordered[high] - ordered[low]) * (at - low), 1e-12)


def test_feature_quantiles_keep_rows_wide(spark, monkeypatch):
    """Groups below and above the sketch's accuracy, ties, missing values and a feature without any."""
    monkeypatch.setattr(Q, "ACCURACY", 200)
    rng = np.random.default_rng(4)
    rows = [(("a", "b")[i % 9 == 0], float(rng.normal()), float(i % 3) if i % 7 else None, None) for i in range(3000)]
    rows.append((None, 1.0, 1.0, 1.0))
    df = spark.createDataFrame(rows, "g string, x double, y double, z double")
    wanted = {"q10": 0.1, "q50": 0.5, "q100": 1.0}
    got = {(r["g"], r["feature"]): r for r in Q.feature_quantiles(df, ["g"], ["x", "y", "z"], wanted).collect()}
    assert {k for k in got if k[0]} == {(g, f) for g in "ab" for f in "xy"}
    for (g, f), r in got.items():
        if g:
            column = [row["xyz".index(f) + 1] for row in rows if row[0] == g]
            column = [v for v in column if v is not None]
            assert all(abs(r[n] - np.quantile(column, q)) < 1e-12 for n, q in wanted.items())
    over_all = {r["feature"]: r["q50"] for r in Q.feature_quantiles(df, [], ["x", "y", "z"], {"q50": 0.5}).collect()}
    assert over_all["x"] == np.median([r[1] for r in rows]) and over_all["z"] == 1.0
    plan = Q.feature_quantiles(df, ["g"], ["x", "y"], wanted)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
    assert Q.feature_quantiles(df.limit(0), ["g"], ["x"], wanted).count() == 0
