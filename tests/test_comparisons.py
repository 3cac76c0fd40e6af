import glob
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom import cli
from strandloom.operators import (
    classify as K, contrast as C, describe as D, grids as G, tests as T,
)
from strandloom.schema import CONTRAST_KEY, FEATURES, SITES, SUMMARY
from strandloom.sources import tables
from tests.helpers import SITE, near, site_rows


def summary_rows(spark, *rows):
    """(pos, sample, mean[, haplotype])."""
    return spark.createDataFrame(
        [("chr1", r[0], "SNV", "v", r[1], "ref", r[3] if len(r) > 3 else "1", 2, 3, r[2], "+")
         for r in rows], SUMMARY,
    )


def test_pivot_and_missing_sides(spark):
    df = summary_rows(spark, (1, "tumor", 0.75), (1, "normal", 0.5), (2, "tumor", 0.25),
                      (3, "normal", 1.0))
    rows = {r["somatic_pos"]: r for r in C.pivot_delta(df).collect()}
    assert (rows[1]["normal"], rows[1]["tumor"], rows[1]["delta"]) == (0.5, 0.75, 0.25)
    assert rows[2]["normal"] is None and rows[2]["delta"] is None and rows[3]["tumor"] is None
    done = C.pivot_delta(df)
    assert C.pivot_delta(done) is done
    with pytest.raises(KeyError):
        C.pivot_delta(df.drop("bam_source_id"))
    with pytest.raises(KeyError):
        C.require_both_samples(C.pivot_delta(df.where("bam_source_id = 'tumor'")))


def test_features_count_positions_not_rows(spark):
    df = site_rows(spark, dict(methyl_pos=1), dict(methyl_pos=1), dict(methyl_pos=2, read_id="b"),
                   dict(bam_source_id="normal", methyl_pos=2, read_id="c"))
    row = C.detail_features(df).first()
    assert (row["supporting_read_count"], row["methyl_sites_count"]) == (3, 2)
    summary = summary_rows(spark, (90, "tumor", 0.5), (90, "normal", 0.5), (91, "tumor", 0.5))
    joined = C.merged_features(
        C.pivot_delta(summary.withColumn("vcf_source_id", F.lit("tp"))), C.detail_features(df)
    )
    assert joined.count() == 1 and set(FEATURES) <= set(joined.columns)


def counts(spark, *cells):
    return spark.createDataFrame([(f"v{i}", a, b) for i, (a, b) in enumerate(cells)],
                                 "v string, FP long, TP long")


def test_chi_square(spark):
    row = C.chi_square(counts(spark, (10, 20), (20, 10))).first()
    assert near(row["chi2"], 5.4) and row["dof"] == 1
    assert near(row["p_value"], math.erfc(math.sqrt(5.4 / 2)), 1e-12)
    cells = [(10, 20), (20, 10), (7, 30)]
    row = C.chi_square(counts(spark, *cells)).first()
    table = np.array(cells, float)
    expected = np.outer(table.sum(1), table.sum(0)) / table.sum()
    chi2 = ((table - expected) ** 2 / expected).sum()
    assert near(row["chi2"], chi2, 1e-9) and near(row["p_value"], math.exp(-chi2 / 2), 1e-12)
    got = [(r["expected_FP"], r["expected_TP"])
           for r in C.expected_counts(counts(spark, *cells), "v").orderBy("v").collect()]
    assert np.allclose(got, expected)
    assert C.chi_square(counts(spark, (5, 0), (3, 0))).first()["p_value"] is None


def test_grid_of_an_empty_table_is_whole(spark):
    df = spark.createDataFrame([], "label string, normal double, delta double, n int")
    rows = G.rate_grid(df, [0.0, 0.5], [0.0, 0.1], [0, 5, 9], "n").collect()
    assert len(rows) == 12 and all(r["TPR"] is None and r["FPR"] is None for r in rows)


def test_large_grid(spark):
    """125,000 cells, each against the plain count."""
    rng = np.random.default_rng(3)
    rows = [("TP" if i % 2 else "FP", float(a), float(b), int(c)) for i, (a, b, c) in
            enumerate(zip(rng.random(60), rng.random(60), rng.integers(0, 50, 60)))]
    df = spark.createDataFrame(rows, "label string, normal double, delta double, n int")
    ths = [i / 50 for i in range(50)]
    got = G.rate_grid(df, ths, ths, list(range(50)), "n").toPandas()
    assert len(got) == 125_000
    v = {k: np.array([r[j] for r in rows]) for j, k in enumerate(("label", "normal", "delta", "n"))}
    for r in got.sample(200, random_state=1).itertuples():
        met = (v["normal"] >= r.normal_th) & (v["delta"] >= r.delta_th) & (v["n"] >= r.read_th)
        assert near(r.TPR, met[v["label"] == "TP"].mean(), 1e-12)
        assert near(r.FPR, met[v["label"] == "FP"].mean(), 1e-12)


def test_detail_features_count_without_multiplying(spark, capsys):
    key = "'chr1' chrom, 5 somatic_pos, 'SNV' variant_type, 'tp' vcf_source_id, 'ref' somatic_allele_type"
    df = spark.sql(f"""SELECT {key}, h haplotype_tag, r read_id, p methyl_pos, CAST(c AS FLOAT) meth_call
      FROM VALUES ('1', 'a', 1, 0.5), ('1', 'a', 2, 1.0), ('1', 'b', 1, NULL), ('1', NULL, NULL, 0.0),
        (NULL, 'a', 3, NULL) t(h, r, p, c)""")
    got = C.detail_features(df)
    rows = {r["haplotype_tag"]: tuple(r)[-3:] for r in got.collect()}
    assert rows == {"1": (2, 2, 0.5), None: (1, 1, None)}
    got.explain()
    assert "Expand" not in capsys.readouterr().out


def test_grids_match_plain_loops(spark):
    rng = random.Random(2)
    pick = lambda: rng.choice([None, rng.random(), rng.random()])
    rows = [(rng.choice(["TP", "FP"]), pick(), pick(), rng.randint(0, 12)) for _ in range(300)]
    df = spark.createDataFrame(rows, "label string, normal double, delta double, read_count_detail long")
    got = {(r[0], r[1], r[2]): (r[3], r[4]) for r in
           G.rate_grid(df, [0.3, 0.0, 0.7], [0.0, 0.5], [10, 0, 5]).collect()}
    assert len(got) == 18
    for (r, n, d), rates in got.items():
        for label, rate in zip(("TP", "FP"), rates):
            own = [x for x in rows if x[0] == label]
            kept = [x for x in own if x[1] is not None and x[1] >= n
                    and x[2] is not None and abs(x[2]) >= d and x[3] >= r]
            assert near(rate, len(kept) / len(own), 1e-12)
    for (r, n, d), (tpr, _) in got.items():
        assert tpr <= got[0, 0.0, 0.0][0]
    keep = spark.createDataFrame([("TP", 5, 3), ("TP", 0, 0), ("FP", 9, 1)],
                                 "label string, supporting_read_count int, methyl_sites_count int")
    cells = {(r["min_cpg"], r["min_reads"]): (r["tp_count"], r["fp_count"], r["tp_rate"])
             for r in G.retention_grid(keep, [0, 5, 9], [0, 2]).collect()}
    assert cells == {(0, 0): (2, 1, 1.0), (0, 5): (1, 1, 0.5), (0, 9): (0, 1, 0.0),
                     (2, 0): (1, 0, 0.5), (2, 5): (1, 0, 0.5), (2, 9): (0, 0, 0.0)}
    assert G.parse_thresholds("0, 5,x,-1,10") == [0, 5, 10]


def labelled(spark, tp, fp):
    return spark.createDataFrame(
        [("TP", float(v)) for v in tp] + [("FP", float(v)) for v in fp] + [("TP", None)],
        "label string, x double",
    )


def test_welch_and_effect_sizes(spark):
    df = labelled(spark, [1, 2, 3], [2, 4, 6, 8])
    row = T.with_effect_sizes(T.with_welch(T.label_moments(df, ["x"]))).first()
    assert near(row["t_stat"], -2.121320) and near(row["t_df"], 4.075472)
    assert near(row["d_simple"], -1.532262) and near(row["d_weighted"], -1.430194)
    flat = T.stat_tests(labelled(spark, [1, 1], [2, 2]), ["x"]).first()
    assert flat["t_stat"] == -math.inf and flat["p_val"] == 0.0 and flat["significant"]
    same = T.stat_tests(labelled(spark, [2, 2], [2, 2]), ["x"]).first()
    assert same["t_stat"] is None and same["p_val"] is None and not same["significant"]


def plain_bootstrap(x, y, n, rng):
    pool, gap = np.concatenate([x, y]), abs(x.mean() - y.mean())
    a = rng.choice(pool, (n, len(x))).mean(1)
    b = rng.choice(pool, (n, len(y))).mean(1)
    return (abs(a - b) >= gap).mean()


def test_bootstrap_near_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(T, "VALUES_PER_PART", 16)
    rng = np.random.default_rng(4)
    x, y = rng.normal(0, 1, 120), rng.normal(0.25, 1.3, 90)
    df = labelled(spark, x, y).withColumn("g", F.lit("a"))
    run = lambda seed: T.bootstrap_p(df, ["x"], ["g"], n_boot=2000, seed=seed).first()["p_boot"]
    first = run(1)
    assert near(first, plain_bootstrap(x, y, 20000, rng), 0.04)
    assert run(1) == first


@pytest.mark.parametrize("number", [30, 70_000])
def test_draws_are_uniform(spark, number):
    """Counts of places as far from equal as chance has them, and streams without relation."""
    rows = spark.range(2000 if number == 30 else 4).selectExpr(
        "id AS redraw", "0 AS side", "7L AS stream", "5L AS start", "45L AS stop", f"{number}L AS number")
    drawn = lambda rows: T.places(T.streams(rows, 1, F.lit(False), 3), "redraw").groupBy(
        "redraw", F.col("place0").alias("place")).count().toPandas()
    out = drawn(rows)
    table = out.pivot(index="redraw", columns="place", values="count").fillna(0).to_numpy()
    assert table.shape[1] == 40 and (table.sum(1) == number).all()
    expected = number / 40
    assert near(((table - expected) ** 2 / expected).sum() / (table.shape[0] * 39), 1, 0.3 if number > 30 else 0.03)
    total = table.sum(0)
    assert ((total - total.mean()) ** 2 / total.mean()).sum() < 75
    again = drawn(rows.repartition(3))
    order = ["redraw", "place"]
    assert out.sort_values(order).values.tolist() == again.sort_values(order).values.tolist()


def mixed(step, k1, k2):
    """The mix of a counter with two keys in whole numbers, as the SQL states it."""
    a = ((step ^ k1) * 2146121005) & 2147483647
    c = (((a ^ (a >> 15)) + k2) * 739982445) & 2147483647
    e = ((c ^ (c >> 13)) * 695872825) & 2147483647
    return e ^ (e >> 16)


@pytest.mark.parametrize("run", [65_536, 40])
def test_draws_of_a_chunk_are_those_of_its_counter(spark, monkeypatch, run):
    """By step and by range, for long and short chunks together, whatever a worker has in hand at once."""
    monkeypatch.setattr(T, "RUN", run)
    chunks = [(0, 2**31 - 1, 2**31 - 1, 0, 131_072, 500, 1), (1, 5, 2**30, 131_072, 131_073, 1, 9_000_000_000),
              (2, 123_456_789, 987_654_321, 10**12, 10**12 + 3_000_000, 300, 1), (3, 0, 0, 70, 75, 1, 1),
              (4, 2**31 - 1, 0, 100_000, 2**27, 700, 1)]
    df = spark.createDataFrame(
        chunks, "redraw int, k1 long, k2 long, start long, stop long, steps long, times long").coalesce(1)
    want = [(r, start + math.floor(mixed(i, k1, k2) * ((stop - start) / 2**31)), times)
            for r, k1, k2, start, stop, steps, times in chunks for i in range(steps)]
    got = T.places(df, "redraw").select("redraw", "place0", "times").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    ranges = {}
    for r, place, times in want:
        ranges[r, place // 1000] = ranges.get((r, place // 1000), 0) + times
    got = T.places(df, "redraw", span=1000).select("redraw", "place0", "times").collect()
    assert sorted(map(tuple, got)) == sorted((*key, n) for key, n in ranges.items())


def test_single_values_need_no_draws(spark):
    df = labelled(spark, [1] * 40 + [2], [1] * 40).withColumn("g", F.lit("a"))
    same = labelled(spark, [0.1] * 30, [0.1] * 47).withColumn("g", F.lit("b"))
    got = {r["g"]: r["p_boot"] for r in T.bootstrap_p(df.union(same), ["x"], ["g"], n_boot=500).collect()}
    assert got["b"] == 1.0 and 0.3 < got["a"] < 1.0


def test_bootstrap_over_a_tree_of_parts(spark, monkeypatch):
    """With four values a part and a fan-out of three, draws pass four levels."""
    monkeypatch.setattr(T, "VALUES_PER_PART", 4)
    monkeypatch.setattr(T, "FANOUT", 3)
    rng = np.random.default_rng(4)
    x, y = rng.normal(0, 1, 120), rng.normal(0.25, 1.3, 90)
    df = labelled(spark, x, y).withColumn("g", F.lit("a"))
    got = T.bootstrap_p(df, ["x"], ["g"], n_boot=2000, seed=1).first()["p_boot"]
    assert near(got, plain_bootstrap(x, y, 20000, rng), 0.04)


def broadcast_parts(df):
    """The parts of the plan that are gathered on the driver, as text."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(re.match(r"[ :+-]*", line).group()) for line in lines]
    for i, line in enumerate(lines):
        if line[depth[i]:].startswith("BroadcastExchange"):
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i:end])


def test_draws_of_feature_tests_are_not_gathered(spark):
    """the counts of draws, a row for each part and redraw, were planned as a broadcast."""
    df = labelled(spark, range(60), range(5, 45)).withColumn("g", F.lit("a"))
    out = T.feature_tests(df, ["x"], "g", n_boot=20)
    gathered = list(broadcast_parts(out))
    assert gathered and not any("InArrow" in part for part in gathered)
    assert [r["group"] for r in out.collect()] == ["a"]


def test_draws_of_a_bootstrap_are_not_gathered(spark, monkeypatch):
    """the same with several parts a group, a part of one value and a group without a name, which is left out."""
    monkeypatch.setattr(T, "VALUES_PER_PART", 16)
    named = labelled(spark, range(60), [7] * 40).withColumn("g", F.lit("a"))
    out = T.bootstrap_p(named.union(labelled(spark, range(30), range(9)).withColumn(
        "g", F.lit(None).cast("string"))), ["x"], ["g"], n_boot=20)
    gathered = list(broadcast_parts(out))
    assert gathered and not any("InArrow" in part for part in gathered)
    found = out.collect()
    assert [r["g"] for r in found] == ["a"] and found == T.bootstrap_p(named, ["x"], ["g"], n_boot=20).collect()


def test_sums_of_a_part():
    """A part of one value is not drawn from, and chunks without a part give nothing."""
    chunks = pa.table({
        "pool": [4, 4], "side": [0, 1], "redraw": [7, 7], "k1": [11, 12], "k2": [13, 14], "start": [32, 32],
        "stop": [36, 36], "steps": [5, 3], "times": [1, 1]})
    drawn = lambda values: T._sums(chunks, pa.table(
        {"values": pa.array(values, pa.list_(pa.float64()))})).column("drawn").to_pylist()
    assert drawn([[0.5] * 4]) == [2.5, 1.5] and drawn([]) == []
    values = [1.0, 10.0, 100.0, 1000.0]
    assert drawn([values]) == [
        sum(values[math.floor(mixed(i, k1, k2) * 4 / 2**31)] for i in range(steps))
        for k1, k2, steps in ((11, 13, 5), (12, 14, 3))]


def test_grouped_feature_tests(spark):
    rows = [("TP", "a", i % 7, None) for i in range(20)] + [("FP", "a", i % 5, 1.0) for i in range(20)]
    rows += [("TP", "b", 1, 1.0), ("FP", "b", 2, 1.0), ("FP", None, 2, 1.0)]
    df = spark.createDataFrame(rows, "label string, g string, x int, y double")
    out = T.feature_tests(df, ["x", "y"], "g", n_boot=50).collect()
    assert [(r["group"], r["feature"]) for r in out] == [("a", "x")]
    assert out[0]["p_adj"] == out[0]["p_val"] and 0 <= out[0]["p_boot"] <= 1
    everything = T.feature_tests(df, ["x", "y"], None, n_boot=50).collect()
    assert {r["group"] for r in everything} == {"ALL"}
    assert T.feature_tests(df, ["x"], "absent", n_boot=10).first()["group"] == "ALL"
    adjusted = T.bonferroni(spark.createDataFrame([(0.01,), (0.4,), (0.9,)], "p_val double"))
    assert [round(r["p_adj"], 6) for r in adjusted.orderBy("p_val").collect()] == [0.03, 1.0, 1.0]


def test_correlation(spark):
    rng = np.random.default_rng(1)
    a = rng.random(50)
    b = a + rng.random(50)
    rows = [("TP", float(p), float(q), 1.0) for p, q in zip(a, b)] + [("TP", 5.0, None, 1.0)]
    df = spark.createDataFrame(rows, "label string, a double, b double, c double")
    got = {(r[1], r[2]): r[3] for r in D.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert near(got["a", "b"], np.corrcoef(a, b)[0, 1], 1e-9) and got["a", "b"] == got["b", "a"]
    assert got["c", "c"] is None and near(got["a", "a"], 1.0) and len(got) == 9


def test_histogram_edges(spark):
    df = labelled(spark, [0, 1, 2, 10], [5, 5])
    got = {(r["label"], r["bin"]): (r["left_edge"], r["count"])
           for r in D.histogram(df, ["x"], 5).collect()}
    assert got == {("TP", 0): (0.0, 2), ("TP", 1): (2.0, 1), ("TP", 4): (8.0, 1), ("FP", 0): (5.0, 2)}


def test_split_is_stratified_and_stable(spark):
    assert K.split_sizes({"TP": 7, "FP": 3}) == {"TP": 2, "FP": 1}
    assert K.split_sizes({"TP": 101, "FP": 50}) == {"TP": 31, "FP": 15}
    rows = [("TP" if i % 3 else "FP", i) for i in range(151)]
    df = spark.createDataFrame(rows, "label string, k int")
    split = K.stratified_split(df, ["k"])
    sizes = {r["label"]: r["count"] for r in split.where("is_test").groupBy("label").count().collect()}
    assert sizes == K.split_sizes({"TP": 100, "FP": 51})
    again = K.stratified_split(df.repartition(7), ["k"])
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, again.collect()))


def test_model_recovers_a_separation(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        tp = i % 4 == 0
        rows.append(("TP" if tp else "FP", i, float(rng.normal(2.0 if tp else 0.0, 1)),
                     None if i % 9 == 0 else float(rng.normal())))
    df = spark.createDataFrame(rows, "label string, k int, good double, noise double")
    result = K.evaluate(df, ["good", "noise"], ["k", "label"])
    row = result.metrics.first()
    assert row["auc"] > 0.85 and row["accuracy"] > 0.7
    assert row["tp"] + row["fp"] + row["fn"] + row["tn"] == 120 == row["support_TP"] + row["support_FP"]
    assert [r["feature"] for r in result.coefficients.collect()] == ["good", "noise"]
    # The fit minimizes the weighted loss: the gradient there is zero.
    train = K.standardize(K.impute_medians(df, ["good", "noise"]), ["good", "noise"])
    model = K.fit_balanced_logistic(train, ["good", "noise"])
    pdf = train.toPandas()
    y = (pdf.label == "TP").to_numpy(float)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    x = pdf[["good", "noise"]].to_numpy()
    beta = np.array(model.coefficients)
    p = 1 / (1 + np.exp(-(model.intercept + x @ beta)))
    assert np.allclose(x.T @ (w * (p - y)) + beta, 0, atol=1e-6) and near((w * (p - y)).sum(), 0, 1e-6)


def test_model_of_separable_and_unfit_rows(spark):
    rows = [("TP" if i % 2 else "FP", 1e3 * (i % 2) + i, 7.0) for i in range(40)]
    df = spark.createDataFrame(rows, "label string, x double, same double")
    model = K.fit_balanced_logistic(K.standardize(df, ["x", "same"]), ["x", "same"], c=100.0)
    assert 0 < model.coefficients[0] < 100 and near(model.coefficients[1], 0, 1e-9)
    with pytest.raises(ValueError):
        K.fit_balanced_logistic(df.where("label = 'TP'"), ["x"])
    with pytest.raises(ValueError):
        K.fit_balanced_logistic(df.withColumn("x", F.when(F.col("x") > 20, F.col("x"))), ["x"])


def test_curve_area_counts_ties_half(spark):
    rows = [("TP", 0.9), ("TP", 0.5), ("TP", 0.5), ("FP", 0.5), ("FP", 0.1)]
    scored = spark.createDataFrame(rows, "label string, score double")
    pairs = [(a, b) for (l, a), (m, b) in itertools.product(rows, rows) if l == "TP" and m == "FP"]
    want = sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)
    curve = K.roc_points(scored)
    assert near(K.area_under_curve(curve).first()["auc"], want)
    points = sorted((r["fpr"], r["tpr"]) for r in curve.collect())
    assert points[0] == (0.0, 0.0) and points[-1] == (1.0, 1.0) and len(points) == 4


# --- command line --------------------------------------------------------------------------------


def write_call_set(folder, name, shift):
    rng = random.Random(shift)
    key = lambda p: f"chr1\t{p}\tSNV\t{name}"
    sites = ["\t".join(SITES.names)]
    summary = ["\t".join(SUMMARY.names)]
    for p in range(60):
        hap = rng.choice(["0", "1", "1-1"])
        for sample in ("tumor", "normal"):
            if p == 3 and sample == "normal":
                continue
            level = min(1.0, rng.random() * 0.5 + shift * (sample == "tumor"))
            for i in range(rng.randint(1, 6)):
                sites.append(f"chr1\t{p * 10 + i}\t{p}\tSNV\t{name}\t{sample}\tref\tA\t{hap}\t"
                             f"{level:.4f}\tmid\t+\tr{i}")
            summary.append(f"{key(p)}\t{sample}\tref\t{hap}\t{rng.randint(1, 40)}\t"
                           f"{rng.randint(1, 9)}\t{level:.4f}\t+")
    (folder / f"{name}_l1.tsv").write_text("\n".join(sites) + "\n")
    (folder / f"{name}_l2.tsv").write_text("\n".join(summary) + "\n")


def table_lines(path):
    return [line for f in sorted(glob.glob(f"{path}/part-*")) for line in open(f).read().splitlines()]


def test_command_line_tools(spark, tmp_path):
    write_call_set(tmp_path, "tp", 0.5)
    write_call_set(tmp_path, "fp", 0.0)
    d = str(tmp_path)
    both = ["--tp-summary", f"{d}/tp_l2.tsv", "--fp-summary", f"{d}/fp_l2.tsv"]
    details = ["--tp-detail", f"{d}/tp_l1.tsv", "--fp-detail", f"{d}/fp_l1.tsv"]

    assert cli.main(["full", *both, *details, "--out-dir", f"{d}/full"]) == 0
    stats = table_lines(f"{d}/full/descriptive/descriptive_stats.csv")
    assert stats[0] == "feature,group,count,mean,median,std,min,max" and len(stats) == 13
    tests = table_lines(f"{d}/full/stat_tests/stat_tests.csv")
    assert tests[0] == "feature,TP_mean,FP_mean,t_stat,p_val,cohen_d,significant"
    assert any(t.startswith("tumor,") and t.endswith(",true") for t in tests)
    assert table_lines(f"{d}/full/classification/feature_coefficients.csv")[0] == "feature,coef"

    assert cli.main(["grid", *both, *details, "--out-dir", f"{d}/grid"]) == 0
    grid = table_lines(f"{d}/grid/threshold_grid_results.csv")
    assert grid[0] == "read_th,normal_th,delta_th,TPR,FPR" and len(grid) == 121

    assert cli.main(["haplotypes", *both, "--out-prefix", f"{d}/h"]) == 0
    assert table_lines(f"{d}/h_haplotype_counts.tsv")[0] == "haplotype_tag\tFP\tTP"
    report = table_lines(f"{d}/h_asm_mode_chi2.txt")
    assert report[0].startswith("chi2 = ") and report[4] == "expected frequencies:"

    assert cli.main(["retention", "--tp", f"{d}/tp_l2.tsv", "--fp", f"{d}/fp_l2.tsv", "--out-dir",
                     f"{d}/keep"]) == 0
    matrix = table_lines(f"{d}/keep/tp_counts.csv")
    assert matrix[0].split("\t") == ["min_cpg", "0", "5", "10", "15", "20", "25", "30", "40", "50"]
    assert matrix[1].split("\t")[:2] == ["0", "119"] and len(matrix) == 8

    (tmp_path / "f.csv").write_text("mean_methylation\nsupporting_read_count\nabsent\n")
    assert cli.main(["features", "--tp", f"{d}/tp_l2.tsv", "--fp", f"{d}/fp_l2.tsv", "--group-by",
                     "bam_source_id", "--feature-file", f"{d}/f.csv", "--n-boot", "20", "--out-dir",
                     f"{d}/feat"]) == 0
    rows = table_lines(f"{d}/feat/tp_fp_feature_stats.csv")
    assert rows[0] == "group,feature,t_stat,p_val,p_boot,cohens_d,p_adj" and len(rows) == 5
    spread = table_lines(f"{d}/feat/feature_distribution.csv")
    assert spread[0].startswith("label,bam_source_id,feature,count,missing,mean") and len(spread) > 4
    assert table_lines(f"{d}/feat/feature_histograms.csv")[0] == "feature,label,bam_source_id,bin,left_edge,count"
    assert cli.main(["retention", "--tp", f"{d}/tp_l2.tsv", "--fp", f"{d}/fp_l2.tsv", "--out-dir",
                     f"{d}/keep2", "--min-reads", "0", "--min-cpg", "0"]) == 0


def test_table_reading(spark, tmp_path):
    path = tmp_path / "s.tsv"
    names = [*CONTRAST_KEY, "normal", "tumor", "delta", "note"]
    path.write_text("\t".join(names) + "\nchr1\t5\tSNV\tv\tref\t1\t0.5\tNaN\tx\thello\n")
    row = tables.read_summary(spark, str(path)).first()
    assert row["haplotype_tag"] == "1" and row["normal"] == 0.5 and row["tumor"] is None
    assert row["delta"] is None and row["note"] == "hello" and row["somatic_pos"] == 5
    wide = tables.read_feature_table(spark, str(path))
    assert dict(wide.dtypes)["haplotype_tag"] == "string"
    assert tables.numeric_columns(wide) == ["somatic_pos", "normal", "tumor"]


def test_duplicates_leave_each_set(spark):
    rows = site_rows(spark, {}, {}, dict(methyl_pos=2))
    assert C.distinct_labelled(rows, rows.where("methyl_pos = 2")).count() == 3
    assert SITE["methyl_pos"] == 100
