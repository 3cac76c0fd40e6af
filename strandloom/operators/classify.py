"""How well the features separate TP from FP: imputation, scaling, split, model, scores."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from strandloom.functions.numeric import ratio
from strandloom.operators.quantiles import feature_quantiles, order_statistics, running_totals
from strandloom.session import materialize

TEST_SHARE = 0.3
SPLIT_SEED = 42


def impute_medians(df: DataFrame, features: list[str]) -> DataFrame:
    """Fill missing values with the exact median of the feature, over both labels."""
    medians = {
        r["feature"]: r["median"]
        for r in feature_quantiles(df, [], features, {"median": 0.5}).collect()
    }
    return df.withColumns({
        f: F.coalesce(F.col(f).cast("double"), F.lit(medians.get(f)).cast("double"))
        for f in features
    })


def standardize(df: DataFrame, features: list[str]) -> DataFrame:
    """Centre and divide by the population deviation over all rows; constants become 0."""
    row = df.agg(*[
        make(f).alias(f"{f}__{name}")
        for f in features for name, make in (("mean", F.avg), ("sd", F.stddev_pop))
    ]).first()
    scaled = {}
    for f in features:
        mean, sd = row[f"{f}__mean"], row[f"{f}__sd"]
        scaled[f] = (F.col(f) - F.lit(mean)) / F.lit(sd if sd else 1.0)
    return df.withColumns(scaled)


def split_sizes(counts: dict[str, int], test_share: float = TEST_SHARE) -> dict[str, int]:
    """Test rows per label: the rounded-up share of all rows, divided in proportion."""
    total = sum(counts.values())
    test = math.ceil(total * test_share)
    exact = {label: n * test / total for label, n in counts.items()}
    sizes = {label: math.floor(x) for label, x in exact.items()}
    by_rest = sorted(counts, key=lambda label: (sizes[label] - exact[label], label))
    for label in by_rest[: test - sum(sizes.values())]:
        sizes[label] += 1
    return sizes


def stratified_split(
    df: DataFrame, key: list[str], test_share: float = TEST_SHARE, seed: int = SPLIT_SEED
) -> DataFrame:
    """Adds ``is_test``: per label, the rows with the smallest seeded key hashes.

    The hash is the first 60 bits of the MD5 of seed and keys, which any SQL can state. The cut is an exact
    order statistic of the hash, so no label is sorted on one task.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    hashed = df.withColumn("_hash", F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"))
    counts = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    sizes = split_sizes(counts, test_share)
    wanted = F.coalesce(*[F.when(F.col("label") == k, F.lit(n)) for k, n in sizes.items()])
    cuts = order_statistics(
        hashed, ["label"], "_hash", {"cut": (test_share, lambda n: wanted - 1)}
    ).select("label", F.when(wanted > 0, F.col("cut_low")).alias("_cut"))
    return (
        hashed.join(F.broadcast(cuts), "label")
        .withColumn("is_test", F.coalesce(F.col("_hash") <= F.col("_cut"), F.lit(False)))
        .drop("_hash", "_cut")
    )


@dataclass(frozen=True)
class Model:
    """Linear model on standardized features."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def margin(self) -> Column:
        margin = F.lit(self.intercept)
        for name, weight in zip(self.features, self.coefficients):
            margin = margin + F.lit(weight) * F.col(name)
        return margin

    def probability(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))


NEWTON_STEPS = 100
GRADIENT_LIMIT = 1e-10


def _loss_sums(rows: DataFrame, x: list[str], model: Model) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted loss, gradient and Gram matrix at ``model``, summed in one aggregate over ``rows``."""
    margin = model.margin()
    z = F.when(F.col("_y") == 1, -margin).otherwise(margin)
    placed = rows.select(
        *x, "_w", model.probability().alias("_p"), "_y",
        (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))).alias("_loss"))
    slope, bend = F.col("_w") * (F.col("_p") - F.col("_y")), F.col("_w") * F.col("_p") * (1 - F.col("_p"))
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    row = placed.agg(
        F.sum(F.col("_w") * F.col("_loss")), *[F.sum(slope * F.col(c)) for c in x],
        *[F.sum(bend * F.col(x[i]) * F.col(x[j])) for i, j in pairs],
    ).first()
    gram = np.zeros((len(x), len(x)))
    for (i, j), value in zip(pairs, row[1 + len(x):]):
        gram[i, j] = gram[j, i] = value
    return row[0], np.array(row[1 : 1 + len(x)], dtype=float), gram


def fit_balanced_logistic(train: DataFrame, features: list[str], c: float = 1.0) -> Model:
    """L2 logistic regression with labels weighted to equal totals, at inverse strength ``c``.

    Newton's method: each step is one aggregate over the rows (loss, gradient and weighted Gram matrix, whose
    size depends on the features alone), halved where the loss would grow. The intercept is not
    penalized. Rows of two labels and features without missing values are required.
    """
    seen = train.groupBy("label").agg(
        F.count("*").alias("count"),
        F.count_if(F.array_contains(F.array(*[F.col(f).isNull() for f in features]), True)).alias("missing"))
    counts, missing = {}, 0
    for r in seen.collect():
        counts[r["label"]] = r["count"]
        missing += r["missing"]
    if len(counts) != 2 or missing:
        raise ValueError(f"two labels and no missing values needed, not {counts} with {missing} missing")
    total = sum(counts.values())
    weight = F.coalesce(*[
        F.when(F.col("label") == label, F.lit(total / (len(counts) * n))) for label, n in counts.items()
    ])
    rows = train.select(
        *[F.col(f).cast("double").alias(f) for f in features], F.lit(1.0).alias("_one"),
        (F.col("label") == "TP").cast("double").alias("_y"), weight.alias("_w"),
    )
    x = [*features, "_one"]
    ridge = np.array([1.0 / c] * len(features) + [0.0])
    model_of = lambda v: Model(tuple(features), tuple(float(b) for b in v[:-1]), float(v[-1]))
    best, at, step = math.inf, np.zeros(len(x)), np.zeros(len(x))
    for _ in range(NEWTON_STEPS):
        loss, gradient, gram = _loss_sums(rows, x, model_of(at - step))
        loss += float(ridge @ (at - step) ** 2) / 2
        if not loss <= best * (1 + 1e-12):
            step = step / 2
            continue
        best, at = loss, at - step
        gradient = gradient + ridge * at
        if np.abs(gradient).max() <= GRADIENT_LIMIT * total:
            break
        step = np.linalg.solve(gram + np.diag(ridge), gradient)
    return model_of(at)


def coefficients(df: DataFrame, model: Model) -> DataFrame:
    """Feature weights, largest absolute value first."""
    table = df.sparkSession.createDataFrame(
        list(zip(model.features, model.coefficients)), "feature string, coef double"
    )
    return table.orderBy(F.abs("coef").desc())


def roc_points(scored: DataFrame, score: str = "score", is_positive: Column | None = None) -> DataFrame:
    """ROC curve: per distinct score, the rates of rows scored at or above it.

    Rows are counted per score first, and the counts written. The curve starts at (0, 0) with a NULL
    threshold.
    """
    positive = F.col("label") == "TP" if is_positive is None else is_positive
    counted = materialize(
        scored.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(
            F.count_if(positive).alias("tp"), F.count_if(~positive).alias("fp")
        ), "score-counts",
    )
    p, n = counted.agg(F.sum("tp"), F.sum("fp")).first()
    curve = running_totals(counted, "threshold", ["tp", "fp"]).select(
        F.col("threshold").cast("double").alias("threshold"),
        "tp", "fp", "cum_tp", "cum_fp",
        ratio(F.col("cum_fp"), F.lit(n).cast("long")).alias("fpr"),
        ratio(F.col("cum_tp"), F.lit(p).cast("long")).alias("tpr"),
    )
    start = scored.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"),
        *[F.lit(0).cast("long").alias(c) for c in ("tp", "fp", "cum_tp", "cum_fp")],
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
    )
    return curve.unionByName(start)


def area_under_curve(curve: DataFrame) -> DataFrame:
    """Trapezoid area from the counts of the curve; ties between labels count half."""
    return curve.agg(
        ratio(
            F.sum(F.col("fp") * (F.col("cum_tp") - F.col("tp") / 2)),
            F.max("cum_tp").cast("double") * F.max("cum_fp"),
        ).alias("auc")
    )


def prediction_metrics(scored: DataFrame, score: str = "score", cut: float = 0.5) -> DataFrame:
    """Accuracy, confusion counts, precision, recall, F1 and support per class, and their averages:
    macro, and weighted by support."""
    positive, called = F.col("label") == "TP", F.col(score) > F.lit(cut)
    counts = scored.agg(
        F.count_if(positive & called).alias("tp"), F.count_if(~positive & called).alias("fp"),
        F.count_if(positive & ~called).alias("fn"), F.count_if(~positive & ~called).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    per_class = counts.select(
        tp, fp, fn, tn,
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        *[
            metric.alias(f"{name}_{side}")
            for side, hit, wrong, missed in (("TP", tp, fp, fn), ("FP", tn, fn, fp))
            for name, metric in (
                ("precision", zero(ratio(hit, hit + wrong))),
                ("recall", zero(ratio(hit, hit + missed))),
                ("f1", zero(ratio(2 * hit, 2 * hit + wrong + missed))),
                ("support", hit + missed),
            )
        ],
    )
    first, second = F.col("support_TP"), F.col("support_FP")
    return per_class.select("*", *[
        average.alias(f"{name}_{kind}")
        for name in ("precision", "recall", "f1")
        for a, b in ((F.col(f"{name}_TP"), F.col(f"{name}_FP")),)
        for kind, average in (
            ("macro", (a + b) / 2), ("weighted", ratio(a * first + b * second, first + second)),
        )
    ])


@dataclass(frozen=True)
class Evaluation:
    model: Model
    scored: DataFrame
    metrics: DataFrame
    roc: DataFrame
    coefficients: DataFrame


def evaluate(df: DataFrame, features: list[str], key: list[str]) -> Evaluation:
    """Impute, scale, split, fit and score the held-out rows.

    ``df`` is passed over several times and should be a stored table.
    """
    columns = [*key, *[c for c in ("label", *features) if c not in key], "is_test"]
    prepared = standardize(impute_medians(df, features), features)
    table = materialize(stratified_split(prepared, key).select(*columns), "classifier-rows")
    model = fit_balanced_logistic(table.where(~F.col("is_test")), features)
    scored = table.where("is_test").withColumn("score", model.probability())
    roc = roc_points(scored)
    auc = area_under_curve(roc).scalar()
    metrics = prediction_metrics(scored).withColumn("auc", auc)
    return Evaluation(model, scored, metrics, roc, coefficients(df, model))
