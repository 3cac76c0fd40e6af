"""Descriptive tables of features by label, and the data behind the usual plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandloom.functions import numeric as N
from strandloom.operators.quantiles import feature_quantiles


def unpivoted(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """Long form (ids, feature, value) without missing values."""
    wide = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features])
    return wide.unpivot(ids, features, "feature", "value").where(F.col("value").isNotNull())


def wide_aggregate(
    df: DataFrame, by: list[str], features: list[str], stats: dict[str, callable]
) -> DataFrame:
    """Aggregate all features in one pass over the rows, then turn the result long.

    ``stats`` maps an output column to a function of a feature column. Only the aggregated rows
    are multiplied, never the input.
    """
    totals = df.groupBy(*by).agg(*[
        make(F.col(f).cast("double")).alias(f"{f}__{stat}")
        for f in features for stat, make in stats.items()
    ])
    return totals.select(*by, F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), *[F.col(f"{f}__{stat}").alias(stat) for stat in stats])
        for f in features
    ])))


MOMENTS = {
    "count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
}


def descriptive_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """count, mean, median, std, min and max per feature and label."""
    moments = wide_aggregate(df, ["label"], features, MOMENTS)
    medians = feature_quantiles(df, ["label"], features, {"median": 0.5})
    return moments.join(F.broadcast(medians), ["label", "feature"], "left").select(
        "feature", F.col("label").alias("group"), "count", "mean", "median", "std", "min", "max"
    )


def _few(df: DataFrame, by: list[str]) -> DataFrame:
    """Broadcast of a table with a row per label and feature; with further keys it has no bound."""
    return F.broadcast(df) if set(by) <= {"label"} else df


def describe(df: DataFrame, features: list[str], by: tuple[str, ...] = ("label",)) -> DataFrame:
    """count, missing, mean, std, min, quartiles and max per feature and label, or the keys ``by``."""
    stats = {**MOMENTS, "missing": lambda c: F.count_if(c.isNull())}
    keys = [*by]
    moments = wide_aggregate(df, keys, features, stats)
    quartiles = feature_quantiles(df, keys, features, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return moments.join(_few(quartiles, keys), [*keys, "feature"], "left").select(
        *keys, "feature", "count", "missing", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def correlation_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """Pearson correlation of each feature pair by label, over rows that have both values.

    All pairs come from one aggregation. A pair with a constant side gives NULL.
    """
    def pearson(a: str, b: str) -> Column:
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        return N.ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    sums = df.groupBy("label").agg(*[pearson(a, b).alias(f"{a}__{b}") for a, b in pairs])
    both_ways = [(a, b, f"{a}__{b}") for a, b in pairs]
    both_ways += [(b, a, f"{a}__{b}") for a, b in pairs if a != b]
    return sums.select("label", F.inline(F.array(*[
        F.struct(
            F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
            F.col(column).alias("correlation"),
        )
        for a, b, column in both_ways
    ])))


def histogram(
    df: DataFrame, features: list[str], bins: int, shared: bool = False, by: tuple[str, ...] = ("label",)
) -> DataFrame:
    """Equal-width histogram per feature and label, or the keys ``by``; ``shared`` uses one range for
    both labels.

    The last bin includes the maximum. Only bins with rows appear.
    """
    ranged = [c for c in by if not (shared and c == "label")]
    ranges = wide_aggregate(df, ranged, features, {"low": F.min, "high": F.max})
    rows = unpivoted(df, [*by], features)
    placed = rows.join(_few(ranges, ranged), [*ranged, "feature"])
    width = F.col("high") - F.col("low")
    place = F.floor((F.col("value") - F.col("low")) / width * bins)
    return (
        placed.withColumn(
            "bin", F.when(width > 0, F.least(place, F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
        )
        .groupBy("feature", *by, "bin", "low", "high").agg(F.count("*").alias("count"))
        .withColumn("left_edge", F.col("low") + width * F.col("bin") / bins)
        .select("feature", *by, "bin", "left_edge", "count")
    )
