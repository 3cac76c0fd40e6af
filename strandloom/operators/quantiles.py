"""Exact order statistics and running totals without gathering a group on one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.operators.balance import attach_by_key
from strandloom.session import materialize

ACCURACY = 10000
BUCKET_ROWS = 1_000_000


def order_statistics(
    df: DataFrame,
    by: list[str],
    value: str,
    ranks: dict[str, tuple[float, Callable[[Column], Column]]],
) -> DataFrame:
    """Exact values at given ranks per group: columns ``n`` and, per name, ``_low`` and ``_high``.

    ``ranks`` maps a name to a fraction and a function of the group size that gives the 0-based
    rank; the rank must be within two of fraction * n. ``_high`` is the value one rank up.

    A sketch first brackets every rank. Rows below a bracket are only counted, rows inside it are
    counted per distinct value, and both counts are combined before the shuffle. What is then
    sorted per group is the inside of a bracket: a share of at most a few in ACCURACY of the
    group, with copies of one value folded into one row.

    ``by`` must name at least one column. The brackets, one row per group, are broadcast if their counted size
    allows; otherwise rows meet them by key, and those of a large group on many tasks.
    """
    rows = df.select(*by, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    margin = 4.0 / ACCURACY
    names = list(ranks)
    fractions = []
    for name in names:
        fraction = ranks[name][0]
        fractions += [max(fraction - margin, 0.0), min(fraction + margin, 1.0)]
    sketch = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", fractions, ACCURACY).alias("_q"),
    )
    small = F.col("n") <= ACCURACY
    brackets = sketch.select(*by, "n", F.array(*[
        F.struct(
            F.lit(name).alias("_name"),
            F.greatest(F.least(ranks[name][1](F.col("n")), F.col("n") - 1), F.lit(0))
            .cast("long").alias("_rank"),
            F.when(small | F.lit(fractions[2 * i] <= 0.0), F.col("_min"))
            .otherwise(F.col("_q")[2 * i]).alias("_from"),
            F.when(small | F.lit(fractions[2 * i + 1] >= 1.0), F.col("_max"))
            .otherwise(F.col("_q")[2 * i + 1]).alias("_to"),
        )
        for i, name in enumerate(names)
    ]).alias("_brackets"))
    joined = attach_by_key(rows, brackets, by, "n", ["_v"]).where(F.col("n").isNotNull()).select(
        *by, "n", "_v", F.inline(F.filter("_brackets", lambda b: F.col("_v") <= b["_to"])))
    inside = F.when(F.col("_v") >= F.col("_from"), F.col("_v"))
    counted = (
        joined.groupBy(*by, "_name", inside.alias("_v"))
        .agg(F.count("*").alias("_count"), F.first("n").alias("n"), F.first("_rank").alias("_rank"))
    )
    so_far = F.sum("_count").over(
        Window.partitionBy(*by, "_name").orderBy(F.col("_v").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = counted.withColumn("_upto", so_far)
    last = F.least(F.col("_rank") + 1, F.col("n") - 1)
    found = placed.groupBy(*by, "n", "_name").agg(
        F.min(F.when(F.col("_upto") > F.col("_rank"), F.col("_v"))).alias("_low"),
        F.min(F.when(F.col("_upto") > last, F.col("_v"))).alias("_high"),
    )
    pick = lambda name, column: F.max(F.when(F.col("_name") == name, F.col(column)))
    return found.groupBy(*by, "n").agg(*[
        pick(name, column).alias(f"{name}{column}")
        for name in names for column in ("_low", "_high")
    ])


def exact_quantiles(
    df: DataFrame, by: list[str], value: str, quantiles: dict[str, float]
) -> DataFrame:
    """Exact quantiles with linear interpolation between neighbours, one column per name."""
    def rank_of(q: float) -> Callable[[Column], Column]:
        return lambda n: F.floor((n - 1) * F.lit(q))

    stats = order_statistics(
        df, by, value, {name: (q, rank_of(q)) for name, q in quantiles.items()}
    )

    def between(name: str, q: float) -> Column:
        low, high = F.col(f"{name}_low").cast("double"), F.col(f"{name}_high").cast("double")
        share = (F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q))
        return (low + (high - low) * share).alias(name)

    return stats.select(*by, *[between(name, q) for name, q in quantiles.items()])


def feature_quantiles(
    df: DataFrame, by: list[str], features: list[str], quantiles: dict[str, float]
) -> DataFrame:
    """Exact quantiles of many features at once: a row per group and feature, a column per name.

    As ``exact_quantiles``, but rows stay wide: one aggregate sketches all features, one counts the values below
    every bracket, and only the values inside a bracket leave their row, to be counted per distinct value. A
    feature without values in a group has no row. ``by`` may be empty.
    """
    if not features:
        raise ValueError("no features")
    names, margin = list(quantiles), 4.0 / ACCURACY
    fractions = [f for q in quantiles.values() for f in (max(q - margin, 0.0), min(q + margin, 1.0))]
    keys = by or ["_all"]
    group = [F.col(c) for c in by] or [F.lit(0).alias("_all")]
    values = [f"_v{i}" for i in range(len(features))]
    wide = df.select(*group, *[F.col(f).cast("double").alias(v) for f, v in zip(features, values)])
    sketch = wide.groupBy(*keys).agg(F.count("*").alias("_rows"), *[
        make(v).alias(f"{v}_{name}") for v in values for name, make in (
            ("n", F.count), ("min", F.min), ("max", F.max),
            ("q", lambda c: F.percentile_approx(c, fractions, ACCURACY)))
    ])

    def bracket(v: str, k: int) -> Column:
        n, q, low, high = F.col(f"{v}_n"), quantiles[names[k]], fractions[2 * k], fractions[2 * k + 1]
        small = n <= ACCURACY
        return F.struct(
            F.greatest(F.floor((n - 1) * F.lit(q)), F.lit(0)).cast("long").alias("rank"), n.alias("n"),
            F.when(small | F.lit(low <= 0.0), F.col(f"{v}_min")).otherwise(F.col(f"{v}_q")[2 * k]).alias("low"),
            F.when(small | F.lit(high >= 1.0), F.col(f"{v}_max")).otherwise(F.col(f"{v}_q")[2 * k + 1]).alias("high"),
        )

    places = [(i, k) for i in range(len(features)) for k in range(len(names))]
    brackets = sketch.select(
        *keys, "_rows", *[bracket(values[i], k).alias(f"_b{i}_{k}") for i, k in places])
    joined = attach_by_key(wide, brackets, keys, "_rows", values).where(F.col("_rows").isNotNull())
    at = lambda i, k, part: F.col(f"_b{i}_{k}")[part]
    below = joined.groupBy(*keys).agg(*[
        F.struct(
            F.max(at(i, k, "n")).alias("_n"), F.max(at(i, k, "rank")).alias("_rank"),
            F.count_if(F.col(values[i]) < at(i, k, "low")).alias("_below"),
        ).alias(f"_b{i}_{k}") for i, k in places
    ]).select(*keys, F.inline(F.array(*[
        F.struct(F.lit(i).alias("_feature"), F.lit(k).alias("_name"), F.col(f"_b{i}_{k}").alias("_place"))
        for i, k in places
    ])))
    inside = joined.select(*keys, F.inline(F.filter(
        F.array(*[
            F.struct(F.lit(i).alias("_feature"), F.lit(k).alias("_name"), F.when(
                F.col(values[i]).between(at(i, k, "low"), at(i, k, "high")), F.col(values[i])).alias("_v"))
            for i, k in places
        ]), lambda x: x["_v"].isNotNull(),
    ))).groupBy(*keys, "_feature", "_name", "_v").agg(F.count("*").alias("_count"))
    place = [*keys, "_feature", "_name"]
    upto = F.col("_place._below") + F.sum("_count").over(
        Window.partitionBy(*place).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rank, last = F.col("_place._rank"), F.least(F.col("_place._rank") + 1, F.col("_place._n") - 1)
    found = inside.join(below, place).withColumn("_upto", upto).groupBy(*place).agg(
        F.min(F.when(F.col("_upto") > rank, F.col("_v"))).alias("_low"),
        F.min(F.when(F.col("_upto") > last, F.col("_v"))).alias("_high"),
        F.first("_place._n").alias("_n"),
    )

    def between(k: int) -> Column:
        pick = lambda c: F.max(F.when(F.col("_name") == k, F.col(c)))
        place = (F.max("_n") - 1) * F.lit(quantiles[names[k]])
        return (pick("_low") + (pick("_high") - pick("_low")) * (place - F.floor(place))).alias(names[k])

    title = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("_feature") + 1).alias("feature")
    wanted = found.groupBy(*keys, "_feature").agg(*[between(k) for k in range(len(names))])
    return wanted.select(*by, title, *names)


def running_totals(
    df: DataFrame, order: str, sums: list[str], descending: bool = True, buckets: int | None = None
) -> DataFrame:
    """Adds ``cum_<column>``: the sums over all rows up to and including each ``order`` value.

    ``order`` must be unique, and ``df`` a stored table. Rows are cut into ranges of about BUCKET_ROWS
    rows each and written with the number of their range. Ranges are summed, their running totals form
    a table of ``buckets`` rows, and rows are then accumulated within ranges.
    """
    if buckets is None:
        buckets = max(1, -(-df.count() // BUCKET_ROWS))
    rows = materialize(
        df.repartitionByRange(buckets, order).withColumn("_bucket", F.spark_partition_id()), "ranges"
    )
    direction = F.desc if descending else F.asc
    totals = rows.groupBy("_bucket").agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    # Partition-less window over ``buckets`` rows.
    before = Window.orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_bucket",
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums],
    )
    within = (
        Window.partitionBy("_bucket").orderBy(direction(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.join(F.broadcast(offsets), "_bucket")
        .withColumns({
            f"cum_{c}": F.col(f"_before_{c}") + F.sum(c).over(within) for c in sums
        })
        .select(*df.columns, *[f"cum_{c}" for c in sums])
    )
