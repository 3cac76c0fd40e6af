"""Joins that stay balanced when a few keys own most of the rows.

Everything broadcast here has a bound that does not grow with the data: either a fixed number of
rows, or a table whose size was counted first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandloom.session import materialize

# Rows of one key that a task of a shuffled join may hold. Where that would make more than MOST_HEAVY
# keys heavy, the number is raised to the share of the rows that at most so many keys can exceed.
HEAVY_ROWS = 1_000_000
MOST_HEAVY = 100_000
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 128 * 1024 * 1024


def fits_broadcast(df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> bool:
    """Count ``df``, reading at most one row past the limit, and measure its text columns."""
    max_rows = BROADCAST_ROWS if max_rows is None else max_rows
    max_bytes = BROADCAST_BYTES if max_bytes is None else max_bytes
    text = [c for c, kind in df.dtypes if kind in ("string", "binary")]
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in text), F.lit(16 * len(df.columns)))
    rows, size = (
        df.limit(max_rows + 1)
        .agg(F.count("*"), F.coalesce(F.sum(width.cast("long")), F.lit(0)))
        .first()
    )
    return rows <= max_rows and size <= max_bytes


def attach_by_key(
    left: DataFrame, attributes: DataFrame, on: list[str], weight: str, spread_by: list[str]
) -> DataFrame:
    """Left join ``attributes`` (one row per key) to ``left``, whatever the key frequencies.

    ``attributes`` is written once, since it usually is an aggregate of ``left``. If its counted
    size allows, it is broadcast and ``left`` is not shuffled at all.

    Otherwise ``weight``, the number of ``left`` rows a key owns, decides. All keys above the number
    of rows that a task may hold are joined by broadcast. Their rows then pass the shuffled join under a
    spread key with one part for each such number of rows, so they land on many tasks instead of one.
    """
    attributes = materialize(attributes, "attributes")
    if fits_broadcast(attributes):
        return left.join(F.broadcast(attributes), on, "left").select(
            *left.columns, *[c for c in attributes.columns if c not in on]
        )
    payload = [c for c in attributes.columns if c not in on]
    # Always 0, but not a constant to the optimizer: a constant would leave the join key.
    own_part = F.when(F.col(weight) < 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
    packed = attributes.select(*on, own_part.alias("_part"), F.struct(*payload).alias("_payload"))
    total = attributes.agg(F.sum(weight)).first()[0] or 0
    most = max(HEAVY_ROWS, total // MOST_HEAVY)
    heavy = attributes.where(F.col(weight) > most).select(
        *on, F.struct(*payload).alias("_heavy"), F.ceil(F.col(weight) / most).alias("_parts")
    )
    tagged = left.join(F.broadcast(heavy), on, "left").withColumn(
        "_part",
        F.when(F.col("_heavy").isNull(), F.lit(0).cast("long"))
        .otherwise(F.pmod(F.xxhash64(*spread_by), F.col("_parts")) + 1),
    )
    joined = tagged.join(packed, [*on, "_part"], "left")
    found = F.coalesce("_heavy", "_payload")
    return joined.select(
        *[joined[c] for c in left.columns], *[found[c].alias(c) for c in payload]
    )


def semi_join(left: DataFrame, keys: DataFrame, on: list[str], spread_by: list[str]) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``keys``; balanced for frequent keys.

    A key list of counted, small size is broadcast. A larger one is matched once per distinct key
    of ``left``, after which only the verdict travels to the rows.
    """
    keys = keys.select(*on).distinct()
    if fits_broadcast(keys):
        return left.join(F.broadcast(keys), on, "left_semi")
    verdict = left.groupBy(*on).agg(F.count("*").alias("_rows")).join(keys, on, "left_semi")
    return (
        attach_by_key(left, verdict, on, "_rows", spread_by)
        .where(F.col("_rows").isNotNull()).drop("_rows")
    )


def spread_bins(
    many: DataFrame, few: DataFrame, on: list[str], hot_rows: int, spread_by: list[Column]
) -> tuple[DataFrame, DataFrame]:
    """Split hot join keys: ``many`` is spread over parts, ``few`` is copied to each part.

    A key is hot when ``many`` has more than ``hot_rows`` rows of it, and gets one part for each
    ``hot_rows`` rows. All hot keys are split, however many there are: their table is written and
    counted, and only a small one is broadcast. Both results carry a ``_part`` column that belongs
    to the join key.
    """
    hot = materialize(
        many.groupBy(*on).agg(F.count("*").alias("_rows")).where(F.col("_rows") > hot_rows)
        .select(*on, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_parts")), "hot-keys",
    )
    if hot.count() <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    parts = F.coalesce("_parts", F.lit(1))
    spread = many.join(hot, on, "left").withColumn(
        "_part", F.pmod(F.xxhash64(*spread_by), parts).cast("int")
    ).drop("_parts")
    copied = few.join(hot, on, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), parts - 1))
    ).drop("_parts")
    return spread, copied
