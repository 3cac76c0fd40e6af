"""Comparison of features between the labels TP and FP."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as Y

from strandloom.functions import numeric as N
from strandloom.operators.balance import attach_by_key
from strandloom.operators.describe import unpivoted, wide_aggregate
from strandloom.operators.quantiles import running_totals
from strandloom.session import materialize


def label_moments(df: DataFrame, features: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean, variance and count of each feature on both sides, in one pass."""
    side = lambda c, label: F.when(F.col("label") == label, c)
    return wide_aggregate(df, by or [], features, {
        "tp_mean": lambda c: F.avg(side(c, "TP")),
        "tp_var": lambda c: F.var_samp(side(c, "TP")),
        "tp_n": lambda c: F.count(side(c, "TP")),
        "fp_mean": lambda c: F.avg(side(c, "FP")),
        "fp_var": lambda c: F.var_samp(side(c, "FP")),
        "fp_n": lambda c: F.count(side(c, "FP")),
    })


def _sides() -> tuple[Column, ...]:
    return tuple(F.col(c) for c in ("tp_mean", "tp_var", "tp_n", "fp_mean", "fp_var", "fp_n"))


def with_welch(moments: DataFrame) -> DataFrame:
    m1, v1, n1, m2, v2, n2 = _sides()
    return moments.withColumn("t_stat", N.welch_t(m1, v1, n1, m2, v2, n2)).withColumn(
        "t_df", N.welch_df(v1, n1, v2, n2)
    )


def with_effect_sizes(moments: DataFrame) -> DataFrame:
    m1, v1, n1, m2, v2, n2 = _sides()
    return moments.withColumn("d_simple", N.cohens_d_simple(m1, v1, m2, v2)).withColumn(
        "d_weighted", N.cohens_d_weighted(m1, v1, n1, m2, v2, n2)
    )


def stat_tests(df: DataFrame, features: list[str], alpha: float = 0.05) -> DataFrame:
    """Welch test and simple pooled effect size per feature."""
    tested = with_effect_sizes(with_welch(label_moments(df, features))).withColumn(
        "p_val", N.t_two_sided_p("t_stat", "t_df")
    )
    # Names of the result columns.
    return tested.select(
        "feature", F.col("tp_mean").alias("TP_mean"), F.col("fp_mean").alias("FP_mean"),
        "t_stat", "p_val", F.col("d_simple").alias("cohen_d"),
        F.coalesce(F.col("p_val") < F.lit(alpha), F.lit(False)).alias("significant"),
    )


def bonferroni(tests: DataFrame, p: str = "p_val") -> DataFrame:
    """Adds ``p_adj``: p times the number of result rows, at most 1."""
    number = tests.select(F.count("*")).scalar()
    return tests.withColumn("p_adj", F.least(F.col(p) * number, F.lit(1.0)))


def feature_tests(
    df: DataFrame,
    features: list[str],
    group_by: str | None = None,
    n_boot: int = 1000,
    seed: int = 0,
) -> DataFrame:
    """Welch, bootstrap and weighted effect size per group and feature, with adjusted p.

    Pairs with fewer than two values on a side are left out. Without grouping the group is ALL.
    """
    if group_by and group_by in df.columns:
        grouped = df.where(F.col(group_by).isNotNull()).withColumn(
            "group", F.col(group_by).cast("string")
        )
    else:
        grouped = df.withColumn("group", F.lit("ALL"))
    moments = label_moments(grouped, features, ["group"]).where(
        (F.col("tp_n") >= 2) & (F.col("fp_n") >= 2)
    )
    tested = with_effect_sizes(with_welch(moments)).withColumn(
        "p_val", N.t_two_sided_p("t_stat", "t_df")
    )
    boot = bootstrap_p(grouped, features, ["group"], n_boot, seed)
    result = tested.join(boot, ["group", "feature"], "left").select(
        "group", "feature", "t_stat", "p_val", "p_boot", F.col("d_weighted").alias("cohens_d")
    )
    return bonferroni(result)


# --- bootstrap ---------------------------------------------------------------------------------

VALUES_PER_PART = 131_072
FANOUT = 1024
CHUNK = 65_536  # draws of one stream
DRAWS_PER_TASK = 200_000_000
DRAWS_TOGETHER = 12_500_000  # draws of one node whose counts are put together before they shuffle
SLICES = 8  # groups that share the redraws of a full part
RUN = 65_536  # draws, ranges or rows that a worker has in hand
BITS = 0x7FFFFFFF
TOLERANCE = 1e-12  # of the largest absolute value: the gap and a redraw that equals it differ by rounding


def streams(nodes: DataFrame, level: int, one: Column, seed: int = 0) -> DataFrame:
    """Cut the ``number`` draws of each node into chunks, with two keys of 31 bits (``k1``, ``k2``) each.

    The keys come from the MD5 of the seed, the level, the node (``stream``, ``start``, ``side``, ``redraw``) and the
    chunk, so draws are a function of their counter and the same in each run of a task. A node with ``one`` has a
    single stream, of one step that counts for all its draws.
    """
    chunked = nodes.where(F.col("number") > 0).withColumn("one", one).withColumn("chunk", F.explode(
        F.sequence(F.lit(0).cast("long"), F.when(F.col("one"), F.lit(0)).otherwise(
            F.floor((F.col("number") - 1) / CHUNK)))
    ))
    text = F.concat_ws("|", F.lit(f"{seed}|{level}"), *[
        F.col(c).cast("string") for c in ("stream", "start", "side", "redraw", "chunk")])
    bits = lambda at: F.conv(F.substring("md5", at, 8), 16, 10).cast("long").bitwiseAND(BITS)
    rest = F.least(F.lit(CHUNK), F.col("number") - F.col("chunk") * CHUNK)
    return chunked.withColumn("md5", F.md5(text)).select(
        *nodes.columns, bits(1).alias("k1"), bits(9).alias("k2"),
        F.when(F.col("one"), F.lit(1)).otherwise(rest).cast("long").alias("steps"),
        F.when(F.col("one"), F.col("number")).otherwise(F.lit(1)).alias("times"),
    )


def _each(values: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The value of its chunk for each step; that of a single chunk serves all of them as it is."""
    return values if len(steps) == 1 else np.repeat(values, steps)


def _places(k1: np.ndarray, k2: np.ndarray, start: np.ndarray, stop: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Places of the steps of all chunks: the counter of a step is mixed with the two keys of its chunk.

    In 4 bytes without sign a product wraps, which leaves the 31 bits that are kept as they are.
    """
    short = lambda values: _each(values.astype(np.uint32), steps)
    bits = np.uint32(BITS)
    x = np.arange(steps.sum(), dtype=np.uint32)
    if len(steps) > 1:
        x -= short(np.cumsum(steps) - steps)
    x ^= short(k1)
    x *= np.uint32(0x7FEB352D)
    x &= bits
    x ^= x >> np.uint32(15)
    x += short(k2)
    x *= np.uint32(0x2C1B3C6D)
    x &= bits
    x ^= x >> np.uint32(13)
    x *= np.uint32(0x297A2D39)
    x &= bits
    x ^= x >> np.uint32(16)
    return _each(start, steps) + (x * _each((stop - start) / (BITS + 1.0), steps)).astype(np.int64)


def _arrays(chunks: pa.Table, *names: str) -> list[np.ndarray]:
    return [chunks.column(c).to_numpy() for c in names]


def _runs(chunks: pa.Table, weight: np.ndarray) -> Iterator[pa.Table]:
    """The chunks in turn, as many at a time as weigh about RUN."""
    before = np.cumsum(weight) - weight
    cuts = [0, *(np.flatnonzero(np.diff(before // RUN)) + 1), chunks.num_rows]
    for low, high in zip(cuts, cuts[1:]):
        yield chunks.slice(low, high - low)


def _ranges(chunks: pa.Table, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk, range of ``span`` places and number of draws there, for each range that a chunk draws from."""
    start, stop, steps, times = _arrays(chunks, "start", "stop", "steps", "times")
    low = start // span
    width = (stop - 1) // span - low + 1
    first = np.cumsum(width) - width
    drawn = np.bincount(
        _places(*_arrays(chunks, "k1", "k2"), start, stop, steps) // span + _each(first - low, steps))
    hit = np.flatnonzero(drawn)
    owner = np.searchsorted(first, hit, side="right") - 1
    return owner, hit - first[owner] + low[owner], drawn[hit] * times[owner]


def places(chunks: DataFrame, *kept: str, span: int | None = None) -> DataFrame:
    """The draws of the chunks, as rows that count ``times`` each.

    A row is a step and has its place from ``start`` up to ``stop`` as ``place0``. With a ``span`` it is a range of so
    many places that a chunk draws from, with the number of the range as ``place0``.
    """
    schema = Y.StructType([*[chunks.schema[c] for c in kept], *[
        Y.StructField(c, Y.LongType()) for c in ("times", "place0")]])

    def rows(run: pa.Table) -> pa.Table:
        if span is None:
            k1, k2, start, stop, steps, times = _arrays(run, "k1", "k2", "start", "stop", "steps", "times")
            owner, place = np.repeat(np.arange(len(steps)), steps), _places(k1, k2, start, stop, steps)
            number = times[owner]
        else:
            owner, place, number = _ranges(run, span)
        return run.select(list(kept)).take(owner).append_column("times", pa.array(number)).append_column(
            "place0", pa.array(place))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            start, stop, steps = _arrays(table, "start", "stop", "steps")
            ranges = (stop - 1) // span - start // span + 1 if span else 0
            for run in _runs(table, steps + ranges):
                held.append(rows(run))
                number += held[-1].num_rows
                if number >= RUN:
                    yield from pa.concat_tables(held).combine_chunks().to_batches()
                    held, number = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    return chunks.mapInArrow(drawn, schema)


def _sums(chunks: pa.Table, part: pa.Table) -> pa.Table:
    """The sum of the values that each chunk draws from a part, whose values come in order as one row.

    A part of a single value needs no draws. Chunks without a part, those of a group that is left out, give nothing.
    """
    sums = []
    values = pc.list_flatten(part.column("values")).to_numpy()
    if not len(values):
        chunks = chunks.slice(0, 0)
    for run in _runs(chunks, chunks.column("steps").to_numpy()) if chunks.num_rows else ():
        k1, k2, start, stop, steps = _arrays(run, "k1", "k2", "start", "stop", "steps")
        if values[0] == values[-1]:
            sums.append(steps * values[0])
            continue
        drawn = values[_places(k1, k2, start - start, stop - start, steps)]
        sums.append(np.add.reduceat(drawn, np.cumsum(steps) - steps))
    return chunks.select(["pool", "side", "redraw"]).append_column(
        "drawn", pa.array(np.concatenate(sums) if sums else [], pa.float64()))


def _values_by_part(ranked: DataFrame) -> DataFrame:
    """The values of each part in order, one entry per pooled row: at most VALUES_PER_PART entries."""
    start, stop = F.col("first"), F.col("first") + F.col("weight")
    part = lambda place: F.floor(place / VALUES_PER_PART)
    low = F.greatest(start, F.col("part") * VALUES_PER_PART)
    high = F.least(stop, (F.col("part") + 1) * VALUES_PER_PART)
    runs = ranked.withColumn("part", F.explode(F.sequence(part(start), part(stop - 1)))).select(
        "pool", "part", F.struct(low.alias("low"), "value", (high - low).cast("int").alias("rows")).alias("run"))
    return runs.groupBy("pool", "part").agg(F.sort_array(F.collect_list("run")).alias("runs")).select(
        "pool", "part", F.flatten(F.transform("runs", lambda r: F.array_repeat(r["value"], r["rows"]))).alias("values"))


def _slices(rows: Column) -> Column:
    """The number of groups that share the redraws of a part with so many pooled rows."""
    return F.ceil(rows * SLICES / VALUES_PER_PART)


def bootstrap_p(
    df: DataFrame, features: list[str], by: list[str], n_boot: int = 1000, seed: int = 0
) -> DataFrame:
    """Bootstrap p-value of the difference of means, per group and feature.

    Both sides are redrawn with replacement from the pooled values; the p-value is the share of
    redraws with a difference at least as large as the observed one. The pooled values have places in the
    order of their size. Draws pick places, in steps, so that no task holds a whole group: first how many
    fall to each of at most FANOUT ranges of places, then within each range, down to parts of
    VALUES_PER_PART places, and last the values within each part. Only counts of draws shuffle. Ranges
    of a single part, and parts of a single value, take all their draws at once. No join meets the counts of
    draws: they and the values of a part come together by their key alone.
    """
    key = [*by, "feature"]
    counted = materialize(unpivoted(df, [*by, "label"], features).groupBy(*key, "value").agg(
        F.count_if(F.col("label") == "TP").alias("tp"),
        F.count_if(F.col("label") == "FP").alias("fp"),
    ).select(
        *key, "value", "tp", "fp", (F.col("tp") + F.col("fp")).alias("weight"),
        F.struct(*key, "value").alias("order"),
    ).where(F.col("weight") > 0), "value-counts")
    placed = running_totals(counted, "order", ["weight"], descending=False).drop("order")
    rows = F.col("tp_n") + F.col("fp_n")
    name = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key]))
    groups = materialize(
        placed.groupBy(*key).agg(
            F.min(F.col("cum_weight") - F.col("weight")).alias("base"),
            F.sum("tp").alias("tp_n"), F.sum("fp").alias("fp_n"),
            F.sum(F.col("value") * F.col("tp")).alias("tp_sum"),
            F.sum(F.col("value") * F.col("fp")).alias("fp_sum"),
            F.max(F.abs("value")).alias("scale"),
        )
        .where((F.col("tp_n") >= 2) & (F.col("fp_n") >= 2))
        .select(
            *key, "base", "tp_n", "fp_n", rows.alias("rows"),
            F.monotonically_increasing_id().alias("pool"),
            F.conv(F.substring(name, 1, 15), 16, 10).cast("long").alias("stream"),
            (F.abs(F.col("tp_sum") / F.col("tp_n") - F.col("fp_sum") / F.col("fp_n"))
             - TOLERANCE * F.col("scale")).alias("gap"),
        ), "value-groups",
    )
    most, total = groups.agg(F.coalesce(F.max("rows"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-total * n_boot // DRAWS_PER_TASK))
    spans = [VALUES_PER_PART]
    while spans[-1] * FANOUT < most:
        spans.append(spans[-1] * FANOUT)

    nodes = groups.select(
        "pool", "stream", "rows", F.lit(0).cast("long").alias("start"), F.col("rows").alias("stop"),
        F.posexplode(F.array("tp_n", "fp_n")).alias("side", "number"),
    ).withColumn("redraw", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    node = ["pool", "side", "redraw"]
    for span in reversed(spans):
        within = F.floor(F.col("start") / span) == F.floor((F.col("stop") - 1) / span)
        # An explicit number of tasks: the chunks are few and small, but each stands for many draws. Those of one
        # node lie together, so that its counts are added up before they shuffle; a large node is dealt out by k1.
        share = F.col("k1") % F.ceil(F.col("number") / DRAWS_TOGETHER)
        chunks = streams(nodes, span, within, seed).repartition(tasks, *node, share)
        nodes = (
            places(chunks, *node, "stream", "rows", span=span)
            .groupBy(*node, F.col("place0").alias("part"))
            .agg(F.sum("times").alias("number"), F.max("stream").alias("stream"), F.max("rows").alias("rows"))
            .withColumns({
                "start": F.col("part") * span, "stop": F.least("rows", (F.col("part") + 1) * span),
            })
        )
    ranked = attach_by_key(placed, groups.select(*key, "pool", "rows", "base"), key, "rows", ["value"]).where(
        F.col("base").isNotNull()
    ).withColumn("first", F.col("cum_weight") - F.col("weight") - F.col("base"))
    place = ["pool", "part", "slice"]
    # A node tells the size of its part itself. A join would be planned by the few groups that the nodes, a row for
    # each part and redraw, stem from, and would gather them on the driver to broadcast them.
    chunks = streams(nodes, 1, F.lit(False), seed).withColumn(
        "slice", F.col("redraw") % _slices(F.col("stop") - F.col("start"))).repartition(tasks, *place)
    copies = _values_by_part(ranked).withColumn("slice", F.explode(
        F.sequence(F.lit(0).cast("long"), _slices(F.size("values")) - 1))).repartition(tasks, *place)
    drawn = chunks.groupBy(*place).cogroup(copies.groupBy(*place)).applyInArrow(
        _sums, Y.StructType([*[chunks.schema[c] for c in node], Y.StructField("drawn", Y.DoubleType())]))
    sums = drawn.groupBy(*node).agg(F.sum("drawn").alias("drawn"))
    redraws = sums.groupBy("pool", "redraw").agg(*[
        F.sum(F.when(F.col("side") == i, F.col("drawn"))).alias(side) for i, side in enumerate(("tp", "fp"))])
    return (
        redraws.join(groups, "pool")
        .groupBy(*key)
        .agg((F.count_if(
            F.abs(F.col("tp") / F.col("tp_n") - F.col("fp") / F.col("fp_n")) >= F.col("gap")
        ) / F.lit(n_boot)).alias("p_boot"))
    )
