"""A reads table in the order of the genome, of which a run reads the parts around its variants only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandloom.operators.reads import with_span
from strandloom.schema import READS
from strandloom.sources.bam import TILE_BITS, Tiles

#: Rows are pruned in groups of about so many bytes.
ROW_GROUP_BYTES = 8 * 1024 * 1024
#: Runs of tiles that a scan is asked for; more are put together across the smallest gaps.
MOST_RUNS = 200


def write_reads_table(
    reads: DataFrame, path: str, mode: str = "errorifexists", row_group_bytes: int = ROW_GROUP_BYTES
) -> None:
    """Write reads clustered by chromosome and start, with their spans (``start0``, ``end0``).

    Every file, row group and page covers a stretch of the genome, which its statistics state. Reads that
    share a start are spread by name, so no file grows with the depth of one place.
    """
    place = ["rname", "start0", F.xxhash64("qname")]
    with_span(reads).repartitionByRange(*place).sortWithinPartitions(*place).write.option(
        "parquet.block.size", str(row_group_bytes)).mode(mode).parquet(path)


def merged_runs(tiles: Tiles, most: int = MOST_RUNS) -> Tiles:
    """At most ``most`` runs (or one per chromosome) that cover all of ``tiles``, across the smallest gaps."""
    gaps = sorted(
        (b[0] - a[1], name, i) for name, runs in tiles.items() for i, (a, b) in enumerate(zip(runs, runs[1:])))
    surplus = max(0, sum(map(len, tiles.values())) - most)
    closed = {(name, i) for _, name, i in gaps[:surplus]}
    merged: Tiles = {}
    for name, runs in tiles.items():
        found: list[tuple[int, int]] = []
        for i, (first, last) in enumerate(runs):
            if found and (name, i - 1) in closed:
                found[-1] = (found[-1][0], last)
            else:
                found.append((first, last))
        merged[name] = found
    return merged


def overlaps(tiles: Tiles, bits: int = TILE_BITS) -> Column:
    """Condition on ``rname``, ``start0`` and ``end0`` that a scan can answer from statistics."""
    terms = [
        (F.col("rname") == name) & (F.col("start0") < ((last + 1) << bits)) & (F.col("end0") > (first << bits))
        for name, runs in merged_runs(tiles).items() for first, last in runs
    ]
    while len(terms) > 1:  # a balanced tree: long chains are slow to plan
        terms = [reduce(lambda a, b: a | b, terms[i:i + 2]) for i in range(0, len(terms), 2)]
    return terms[0] if terms else F.lit(False)


def read_reads_table(spark: SparkSession, *paths: str, tiles: Tiles | None = None) -> DataFrame:
    """Reads of Parquet tables; with ``tiles``, of a clustered one only the parts that may overlap them."""
    if tiles is not None and {"start0", "end0"} <= set(spark.read.parquet(*paths).columns):
        schema = with_span(spark.createDataFrame([], READS)).schema
        near = spark.read.schema(schema).parquet(*paths).where(overlaps(tiles))
        return near.select(*READS.names)
    return spark.read.schema(READS).parquet(*paths)
