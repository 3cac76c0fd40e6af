"""Alignment text (SAM) as a reads table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandloom.schema import READS


def _tag(prefix: str) -> Column:
    """Text after ``XX:T:`` of the first tag with this prefix, NULL without one."""
    found = F.get(F.filter("tags", lambda t: t.startswith(prefix)), F.lit(0))
    return F.regexp_extract(found, r"^[^:]*:[^:]*:(.*)$", 1)


def sam_reads(lines: DataFrame, sample: str | None = None) -> DataFrame:
    """Reads from lines (``value``, ``ord``); header lines are skipped.

    Modification tags are also read in their older lower-case spelling; ``legacy_mm`` marks those.
    """
    parsed = (
        lines.where(~F.col("value").startswith("@") & (F.col("value") != ""))
        .select("ord", F.split("value", "\t").alias("f"))
        .withColumn("tags", F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))))
    )
    ml = F.transform(
        F.filter(F.split(F.coalesce(_tag("ML:"), _tag("Ml:")), ","), lambda v: v.rlike(r"^\d+$")),
        lambda v: v.try_cast("int"),
    )
    field = lambda i: F.get("f", F.lit(i))
    hp = F.get(F.filter("tags", lambda t: t.startswith("HP:")), F.lit(0))
    values = {
        "bam_source_id": F.lit(sample).cast("string"),
        "ord": F.col("ord"),
        "qname": field(0),
        "flag": field(1).try_cast("int"),
        "rname": field(2),
        "pos": field(3).try_cast("int"),
        "mapq": field(4).try_cast("int"),
        "cigar": field(5),
        "seq": F.when(field(9) == "*", "").otherwise(field(9)),
        "mm": F.coalesce(_tag("MM:"), _tag("Mm:")),
        "ml": ml,
        "hp_type": F.substring(hp, 4, 1),
        "hp_value": _tag("HP:"),
        "orig_hp": F.coalesce(_tag("origHP:"), _tag("or:")),
        "ps": _tag("PS:"),
        "legacy_mm": _tag("MM:").isNull() & _tag("Mm:").isNotNull(),
    }
    return parsed.select(*[values[f.name].alias(f.name) for f in READS.fields])


def read_sam(spark: SparkSession, *paths: str, sample: str | None = None) -> DataFrame:
    """Records of SAM text files."""
    lines = spark.read.text(list(paths)).select(
        "value",
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("ord"),
    )
    return sam_reads(lines, sample)


def read_alignments(
    spark: SparkSession, *paths: str, sample: str | None = None,
    tiles: dict[str, list[tuple[int, int]]] | None = None, head: int | None = None,
) -> DataFrame:
    """Reads from SAM text, BAM or a Parquet reads table, by file name.

    ``tiles`` let indexed BAM files and clustered reads tables leave out reads elsewhere, ``head`` lets BAM
    files leave out those after the first; other files give all their reads.
    """
    from strandloom.sources.bam import read_bam
    from strandloom.sources.reads_table import read_reads_table

    if all(p.rstrip("/").endswith(".parquet") for p in paths):
        reads = read_reads_table(spark, *paths, tiles=tiles)
        return reads.withColumn("bam_source_id", F.lit(sample)) if sample else reads
    if all(p.endswith(".bam") for p in paths):
        return read_bam(spark, *paths, sample=sample, tiles=tiles, head=head)
    return read_sam(spark, *paths, sample=sample)
