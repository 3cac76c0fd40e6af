"""Result tables (TSV) and feature lists read back for the comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from strandloom.schema import CONTRAST_KEY, SITES, SUMMARY

CONTRAST_SUMMARY = T.StructType(
    [f for f in SUMMARY.fields if f.name in CONTRAST_KEY]
    + [T.StructField(c, T.DoubleType()) for c in ("normal", "tumor", "delta")]
)


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("sep", "\t").option("header", True).csv(path).columns


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tab-separated table with a header, plain or gzip, typed by column name.

    Columns that the schema does not know stay text if absent from it and are kept; columns that
    the file lacks are not invented. Text that is not a number becomes NULL, and so does NaN.
    """
    known = {f.name: f.dataType for f in schema.fields}
    names = _header(spark, path)
    as_read = T.StructType([T.StructField(n, known.get(n, T.StringType())) for n in names])
    table = (
        spark.read.schema(as_read).option("sep", "\t").option("header", True)
        .option("nullValue", "NA").option("mode", "PERMISSIVE").csv(path)
    )
    floats = [f.name for f in as_read if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return table.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Level 1 table."""
    return read_table(spark, path, SITES)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Level 2 table, or one that already holds normal, tumor and delta."""
    return read_table(
        spark, path,
        T.StructType(SUMMARY.fields + [f for f in CONTRAST_SUMMARY if f.name not in SUMMARY.names]),
    )


def read_feature_table(spark: SparkSession, path: str) -> DataFrame:
    """Any tab-separated table, with inferred types; haplotype labels stay text."""
    table = spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(path)
    if "haplotype_tag" in table.columns:
        table = table.withColumn("haplotype_tag", F.col("haplotype_tag").cast("string"))
    return table


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def read_feature_list(spark: SparkSession, path: str) -> list[str]:
    """First column of a headerless list of feature names."""
    rows = spark.read.csv(path).select(F.trim("_c0").alias("name")).where("name != ''")
    return [r["name"] for r in rows.collect()]
