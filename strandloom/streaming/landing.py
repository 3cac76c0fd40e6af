"""Level 1 files arriving over time.

Site rows have no event time and their groups never close, so a stream only types and stores new
files; the summaries are batch jobs over the stored table and always see whole groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from strandloom.schema import SITES


def site_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """New Level 1 files below ``folder`` (plain or gzip) as a stream of site rows."""
    reader = (
        spark.readStream.schema(SITES).option("sep", "\t").option("header", True)
        .option("recursiveFileLookup", True)
    )
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.csv(folder)
    return rows.withColumn("meth_call", F.when(~F.isnan("meth_call"), F.col("meth_call")))


def land_sites(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append the stream to a Parquet table split by VCF; ends when no file is left."""
    return (
        stream.writeStream.format("parquet").partitionBy("vcf_source_id")
        .option("path", table).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
