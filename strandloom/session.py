"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Tables written inside each open ``scratch`` block.
_SCRATCH: list[list[tuple[SparkSession, str]]] = []


def build_session(app: str = "strandloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution and skew handling on; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    ship_package()
    return builder.getOrCreate()


def ship_package() -> None:
    """Send the package's functions to workers by value: they may not find it on their path."""
    cloudpickle.register_pickle_by_value(sys.modules["strandloom"])


def work_folder(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as named by the cluster.

    Only a local master may fall back to a temporary folder: on a cluster such a folder would
    live on one machine and be lost with it.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="strandloom-")
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


@contextmanager
def scratch() -> Iterator[None]:
    """Delete the tables that ``materialize`` writes inside, at the end and also after an error.

    For runs whose results are files: nothing that leaves the block may still read those tables.
    """
    _SCRATCH.append([])
    try:
        yield
    finally:
        for spark, path in _SCRATCH.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Later passes then read pruned columns from storage instead of repeating the work that
    produced ``df``, and a lost executor costs a re-read, not a recomputation. See ``scratch``.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append((spark, path))
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
