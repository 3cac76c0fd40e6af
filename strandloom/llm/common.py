"""What the operators of this subpackage share: inputs, scratch tables, state of a worker."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.session import work_folder

#: White space between words; everything else belongs to a word.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: See ``attach``.
HEAVY_ROWS, MOST_HEAVY = 10_000, 100_000
#: Sorts after every other id: a document without an id is never the earlier one.
NO_ID = (1 << 63) - 1

# Scratch tables by owner and step; see ``scratch_of``.
_MADE: dict[tuple[str, int], list[tuple[SparkSession, str, str]]] = {}
_OWNER = [("", 0)]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def store(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; see ``scratch_of``."""
    path = f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _made(df.sparkSession, "path", path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` as a table bucketed by ``key``: later joins on it leave this side in place."""
    spark = df.sparkSession
    title = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).format("parquet").saveAsTable(title)
    _made(spark, "table", title)
    return spark.table(title)


def _made(spark: SparkSession, kind: str, what: str) -> None:
    _MADE.setdefault(_OWNER[-1], []).append((spark, kind, what))


@contextmanager
def scratch_of(owner: str, step: int = 0) -> Iterator[None]:
    """Scratch tables made inside belong to this step of ``owner``; those of its earlier steps are deleted first.

    For callers that write each result before they ask for the next step: results are lazy, so the tables
    behind one must stay until it is written. Those of the same step stay: its results may still be unread.
    """
    for done in [key for key in _MADE if key[0] == owner and key[1] < step]:
        for spark, kind, what in _MADE.pop(done):
            if kind == "table":
                spark.sql(f"DROP TABLE IF EXISTS {what}")
            else:
                path = spark._jvm.org.apache.hadoop.fs.Path(what)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _OWNER.append((owner, step))
    try:
        yield
    finally:
        _OWNER.pop()


def attach(
    rows: DataFrame, values: DataFrame, key: str, weight: str, by: str, how: str = "inner"
) -> DataFrame:
    """Join of ``values`` (stored; one row per key) to ``rows`` that no frequent key holds up.

    ``weight`` counts the rows of a key. A key with more than ``HEAVY_ROWS`` has one copy of its values for
    each such number of rows, and its rows spread over the copies by ``by``. The heavy keys are broadcast:
    at most ``MOST_HEAVY``, since beyond that the number rises to the share of the rows so few can exceed.
    Rows without a key are spread as well. The weight is dropped.
    """
    part, parts = free_name(rows, "_part"), free_name(rows, "_parts")
    most = max(HEAVY_ROWS, (values.agg(F.sum(weight)).first()[0] or 0) // MOST_HEAVY)
    heavy = F.broadcast(values.where(F.col(weight) > most).select(
        key, F.ceil(F.col(weight) / most).cast("long").alias(parts)))
    many = F.coalesce(parts, F.lit(1).cast("long"))
    copies = values.drop(weight).join(heavy, key, "left").withColumn(
        part, F.explode(F.sequence(F.lit(0).cast("long"), many - 1))).drop(parts)
    spread = F.xxhash64(by)
    tagged = rows.join(heavy, key, "left").withColumn(
        part, F.when(F.col(key).isNull(), spread).otherwise(F.pmod(spread, many))).drop(parts)
    return tagged.join(copies, [key, part], how).drop(part)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of a few megabytes, unless the session asks for something else:
    with the usual ten thousand rows a batch of long texts may take all of a worker's memory."""
    records, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(records) == "10000":
        spark.conf.set(records, "1000")
        spark.conf.set(size, str(4 << 20))


def worker_state(owner: str) -> dict:
    """A dictionary that lives in the Python worker across its tasks, until another owner asks."""
    name = "_strandloom_llm_worker"
    module = sys.modules.get(name)
    if module is None:
        module = sys.modules.setdefault(name, types.ModuleType(name))
        module.owner, module.state = owner, {}
    if module.owner != owner:
        module.owner, module.state = owner, {}
    return module.state


def per_batch(
    function: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``mapInArrow`` function from a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                yield from out.to_batches() if isinstance(out, pa.Table) else (out,)

    return run


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
