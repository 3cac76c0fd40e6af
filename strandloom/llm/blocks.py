"""Documents in blocks, and hashes of word sequences within a block.

Operators that look at the texts more than once write them in blocks of documents, as a table bucketed by
block. What was found out about a block is brought to it by a join on its number, for which only that
small side is shuffled; the texts stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, types as T

from strandloom.llm.common import bounded_batches, shuffle_width, store_bucketed, worker_state

#: Characters and documents after which a block is closed.
BLOCK_CHARS = 1_000_000
BLOCK_DOCS = 2_000
#: Bits of a block's number within its task, and of a document's number within its block.
TASK_BITS, DOC_BITS = 24, 11

U = np.uint64
_SEED = np.random.default_rng(20240601)
_BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASES = [int(x) | 1 for x in _SEED.integers(1 << 62, 1 << 63, 2)]
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))


def blocked(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """The rows of ``docs`` as a bucketed table (block, chars, docs: array of rows)."""
    bounded_batches(docs.sparkSession)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << TASK_BITS
        for batch in batches:
            sizes = np.array(pc.fill_null(pc.utf8_length(batch.column(place)), 0), np.int64)
            limits = np.cumsum(sizes) // BLOCK_CHARS + np.arange(len(sizes)) // BLOCK_DOCS * (1 << 32)
            starts = np.flatnonzero(np.append(True, limits[1:] != limits[:-1])) if len(sizes) else []
            rows = pa.StructArray.from_arrays(batch.columns, fields=[*batch.schema])
            for a, b in zip(starts, [*starts[1:], len(sizes)]):
                number += 1
                part = pa.ListArray.from_arrays(np.array([0, b - a], np.int32), rows[int(a) : int(b)])
                chars = pa.array([int(sizes[a:b].sum())], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), chars, part], names=["block", "chars", "docs"])

    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("chars", T.LongType()),
        T.StructField("docs", T.ArrayType(docs.schema)),
    ])
    return store_bucketed(docs.mapInArrow(run, schema), name, "block", shuffle_width(docs.sparkSession))


def each_block(blocks: DataFrame, function: Callable[[int, pa.RecordBatch], Iterator], schema) -> DataFrame:
    """Rows of ``function`` (block, its rows) for every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = pa.RecordBatch.from_struct_array(batch.column(1)[i].values)
                yield from function(batch.column(0)[i].as_py(), rows)

    return blocks.select("block", "docs").mapInArrow(run, schema)


def with_blocks(
    blocks: DataFrame, info: DataFrame, function: Callable[[pa.RecordBatch, pa.Table], pa.Table], schema
) -> DataFrame:
    """Rows of ``function`` (rows of the block, its rows of ``info``) for every block."""

    def run(block: pa.Table, own: pa.Table) -> pa.Table:
        rows = pa.concat_arrays([c.flatten() for c in block["docs"].chunks])
        return function(pa.RecordBatch.from_struct_array(rows), own)

    return blocks.select("block", "docs").groupBy("block").cogroup(info.groupBy("block")).applyInArrow(run, schema)


def _powers(base: int, size: int) -> np.ndarray:
    """Powers of ``base`` modulo 2**64, kept by the worker."""
    state = worker_state("blocks")
    known = state.get(base)
    if known is None or len(known) < size:
        known = np.full(max(size, 1 << 16), base, U)
        known[0] = 1
        state[base] = known = np.cumprod(known, dtype=U)
    return known[:size]


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Segments:
    """Hashes of any runs of an array of 64-bit values: equal runs have equal hashes wherever they are."""

    def __init__(self, values: np.ndarray, which: int):
        base = _BASES[which]
        size = len(values) + 1
        self.back = _powers(pow(base, -1, 1 << 64), size)
        self.sums = np.zeros(size, U)
        np.cumsum(values * _powers(base, size)[:-1], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(U))


#: Bytes beyond which a word is hashed on its own. Sums modulo 2**64 are the same for certain pairs of long
#: words, whatever the base (those of Thue and Morse, from about a thousand letters on), and by chance alone for others.
LONG_WORD = 256


class Words:
    """Words of several texts in a row: hash of each word, and the words' range of each text."""

    def __init__(self, texts: list[str | None]):
        data = [(t or "").encode("utf-8") for t in texts]
        joined = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
        space = _SPACE[joined]
        edges = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1, append=1))
        starts, ends = edges[0::2], edges[1::2]
        self.hashes = Segments(_BYTE[joined], 0)(starts, ends)
        for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            self.hashes[i] = xxhash.xxh3_64_intdigest(joined[starts[i] : ends[i]].tobytes())
        limits = np.cumsum([0, *(len(d) + 1 for d in data)])
        self.bounds = np.searchsorted(starts, limits)
        self.counts = np.diff(self.bounds)
        #: Text of each word.
        self.owner = np.repeat(np.arange(len(data)), self.counts)

    def __len__(self) -> int:
        return len(self.hashes)
