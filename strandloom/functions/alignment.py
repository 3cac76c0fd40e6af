"""CIGAR arithmetic.

Each expression walks the operations once with a fixed-size accumulator, so the cost is linear
in the CIGAR length also for long reads with tens of thousands of operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

TOKEN = r"\d+[MIDNSHP=X]"
BLOCKS = T.ArrayType(T.StructType([
    T.StructField(name, T.IntegerType()) for name in ("query_start", "ref_start", "length")
]))


def cigar_tokens(cigar: Column) -> Column:
    """``3S5M`` → array of ``3S``, ``5M``."""
    return F.regexp_extract_all(cigar, F.lit(TOKEN), F.lit(0))


def _length(token: Column) -> Column:
    return F.substring(token, F.lit(1), F.length(token) - 1).cast("int")


def reference_span(cigar: Column) -> Column:
    """Reference bases the alignment covers."""
    return F.aggregate(
        cigar_tokens(cigar),
        F.lit(0),
        lambda total, token: total
        + F.when(F.right(token, F.lit(1)).isin("M", "D", "N", "=", "X"), _length(token))
        .otherwise(F.lit(0)),
    )


def query_index_at(cigar: Column, start: Column, target: Column) -> Column:
    """0-based read index aligned to reference position ``target``, or -1.

    ``start`` and ``target`` share one coordinate base. Positions before the alignment, past its
    end or inside a deletion have no index.
    """
    def step(state: Column, token: Column) -> Column:
        op, n = F.right(token, F.lit(1)), _length(token)
        on_both = op.isin("M", "=", "X")
        on_query = on_both | op.isin("I", "S")
        on_ref = on_both | op.isin("D", "N")
        inside = on_both & (target >= state["ref"]) & (target < state["ref"] + n)
        return F.struct(
            (state["query"] + F.when(on_query, n).otherwise(0)).alias("query"),
            (state["ref"] + F.when(on_ref, n).otherwise(0)).alias("ref"),
            F.when(inside, state["query"] + target - state["ref"])
            .otherwise(state["found"]).alias("found"),
        )

    zero = F.struct(
        F.lit(0).alias("query"), start.cast("int").alias("ref"), F.lit(-1).alias("found")
    )
    return F.aggregate(cigar_tokens(cigar), zero, step, lambda state: state["found"])


def base_at(seq: Column, index: Column) -> Column:
    """Read base at a 0-based index; ``N`` past the stored sequence."""
    inside = (index >= 0) & (index < F.length(seq))
    return F.when(inside, F.upper(F.substring(seq, index + 1, F.lit(1)))).otherwise("N")


OPERATIONS = "MIDNSHP=X"
_TO_BLANKS = str.maketrans(OPERATIONS, " " * len(OPERATIONS))


def _advances(ops: str) -> np.ndarray:
    """Lookup by character code: 1 for the given operations."""
    table = np.zeros(128, dtype=np.int64)
    table[[ord(op) for op in ops]] = 1
    return table


_ON_QUERY, _ON_REF, _ON_BOTH = _advances("M=XIS"), _advances("M=XDN"), _advances("M=X")


def aligned_blocks(cigars: list[str], starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gap-free stretches of many alignments: row, query start, reference start, length.

    All operations are laid out in one array; positions within a read are running sums minus the
    sum at the read's first operation.
    """
    cigars = ["" if c is None or c == "*" else c for c in cigars]
    joined = "".join(cigars)
    codes = np.frombuffer(joined.encode("ascii"), dtype=np.uint8)
    is_op = codes > ord("9")
    ops = codes[is_op]
    lengths = np.fromstring(joined.translate(_TO_BLANKS), dtype=np.int64, sep=" ")
    row = np.repeat(np.arange(len(cigars)), [len(c) for c in cigars])[is_op]
    first = np.searchsorted(row, row, side="left")
    query, ref = lengths * _ON_QUERY[ops], lengths * _ON_REF[ops]
    query_end, ref_end = query.cumsum(), ref.cumsum()
    query_at, ref_at = query_end - query, ref_end - ref
    both = _ON_BOTH[ops] == 1
    row, first = row[both], first[both]
    return (
        row, query_at[both] - query_at[first], starts[row] + ref_at[both] - ref_at[first],
        lengths[both],
    )


@F.arrow_udf(BLOCKS)
def cigar_blocks(cigar: pa.Array, start: pa.Array) -> pa.Array:
    """Aligned blocks of every read in the batch.

    Declared non-deterministic, although it is not: unpacking a deterministic call would add a
    filter with a second copy of it.
    """
    row, *columns = aligned_blocks(cigar.to_pylist(), start.to_numpy(zero_copy_only=False))
    return list_of_structs(len(cigar), row, columns, ["query_start", "ref_start", "length"])


cigar_blocks = cigar_blocks.asNondeterministic()


def list_of_structs(
    size: int, row: np.ndarray, columns: list[np.ndarray], names: list[str]
) -> pa.Array:
    """Parallel int columns, ordered by row number, as one list-of-struct value per row."""
    offsets = np.searchsorted(row, np.arange(size + 1), side="left").astype(np.int32)
    values = [pa.array(c.astype(np.int32)) for c in columns]
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.StructArray.from_arrays(values, names=names)
    )
