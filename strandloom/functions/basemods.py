"""Base-modification tags (MM/ML) decoded to reference positions.

A read's calls are stored as skip counts along the original read, so finding them needs the
whole sequence. That runs in Arrow batches, with array operations over many reads at once;
everything before and after it stays in Spark expressions.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from strandloom.functions.alignment import aligned_blocks, list_of_structs

CALLS = T.ArrayType(T.StructType([
    T.StructField(name, T.IntegerType()) for name in ("ref_pos", "qual")
]))

# Layout of one tag group, the modified base and the codes that are kept.
MM_GROUP = re.compile(r"([A-Z])[-+]([a-z]+|[A-Z]|\d+)[.?]?((?:,\d+)*)$")
CANONICAL_BASE = "C"
KEPT_CODES = ("m", "h")
COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A"}
NO_QUALITY = -1
REVERSE_FLAG = 16


def _groups(rows: list[int], mms: list[str]) -> list[tuple]:
    """Kept tag groups: row, first ML entry, codes per base, place of the code, skip text.

    Groups consume ML in order, also those that are not kept; within a group the codes of one base
    follow each other. The last entry of a row, with the place -1, only states how much ML the row
    needs in all. A row with a group that cannot be read has no entries at all.
    """
    found = []
    for row, mm in zip(rows, mms):
        parsed = [MM_GROUP.match(t) for t in map(str.strip, mm.split(";")) if t]
        if None in parsed:
            continue
        used = 0
        for group in parsed:
            base, codes, skips = group.groups()
            codes = codes if codes.isalpha() else (codes,)
            if base == CANONICAL_BASE and skips:
                found += [(row, used, len(codes), at, skips)
                          for at, code in enumerate(codes) if code in KEPT_CODES]
            used += skips.count(",") * len(codes)
        found.append((row, used, 1, -1, ""))
    return found


def decode(seqs, flags, starts, cigars, mms, ml_values, ml_bounds, has_ml, low, high):
    """Placed calls of many reads: row, reference position, quality; ordered by row.

    Works on arrays over all reads at once. A read whose tag asks for more bases than it has, or
    for more values than its ML holds, is malformed and has no calls; without any ML the quality
    is NO_QUALITY.
    """
    size = len(seqs)
    usable = [i for i in range(size) if seqs[i] and mms[i]]
    groups = _groups(usable, [mms[i] for i in usable])
    if not groups:
        return (np.empty(0, np.int64),) * 3
    row, first, codes, place = (
        np.array(c, dtype=np.int64) for c in list(zip(*groups))[:4]
    )
    bad = np.zeros(size, dtype=bool)
    total = place < 0
    ml_size = np.diff(ml_bounds)
    bad[row[total]] = has_ml[row[total]] & (first[total] > ml_size[row[total]])

    skips = "".join(g[4] for g in groups)
    steps = np.fromstring(skips[1:], dtype=np.int64, sep=",") if skips else np.empty(0, np.int64)
    counts = np.array([g[4].count(",") for g in groups], dtype=np.int64)
    group = np.repeat(np.arange(len(groups)), counts)
    begin = (counts.cumsum() - counts)[group]
    reached = (steps + 1).cumsum()
    nth = reached - (reached - steps - 1)[begin] - 1
    item, row = np.arange(len(steps)) - begin, row[group]

    joined = "".join(s or "" for s in seqs).upper().encode("ascii")
    bases = np.frombuffer(joined, dtype=np.uint8)
    lengths = np.array([len(s or "") for s in seqs], dtype=np.int64)
    reverse = (flags & REVERSE_FLAG) != 0
    target = np.where(reverse, ord(COMPLEMENT[CANONICAL_BASE]), ord(CANONICAL_BASE))
    places = np.flatnonzero(bases == np.repeat(target.astype(np.uint8), lengths))
    read_end = lengths.cumsum()
    read_begin = read_end - lengths
    place_begin = np.searchsorted(places, read_begin)
    place_count = np.searchsorted(places, read_end) - place_begin
    bad[row[nth >= place_count[row]]] = True

    keep = ~bad[row]
    row, nth, item, group = row[keep], nth[keep], item[keep], group[keep]
    turned = np.where(reverse[row], place_count[row] - 1 - nth, nth)
    query = places[place_begin[row] + turned] - read_begin[row]
    qual = np.full(len(row), NO_QUALITY, dtype=np.int64)
    known = has_ml[row]
    entry = ml_bounds[row] + first[group] + item * codes[group] + place[group]
    qual[known] = ml_values[entry[known]]

    block_row, block_query, block_ref, block_length = aligned_blocks(cigars, starts)
    if not len(block_row) or not len(row):
        return (np.empty(0, np.int64),) * 3
    stride = int(lengths.max()) + int(block_query.max()) + 1
    block = np.searchsorted(
        block_row * stride + block_query, row * stride + query, side="right"
    ) - 1
    offset = query - block_query[block]
    ref = block_ref[block] + offset
    keep = (
        (block >= 0) & (block_row[block] == row) & (offset < block_length[block])
        & (ref >= low[row]) & (ref <= high[row])
    )
    return row[keep], ref[keep], qual[keep]


# Reads decoded together hold about this many bases, whatever the batch size.
BASES_AT_ONCE = 4_000_000


@F.arrow_udf(CALLS)
def methylation_calls(
    seq: pa.Array, flag: pa.Array, start: pa.Array, cigar: pa.Array,
    mm: pa.Array, ml: pa.Array, low: pa.Array, high: pa.Array,
) -> pa.Array:
    """5mC and 5hmC calls of every read with a reference position in ``low..high``.

    ``start`` and the result are 1-based. A base with both codes gives two calls.

    Declared non-deterministic, although it is not: unpacking a deterministic call would add a
    filter with a second copy of it, and push that below joins to reads that need no decoding.
    """
    number = lambda column: column.to_numpy(zero_copy_only=False).astype(np.int64)
    seqs, cigars, mms = seq.to_pylist(), cigar.to_pylist(), mm.to_pylist()
    flags, starts, low, high = map(number, (flag, start, low, high))
    bounds, values = number(ml.offsets), ml.values.to_numpy(zero_copy_only=False)
    has_ml = ml.is_valid().to_numpy(zero_copy_only=False)
    bases = np.cumsum([len(s or "") for s in seqs])
    cuts = np.flatnonzero(np.diff(bases // BASES_AT_ONCE)) + 1
    parts = []
    for a, b in zip([0, *cuts], [*cuts, len(seqs)]):
        row, ref, qual = decode(
            seqs[a:b], flags[a:b], starts[a:b], cigars[a:b], mms[a:b], values, bounds[a:b + 1],
            has_ml[a:b], low[a:b], high[a:b],
        )
        parts.append((row + a, ref, qual))
    row, ref, qual = (np.concatenate(c) for c in zip(*parts))
    return list_of_structs(len(seqs), row, [ref, qual], ["ref_pos", "qual"])


methylation_calls = methylation_calls.asNondeterministic()


HITS = T.ArrayType(T.StructType([
    T.StructField("hit", T.IntegerType()), T.StructField("base", T.StringType()),
    T.StructField("ref_pos", T.IntegerType()), T.StructField("qual", T.IntegerType()),
]))
HITS_ARROW = to_arrow_type(HITS)
NO_BASE = ord("N")


def _bases_at(seqs, cigars, starts, row, target):
    """Upper-case read base (character code) at reference positions of reads, 0 where none is aligned and
    NO_BASE past the stored sequence. All positions of a read are found in one walk along its CIGAR."""
    block_row, block_query, block_ref, block_length = aligned_blocks(cigars, starts)
    found = np.zeros(len(row), dtype=np.int64)
    if not len(block_row) or not len(row):
        return found
    base = min(int(block_ref.min()), int(target.min()))
    stride = max(int((block_ref + block_length).max()), int(target.max())) - base + 1
    block = np.searchsorted(
        block_row * stride + block_ref - base, row * stride + target - base, side="right") - 1
    there = (block >= 0) & (block_row[block] == row)
    offset = target - block_ref[block]
    there &= offset < block_length[block]
    query = block_query[block] + offset
    letters = np.frombuffer("".join(s or "" for s in seqs).upper().encode("ascii"), dtype=np.uint8)
    lengths = np.array([len(s or "") for s in seqs], dtype=np.int64)
    inside = there & (query < lengths[row])
    found[there] = NO_BASE
    found[inside] = letters[(lengths.cumsum() - lengths)[row[inside]] + query[inside]]
    return found


def decode_around(
    seqs, flags, starts, cigars, mms, ml_values, ml_bounds, has_ml, row, target, ref, alt, window
):
    """Calls around positions of reads: number of the (read, position) pair, base there, reference position
    of the call, quality; ordered by pair.

    ``row`` (ascending), ``target``, and the codes of the first ``ref`` and ``alt`` base are given per pair.
    Pairs whose base is neither have no calls, and reads without any other are not decoded. The others are
    decoded once, whatever their number of pairs: their calls are put in order, and each pair takes a stretch.
    """
    base = _bases_at(seqs, cigars, starts, row, target)
    pair = np.flatnonzero((base > 0) & ((base == ref) | (base == alt)))
    wanted = set(row[pair].tolist())
    everywhere = np.full(len(seqs), 1 << 40, dtype=np.int64)
    call_row, place, qual = decode(
        seqs, flags, starts, cigars, [mm if i in wanted else None for i, mm in enumerate(mms)],
        ml_values, ml_bounds, has_ml, -everywhere, everywhere,
    )
    if not len(call_row):
        return (np.empty(0, np.int64),) * 4
    order = np.lexsort((place, call_row))
    call_row, place, qual = call_row[order], place[order], qual[order]
    lowest = min(int(place.min()), int(target.min()) - window)
    stride = max(int(place.max()), int(target.max()) + window) - lowest + 2
    key = call_row * stride + place - lowest
    middle = row[pair] * stride + target[pair] - lowest
    first = np.searchsorted(key, middle - window, side="left")
    count = np.searchsorted(key, middle + window, side="right") - first
    at = np.repeat(first - (count.cumsum() - count), count) + np.arange(count.sum())
    pair = np.repeat(pair, count)
    return pair, base[pair], place[at], qual[at]


@F.arrow_udf(HITS)
def calls_around(
    seq: pa.Array, flag: pa.Array, start: pa.Array, cigar: pa.Array, mm: pa.Array, ml: pa.Array,
    targets: pa.Array, window: pa.Array,
) -> pa.Array:
    """5mC and 5hmC calls of every read within ``window`` of its ``targets`` (structs of position, ref, alt)
    whose ref or alt the read supports, each with the number of its target and the read's base there.

    Positions are 1-based. A base with both codes gives two calls. Declared non-deterministic like
    ``methylation_calls``, for the same reason.
    """
    if not len(seq):
        return pa.array([], HITS_ARROW)
    number = lambda column: column.to_numpy(zero_copy_only=False).astype(np.int64)
    code = lambda column: np.array([ord(v[0]) if v else -1 for v in column.to_pylist()], dtype=np.int64)
    seqs, cigars, mms = seq.to_pylist(), cigar.to_pylist(), mm.to_pylist()
    flags, starts = number(flag), number(start)
    bounds, values = number(ml.offsets), ml.values.to_numpy(zero_copy_only=False)
    has_ml = ml.is_valid().to_numpy(zero_copy_only=False)
    limits = number(targets.offsets)
    target = number(targets.values.field(0))
    ref, alt = code(targets.values.field(1)), code(targets.values.field(2))
    bases = np.cumsum([len(s or "") for s in seqs])
    cuts = np.flatnonzero(np.diff(bases // BASES_AT_ONCE)) + 1
    parts = []
    for a, b in zip([0, *cuts], [*cuts, len(seqs)]):
        p, q = limits[a], limits[b]
        row = np.repeat(np.arange(b - a), np.diff(limits[a:b + 1]))
        pair, *rest = decode_around(
            seqs[a:b], flags[a:b], starts[a:b], cigars[a:b], mms[a:b], values, bounds[a:b + 1],
            has_ml[a:b], row, target[p:q], ref[p:q], alt[p:q], int(window[0].as_py()),
        )
        parts.append((pair + p, *rest))
    pair, base, place, qual = (np.concatenate(c) for c in zip(*parts))
    owner = np.repeat(np.arange(len(seqs)), np.diff(limits))[pair - limits[0]]
    letters = np.array([chr(c) for c in range(128)])
    columns = [
        pa.array((pair - limits[owner]).astype(np.int32)), pa.array(letters[base].tolist(), pa.string()),
        pa.array(place.astype(np.int32)), pa.array(qual.astype(np.int32)),
    ]
    offsets = np.searchsorted(owner, np.arange(len(seqs) + 1), side="left").astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.StructArray.from_arrays(columns, names=HITS.elementType.names))


calls_around = calls_around.asNondeterministic()
