"""Documents packed into token windows by non-negative least squares.

A document is tokenised, closed by an id, and cut into whole windows and a rest. Whole windows are
sequences already. For the rests, the histogram of their lengths (at most one count per length) goes
to the driver. There all combinations of up to three lengths that fill a window exactly are listed,
and non-negative least squares finds how often to repeat each, so that together they come close to
the histogram. The counts are rounded to what the histogram allows. What remains is packed greedily:
laid in a line, longest first, and cut at the window borders. So only the last sequence has padding.

A rest finds its place by arithmetic from its length and its rank among the rests of that length.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandloom.llm.bpe import little
from strandloom.llm.common import bounded_batches, per_batch, store, worker_state

WINDOW = 1024
DEPTH = 3
#: The faster library takes white space by recursion and ends its process on runs of a million; texts with a run
#: of this length go to the other one.
LONG_BLANK = re.compile(r"\s{2000}")
#: Rests of one length that one task ranks.
RANK_ROWS = 20_000


class _Ids:
    """Ids of a byte-level tokenizer file, without tokens that a template would add.

    With ``added`` the file is taken as it is: where a text holds one of the file's added tokens, that
    token's id stands there. Without, special ones are text like any other.

    The file's vocabulary orders its tokens by the rank of their merge, which is all that the merging of
    a piece depends on. So the merging itself is left to the faster of the two public libraries; the
    other, that the file is made for, answers a probe first, and is used if the answers differ, or where the
    faster one cannot take a text.
    """

    def __init__(self, path: str, pattern: str, added: bool = False):
        import tiktoken
        from tokenizers import pre_tokenizers

        tokenizer = self._library(path, added)
        # The library writes each byte as a printable character: itself, or the next free one from 256 on.
        plain = [c for c in range(256) if chr(c) in pre_tokenizers.ByteLevel.alphabet()]
        other = [c for c in range(256) if c not in plain]
        byte = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(other)}
        ranks = {
            bytes(byte[c] for c in token): rank for token, rank in tokenizer.get_vocab(False).items()
            if all(c in byte for c in token)
        }
        known = tokenizer.get_added_tokens_decoder()
        special = {t.content for t in known.values()}
        self.marks = {t.content: i for i, t in known.items() if added or not t.special}
        longest = sorted(map(re.escape, self.marks), key=len, reverse=True)
        self.split = re.compile(f"({'|'.join(longest)})") if longest else None
        self.fast = tiktoken.Encoding(
            "own", pat_str=pattern, special_tokens={},
            mergeable_ranks={t: r for t, r in ranks.items() if t.decode("utf-8", "replace") not in special})
        probe = "It's  3 o'clock\n\n\tçaß 12345 naïve… \u3000x <|endoftext|>\x1c\x85 \U0001f600"
        probe += "".join(f"a {m} b{m}{m}\n{m}1x{m}x" for m in sorted(special))
        ids = tokenizer.encode(probe, add_special_tokens=False).ids
        #: The slower library, only where it is needed: it takes tens of megabytes.
        self.slow = None if self._fast(probe).tolist() == ids else tokenizer
        self.library, self.path, self.added = None, path, added

    @staticmethod
    def _library(path: str, added: bool):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = not added
        return tokenizer

    def _fast(self, text: str) -> array:
        if self.split is None:
            return array("I", self.fast.encode_ordinary(text))
        ids = array("I")
        for i, part in enumerate(self.split.split(text)):  # every second one is an added token
            ids.extend([self.marks[part]] if i % 2 else self.fast.encode_ordinary(part))
        return ids

    def __call__(self, text: str) -> array:
        if self.slow is None and not LONG_BLANK.search(text):
            return self._fast(text)
        if self.library is None:
            self.library = self.slow or self._library(self.path, self.added)
        return array("I", self.library.encode(text, add_special_tokens=False).ids)


def _ids(path: str, pattern: str, added: bool) -> _Ids:
    state = worker_state("packing")
    key = (path, pattern, added)
    if key not in state:
        state[key] = _Ids(path, pattern, added)
    return state[key]


def tokenised(
    docs: DataFrame, path: str, pattern: str, closing: int = 0, window: int = WINDOW,
    doc_id: str = "doc_id", text: str = "text", added: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (little-endian 32-bit, binary)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = _ids(path, pattern, added)
        index, start, length, total, ids = [], [], [], [], []
        for i, value in enumerate(batch.column(1)):
            tokens = own(value.as_py() or "")
            tokens.append(closing)
            data = little(tokens)
            for at in range(0, len(tokens), window):
                index.append(i)
                start.append(at)
                length.append(min(window, len(tokens) - at))
                total.append(len(tokens))
                ids.append(data[4 * at : 4 * (at + window)])
        return pa.RecordBatch.from_arrays([
            batch.column(0).take(pa.array(index, pa.int64())), pa.array(start, pa.int64()),
            pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary()),
        ], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(
        per_batch(run), "doc_id long, start long, length long, doc_tokens long, ids binary")


def combinations(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """All ways to fill ``window`` with two or three of ``lengths`` (ascending), 0 for no third."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    found = []
    pairs = lengths[(lengths <= window - lengths) & there[window - lengths]]
    found.append(np.column_stack([0 * pairs, pairs, window - pairs]))
    for a in lengths[lengths <= window // DEPTH]:
        b = lengths[(lengths >= a) & (lengths <= (window - a) // 2)]
        b = b[there[window - a - b]]
        found.append(np.column_stack([np.full(len(b), a), b, window - a - b]))
    return np.concatenate(found)


def repeats(combos: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient: repeats of each combination
    such that the lengths used come close to ``counts`` (by length)."""
    if not len(combos):
        return np.zeros(0)
    scale = max(float(counts.max()), 1.0)
    goal = counts / scale
    goal[0] = 0.0
    size = len(counts)
    real = combos > 0

    def used(x):
        return np.bincount(combos[real], np.repeat(x, real.sum(1)), size)

    def back(y):
        return np.where(real, y[combos], 0).sum(1)

    step = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue gives the step
        step = back(used(step))
        largest = np.linalg.norm(step)
        step /= largest
    x = z = np.zeros(len(combos))
    momentum = 1.0
    for _ in range(rounds):
        nxt = np.maximum(0.0, z - back(used(z) - goal) / (1.05 * largest))
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        z = nxt + (momentum - 1) / after * (nxt - x)
        x, momentum = nxt, after
    return x * scale


class Plan:
    """Where the rests go, from the counts of their lengths; its size depends on the window only.

    ``slot`` tables hold, per (combination, length): the length, the first rank it takes, how many
    of that length one sequence takes, its first sequence, and the offset there.
    """

    def __init__(self, counts: np.ndarray, window: int = WINDOW):
        self.window = window
        left = counts.astype(np.int64).copy()
        combos = combinations(np.flatnonzero(left), window)
        amounts = np.rint(repeats(combos, counts.astype(float))).astype(np.int64)
        slots, sequence = [], 0
        for c in np.argsort(-amounts, kind="stable"):
            if not amounts[c]:
                break
            lengths, many = np.unique(combos[c][combos[c] > 0], return_counts=True)
            times = min(amounts[c], (left[lengths] // many).min())
            if times <= 0:
                continue
            offset = 0
            for length, each in zip(lengths.tolist(), many.tolist()):
                slots.append((length, counts[length] - left[length], each, sequence, offset))
                offset += length * each
            left[lengths] -= times * many
            sequence += int(times)
        slots.sort()
        self.slots = np.array(slots, np.int64).reshape(-1, 5)
        self.planned = (counts - left).astype(np.int64)
        order = np.arange(window, -1, -1)
        tokens = (left * np.arange(window + 1))[order]
        line = np.zeros(window + 1, np.int64)
        line[order] = np.cumsum(tokens) - tokens
        self.line, self.first_cut = line, sequence
        self.sequences = sequence + -(-int(tokens.sum()) // window)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the rests with these lengths and ranks."""
        at = self.line[length] + (rank - self.planned[length]) * length
        sequence, offset = self.first_cut + at // self.window, at % self.window
        fixed = rank < self.planned[length]
        if fixed.any():
            key = self.slots[:, 0] * (1 << 40) + self.slots[:, 1]
            found = np.searchsorted(key, length[fixed] * (1 << 40) + rank[fixed], "right") - 1
            _, first, each, base, begin = self.slots[found].T
            number = rank[fixed] - first
            sequence[fixed] = base + number // each
            offset[fixed] = begin + number % each * length[fixed]
        return sequence, offset


def packed(
    docs: DataFrame, path: str, pattern: str, closing: int = 0, window: int = WINDOW,
    doc_id: str = "doc_id", text: str = "text", added: bool = False,
) -> DataFrame:
    """Pieces of all documents with their places: doc_id, start, length, doc_tokens, ids,
    sequence_id, offset.

    A null or empty text is the closing id alone. Repeated rows and ids, and null ids, are packed
    each on its own. An empty table gives no pieces. Other columns of ``docs`` play no part. Texts
    of any length are cut whole. ``added`` is that of ``_Ids``. Every task holds one batch; the driver sees one count per length.
    """
    pieces = store(
        tokenised(docs, path, pattern, closing, window, doc_id, text, added), "pieces",
        compression="zstd")
    counts = np.zeros(window + 1, np.int64)
    for length, n in pieces.where(F.col("length") < window).groupBy("length").count().collect():
        counts[length] = n
    plan = Plan(counts, window)
    parts = F.lit([max(1, -(-int(n) // RANK_ROWS)) for n in counts[1:]])
    key = ["length", "_part"]
    rests = pieces.where(F.col("length") < window).withColumn(
        "_part", F.pmod(F.xxhash64("doc_id", F.crc32("ids")), F.get(parts, (F.col("length") - 1).cast("int"))))
    before = rests.groupBy(*key).agg(F.count("*").alias("_n")).withColumn(
        "_before", F.sum("_n").over(
            Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    own = Window.partitionBy(*key).orderBy("doc_id", "doc_tokens", "ids")
    ranked = rests.withColumn("_rank", F.row_number().over(own) - 1).join(before, key, "left").select(
        "doc_id", "start", "length", "doc_tokens", "ids",
        (F.col("_rank") + F.coalesce("_before", F.lit(0))).alias("_rank"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        start, length, rank = (np.array(batch.column(i)) for i in (1, 2, 5))
        sequence, offset = plan.place(length, rank)
        head = np.minimum(length, window - offset)
        cut = np.flatnonzero(head < length)
        rows = np.concatenate([np.arange(len(length)), cut])
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        skip = np.concatenate([0 * head, head[cut]])[order]
        take = np.concatenate([head, (length - head)[cut]])[order]
        data = batch.column(4)
        ids = [data[r].as_py()[4 * s : 4 * (s + t)] for r, s, t in
               zip(rows.tolist(), skip.tolist(), take.tolist())]
        later = skip > 0
        index = pa.array(rows)
        return pa.RecordBatch.from_arrays([
            batch.column(0).take(index), pa.array(start[rows] + skip), pa.array(take),
            batch.column(3).take(index), pa.array(ids, pa.binary()),
            pa.array(sequence[rows] + later), pa.array(np.where(later, 0, offset[rows])),
        ], names=["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"])

    placed = ranked.mapInArrow(
        per_batch(run), "doc_id long, start long, length long, doc_tokens long, ids binary, "
        "sequence_id long, offset long")
    whole = pieces.where(F.col("length") == window).select(
        "*", (F.monotonically_increasing_id() + plan.sequences).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(whole)
