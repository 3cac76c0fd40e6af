"""Token counts of whole texts, huge ones in overlapping chunks that are spliced where they agree.

A greedy merging tokenizer cuts a text into t1 … tn exactly if it cuts every two neighbours t, u on their
own into t, u: as long as no merge has crossed a border, the merges within two neighbouring tokens are those
of the two alone, so the first merge across a border would happen in the two alone as well. Every chunk
consists of such neighbours. So if two overlapping chunks hold one and the same token at the same place, the
first chunk's tokens up to it and the second one's tokens after it are the tokens of the whole: the
border at that token is proven stable, whatever surrounds the chunks.

Chunks that share no token, as in a long run of one character, are joined with their neighbours and encoded
again, with twice as many neighbours in each round, down to the whole text where nothing else helps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.llm.common import bounded_batches, store, worker_state

#: Characters of a chunk, and those it shares with the next one. Longer texts than two chunks are cut.
CHUNK, OVERLAP = 16_384, 256
#: Characters of chunks in a batch that leaves Python, and rows of it.
BATCH_CHARS = 1 << 22

_SYMBOL = "array<struct<at: bigint, end: bigint, index: bigint>>"
_SEGMENT = f"doc bigint, first bigint, last bigint, n_tokens bigint, left {_SYMBOL}, right {_SYMBOL}"
_CUT = ("doc_id bigint, n_bytes bigint, n_tokens bigint, doc bigint, chunk bigint, chunks bigint, at bigint, "
        "core string, next string")


class _Pieces:
    """A SentencePiece model, and the characters that each of its ids stands for."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        #: Of a character that is written in bytes, the first one counts.
        self.chars = np.array([
            int(self.model.id_to_piece(i)[1:-1], 16) & 0xC0 != 0x80 if self.model.is_byte(i)
            else len(self.model.id_to_piece(i)) for i in ids], np.int64)

    def count(self, text: str) -> int:
        return len(self.model.encode(text))

    def symbols(self, text: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Number of tokens; start, end and number of each that is not the later byte of a character.
        The blank that the model puts in front of a text has the place -1."""
        ids = np.array(self.model.encode(text), np.int64)
        size = self.chars[ids]
        ends = np.cumsum(size) - 1
        if not len(ids) or ends[-1] != len(text):  # the model changes texts: no token has a known place
            return len(ids), *(np.zeros(0, np.int64),) * 3
        index = np.flatnonzero(size)
        return len(ids), (ends - size)[index], ends[index], index


def _pieces(path: str) -> _Pieces:
    state = worker_state("tokencount")
    if path not in state:
        state[path] = _Pieces(path)
    return state[path]


def _cut(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """One counted row per text, or for a huge one a row per chunk with the start of the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, made = _pieces(path), TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        waiting = 0

        def batch() -> pa.RecordBatch:
            types = [pa.int64()] * 7 + [pa.string()] * 2
            names = [field.split()[0] for field in _CUT.split(", ")]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for part in batches:
            for i in range(part.num_rows):
                name, text = part.column(0)[i].as_py(), part.column(1)[i].as_py() or ""
                size = len(text.encode("utf-8"))
                if len(text) <= 2 * chunk:
                    rows.append((name, size, own.count(text), None, None, None, None, None, None))
                else:
                    made += 1
                    chunks = -(-len(text) // chunk)
                    for number in range(chunks):
                        at = number * chunk
                        rows.append((name, size, None, made, number, chunks, at, text[at : at + chunk],
                                     text[at + chunk : at + chunk + overlap]))
                        waiting += chunk
                        if waiting >= BATCH_CHARS:
                            yield batch()
                            rows, waiting = [], 0
            if rows:
                yield batch()
                rows, waiting = [], 0

    return docs.mapInArrow(run, _CUT)


def _encoded(segments: DataFrame, path: str, overlap: int) -> DataFrame:
    """Segments (doc, first and last chunk, at, core, next) with their tokens counted, and the tokens at
    either end by their places in the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _pieces(path)
        for part in batches:
            counts: list[int] = []
            lists: tuple[list, list] = [], []
            for at, core, after in zip(*(part.column(c).to_pylist() for c in ("at", "core", "next"))):
                total, start, end, index = own.symbols(core + after)
                counts.append(total)
                for low, found in zip((0, len(core)), lists):
                    a, b = np.searchsorted(start, [low, low + overlap])
                    found.append([{"at": s + at, "end": e + at, "index": i} for s, e, i in zip(
                        start[a:b].tolist(), end[a:b].tolist(), index[a:b].tolist())])
            symbol = pa.list_(pa.struct([(n, pa.int64()) for n in ("at", "end", "index")]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), part.column("first"), part.column("last"), pa.array(counts, pa.int64()),
                 *(pa.array(found, symbol) for found in lists)],
                names=["doc", "first", "last", "n_tokens", "left", "right"])

    # A huge text's chunks come from one task: deal them anew.
    return segments.repartition("doc", "first").mapInArrow(run, _SEGMENT)


def _place(symbol: Column) -> Column:
    return F.struct(symbol["at"], symbol["end"])


def _spliced(segments: DataFrame) -> DataFrame:
    """doc, first, last, tokens: those from the splice before a segment's end to the one after, but for what the
    next segment counts too; null where a segment and the next one share no token."""
    after = segments.select("doc", (F.col("first") - 1).alias("last"), F.col("left").alias("_after"))
    both = segments.join(after, ["doc", "last"], "left")
    here, there = F.transform("right", _place), F.transform("_after", _place)
    common = F.get(F.array_intersect(here, there), F.lit(0))

    def index(side: str, places: Column) -> Column:
        return F.get(side, (F.array_position(places, common) - 1).cast("int"))["index"]

    return both.select(
        "doc", "first", "last",
        F.when(F.col("_after").isNull(), F.col("n_tokens"))
        .when(common.isNotNull(), index("right", here) - index("_after", there)).alias("tokens"))


def _joined(spliced: DataFrame, chunks: DataFrame, reach: int) -> DataFrame:
    """Segments made of those that share no token with the next one, and of all within ``reach`` chunks of the
    border."""
    bad = spliced.where(F.col("tokens").isNull()).select("doc").distinct()
    order = Window.partitionBy("doc").orderBy("first")
    near = Window.partitionBy("doc").orderBy("first").rangeBetween(1 - reach, reach - 1)
    failed = F.coalesce(F.lag(F.col("tokens").isNull()).over(order), F.lit(False))
    groups = (
        spliced.join(bad, "doc", "left_semi").withColumn("_open", failed.cast("int"))
        .withColumn("_open", F.max("_open").over(near))
        .withColumn("_open", F.when(F.lag("first").over(order).isNull(), 0).otherwise(F.col("_open")))
        .withColumn("_group", F.sum(1 - F.col("_open")).over(order))
        .groupBy("doc", "_group").agg(F.min("first").alias("first"), F.max("last").alias("last"),
                                      F.count("*").alias("_n"))
        .where(F.col("_n") > 1))
    parts = groups.select("doc", "first", "last", F.explode(F.sequence("first", "last")).alias("chunk"))
    return parts.join(chunks, ["doc", "chunk"]).groupBy("doc", "first", "last").agg(
        F.min("at").alias("at"),
        F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("chunk", "core"))),
                                    lambda part: part["core"])).alias("core"),
        F.max_by("next", "chunk").alias("next"))


def counted(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """Bytes (UTF-8) and tokens of every text, as the SentencePiece model at ``path`` gives them without added
    tokens: doc_id, n_bytes, n_tokens.

    A null text is an empty one, with no tokens. Rows with the same or no id are counted each on its own; an
    empty table gives no rows; other columns play no part. Texts over two chunks are cut into chunks that
    any task may encode; their number of rows follows their length, and only the ends of chunks meet.
    Models that normalise texts are served too: their tokens have no known places, so texts are widened to the whole.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("the overlap is at least one character and at most a chunk")
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    made = store(_cut(rows, path, chunk, overlap), "counted", compression="zstd")
    short = made.where(F.col("doc").isNull()).select("doc_id", "n_bytes", "n_tokens")
    chunks = made.where(F.col("doc").isNotNull())
    first = chunks.select("doc", F.col("chunk").alias("first"), F.col("chunk").alias("last"), "at", "core", "next")
    known = store(_encoded(first, path, overlap), "segments")
    reach = 1
    while True:
        spliced = _spliced(known)
        if spliced.where(F.col("tokens").isNull()).isEmpty():
            break
        wider = store(_joined(spliced, chunks, reach), "wider", compression="zstd")
        covered = wider.select("doc", F.explode(F.sequence("first", "last")).alias("first"))
        kept = known.join(covered, ["doc", "first"], "left_anti").select(*known.columns)
        known = store(kept.unionByName(_encoded(wider, path, overlap)), "segments")
        reach *= 2
    totals = spliced.groupBy("doc").agg(F.sum("tokens").alias("n_tokens"))
    heads = chunks.where(F.col("chunk") == 0).select("doc", "doc_id", "n_bytes")
    return short.unionByName(heads.join(totals, "doc").select("doc_id", "n_bytes", "n_tokens"))
