"""Lines of block-compressed text files (as made by bgzip) as a Spark data source.

The blocks of such a file are compressed on their own, so any of them can be read first. A file is cut by compressed
bytes; a task looks for the first block that starts in its range, leaves the line that was open there to the task
before, and reads past its range to the end of its own last line. With tiles of the genome and a position index
beside the file (``.tbi``), only the ranges are read that the index names for them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandloom.sources.bam import (
    BlockStream, Index, Tiles, _cut, _exists, _open, _parse_tiles, tiles_text,
)

SPLIT_BYTES = 16 * 1024 * 1024
#: Bytes of lines in a batch.
BATCH_BYTES = 4 * 1024 * 1024
#: A block has no more compressed bytes.
MOST_BYTES = 1 << 16
# Fixed values of the format: first bytes of a block, and of an index.
MAGIC = b"\x1f\x8b\x08\x04"
INDEX_MAGIC = b"TBI\1"

LINES = "value string, file string, block bigint, row bigint"


def _block_size(data: bytes, at: int = 0) -> int | None:
    """Compressed size of the block that starts at ``at``, None if none does."""
    if data[at:at + 4] != MAGIC or len(data) < at + 18:
        return None
    end = at + 12 + struct.unpack_from("<H", data, at + 10)[0]
    at += 12
    while at + 6 <= min(end, len(data)):
        tag, length = data[at:at + 2], struct.unpack_from("<H", data, at + 2)[0]
        if tag == b"BC" and length == 2:
            return struct.unpack_from("<H", data, at + 4)[0] + 1
        at += 4 + length
    return None


def is_block_compressed(path: str) -> bool:
    """Whether a file can be read from any of its blocks; plain gzip files cannot."""
    try:
        with _open(path) as file:
            return _block_size(file.read(MOST_BYTES)) is not None
    except (OSError, ValueError, pa.ArrowException):  # a folder, a pattern, or a store that only Spark reads
        return False


def _first_block(file, start: int, end: int, size: int) -> int | None:
    """Start of the first block in ``start .. end``: one that the next block, or the end, follows."""
    if start == 0:
        return 0
    file.seek(start)
    data = file.read(3 * MOST_BYTES)
    at = data.find(MAGIC)
    while 0 <= at < end - start:
        length = _block_size(data, at)
        if length is not None:
            after = at + length
            if start + after == size or _block_size(data, after) is not None:
                return start + at
        at = data.find(MAGIC, at + 1)
    return None


def tabix_index(path: str) -> tuple[list[str], Index] | None:
    """Names and index of the file's position index, None without one."""
    place = path + ".tbi"
    if not _exists(place):
        return None
    with _open(place) as file:
        stream = BlockStream(file)
        parts = []
        while part := stream.read(1 << 20):
            parts.append(part)
    data = b"".join(parts)
    if data[:4] != INDEX_MAGIC:
        raise ValueError(f"not a position index: {place}")
    count = struct.unpack_from("<i", data, 4)[0]
    length = struct.unpack_from("<i", data, 32)[0]
    names = data[36:36 + length].split(b"\0")[:count]
    # From here on, the layout is that of alignment indexes.
    return [n.decode() for n in names], Index(b"BAI\1" + struct.pack("<i", count) + data[36 + length:])


class LineRange(InputPartition):
    """Compressed bytes ``start .. end`` of a file, or ranges of virtual offsets where lines start."""

    def __init__(self, path: str, start: int, end: int, ranges: list[tuple] | None = None):
        self.path, self.start, self.end, self.ranges = path, start, end, ranges


class LineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["paths"].split("\n")
        self.split_bytes = max(1, int(options.get("splitbytes", SPLIT_BYTES)))
        self.tiles = None if "tiles" not in options else _parse_tiles(options["tiles"])

    def partitions(self) -> list[LineRange]:
        found = []
        for path in self.paths:
            with _open(path) as file:
                size = file.size()
            index = None if self.tiles is None else tabix_index(path)
            if index is None:
                found += [LineRange(path, at, min(at + self.split_bytes, size))
                          for at in range(0, size, self.split_bytes)]
            else:
                names, own = index
                groups = _cut(own.ranges(names, self.tiles), own.starts(), self.split_bytes)
                found += [LineRange(path, group[0][0] >> 16, 0, group) for group in groups]
        return found or [LineRange(self.paths[0], 0, 0)]

    def read(self, partition: LineRange) -> Iterator[pa.RecordBatch]:
        name, row = partition.path.rstrip("/").rsplit("/", 1)[-1], 0
        with _open(partition.path) as file:
            texts = _own_text(file, partition) if partition.ranges is None else _named_text(file, partition.ranges)
            for text in texts:
                lines = text.replace(b"\r\n", b"\n").replace(b"\r", b"\n").removesuffix(b"\n").split(b"\n")
                yield pa.RecordBatch.from_arrays([
                    pa.array([line.decode("utf-8", "replace") for line in lines], pa.string()),
                    pa.array([name] * len(lines), pa.string()),
                    pa.array([partition.start] * len(lines), pa.int64()),
                    pa.array(range(row, row + len(lines)), pa.int64()),
                ], names=[field.split()[0] for field in LINES.split(", ")])
                row += len(lines)


def _own_text(file, own: LineRange) -> Iterator[bytes]:
    """The lines that start in blocks of the range, whole. A line that starts where the next range's first block
    does belongs here as well, since every range but the first leaves its first line out."""
    first = _first_block(file, own.start, own.end, file.size()) if own.end > own.start else None
    if first is None:
        return
    stream = BlockStream(file, first << 16)
    held, skip = [], own.start > 0

    def next_data() -> bytes | None:
        return stream.data if stream._load() else None

    def cut(data: bytes) -> bytes | None:
        """``data`` behind the line that was open at the start; None while that goes on."""
        at = data.find(b"\n")
        return None if at < 0 else data[at + 1:]

    size = 0
    while stream.next_block < own.end:
        data = next_data()
        if data is None:
            break
        if skip:
            data = cut(data)
            if data is None:
                continue
            skip = False
        held.append(data)
        size += len(data)
        if size >= BATCH_BYTES:
            text = b"".join(held)
            at = text.rfind(b"\n") + 1
            if at:
                yield text[:at]
            held, size = [text[at:]], len(text) - at
    while not skip or held:  # the last line goes on behind the range
        data = next_data()
        if data is None:
            break
        at = data.find(b"\n")
        held.append(data if at < 0 else data[:at + 1])
        if at >= 0:
            break
    if text := b"".join(held):
        yield text


def _named_text(file, ranges: list[tuple[int, int]]) -> Iterator[bytes]:
    """Ranges of virtual offsets, in whole lines as the index names them."""
    for start, end in ranges:
        stream, held, size = BlockStream(file, start), [], 0
        while (place := stream.tell()) < end:
            last = len(stream.data) if stream.block < end >> 16 else end & 0xFFFF
            part = stream.data[stream.at:last]
            if not part and place == stream.tell() and stream.at >= len(stream.data):
                break  # the end of the file
            stream.at += len(part)
            held.append(part)
            size += len(part)
            if size >= BATCH_BYTES:
                text = b"".join(held)
                at = text.rfind(b"\n") + 1
                if at:
                    yield text[:at]
                held, size = [text[at:]], len(text) - at
        if text := b"".join(held):
            yield text


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strandloom_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> LineReader:
        return LineReader(self.options)


def read_lines(
    spark: SparkSession, *paths: str, split_bytes: int = SPLIT_BYTES, tiles: Tiles | None = None
) -> DataFrame:
    """Lines of block-compressed files: value, file (its name), and the place: block, row.

    With ``tiles``, a file that has a position index gives every line that overlaps one of them and some
    around, without its header; one without an index is read whole.
    """
    spark.dataSource.register(LineSource)
    reader = spark.read.format("strandloom_lines").option("paths", "\n".join(paths))
    reader = reader.option("splitBytes", str(split_bytes))
    if tiles is not None:
        reader = reader.option("tiles", tiles_text(tiles))
    return reader.load()
