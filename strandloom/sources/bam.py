"""Binary alignment files (BAM) as a Spark data source.

A file is read in parallel at record starts taken from its index, so each task decodes its own
compressed range. Given tiles of the genome, only the ranges are read that the index names for them.
Without an index a file is one task and read whole.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from strandloom.schema import READS

SPLIT_BYTES = 64 * 1024 * 1024
BATCH_ROWS = 2000
BATCH_BYTES = 8 * 1024 * 1024

#: Runs of tiles per chromosome: (first, last), in order, last included.
Tiles = dict[str, list[tuple[int, int]]]

# Fixed values of the format.
CIGAR_OPS = "MIDNSHP=X"
BASES = np.frombuffer(b"=ACMGRSVTWYHKDBN", dtype=np.uint8)
NUMBER_TAGS = {
    "c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f",
}
# A tile is the unit of the linear index. Bins: bits of the width of a level, and its first number.
TILE_BITS = 14
BIN_LEVELS = ((29, 0), (26, 1), (23, 9), (20, 73), (17, 585), (14, 4681))
PSEUDO_BIN = 37450
ARRAY_TYPES = {"c": "i1", "C": "u1", "s": "<i2", "S": "<u2", "i": "<i4", "I": "<u4", "f": "<f4"}


def _open(path: str):
    if "://" in path or path.startswith("file:"):
        fs, local = pafs.FileSystem.from_uri(path)
    else:
        fs, local = pafs.LocalFileSystem(), path
    return fs.open_input_file(local)


def _exists(path: str) -> bool:
    try:
        _open(path).close()
        return True
    except FileNotFoundError:
        return False


class BlockStream:
    """Bytes of a block-compressed file from a virtual offset on."""

    def __init__(self, file, offset: int = 0):
        self.file = file
        self.next_block = offset >> 16
        self.block = 0
        self.data, self.at = b"", 0
        if offset & 0xFFFF:
            self._load()
            self.at = offset & 0xFFFF

    def _load(self) -> bool:
        """Decompress the next block; blocks are independent gzip members."""
        self.file.seek(self.next_block)
        head = self.file.read(12)
        if len(head) < 12:
            return False
        extra = self.file.read(struct.unpack_from("<H", head, 10)[0])
        size, at = None, 0
        while at < len(extra):
            tag, length = extra[at:at + 2], struct.unpack_from("<H", extra, at + 2)[0]
            if tag == b"BC":
                size = struct.unpack_from("<H", extra, at + 4)[0] + 1
            at += 4 + length
        if size is None:
            raise ValueError("not a block-compressed file")
        body = self.file.read(size - 12 - len(extra))
        self.block, self.next_block = self.next_block, self.next_block + size
        self.data, self.at = zlib.decompress(body[:-8], wbits=-15), 0
        return True

    def tell(self) -> int:
        """Virtual offset of the next byte."""
        while self.at >= len(self.data):
            if not self._load():
                return self.next_block << 16
        return (self.block << 16) | self.at

    def read(self, size: int) -> bytes:
        parts = []
        while size:
            if self.at >= len(self.data):
                if not self._load():
                    break
                continue
            part = self.data[self.at:self.at + size]
            self.at += len(part)
            size -= len(part)
            parts.append(part)
        return parts[0] if len(parts) == 1 else b"".join(parts)


def _read_header(stream: BlockStream) -> list[str]:
    """Reference names; leaves the stream at the first record."""
    if stream.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    stream.read(struct.unpack("<i", stream.read(4))[0])
    names = []
    for _ in range(struct.unpack("<i", stream.read(4))[0]):
        length = struct.unpack("<i", stream.read(4))[0]
        names.append(stream.read(length)[:-1].decode())
        stream.read(4)
    return names


class Index:
    """Chunks (virtual offsets) by reference and bin, and the linear index, of a BAI file."""

    def __init__(self, data: bytes):
        if data[:4] != b"BAI\1":
            raise ValueError("not a BAI index")
        self.chunks: list[dict[int, np.ndarray]] = []
        self.linear: list[np.ndarray] = []
        at = 8
        for _ in range(struct.unpack_from("<i", data, 4)[0]):
            bins, chunks = struct.unpack_from("<i", data, at)[0], {}
            at += 4
            for _ in range(bins):
                number, count = struct.unpack_from("<Ii", data, at)
                at += 8
                if number != PSEUDO_BIN:  # which holds counts, not places
                    chunks[number] = np.frombuffer(data, "<u8", 2 * count, at).reshape(-1, 2)
                at += 16 * count
            size = struct.unpack_from("<i", data, at)[0]
            self.chunks.append(chunks)
            self.linear.append(np.frombuffer(data, "<u8", size, at + 4))
            at += 4 + 8 * size

    def starts(self) -> list[int]:
        """Record starts named by the index, in file order."""
        return sorted({int(c[0]) for bins in self.chunks for chunks in bins.values() for c in chunks})

    def ranges(self, names: list[str], tiles: Tiles) -> list[tuple[int, int]]:
        """Disjoint ranges, in file order, with every record that overlaps one of the tiles."""
        found = []
        for ref, name in enumerate(names[:len(self.chunks)]):
            for first, last in tiles.get(name, ()):
                low, high = first << TILE_BITS, ((last + 1) << TILE_BITS) - 1
                linear = self.linear[ref]
                least = int(linear[first]) if first < len(linear) else 0
                for bits, offset in BIN_LEVELS:
                    wanted = range(offset + (low >> bits), offset + (high >> bits) + 1)
                    for number in wanted:
                        chunks = self.chunks[ref].get(number, ())
                        found += [(int(a), int(b)) for a, b in chunks if b > least]
        merged: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged


def tile_runs(spans: DataFrame, low: str, high: str, bits: int = TILE_BITS) -> Tiles:
    """Runs of genome tiles of 2**``bits`` bases that half-open spans touch, by chromosome.

    The driver holds them: their number is bounded by the length of the genome, whatever the number
    of spans.
    """
    tile = lambda c: F.shiftright(c, bits)
    touched = spans.select("chrom", F.explode(
        F.sequence(tile(F.col(low)), tile(F.col(high) - 1))
    ).alias("tile")).distinct()
    runs: Tiles = {}
    for chrom, at in touched.orderBy("chrom", "tile").collect():
        found = runs.setdefault(chrom, [])
        if found and found[-1][1] == at - 1:
            found[-1] = (found[-1][0], at)
        else:
            found.append((at, at))
    return runs


def tiles_text(tiles: Tiles) -> str:
    return "\n".join(
        f"{name}\t" + ",".join(f"{a}-{b}" for a, b in runs) for name, runs in tiles.items()
    )


def _parse_tiles(text: str) -> Tiles:
    tiles: Tiles = {}
    for part in filter(None, text.split("\n")):
        name, runs = part.rsplit("\t", 1)
        tiles[name] = [tuple(map(int, run.split("-"))) for run in runs.split(",")]
    return tiles


def _tags(data: bytes) -> dict[str, tuple[str, object]]:
    """Tags of one record: name → (type, value); arrays stay NumPy arrays."""
    tags, at = {}, 0
    while at + 3 <= len(data):
        name, kind = data[at:at + 2].decode("latin-1"), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            value, at = data[at:end].decode("latin-1"), end + 1
        elif kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind == "B":
            item, count = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            value = np.frombuffer(data, ARRAY_TYPES[item], count, at + 5)
            at += 5 + value.nbytes
        else:
            code = NUMBER_TAGS[kind]
            value, at = struct.unpack_from(code, data, at)[0], at + struct.calcsize(code)
        tags.setdefault(name, (kind, value))
    return tags


def _record(data: bytes, place: int, names: list[str], sample: str | None) -> dict:
    ref, pos, name_len, mapq, _, ops, flag, length = struct.unpack_from("<iiBBHHHi", data, 0)
    at = 32 + name_len
    cigar = np.frombuffer(data, "<u4", ops, at)
    at += 4 * ops
    packed = np.frombuffer(data, np.uint8, (length + 1) // 2, at)
    codes = np.empty(2 * len(packed), np.uint8)
    codes[0::2], codes[1::2] = packed >> 4, packed & 15
    at += len(packed) + length
    tags = _tags(data[at:])
    if "CG" in tags:  # CIGARs with more than 65535 operations are kept in a tag
        cigar = tags["CG"][1]
    ml = tags.get("ML", tags.get("Ml", (None, None)))[1]
    hp_kind, hp = tags.get("HP", (None, None))
    text = lambda tag: None if tag not in tags else str(tags[tag][1])
    return {
        "bam_source_id": sample,
        "ord": {"block": place >> 16, "row": place & 0xFFFF},
        "qname": data[32:32 + name_len - 1].decode("latin-1"),
        "flag": flag,
        "rname": names[ref] if ref >= 0 else "*",
        "pos": pos + 1,
        "mapq": mapq,
        "cigar": "".join(f"{c >> 4}{CIGAR_OPS[c & 15]}" for c in cigar.tolist()) or "*",
        "seq": BASES[codes[:length]].tobytes().decode("ascii"),
        "mm": text("MM") if "MM" in tags else text("Mm"),
        "ml": None if ml is None else ml.astype(np.int32),
        "hp_type": None if hp_kind is None else ("i" if hp_kind in NUMBER_TAGS else hp_kind),
        "hp_value": None if hp is None else str(hp),
        "orig_hp": text("or"),
        "ps": text("PS"),
        "legacy_mm": "MM" not in tags and "Mm" in tags,
    }


class BamRange(InputPartition):
    """Ranges of virtual offsets of one file; None is the first record, or the end of the file."""

    def __init__(self, path: str, ranges: list[tuple[int | None, int | None]]):
        self.path, self.ranges = path, ranges


def _cut(ranges: list[tuple], starts: list[int], size: int) -> list[list[tuple]]:
    """Ranges put together to about ``size`` compressed bytes; longer ones are cut at ``starts``."""
    pieces = []
    for a, b in ranges:
        last = a if a is not None else next(iter(starts), 0)
        for start in starts[bisect_right(starts, last):]:
            if b is not None and start >= b:
                break
            if (start >> 16) - (last >> 16) >= size:
                pieces.append((a, start))
                a = last = start
        pieces.append((a, b))
    groups, held = [], 0
    for a, b in pieces:
        length = size if b is None else (b >> 16) - ((a or 0) >> 16) + 1
        if not groups or held + length > size:
            groups.append([])
            held = 0
        groups[-1].append((a, b))
        held += length
    return groups


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["paths"].split("\n")
        self.sample = options.get("sample")
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.tiles = None if "tiles" not in options else _parse_tiles(options["tiles"])
        self.head = None if "head" not in options else int(options["head"])

    def partitions(self) -> list[BamRange]:
        found = []
        for path in self.paths:
            place = next((p for p in (path + ".bai", path[:-4] + ".bai") if _exists(p)), None)
            if place is None or self.head is not None:
                found.append(BamRange(path, [(None, None)]))
                continue
            with _open(place) as f:
                index = Index(f.read())
            ranges: list[tuple] = [(None, None)]
            if self.tiles is not None:
                with _open(path) as f:
                    ranges = index.ranges(_read_header(BlockStream(f)), self.tiles)
            found += [BamRange(path, g) for g in _cut(ranges, index.starts(), self.split_bytes)]
        return found or [BamRange(self.paths[0], [])]

    def read(self, partition: BamRange) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(READS)

        def batch(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(column, field.type) for column, field in zip(zip(*rows), schema)],
                schema=schema,
            )

        with _open(partition.path) as file:
            first = BlockStream(file)
            names = _read_header(first)
            rows, held, left = [], 0, self.head
            for start, end in partition.ranges:
                stream = first if start is None else BlockStream(file, start)
                while left is None or left > 0:
                    place = stream.tell()
                    if end is not None and place >= end:
                        break
                    head = stream.read(4)
                    if len(head) < 4:
                        break
                    data = stream.read(struct.unpack("<i", head)[0])
                    record = _record(data, place, names, self.sample)
                    rows.append([record[c] for c in schema.names])
                    held += len(data)
                    left = None if left is None else left - 1
                    if len(rows) == BATCH_ROWS or held >= BATCH_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strandloom_bam"

    def schema(self):
        return READS

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


def read_bam(
    spark: SparkSession, *paths: str, sample: str | None = None, split_bytes: int = SPLIT_BYTES,
    tiles: Tiles | None = None, head: int | None = None,
) -> DataFrame:
    """Records of BAM files.

    With ``tiles``, an indexed file gives every record that overlaps one of them and some around; a
    file without an index is read whole. With ``head``, only so many first records of each file.
    """
    spark.dataSource.register(BamSource)
    reader = spark.read.format("strandloom_bam").option("paths", "\n".join(paths))
    reader = reader.option("splitBytes", str(split_bytes))
    if sample is not None:
        reader = reader.option("sample", sample)
    if tiles is not None:
        reader = reader.option("tiles", tiles_text(tiles))
    if head is not None:
        reader = reader.option("head", str(head))
    return reader.load()
