"""Sources that read a file in parts: block-compressed lines, position indexes, clustered reads."""

import gzip
import random
import struct

import pytest

from strandloom import cli
from strandloom.operators import extract as E, variants as V
from strandloom.plans import prepare
from strandloom.sources import lines as L, reads_table as T
from strandloom.sources.alignments import read_alignments
from strandloom.sources.bam import tile_runs
from strandloom.sources.variants import read_bed, read_vcf, read_vcf_lines
from tests.helpers import READ, _block, read_rows, sam_line, variant_rows


def write_blocks(path, data: bytes, cuts) -> list[int]:
    """Block-compressed file with blocks that end at ``cuts``; returns the compressed start of each."""
    out, starts = b"", []
    for a, b in zip([0, *cuts], [*cuts, len(data)]):
        starts.append(len(out))
        out += _block(data[a:b])
    path.write_bytes(out + _block(b""))
    return starts


def texts(seed):
    rng = random.Random(seed)
    rows = [f"chr{rng.randint(1, 3)}\t{i}\t" + "x" * rng.choice([0, 3, 40, 900]) for i in range(400)]
    data = "\n".join(rows).encode() + rng.choice([b"", b"\n"])
    return rows, data, rng


def read_parts(path, size):
    """Lines of all parts of the given size, in file order, as the source's tasks give them."""
    reader = L.LineReader({"paths": str(path), "splitbytes": str(size)})
    rows = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    assert len({(r["block"], r["row"]) for r in rows}) == len(rows)
    return [r["value"] for r in sorted(rows, key=lambda r: (r["block"], r["row"]))]


@pytest.mark.parametrize("seed", range(4))
def test_every_line_once_however_the_file_is_cut(spark, tmp_path, seed):
    rows, data, rng = texts(seed)
    cuts = sorted(rng.sample(range(1, len(data)), 60))
    ends = [i + 1 for i, c in enumerate(data) if c == 10]
    cuts = sorted({*cuts, *rng.sample(ends, 20)})  # some blocks end with a line
    path = tmp_path / "x.vcf.gz"
    write_blocks(path, data, cuts)
    for size in (1, 97, 1000, 1 << 30):
        assert read_parts(path, size) == rows
    found = L.read_lines(spark, str(path), split_bytes=path.stat().st_size // 7)
    assert found.rdd.getNumPartitions() > 5
    assert [(r["value"], r["file"]) for r in found.orderBy("block", "row").collect()] == [(r, "x.vcf.gz") for r in rows]


def test_small_batches_long_lines_and_line_ends(spark, tmp_path, monkeypatch):
    data = b"a\r\nbb\r\n" + b"c" * 5000 + b"\r\n\r\nd"
    path = tmp_path / "x.gz"
    write_blocks(path, data, [2, 3, 100, 2000, 2001, 5008])
    for size in (1, 60, 1 << 20):
        assert read_parts(path, size) == ["a", "bb", "c" * 5000, "", "d"]
    monkeypatch.setattr(L, "BATCH_BYTES", 10)
    with open(path, "rb") as file:
        import pyarrow as pa
        own = L.LineRange(str(path), 0, 1 << 20)
        assert b"".join(L._own_text(pa.PythonFile(file), own)) == data
    empty = tmp_path / "e.gz"
    write_blocks(empty, b"", [])
    assert L.read_lines(spark, str(empty)).count() == 0


def test_bytes_that_look_like_a_block(spark, tmp_path):
    """The first bytes of a block may occur inside another one, even with its size field."""
    fake = b"\x1f\x8b\x08\x04" + b"\0" * 6 + struct.pack("<HBBHH", 6, 66, 67, 2, 300)
    rows = [f"line {i}" for i in range(200)]
    plain = "\n".join(rows).encode() + b"\n"

    def stored(data: bytes) -> bytes:  # a block whose compressed bytes hold the fake one: a stored gzip part
        body = b"\1" + struct.pack("<HH", len(data), len(data) ^ 0xFFFF) + data
        head = struct.pack("<BBBBIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
        import zlib
        return head + body + struct.pack("<II", zlib.crc32(data), len(data))

    noise = fake.replace(b"\n", b"") + b"\n"
    path = tmp_path / "x.gz"
    path.write_bytes(b"".join(stored(plain[i:i + 150] ) + stored(noise) for i in range(0, len(plain), 150)) + _block(b""))
    whole = gzip.open(path, "rb").read().decode("utf-8", "replace").replace("\r", "\n").removesuffix("\n").split("\n")
    for size in (1, 40, 5000):
        assert read_parts(path, size) == whole


RECORD = "{}\t{}\t.\tA\tC\t9\tPASS\t.\tGT:AD\t0/1:9,9"


def indexed_vcf(path, places):
    """Sorted records with one block each, and a position index."""
    header = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n"
    data, cuts = header.encode(), []
    for chrom, pos in places:
        cuts.append(len(data))
        data += (RECORD.format(chrom, pos) + "\n").encode()
    starts = write_blocks(path, data, cuts)
    ends = [*starts[2:], path.stat().st_size - len(_block(b""))]
    names = sorted({c for c, _ in places})
    out = b"TBI\1" + struct.pack("<8i", len(names), 2, 1, 2, 0, ord("#"), 0, sum(len(n) + 1 for n in names))
    out += b"".join(n.encode() + b"\0" for n in names)
    for name in names:
        bins, linear = {}, {}
        for (chrom, pos), a, b in zip(places, starts[1:], ends):
            if chrom == name:
                bins.setdefault(4681 + (pos - 1 >> 14), []).append((a << 16, b << 16))
                linear.setdefault(pos - 1 >> 14, a << 16)
        out += struct.pack("<i", len(bins))
        for number, chunks in bins.items():
            out += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        out += struct.pack("<i", max(linear) + 1) + b"".join(
            struct.pack("<Q", linear.get(t, 0)) for t in range(max(linear) + 1))
    path.with_name(path.name + ".tbi").write_bytes(_block(out) + _block(b""))


def test_index_prunes_variants_to_regions(spark, tmp_path):
    rng = random.Random(2)
    places = sorted((rng.choice(["chr1", "chr2"]), rng.randint(1, 3_000_000)) for _ in range(500))
    path = tmp_path / "calls.vcf.gz"
    indexed_vcf(path, places)
    bed = tmp_path / "r.bed"
    bed.write_text("chr1\t100000\t160000\nchr1\t150000\t170000\nchr2\t2000000\t2000500\nchr9\t1\t5\n")
    regions = read_bed(spark, str(bed))
    tiles = tile_runs(regions, "start", "end")
    whole = V.variants_from_records(read_vcf(spark, str(path)), 0, regions)
    pruned = read_vcf(spark, str(path), tiles=tiles)
    want = sorted((r["chrom"], r["pos"]) for r in whole.collect())
    assert len(want) > 3
    assert sorted((r["chrom"], r["pos"]) for r in V.variants_from_records(pruned, 0, regions).collect()) == want
    assert pruned.count() < 40 < read_vcf(spark, str(path)).count() == 500
    assert {r["vcf_source_id"] for r in pruned.select("vcf_source_id").collect()} == {"calls"}
    assert read_vcf(spark, str(path), tiles={"chrX": [(0, 3)]}).count() == 0


def test_block_compressed_and_plain_files_together(spark, tmp_path):
    lines = ["##x"] + [RECORD.format("chr1", p) for p in range(100, 160)]
    text = "\n".join(lines) + "\n"
    write_blocks(tmp_path / "a.vcf.gz", text.encode(), [500, 501, 900])
    (tmp_path / "b.vcf.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "c.vcf").write_text(text)
    assert L.is_block_compressed(str(tmp_path / "a.vcf.gz"))
    assert not L.is_block_compressed(str(tmp_path / "b.vcf.gz")) and not L.is_block_compressed(str(tmp_path))
    found = read_vcf(spark, *(str(tmp_path / n) for n in ("a.vcf.gz", "b.vcf.gz", "c.vcf")))
    counts = {r["vcf_source_id"]: r["count"] for r in found.groupBy("vcf_source_id").count().collect()}
    assert counts == {"a": 60, "b": 60, "c": 60}
    order = [r["line"] for r in read_vcf_lines(spark, str(tmp_path / "a.vcf.gz")).orderBy("ord").collect()]
    assert order == lines
    prepare.pass_filter(spark, str(tmp_path / "a.vcf.gz"), str(tmp_path / "passed"))


def scanned_rows(df):
    """Rows that left the file scan."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_clustered_reads_are_read_around_windows(spark, tmp_path):
    rng = random.Random(9)
    rows = [dict(READ, qname=f"q{i}", rname=rng.choice(["chr1", "chr2", "chr3"]), pos=rng.randint(1, 20_000_000),
                 cigar=rng.choice(["10M", "5M30000N5M"]), seq="".join(rng.choices("ACGT", k=200)))
            for i in range(6000)]
    reads = read_rows(spark, *rows)
    path = str(tmp_path / "reads.parquet")
    T.write_reads_table(reads, path, row_group_bytes=20_000)
    variants = variant_rows(spark, *[(p, "A", "C") for p in (5_000_000, 5_030_000, 17_000_000)])
    tiles = E.window_tiles(variants, 2000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pruned = read_alignments(spark, path, tiles=tiles)
        assert pruned.columns == read_alignments(spark, path).columns
        assert scanned_rows(read_alignments(spark, path)) == 6000
        assert scanned_rows(pruned) < 1500
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    pairs = [{(r["qname"], r["somatic_pos"]) for r in E.reads_near_variants(t, variants, 2000, 1000).collect()}
             for t in (reads, pruned)]
    assert pairs[0] == pairs[1] and len(pairs[0]) > 3
    assert sorted(r["qname"] for r in read_alignments(spark, path).collect()) == sorted(r["qname"] for r in rows)
    assert read_alignments(spark, path, tiles={}).count() == 0


def test_runs_are_merged_across_the_smallest_gaps():
    tiles = {"a": [(0, 1), (3, 3), (10, 12), (14, 14)], "b": [(5, 5), (100, 101)]}
    assert T.merged_runs(tiles, 99) == tiles
    assert T.merged_runs(tiles, 4) == {"a": [(0, 3), (10, 14)], "b": [(5, 5), (100, 101)]}
    assert T.merged_runs(tiles, 1) == {"a": [(0, 14)], "b": [(5, 101)]}


def test_cluster_reads_command(spark, tmp_path, capsys):
    (tmp_path / "x.sam").write_text("@HD\n" + "\n".join(sam_line(dict(READ, qname=f"q{i}", pos=9 - i)) for i in range(5)) + "\n")
    assert cli.main(["cluster-reads", f"{tmp_path}/x.sam", f"{tmp_path}/out"]) == 1
    assert ".parquet" in capsys.readouterr().err
    assert cli.main(["cluster-reads", f"{tmp_path}/x.sam", f"{tmp_path}/out.parquet"]) == 0
    assert sorted(r["pos"] for r in read_alignments(spark, f"{tmp_path}/out.parquet").collect()) == [5, 6, 7, 8, 9]
