"""Small inputs for the tests: site rows, reads, and a writer of BAM files."""

import struct
import zlib

from strandloom.schema import READS, SITES

SITE = dict(
    chrom="chr1", methyl_pos=100, somatic_pos=90, variant_type="SNV", vcf_source_id="tp",
    bam_source_id="tumor", somatic_allele_type="ref", somatic_base_at_variant="A",
    haplotype_tag="1", meth_call=0.5, meth_state="mid", strand="+", read_id="r1",
)
READ = dict(
    bam_source_id="tumor", ord=(0, 0), qname="r", flag=0, rname="chr1", pos=101, mapq=60,
    cigar="10M", seq="ACGTACGTAC", mm=None, ml=None, hp_type=None, hp_value=None, orig_hp=None,
    ps=None, legacy_mm=False,
)
READ_A = dict(
    READ, qname="A", cigar="3S5M2I4M1D3M", seq="TTTACGTCCCGACGCGA", mm="C+m,0,1,2;",
    ml=[204, 100, 51],
)
READ_B = dict(
    READ, qname="B", pos=201, flag=16, cigar="10M", seq="ACGTCGATCG", mm="C+m,1,0;", ml=[255, 0]
)
READ_C = dict(
    READ, qname="C", pos=301, cigar="4M", seq="ACGT", mm="C+m,0;C+h,0;", ml=[200, 40]
)


def table(spark, schema, template, *rows):
    filled = [dict(template, **row) for row in rows]
    return spark.createDataFrame([tuple(r[f] for f in schema.names) for r in filled], schema)


def site_rows(spark, *rows):
    return table(spark, SITES, SITE, *rows)


def read_rows(spark, *rows):
    numbered = [dict(row, ord=(0, i)) for i, row in enumerate(rows)]
    return table(spark, READS, READ, *numbered)


def variant_rows(spark, *rows):
    """(pos, ref, alt[, vcf]) on chr1."""
    return spark.createDataFrame(
        [("chr1", r[0], r[1], r[2], "SNV", r[3] if len(r) > 3 else "tp") for r in rows],
        "chrom string, pos int, ref string, alt string, variant_type string, vcf_source_id string",
    )


def near(a, b, tolerance=1e-6):
    return abs(a - b) < tolerance


# --- BAM ---------------------------------------------------------------------------------------


def sam_line(r):
    tags = []
    if r["mm"]:
        tags.append(f"MM:Z:{r['mm']}")
    if r["ml"] is not None:
        tags.append("ML:B:C," + ",".join(map(str, r["ml"])))
    if r["hp_type"]:
        tags.append(f"HP:{r['hp_type']}:{r['hp_value']}")
    if r["ps"]:
        tags.append(f"PS:i:{r['ps']}")
    return "\t".join([
        r["qname"], str(r["flag"]), r["rname"], str(r["pos"]), str(r["mapq"]), r["cigar"], "*", "0",
        "0", r["seq"] or "*", "*", *tags,
    ])


def _bam_record(r, names):
    ops = []
    number = ""
    for c in r["cigar"]:
        if c.isdigit():
            number += c
        else:
            ops.append(int(number) << 4 | "MIDNSHP=X".index(c))
            number = ""
    codes = ["=ACMGRSVTWYHKDBN".index(b) for b in r["seq"]] + [0]
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(r["seq"]), 2))
    name = r["qname"].encode() + b"\0"
    tags = b"NMi" + struct.pack("<i", 3) + b"XFf" + struct.pack("<f", 1.5)
    if r["mm"]:
        tags += b"MMZ" + r["mm"].encode() + b"\0"
    if r["ml"] is not None:
        tags += b"MLBC" + struct.pack("<i", len(r["ml"])) + bytes(r["ml"])
    if r["hp_type"] == "i":
        tags += b"HPc" + struct.pack("<b", int(r["hp_value"]))
    elif r["hp_type"]:
        tags += b"HPZ" + r["hp_value"].encode() + b"\0"
    if r["ps"]:
        tags += b"PSI" + struct.pack("<I", int(r["ps"]))
    body = struct.pack(
        "<iiBBHHHiiii", names.index(r["rname"]), r["pos"] - 1, len(name), r["mapq"], 0, len(ops),
        r["flag"], len(r["seq"]), -1, -1, 0,
    ) + name + struct.pack(f"<{len(ops)}I", *ops) + packed + b"\xff" * len(r["seq"]) + tags
    return struct.pack("<i", len(body)) + body


def _block(data):
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = packer.compress(data) + packer.flush()
    head = struct.pack("<BBBBIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(packed) + 25)
    return head + packed + struct.pack("<II", zlib.crc32(data), len(data))


def write_bam(path, reads, names=("chr1", "chr2"), per_block=2, index=True):
    """Block-compressed file with ``per_block`` records a block; a record may span two blocks."""
    text = b"@HD\tVN:1.6\n"
    header = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(names))
    for n in names:
        header += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 1000000)
    blocks, starts = [_block(header)], []
    size = len(blocks[0])
    for i in range(0, len(reads), per_block):
        data = b"".join(_bam_record(r, list(names)) for r in reads[i:i + per_block])
        starts.append(size << 16)
        for part in (data[:60], data[60:]):
            blocks.append(_block(part))
            size += len(blocks[-1])
    with open(path, "wb") as f:
        f.write(b"".join(blocks) + _block(b""))
    if index:
        chunks = b"".join(struct.pack("<QQ", *c) for c in zip(starts, [*starts[1:], size << 16]))
        with open(path + ".bai", "wb") as f:
            f.write(b"BAI\1" + struct.pack("<i", len(names)))
            f.write(struct.pack("<iIi", 1, 4681, len(starts)) + chunks + struct.pack("<i", 0))
            f.write(struct.pack("<ii", 0, 0) * (len(names) - 1))
    return [*starts, size << 16]


def write_index(path, reads, places, lengths, names=("chr1", "chr2")):
    """Index of a file with one record a block; ``places`` holds the starts and the end of the last."""
    out = b"BAI\1" + struct.pack("<i", len(names))
    for name in names:
        bins, linear = {}, {}
        for i, (r, length) in enumerate(zip(reads, lengths)):
            if r["rname"] != name:
                continue
            low, high = r["pos"] - 1, r["pos"] - 2 + length
            number = next(o + (low >> b) for b, o in (
                (14, 4681), (17, 585), (20, 73), (23, 9), (26, 1), (29, 0)) if low >> b == high >> b)
            bins.setdefault(number, []).append((places[i], places[i + 1]))
            for tile in range(low >> 14, (high >> 14) + 1):
                linear[tile] = min(linear.get(tile, places[i]), places[i])
        out += struct.pack("<i", len(bins) + 1)
        for number, chunks in bins.items():
            out += struct.pack("<Ii", number, len(chunks))
            out += b"".join(struct.pack("<QQ", *c) for c in chunks)
        out += struct.pack("<IiQQQQ", 37450, 2, 0, 0, 0, 0)
        tiles = max(linear) + 1 if linear else 0
        out += struct.pack("<i", tiles) + b"".join(struct.pack("<Q", linear.get(t, 0)) for t in range(tiles))
    with open(path + ".bai", "wb") as f:
        f.write(out)
