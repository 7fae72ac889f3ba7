"""Binary alignment files: split anywhere, the same rows as the text form, whole round trips."""

import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cladeworks.sources import bam, sequences


def mapped(name, ref, pos, steps, seq, tags):
    """A record with a place and a cigar, made by hand."""
    plain = bam.unmapped(name, 16, seq, "I" * len(seq), [])
    at = bam.HEAD.size + len(name) + 1
    body = plain[4:at] + b"".join(struct.pack("<I", n << 4 | bam.STEPS.index(k)) for n, k in steps) + plain[at:] + tags
    fixed = bytearray(struct.pack("<i", len(body)) + body)
    struct.pack_into("<ii", fixed, 4, ref, pos)
    struct.pack_into("<H", fixed, 16, len(steps))
    return bytes(fixed)


def file_of(records, block, references=("chr1", "chr2")):
    """Blocks of ``block`` bytes whatever the records' lengths, so that these run over block ends."""
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(references))
    head += b"".join(struct.pack("<i", len(r) + 1) + r.encode() + b"\0" + struct.pack("<i", 1000) for r in references)
    data = head + b"".join(records)
    return b"".join(bam.bgzf(data[i : i + block]) for i in range(0, len(data), block)) + bam.bgzf(b"")


def random_records(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        seq = "".join(rng.choices("ACGTN", k=rng.choice([0, 1, 7, 60, 61, 3000 if i % 50 == 0 else 90])))
        out.append((f"r{i}", bam.unmapped(f"r{i}", 4, seq, "".join(chr(33 + rng.randrange(41)) for _ in seq) or None, [("CB", f"c{i % 7}")])))
    return out


@pytest.mark.parametrize("block", [50, 700, 5000, 65280])
def test_splits_of_any_size_own_each_record_once(tmp_path, block):
    records = random_records(300)
    (tmp_path / "x.bam").write_bytes(file_of([r for _, r in records], block))
    size = (tmp_path / "x.bam").stat().st_size
    for split in (97, 1000, 4096, size - 1, size, 1 << 26):
        if split == 97 and block == 50:
            continue
        reader = bam.BamReader(str(tmp_path / "x.bam"), split)
        got = [name for s in reader.partitions() for b in reader.read(s) for name in b.column("name").to_pylist()]
        assert got == [n for n, _ in records]


def test_mapped_records_equal_the_text_form(spark, tmp_path):
    tags = b"ASc" + struct.pack("<b", -7) + b"NMS" + struct.pack("<H", 300) + b"XAAq" + b"XBBs" + struct.pack("<ihh", 2, -1, 5) + b"XFf" + struct.pack("<f", 0.5) + b"CBZcell\0"
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.bam").write_bytes(file_of([mapped("C_U_3_f", 1, 41, [(2, "S"), (3, "M"), (1, "I")], "ACGTNA", tags)], 65280))
    (tmp_path / "x.sam").write_text("@HD\tVN:1\nC_U_3_f\t16\tchr2\t42\t0\t2S3M1I\t*\t0\t0\tACGTNA\tIIIIII\tAS:i:-7\tNM:i:300\tXA:A:q\tXB:B:s,-1,5\tXF:f:0.5\tCB:Z:cell\n")
    got, text = bam.read_bam(spark, str(tmp_path / "m")), sequences.read_sam(spark, str(tmp_path / "x.sam"))
    assert got.columns == text.columns and got.dtypes == text.dtypes
    assert got.collect() == text.collect()
    row = sequences.molecules_of_names(got).first()
    assert (row.cell, row.umi, row.reads, row.flag) == ("C", "U", 3, "f")


def test_round_trip_with_nulls_long_reads_and_overwriting(spark, tmp_path):
    long = "ACGT" * 40_000  # a record over several blocks
    rows = [("a", "ACGTN", "IIII!", {"CB": "x", "UB": "y"}), (None, None, None, None), ("b", "acgx", None, {}), ("long", long, "F" * len(long), {"CB": "é"})]
    table = spark.createDataFrame(rows, "name string, seq string, qual string, tags map<string,string>").withColumn("extra", F.lit(1))
    path = f"file://{tmp_path}/out"
    bam.write_bam(table.repartition(3), path)
    want = {("a", "ACGTN", "IIII!", "x"), ("*", "*", "*", None), ("b", "ACGN", "*", None), ("long", long, "F" * len(long), "é")}
    read = lambda: {(r.name, r.seq, r.qual, r.tags.get("CB")) for r in bam.read_bam(spark, path, 500).collect()}
    assert read() == want
    bam.write_bam(table, path)
    assert bam.read_bam(spark, path).count() == 8
    bam.write_bam(table.limit(0), path, "overwrite")
    assert bam.read_bam(spark, path).count() == 0
    with pytest.raises(Exception, match="as many qualities"):
        bam.write_bam(spark.createDataFrame([("a", "AC", "I")], "name string, seq string, qual string"), path)
    assert bam.read_bam(spark, path).count() == 0


def test_broken_files_are_errors(tmp_path):
    whole = file_of([r for _, r in random_records(40)], 700)
    (tmp_path / "cut.bam").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "text.bam").write_bytes(b"not a file of this kind, but long enough")
    spoilt = bytearray(whole)
    spoilt[len(whole) // 2] ^= 255
    (tmp_path / "spoilt.bam").write_bytes(bytes(spoilt))
    for name in ("cut", "text", "spoilt"):
        reader = bam.BamReader(str(tmp_path / f"{name}.bam"), 1 << 26)
        with pytest.raises((ValueError, pa.ArrowInvalid)):
            [list(reader.read(s)) for s in reader.partitions()]
    no_marker = whole[: -len(bam.bgzf(b""))]
    (tmp_path / "end.bam").write_bytes(no_marker)
    reader = bam.BamReader(str(tmp_path / "end.bam"), 1000)
    assert sum(len(b) for s in reader.partitions() for b in reader.read(s)) == 40


def test_pairs_of_reads_become_tagged_records(spark, tmp_path):
    reads = spark.createDataFrame([("q", "A" * 12 + "C" * 8 + "G", "I" * 21)], "name string, seq string, qual string")
    bam.fastqs_to_bam(reads, reads, "dropseq", str(tmp_path / "out"))
    assert bam.read_bam(spark, str(tmp_path / "out")).first().tags == {"CR": "A" * 12, "CY": "I" * 12, "UR": "C" * 8, "UY": "I" * 8}
