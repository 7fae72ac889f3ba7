"""Binary alignment files as a data source of Spark: ``spark.read.format("bam")``, split within files, and unmapped files written by partition.

A file is a chain of small compressed blocks, and records may run over their ends. A split owns the records that begin in its
blocks. Where it starts in the middle of a file, it looks for the first block there, whose checksum must hold, and for the
first position from which whole records follow each other. Each split also knows where its last record ends, and fails
unless its successor's search gives that very place; as the first split starts behind the file's header, all are then proven.
Files are opened by their URI, on any file system that pyarrow knows.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from cladeworks.sources.sequences import tag_reads

SCHEMA = "name string, flag int, ref string, pos int, cigar string, seq string, qual string, tags map<string,string>"
ARROW = pa.schema([("name", pa.string()), ("flag", pa.int32()), ("ref", pa.string()), ("pos", pa.int32()), ("cigar", pa.string()), ("seq", pa.string()), ("qual", pa.string()), ("tags", pa.map_(pa.string(), pa.string()))])

# fixed values of the format: start of a block, letters of bases and of cigar steps by number, types of tags
MAGIC = b"\x1f\x8b\x08\x04"
BASES = "=ACMGRSVTWYHKDBN"
STEPS = "MIDNSHP=X"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}

NAME = re.compile(rb"[!-~]*\0")
HEAD = struct.Struct("<iiiBBHHHiiii")
TWO_BASES = [a + b for a in BASES for b in BASES]
NUMBER_OF = bytes(max(BASES.find(chr(c).upper()), 0) if chr(c).upper() in BASES else 15 for c in range(256))
#: Bytes of a block before compression, and how many records must follow each other where a split looks for its start.
BLOCK, CHAIN = 65280, 16


def bgzf(data: bytes) -> bytes:
    """One compressed block."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = MAGIC + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


class Blocks:
    """The blocks and records of one file. A place is (offset of a block, offset in its data); the end is (size of the file, 0)."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.last = file, file.size(), (-1, b"", 0)
        self.references: list[str] = []
        self.first = self.header()

    def bytes_at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def block(self, offset: int) -> tuple[bytes, int]:
        """Data of the block at ``offset`` and where the next one begins."""
        if self.last[0] != offset:
            raw = self.bytes_at(offset, 65536)
            if raw[:4] != MAGIC or len(raw) < 18:
                raise ValueError("no block here")
            stop, at, length = 12 + struct.unpack_from("<H", raw, 10)[0], 12, 0
            while at + 4 <= stop <= len(raw):
                kind, n = raw[at : at + 2], struct.unpack_from("<H", raw, at + 2)[0]
                if kind == b"BC" and n == 2 and at + 6 <= stop:
                    length = struct.unpack_from("<H", raw, at + 4)[0] + 1
                at += 4 + n
            if not stop + 8 < length <= len(raw):
                raise ValueError("a block ends before its length")
            try:
                data = zlib.decompress(raw[stop : length - 8], -15)
            except zlib.error as error:
                raise ValueError("a block does not decompress") from error
            if struct.unpack_from("<II", raw, length - 8) != (zlib.crc32(data), len(data)):
                raise ValueError("a block's checksum is wrong")
            self.last = offset, data, offset + length
        return self.last[1:]

    def header(self) -> tuple[int, int]:
        """Reads the names of references; the place of the first record."""
        data, after = self.block(0)
        start, held = 0, data  # the last block's offset and all data before its end

        def have(n: int) -> bytes:
            nonlocal start, held, data, after
            while len(held) < n:
                if after >= self.size:
                    raise ValueError("the file ends within its header")
                start = after
                data, after = self.block(start)
                held += data
            return held

        if have(12)[:4] != b"BAM\1":
            raise ValueError("not a binary alignment file")
        at = 8 + struct.unpack_from("<i", held, 4)[0]
        n, at = struct.unpack_from("<i", have(at + 4), at)[0], at + 4
        for _ in range(n):
            length = struct.unpack_from("<i", have(at + 4), at)[0]
            self.references.append(have(at + 8 + length)[at + 4 : at + 3 + length].decode())
            at += 8 + length
        return start, at - (len(held) - len(data))

    def plausible(self, head: bytes) -> int:
        """The length that a record's first bytes state."""
        size, ref, pos, name, _, _, steps, _, bases, mate, mate_pos, _ = HEAD.unpack(head)
        fits = 32 + name + 4 * steps + (bases + 1) // 2 + bases <= size < 1 << 28
        known = -1 <= ref < len(self.references) and -1 <= mate < len(self.references)
        if not (fits and known and name > 0 and bases >= 0 and pos >= -1 and mate_pos >= -1):
            raise ValueError("no record begins here")
        return 4 + size

    def records(self, place: tuple[int, int]) -> Iterator[tuple[tuple[int, int], bytes]]:
        """(place, record) from ``place`` on; the last one is (end, no bytes)."""
        offset, at = place
        data, after = self.block(offset) if offset < self.size else (b"", self.size)
        while True:
            while at >= len(data):
                at, offset = at - len(data), after
                if offset >= self.size:
                    yield (self.size, 0), b""
                    return
                data, after = self.block(offset)
            place, held, need = (offset, at), data[at : at + HEAD.size], HEAD.size
            whole = False
            while True:
                if len(held) >= need:
                    if whole:
                        break
                    need, whole = self.plausible(held[: HEAD.size]), True
                    if place[0] == offset:
                        held = data[at : at + need]
                    continue
                if after >= self.size:
                    raise ValueError("the file ends within a record")
                offset = after
                data, after = self.block(offset)
                held += data
            at = at + need if place[0] == offset else len(data) - (len(held) - need)
            record = held[:need]
            if not NAME.fullmatch(record, HEAD.size, HEAD.size + record[12]):
                raise ValueError("a record's name is not one")
            yield place, record

    def start(self, offset: int) -> tuple[int, int]:
        """The place of the first record in a block at or after ``offset``."""
        if offset <= self.first[0]:
            return next(self.records(self.first))[0]
        offset = self.block_from(offset)
        while offset < self.size:
            data, after = self.block(offset)
            for at in range(len(data)):
                try:
                    for (_, record), _ in zip(self.records((offset, at)), range(CHAIN)):
                        if not record:
                            break
                    return offset, at
                except ValueError:
                    continue
            offset = after
        return self.size, 0

    def block_from(self, offset: int) -> int:
        while offset < self.size:
            window = self.bytes_at(offset, 1 << 17)
            at = window.find(MAGIC)
            if at < 0:
                offset += max(len(window) - 3, 1)
                continue
            try:
                self.block(offset + at)
                return offset + at
            except ValueError:
                offset += at + 1
        return self.size


def tags_of(record: bytes, at: int) -> list[tuple[str, str]]:
    """Tags as the text form of these files writes them, without their types."""
    out = []
    while at < len(record):
        key, kind = record[at : at + 2].decode(), chr(record[at + 2])
        at += 3
        if kind in "ZH":
            stop = record.index(0, at)
            value, at = record[at:stop].decode(), stop + 1
        elif kind == "A":
            value, at = chr(record[at]), at + 1
        elif kind == "B":
            of, n = chr(record[at]), struct.unpack_from("<i", record, at + 1)[0]
            items = struct.unpack_from(f"<{n}{NUMBERS[of]}", record, at + 5)
            value, at = ",".join([of, *(f"{x:g}" if of == "f" else str(x) for x in items)]), at + 5 + struct.calcsize(f"<{n}{NUMBERS[of]}")
        else:
            one = struct.unpack_from("<" + NUMBERS[kind], record, at)[0]
            value, at = f"{one:g}" if kind == "f" else str(one), at + struct.calcsize(NUMBERS[kind])
        out.append((key, value))
    return out


def row(record: bytes, references: list[str]) -> tuple:
    _, ref, pos, name, _, _, steps, flag, bases, _, _, _ = HEAD.unpack_from(record)
    at = HEAD.size + name
    cigar = "".join(f"{x >> 4}{STEPS[x & 15]}" for x in struct.unpack_from(f"<{steps}I", record, at)) or "*"
    at += 4 * steps
    packed = (bases + 1) // 2
    seq = "".join(map(TWO_BASES.__getitem__, record[at : at + packed]))[:bases] or "*"
    at += packed
    qual = record[at : at + bases]
    text = "*" if not bases or qual[0] == 255 else bytes(q + 33 for q in qual).decode("latin-1")
    return record[HEAD.size : HEAD.size + name - 1].decode(), flag, references[ref] if ref >= 0 else "*", pos + 1, cigar, seq, text, tags_of(record, at + bases)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, type=f.type) for column, f in zip(zip(*rows), ARROW)], schema=ARROW)


@dataclass
class Split(InputPartition):
    uri: str
    start: int
    stop: int


def opened(uri: str) -> pa.NativeFile:
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


class BamReader(DataSourceReader):
    def __init__(self, uri: str, split_bytes: int):
        self.uri, self.split_bytes = uri, split_bytes

    def partitions(self) -> list[Split]:
        system, path = fs.FileSystem.from_uri(self.uri)
        root = self.uri[: len(self.uri) - len(path)] if self.uri.endswith(path) else ""
        found = system.get_file_info(path)
        files = system.get_file_info(fs.FileSelector(path, recursive=True)) if found.type == fs.FileType.Directory else [found]
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        kept = sorted((f for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) and "/_temporary" not in f.path), key=lambda f: f.path)
        splits = [Split(root + f.path, at, min(at + self.split_bytes, f.size)) for f in kept for at in range(0, f.size, self.split_bytes)]
        return splits or [Split("", 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if not split.uri:
            return
        with opened(split.uri) as file:
            blocks, rows = Blocks(file), []
            for place, record in blocks.records(blocks.start(split.start)):
                if place[0] >= split.stop or not record:
                    break
                rows.append(row(record, blocks.references))
                if len(rows) == 4096:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)
            if split.stop < blocks.size and split.stop > blocks.first[0] and blocks.start(split.stop) != place:
                raise ValueError(f"{split.uri}: the records after byte {split.stop} do not continue those before it; read it with a larger splitBytes")


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def unmapped(name: str | None, flag: int | None, seq: str | None, qual: str | None, tags: list[tuple[str, str]] | None) -> bytes:
    title = (name or "*").encode()
    if len(title) > 254:
        raise ValueError(f"a name of more than 254 bytes: {name}")
    letters = "" if seq in (None, "*") else seq
    numbers = letters.encode("latin-1").translate(NUMBER_OF) + b"\0" * (len(letters) % 2)
    packed = bytes(a << 4 | b for a, b in zip(numbers[::2], numbers[1::2]))
    if qual in (None, "*") or not letters:
        marks = b"\xff" * len(letters)
    elif len(qual) != len(letters):
        raise ValueError(f"{name}: as many qualities as letters are needed")
    else:
        marks = bytes(ord(q) - 33 for q in qual)
    more = b"".join(key.encode() + b"Z" + value.encode() + b"\0" for key, value in tags or [] if value is not None)
    body = title + b"\0" + packed + marks + more
    return HEAD.pack(32 + len(body), -1, -1, len(title) + 1, 0, 4680, 0, 4 if flag is None else flag, len(letters), -1, -1, 0) + body


class BamWriter(DataSourceArrowWriter):
    """One whole file a partition, written aside and moved into place when all are done."""

    def __init__(self, uri: str, overwrite: bool):
        self.uri, self.overwrite, self.run = uri.rstrip("/"), overwrite, uuid.uuid4().hex

    def aside(self) -> tuple[fs.FileSystem, str, str]:
        system, path = fs.FileSystem.from_uri(self.uri)
        return system, path, f"{path}/_temporary-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _, folder = self.aside()
        system.create_dir(folder, recursive=True)
        name, text = f"part-{uuid.uuid4().hex}.bam", b"@HD\tVN:1.6\tSO:unsorted\n"
        with system.open_output_stream(f"{folder}/{name}") as out:
            out.write(bgzf(b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", 0)))
            held = bytearray()
            for rows in iterator:
                known = rows.schema.names
                columns = [rows.column(known.index(c)).to_pylist() if c in known else [None] * len(rows) for c in ("name", "flag", "seq", "qual", "tags")]
                for record in map(unmapped, *columns):
                    if held and len(held) + len(record) > BLOCK:  # records begin blocks where they fit into them
                        out.write(bgzf(bytes(held)))
                        held.clear()
                    held += record
                    while len(held) > BLOCK:
                        out.write(bgzf(bytes(held[:BLOCK])))
                        del held[:BLOCK]
            if held:
                out.write(bgzf(bytes(held)))
            out.write(bgzf(b""))
        return Written([name])

    def commit(self, messages: list[Written | None]) -> None:
        system, path, folder = self.aside()
        system.create_dir(folder, recursive=True)
        before = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.base_name.endswith(".bam")]
        for message in messages:
            for name in message.files if message else []:
                system.move(f"{folder}/{name}", f"{path}/{name}")
        if self.overwrite:
            for old in before:
                system.delete_file(old)
        system.delete_dir(folder)

    def abort(self, messages: list[Written | None]) -> None:
        system, _, folder = self.aside()
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class BamSource(DataSource):
    """Option ``splitBytes``: how many bytes of a file a task reads, 64 MB by default."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options["path"], int(self.options.get("splitbytes", self.options.get("splitBytes", 1 << 26))))

    def writer(self, schema, overwrite: bool) -> BamWriter:
        return BamWriter(self.options["path"], overwrite)


def read_bam(spark: SparkSession, path: str, split_bytes: int = 1 << 26) -> DataFrame:
    """The columns of ``read_sam`` from a binary file, or all files under a folder; an empty folder gives no rows."""
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("splitBytes", str(split_bytes)).load(path)


def write_bam(reads: DataFrame, path: str, mode: str = "append") -> None:
    """Unmapped records of (name, seq, qual) and, where present, flag and tags (a map of text); other columns are left out.

    A null name is ``*``, null letters are none, null qualities are unknown, null tags are left out; letters that are no base become N.
    """
    reads.sparkSession.dataSource.register(BamSource)
    reads.write.format("bam").mode(mode).save(path)


def fastqs_to_bam(first: DataFrame, second: DataFrame, chemistry: str, path: str) -> None:
    """Pairs of reads as unmapped records with the raw barcodes and UMIs and their qualities as tags CR, CY, UR and UY."""
    tags = {"CR": "cell_raw", "CY": "cell_qual", "UR": "umi_raw", "UY": "umi_qual"}
    pairs = [item for tag, column in tags.items() for item in (F.lit(tag), F.col(column))]
    write_bam(tag_reads(first, second, chemistry).select("name", "seq", "qual", F.create_map(*pairs).alias("tags")), path)
