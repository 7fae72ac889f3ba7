"""WARC archives with a Zstandard dictionary: written by Spark tasks into the shared folder, and read back.

Each file begins with a skippable frame (magic 0x184D2A5D) that holds a dictionary trained on a bounded sample of the
file's own records; then every record is a frame of its own, compressed with it, so that one record can be read alone.
Of records with one payload the smallest id is a response and the others are revisits without payload.

A task writes under a name that has its attempt number, and reports the name only when the file is whole. The reader
takes files that were reported, so files of lost or repeated tasks do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.llm.shared import scratch

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
DICTIONARY_BYTES, SAMPLE_BYTES, FILE_BYTES, LEVEL = 48 << 10, 2 << 20, 24 << 20, 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(identifier: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", identifier or "")
    return int(found[1]) if found else None


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One record; the HTTP block names the payload's length also where the payload is left out."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES, sample: int = SAMPLE_BYTES) -> zstandard.ZstdCompressionDict:
    """Trained on records spread over the file, ``sample`` bytes at most; too few to train on serve as they are."""
    step, some, held = max(1, sum(map(len, records)) // sample), [], 0
    for record in records[::step]:
        some.append(record[: 64 << 10])
        held += len(some[-1])
        if held >= sample:
            break
    try:
        if len(some) >= 16:
            return zstandard.train_dictionary(min(size, max(1024, held // 8)), some)
    except zstandard.ZstdError:
        pass
    return zstandard.ZstdCompressionDict(b"".join(some)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], level: int = LEVEL) -> bytes:
    """A file: the dictionary in a skippable frame, then a frame for each record."""
    shared = dictionary(records)
    packed = zstandard.ZstdCompressor(level=level).compress(shared.as_bytes())
    one = zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(packed)), packed, *map(one.compress, records)])


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file; a damaged file raises."""
    if not data:
        return
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("the leading dictionary frame is missing")
    packed = data[8 : 8 + size]
    content = zstandard.ZstdDecompressor().decompress(packed) if packed[:4] == struct.pack("<I", FRAME) else packed
    reader, rest = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content)), memoryview(data)[8 + size :]
    while len(rest):
        frame = reader.decompressobj()
        record = frame.decompress(rest)
        if not frame.eof:
            raise ValueError("a record is cut off")
        rest = rest[len(rest) - len(frame.unused_data) :]
        head, _, body = record.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines)
        length = int(headers["Content-Length"])
        if version != "WARC/1.1" or body[length:] != b"\r\n\r\n":
            raise ValueError("a record is malformed")
        yield headers, body[:length]


def sha1_160(payload: Column) -> Column:
    return F.unhex(F.sha1(payload))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES, content_hash: Callable[[Column], Column] = sha1_160) -> DataFrame:
    """Write a record per row into ``folder``; returns the manifest (file, records), itself written beside the files.

    Null html is an empty payload. A null url leaves the record without target; a null id leaves it without a number,
    and such a row is never what others refer to unless all ids of its payload are null. Repeated rows of one id all
    carry that id; those of the smallest id are all responses, also where their payloads differ. Payloads are equal where
    their SHA-1, 64 bits of another hash and their lengths are.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    # made SHA-1 collisions differ in the other two
    rows = rows.withColumn("same", F.struct(content_hash(F.col("payload")).alias("hash"), F.xxhash64("payload").alias("check"), F.length("payload").alias("size")))
    first = rows.groupBy("same").agg(F.min("page_id").alias("first"))
    dealt = rows.join(first, "same").select("page_id", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, files, waiting, held = TaskContext.get(), 0, [], 0
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)

        def put() -> pa.RecordBatch:
            nonlocal files, held
            name = f"part-{task.partitionId():06d}-{files:04d}-{task.taskAttemptId()}.warc.zst"
            with store.open_output_stream(f"{base}/.{name}", compression=None) as out:
                out.write(archive(waiting))
            store.move(f"{base}/.{name}", f"{base}/{name}")
            count, files, held = len(waiting), files + 1, 0
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], ["file", "records"])

        for batch in batches:
            for page, url, payload, least in zip(*(column.to_pylist() for column in batch.columns)):
                revisit = len(payload) >= min_revisit_bytes and page != least
                waiting.append(warc_record(page, url, payload, base32_sha1(payload), least, revisit))
                held += len(waiting[-1])
                if held >= file_bytes:
                    yield put()
        if waiting:
            yield put()

    manifest = dealt.mapInArrow(run, "file string, records long")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema("file string, records long").parquet(f"{folder}/manifest")


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload) of every record of the files in the manifest.

    The payload of every response is hashed again; a difference raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns):
                rows = []
                for headers, block in records_of(content.as_py()):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    length, digest, kind = int(re.search(rb"Content-Length: (\d+)", head)[1]), headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                    if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
                        raise ValueError(f"{path}: a payload differs from its digest")
                    rows.append((page_of(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), length, digest, kind, page_of(headers.get("WARC-Refers-To")), path.as_py().rpartition("/")[2], *[payload] * with_payload))
                for at in range(0, len(rows), 2000):
                    columns = zip(*rows[at : at + 2000])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), *[pa.binary()] * with_payload]
    names = ["page_id", "target_uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", *["payload"] * with_payload]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    rows = files.mapInArrow(run, "page_id long, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string" + ", payload binary" * with_payload)
    return rows.join(manifest.select("file"), "file", "left_semi").drop("file")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back. Pages of any length are written whole. An empty table gives an empty result."""
    spark = pages.sparkSession
    folder = scratch(spark, "archives")
    manifest = write_archives(pages, folder, id_col, url_col, html_col, min_revisit_bytes)
    if manifest.isEmpty():
        return spark.createDataFrame([], "page_id long, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_archives(spark, folder, manifest)


