"""WARC archives compressed record by record with a Zstandard dictionary that the archive itself carries.

An archive begins with a skippable frame that holds the dictionary, trained on some of the archive's own
records; each record follows as a frame of its own, so that any record can be read alone, by its offset.
Tasks write archives under names of their own attempt; the table of written records is the only list of what
counts, so a file of a lost or repeated attempt is never read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialise, scratch

#: Magic number of the skippable frame that carries the dictionary (the WARC-Zstandard convention), and of any dictionary.
SKIPPABLE, DICTIONARY = 0x184D2A5D, b"\x37\xa4\x30\xec"
#: An archive is closed at so many bytes of records; a dictionary is trained on up to so many bytes of its first records.
ARCHIVE_BYTES, TRAIN_BYTES, DICTIONARY_BYTES = 16 << 20, 2 << 20, 64 << 10
LEVEL = 3
WRITTEN = "page_id long, path string, offset long, length long"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path: local for plain and file: paths, else by its scheme."""
    if "://" in path or path.startswith("file:"):
        parts = urlparse(path)
        if parts.scheme == "file":
            return pafs.LocalFileSystem(), unquote(parts.path)
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, row: int) -> str:
    """A record's name: the page and the row's own number, as a page may be there several times."""
    return f"<urn:raingrid:page:{'' if page_id is None else page_id}:{row}>"


def warc_record(page_id: int | None, row: int, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, refers_row: int | None) -> bytes:
    """One record; a revisit (``refers_row`` is given) has the HTTP header of the full payload and no body, and names the record that has it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_row is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, row)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to, refers_row)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """The header fields of a record (names in lower case), its type, and the HTTP header fields and body of its block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return fields | {"body": body, "http": {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}}


def train_dictionary(records: list[bytes]) -> bytes:
    """A dictionary of some records; the raw records themselves where there are too few to train on."""
    sample, size = [], 0
    for r in records:
        if size >= TRAIN_BYTES:
            break
        sample.append(r[: TRAIN_BYTES // 8])
        size += len(sample[-1])
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, size // 8)), sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:DICTIONARY_BYTES] or b"WARC/1.1"


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == DICTIONARY else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(data, dict_type=kind)


def _write_archive(path: str, records: list[bytes]) -> tuple[list[int], list[int]]:
    """Write records to a new archive; the offset and length of each one's frame."""
    words = train_dictionary(records)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(words), write_content_size=True)
    offsets, lengths, at = [], [], 0
    system, name = _open(path)
    system.create_dir(os.path.dirname(name), recursive=True)
    with system.open_output_stream(name, compression=None) as out:
        at += out.write(struct.pack("<II", SKIPPABLE, len(words)) + words)
        for r in records:
            frame = packer.compress(r)
            offsets.append(at)
            lengths.append(len(frame))
            at += out.write(frame)
    return offsets, lengths


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        part, ids, records, size = 0, [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal part, ids, records, size
            path = f"{folder}/{attempt:09d}-{part:05d}.warc.zst"
            offsets, lengths = _write_archive(path, records)
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([path] * len(ids), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["page_id", "path", "offset", "length"])
            part, ids, records, size = part + 1, [], [], 0
            return out

        for batch in batches:
            for page_id, row, url, payload, full, digest, refers_to, refers_row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                records.append(warc_record(page_id, row, url, payload or b"", full, base64.b32encode(digest).decode(), refers_to, refers_row))
                ids.append(page_id)
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
        if records:
            yield close()

    return write


def _page(record: str) -> int | None:
    """The page in a record's name."""
    page = record.split(":")[3]
    return int(page) if page else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each archive of the batch from its first byte: the dictionary, then every frame that its table lists, one after the other to the end of the file."""
    for batch in batches:
        for path, frames in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            system, name = _open(path)
            rows: dict[str, list] = {k: [] for k in _SCHEMA.names}
            with system.open_input_stream(name, compression=None) as file:
                magic, n = struct.unpack("<II", file.read(8))
                if magic != SKIPPABLE:
                    raise ValueError(f"{path}: no leading dictionary frame")
                reader = zstandard.ZstdDecompressor(dict_data=_dictionary(file.read(n)))
                at = 8 + n
                for frame in frames:
                    if frame["offset"] != at:
                        raise ValueError(f"{path}: a record at {frame['offset']}, the one before ends at {at}")
                    r = parse_record(reader.decompress(file.read(frame["length"])))
                    at += frame["length"]
                    revisit = r["warc-type"] == "revisit"
                    digest = r["warc-payload-digest"].removeprefix("sha1:")
                    if not revisit and (base32_sha1(r["body"]) != digest or len(r["body"]) != int(r["http"]["content-length"])):
                        raise ValueError(f"{path}: a payload differs from its digest")
                    rows["page_id"].append(_page(r["warc-record-id"]))
                    rows["payload_bytes"].append(int(r["http"]["content-length"]))
                    rows["payload_digest"].append(digest)
                    rows["record_type"].append(r["warc-type"])
                    rows["refers_to"].append(_page(r["warc-refers-to"]) if revisit else None)
                    rows["record_id"].append(r["warc-record-id"])
                    rows["refers_to_record"].append(r["warc-refers-to"] if revisit else None)
                if file.read(1):
                    raise ValueError(f"{path}: more bytes than records")
            yield pa.RecordBatch.from_pydict(rows, schema=_SCHEMA)


_SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("refers_to_record", pa.string())])


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write a record for each row of ``pages(page_id, url, html, ...)``; returns the table of ``(page_id, path, offset, length)``.

    Of rows whose payloads are equal and have at least ``least_bytes`` bytes, the one with the largest page_id
    is written in full and the others refer to its record. A null html is an empty payload; a null url an empty
    target. Rows that repeat the largest page_id are all written in full, and the others refer to one of them; a
    null page_id is written in full if no other page has its payload and refers to that page if one has. An
    empty table writes no file.
    """
    # a row has a number of its own, written with it, so that a record's name is the same in every attempt
    own = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"").cast("binary")).alias("payload"))
    own = own.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.unhex(F.sha1("payload"))})
    own = materialise(own.withColumn("row", F.monotonically_increasing_id()), "payloads")
    first = (
        own.filter(F.col("size") >= least_bytes)
        .groupBy("digest")
        .agg(F.max(F.struct("page_id", "row")).alias("chosen"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .select("digest", F.col("chosen.page_id").alias("chosen"), F.col("chosen.row").alias("chosen_row"))
    )
    first = materialise(first, "chosen")
    refers = ~F.col("page_id").eqNullSafe(F.col("chosen")) & F.col("chosen_row").isNotNull()
    told = own.join(bounded(first), "digest", "left").withColumns({"refers_to": F.when(refers, F.col("chosen")), "refers_row": F.when(refers, F.col("chosen_row"))})
    told = told.select("page_id", "row", "url", F.when(F.col("refers_row").isNull(), F.col("payload")).alias("payload"), "size", "digest", "refers_to", "refers_row")
    return materialise(told.mapInArrow(_writer(folder), WRITTEN), "written")


#: Tasks of the reading job for each core: archives have about equal bytes, so a task gets several of many.
TASKS_A_CORE = 16


def read_archives(written: DataFrame) -> DataFrame:
    """Read back every archive in the table: ``(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, refers_to_record)``, a row for each record.

    Each payload is checked against its digest and length, each archive against the offsets and lengths written.
    """
    files = materialise(written.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("frames")), "files")
    tasks = max(1, min(files.count(), TASKS_A_CORE * written.sparkSession.sparkContext.defaultParallelism))
    # dealt evenly: their rows are too small for the number of tasks to be told by their size
    return files.repartition(tasks).mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string")


def op6_warc_dictionary(spark, sf_dir: str) -> DataFrame:
    """All of ``pages`` written to archives in the shared folder and read back."""
    read = read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch(spark, "warc")))
    return read.drop("record_id", "refers_to_record")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS chosen FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda k:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + CAST((CAST('0x' || substr(h, 1 + CAST(5 * (k // 4) AS INT), 5) AS BIGINT) >> CAST(5 * (3 - k % 4) AS INT)) & 31 AS INT), 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = chosen THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> chosen THEN chosen END AS refers_to
FROM g
"""
