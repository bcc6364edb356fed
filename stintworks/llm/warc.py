"""Web archives as Zstandard frames: one frame per record, the dictionary in a leading skippable frame.

``write_archives`` stores pages as WARC records; pages with equal payloads are stored once and revisited.
``read_archives`` loads the dictionary of each archive, decodes frame by frame with a buffer of a few
records, and checks headers, lengths and digests. Tasks name archives after their own attempt, and only
finished tasks list theirs, so files that a lost task left behind are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from stintworks.workspace import materialize, new_path

# Frame numbers of the Zstandard format, and of the dictionary frame of web archives.
FRAME, SKIPPABLE, DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Payloads of fewer bytes are never revisited.
LEAST_REVISIT = 1000
# Bytes of records in an archive before the next begins; bound of the dictionary and of the sample it is trained on.
ARCHIVE_BYTES = 24 << 20
DICTIONARY_BYTES, SAMPLE_BYTES = 16 << 10, 1 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
_READ = 4 << 20


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri:
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)


def _sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """Header values stay on their line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {_clean(v)}".encode() for k, v in headers), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit of ``refers_to`` with the HTTP head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", url))
    headers.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    headers.append(("Content-Type", "application/http; msgtype=response"))
    return record(headers, head if refers_to is not None else head + payload)


def train_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """From evenly spaced records, as many as the sample holds. None if they are too few to train on."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    samples = [r[: SAMPLE_BYTES // 8] for r in records[::step]]
    if len(samples) < 16:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return None


def archive(records: list[bytes]) -> bytes:
    """The bytes of one archive."""
    dictionary = train_dictionary(records)
    out = []
    if dictionary:
        content = dictionary.as_bytes()
        out.append(struct.pack("<II", DICTIONARY, len(content)) + content)
        dictionary.precompute_compress(level=LEVEL)
    options = {"dict_data": dictionary} if dictionary else {}
    frames = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True, **options)
    return b"".join([*out, *map(frames.compress, records)])


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write one record per row of ``pages``; gives ``path, records, bytes`` of the archives.

    Of rows with equal payloads of at least ``LEAST_REVISIT`` bytes the largest id is the response, the others
    revisit it (rows that repeat its id are responses too). NULL payload counts as empty; a NULL URL leaves
    out the header; with NULL ids alone, all are responses. Empty tables make no archive.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    large = F.octet_length("payload") >= LEAST_REVISIT
    groups = rows.filter(large).groupBy(F.sha2("payload", 256).alias("same")).agg(F.max("page_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups.filter("n > 1").drop("n"), "warc-revisits")  # its size lets Spark choose the join
    same = F.when(large, F.sha2("payload", 256)).otherwise(F.concat_ws(" ", F.lit("small"), "page_id"))  # spread by id
    rows = rows.withColumn("same", same).join(groups, "same", "left").select("page_id", "url", "payload", F.sha1("payload").alias("digest"), "keep_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        records: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{name}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            content = archive([info, *records])
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(content)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{name}"]), pa.array([len(records)], pa.int64()), pa.array([len(content)], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, body, digest, keep = (batch.column(k)[i].as_py() for k in range(5))
                records.append(page_record(page_id, url, body, digest, None if keep == page_id else keep))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    records, size = [], 0
        if records:
            yield close()

    return materialize(rows.mapInArrow(write, "path string, records long, bytes long"), "warc-archives")


def frame_end(data: bytes, start: int) -> int | None:
    """Where the frame at ``start`` ends, read from its block headers; None if ``data`` ends before."""
    if len(data) < start + 18 and len(data) < start + 8:
        return None
    magic, size = struct.unpack_from("<II", data, start)
    if magic & 0xFFFFFFF0 == SKIPPABLE:
        return start + 8 + size if len(data) >= start + 8 + size else None
    if magic != FRAME:
        raise ValueError(f"no frame at byte {start}")
    head = data[start : start + 18]
    try:
        at = start + zstandard.frame_header_size(head)
        checksum = zstandard.get_frame_parameters(head).has_checksum
    except zstandard.ZstdError:
        return None
    last = False
    while not last:
        if len(data) < at + 3:
            return None
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind = bool(block & 1), block >> 1 & 3
        if kind == 3:
            raise ValueError(f"bad block at byte {at}")
        at += 3 + (1 if kind == 1 else block >> 3)
    at += 4 * checksum
    return at if len(data) >= at else None


def frames(stream) -> Iterator[bytes]:
    """Each frame of an open file; the buffer grows only to the longest frame."""
    data, at, more = b"", 0, True
    while True:
        end = frame_end(data, at) if len(data) - at >= 8 else None
        if end is not None:
            yield data[at:end]
            at = end
        elif more:
            new = stream.read(_READ)
            more = bool(new)
            data, at = data[at:] + new, 0
        elif at < len(data):
            raise ValueError("the archive ends inside a frame")
        else:
            return


def load_dictionary(frame: bytes) -> zstandard.ZstdCompressionDict:
    """The dictionary of a skippable frame; it may itself be compressed."""
    content = frame[8:]
    if content[:4] == struct.pack("<I", FRAME):
        content = zstandard.ZstdDecompressor().decompress(content, max_output_size=1 << 27)
    return zstandard.ZstdCompressionDict(content)


def parse(content: bytes) -> dict:
    """Fields of one record. Raises ValueError if version, headers, lengths or payload digest are wrong."""
    head, found, rest = content.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("headers do not end")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/1."):
        raise ValueError("no WARC version")
    headers = {}
    for line in lines:
        key, colon, value = line.partition(b":")
        if not colon or not key or key != key.strip():
            raise ValueError("a header line has no name")
        headers[key.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    for key in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not headers.get(key):
            raise ValueError(f"{key} is missing")
    if not re.fullmatch(r"[0-9]+", headers["content-length"]):
        raise ValueError("content-length is no number")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("content-length does not fit the record")
    out = {"record_type": headers["warc-type"], "record_id": headers["warc-record-id"], "target_uri": headers.get("warc-target-uri"), "refers_to": headers.get("warc-refers-to"), "payload": None, "payload_bytes": None, "payload_digest": None}
    if out["record_type"] in ("response", "revisit"):
        http, found, payload = rest[:size].partition(b"\r\n\r\n")
        length = re.search(rb"(?im)^content-length:\s*([0-9]+)\s*$", http)
        if not found or not length:
            raise ValueError("the HTTP head has no length")
        digest = headers.get("warc-payload-digest", "")
        if not digest.startswith("sha1:"):
            raise ValueError("no sha1 payload digest")
        out["payload_bytes"] = int(length[1])
        out["payload_digest"] = base64.b32decode(digest[5:]).hex()
        if out["record_type"] == "response":
            if len(payload) != out["payload_bytes"]:
                raise ValueError("the HTTP length does not fit the payload")
            if digest[5:] != _sha1(payload):
                raise ValueError("the payload digest does not fit")
            out["payload"] = payload
        elif not out["refers_to"]:
            raise ValueError("a revisit refers to no record")
    return out


_FIELDS = pa.schema(
    [("path", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("error", pa.string())]
)


def read_archive(stream, path: str) -> Iterator[dict]:
    """Records of one archive in order. A record that is not valid becomes a row with ``error``; so does a
    broken file, once, at the place where it breaks."""
    decoder, first = zstandard.ZstdDecompressor(), True
    try:
        for frame in frames(stream):
            magic = struct.unpack_from("<I", frame)[0]
            if magic == DICTIONARY and first:
                decoder = zstandard.ZstdDecompressor(dict_data=load_dictionary(frame))
            first = False
            if magic != FRAME:
                continue
            row = {"path": path}
            try:
                known = zstandard.frame_content_size(frame) >= 0
                row |= parse(decoder.decompress(frame) if known else decoder.decompressobj().decompress(frame))
            except (ValueError, zstandard.ZstdError) as problem:
                row["error"] = str(problem)
            yield row
    except (ValueError, zstandard.ZstdError) as problem:
        yield {"path": path, "error": str(problem)}


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the archives in column ``path``: type, id, URI, payload with length and SHA-1 (hex), error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = file_system(path)
                with store.open_input_stream(place, compression=None) as stream:
                    rows, size = [], 0
                    for row in read_archive(stream, path):
                        size += len(row.get("payload") or b"")
                        rows.append(row if with_payload else row | {"payload": None})
                        if len(rows) == 1000 or size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _FIELDS)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, _FIELDS)

    kinds = "path string, record_type string, record_id string, target_uri string, refers_to string, payload binary, payload_bytes long, payload_digest string, error string"
    paths = archives.select("path")
    return paths.repartition(max(1, min(10_000, archives.count()))).mapInArrow(read, kinds)


def page_of(urn: str) -> F.Column:
    """The page id in a record id that ``write_archives`` made."""
    digits = F.regexp_extract(urn, r"^<urn:page:(-?[0-9]+)>$", 1)
    return F.when(digits != "", digits.cast("long"))


def pages_of(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, error`` of the page records."""
    rows = records.filter("record_type IS NULL OR record_type IN ('response', 'revisit')")
    return rows.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"), "error")
