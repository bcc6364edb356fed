import hashlib
import io
import os

import pytest
import zstandard

from stintworks.llm import warc

BIG = "<p>é " + "same page " * 200


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, payload string, digest string")


ROWS = [(i, f"http://a/{i}", f"<html>{i}" + " word" * (i * 7)) for i in range(60)]
ROWS += [(100, "u", BIG), (101, "u\r\nWARC-Type: x", BIG), (102, None, BIG), (103, "s", "short"), (104, "s", "short"), (105, "e", ""), (106, "n", None)]
ROWS += [(107, "long", "z" * 3_000_000), (None, "no id", "text"), (108, "head", "a\r\n\r\nWARC/1.1\r\n\r\n"), (109, "edge", "x" * 1000), (110, "edge", "x" * 1000), (111, "e", "y" * 999), (112, "e", "y" * 999)]


def wanted(rows):
    keep = {}
    for page_id, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 1000:
            keep[body] = max(keep.get(body, -1), page_id)
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        first = keep.get(body, page_id)
        out.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "response" if first == page_id else "revisit", None if first == page_id else first))
    return sorted(out, key=repr)


def test_round_trip(spark):
    archives = warc.write_archives(pages(spark, ROWS))
    got = warc.pages_of(warc.read_archives(archives)).collect()
    assert all(r["error"] is None for r in got)
    assert sorted((tuple(r)[:5] for r in got), key=repr) == wanted(ROWS)
    records = warc.read_archives(archives).filter("record_type = 'response'").collect()
    bodies = {r["record_id"]: bytes(r["payload"]) for r in records}
    assert bodies["<urn:page:107>"] == b"z" * 3_000_000 and bodies["<urn:page:102>"] == BIG.encode()


def test_unfinished_files_are_not_read(spark, tmp_path):
    archives = warc.write_archives(pages(spark, ROWS[:5]), folder=str(tmp_path / "w"))
    (tmp_path / "w" / "left-behind.warc.zst").write_bytes(b"half a file")
    assert warc.read_archives(archives).filter("error IS NOT NULL").count() == 0


def test_empty_table(spark):
    archives = warc.write_archives(pages(spark, []))
    assert archives.collect() == [] and warc.pages_of(warc.read_archives(archives)).collect() == []


def some_records(n=40):
    return [warc.page_record(i, f"http://a/{i}", f"<html>page {i} ".encode() * 30, hashlib.sha1(f"<html>page {i} ".encode() * 30).hexdigest(), None) for i in range(n)]


def test_the_archive_starts_with_its_dictionary_and_has_a_frame_per_record():
    content = warc.archive(some_records())
    found = list(warc.frames(io.BytesIO(content)))
    assert int.from_bytes(found[0][:4], "little") == warc.DICTIONARY and len(found) == 41
    with pytest.raises(zstandard.ZstdError):  # the records need the dictionary
        zstandard.ZstdDecompressor().decompress(found[1])
    assert all("error" not in r for r in warc.read_archive(io.BytesIO(content), "p"))


def test_a_compressed_dictionary_and_none_at_all():
    content = warc.archive(some_records())
    first, *rest = warc.frames(io.BytesIO(content))
    packed = zstandard.ZstdCompressor().compress(first[8:])
    other = warc.struct.pack("<II", warc.DICTIONARY, len(packed)) + packed + b"".join(rest)
    assert [r.get("payload") for r in warc.read_archive(io.BytesIO(other), "p")] == [r.get("payload") for r in warc.read_archive(io.BytesIO(content), "p")]
    few = warc.archive(some_records(3))
    assert len(list(warc.read_archive(io.BytesIO(few), "p"))) == 3


def test_streamed_frames_without_a_size():
    out = b""
    for r in some_records(3):
        packer = zstandard.ZstdCompressor(write_content_size=False).compressobj()
        out += packer.compress(r) + packer.flush()
    assert len([r for r in warc.read_archive(io.BytesIO(out), "p") if "error" not in r]) == 3


BODY = b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nok"
GOOD = warc.page_record(1, "u", b"ok", hashlib.sha1(b"ok").hexdigest(), None)


@pytest.mark.parametrize(
    "bad,says",
    [
        (GOOD.replace(b"WARC/1.1", b"HTTP/1.1", 1), "version"),
        (GOOD.replace(b"WARC-Date", b"X-Date"), "warc-date"),
        (GOOD.replace(b"WARC-Record-ID", b"X-ID"), "record-id"),
        (GOOD[:-1], "content-length"),
        (GOOD + b"x", "content-length"),
        (GOOD.replace(b"ok\r\n\r\n", b"no\r\n\r\n"), "digest"),
        (GOOD.replace(b"Content-Length: 2", b"Content-Length: 3"), "HTTP length"),
        (GOOD.replace(b"WARC-Type: response", b"WARC-Type: revisit"), "refers"),
        (b"WARC/1.1\r\nno end", "end"),
    ],
)
def test_bad_records_are_rows_with_an_error(bad, says):
    packer = zstandard.ZstdCompressor()
    rows = list(warc.read_archive(io.BytesIO(packer.compress(bad) + packer.compress(GOOD)), "p"))
    assert says.lower() in rows[0]["error"].lower() and rows[1]["payload"] == b"ok"


@pytest.mark.parametrize("cut", [1, 9, 30, -1, -5])
def test_a_cut_archive_ends_in_an_error(cut):
    content = warc.archive(some_records(20))
    rows = list(warc.read_archive(io.BytesIO(content[:cut]), "p"))
    assert rows[-1].get("error")


def test_rubbish_is_an_error():
    assert list(warc.read_archive(io.BytesIO(os.urandom(100)), "p"))[0]["error"]
    assert list(warc.read_archive(io.BytesIO(b""), "p")) == []
