import base64
import hashlib
import io
import struct
import zipfile

import pyarrow as pa
import pytest

from sensorframe.llm import zipwarc


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, refers_to string, sum string")


def test_round_trip(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" * (i % 7 * 30)) for i in range(60)] + [(-5, None, "<p>1</p>" * 30), (100, "http://a\r\nb", None), (101, "u", "é\r\n\r\nx"), (102, "u", "y" * 300_000)]
    packages = zipwarc.write_packages(pages_of(spark, rows), package_bytes=2000)
    assert packages.agg({"records": "sum"}).first()[0] == len(rows)
    got = {r.page_id: r for r in zipwarc.read_packages(packages, block_bytes=500).collect()}
    first = {}
    for i, _, html in rows:
        first[html or ""] = min(i, first.get(html or "", i))
    for i, url, html in rows:
        raw, r = (html or "").encode(), got[i]
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if first[html or ""] == i else ("revisit", first[html or ""]))
        assert r.payload == (raw if r.record_type == "response" else b"")
        assert r.url == (url.replace("\r", "%0D").replace("\n", "%0A") if url else None)


def test_null_and_repeated_ids(spark):
    rows = [(None, "u", "a"), (None, "u", "a"), (1, "u", "a"), (2, "u", "a"), (2, "u", "b"), (2, "v", "a")]
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in zipwarc.round_trip(pages_of(spark, rows)).collect())
    assert got == [(0, "response", 0, 1), (0, "response", 0, 1), (1, "response", 0, 1), (2, "response", 0, 1), (2, "revisit", 1, 1), (2, "revisit", 1, 1)]
    assert zipwarc.round_trip(pages_of(spark, [])).collect() == []


def members(raw):
    return zipwarc.directory(pa.PythonFile(io.BytesIO(raw), mode="r"), len(raw))


def test_directory_of_a_common_zip():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("stored.bin", b"abc" * 10)
        z.writestr("packed.bin", b"abc" * 10, zipfile.ZIP_DEFLATED)
        z.comment = b"a note"
    raw = out.getvalue()
    found = {m["name"]: m for m in members(raw)}
    source = pa.PythonFile(io.BytesIO(raw), mode="r")
    at = zipwarc.data_begin(source, found["stored.bin"])
    assert raw[at : at + found["stored.bin"]["size"]] == b"abc" * 10
    with pytest.raises(ValueError, match="compressed"):
        zipwarc.data_begin(source, found["packed.bin"])
    with pytest.raises(ValueError, match="not a ZIP"):
        members(b"plain text")


def test_zip64_directory():
    """Sizes and places that need the wide fields, in an entry that only the central directory describes."""
    name = b"archive/data.warc.gz"
    wide = struct.pack("<HHQQQ", 1, 24, 5 << 32, 5 << 32, 6 << 32)
    entry = struct.pack("<4sHHHHHHLLLHHHHHLL", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(wide), 0, 0, 0, 0, 0xFFFFFFFF) + name + wide
    end = struct.pack("<4sQHHLLQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), 0)
    locator = struct.pack("<4sLQL", b"PK\x06\x07", 0, len(entry), 1)
    tail = struct.pack("<4sHHHHLLH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert members(entry + end + locator + tail) == [{"name": name.decode(), "method": 0, "size": 5 << 32, "header": 6 << 32}]


def test_damage_is_noticed():
    raw = zipwarc.record(7, b"u", b"payload", None)
    assert zipwarc.parse_record(raw)["page_id"] == 7
    import gzip

    with pytest.raises(ValueError, match="digest"):
        zipwarc.parse_record(gzip.compress(gzip.decompress(raw).replace(b"payload\r\n\r\n", b"paYload\r\n\r\n")))
