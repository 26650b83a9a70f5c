"""WARC records in ZIP packages: writer, and a reader that never extracts.

A package is a ZIP file whose members are stored: ``archive/data.warc.gz`` (one gzip member per record, so that any
record can be read alone) and ``indexes/index.txt`` (offset, length and record id of each).  The reader finds the end
record (and its ZIP64 form), parses the central directory, reads the index members and then only the byte ranges that
the index names.  Ranges are dealt out over all tasks in blocks, so a large package is not one task.

Packages lie in a folder that driver and executors share (any store that ``pyarrow.fs`` opens by URI).  A task names
its packages at random and reports them as rows; only packages in the stored report are read, so a task that ran
twice or died half way leaves no wrong records.

Defined results: a null html is an empty payload; a null url leaves out the target header; rows with a null
``page_id`` are responses of their own, never referred to.  Of rows with equal payloads those with the smallest
``page_id`` are responses.  An empty table makes no package.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.llm.common import materialize, texts_of
from sensorframe.runtime import scratch_path

DATE = "2024-01-01T00:00:00Z"
PACKAGE_BYTES, BLOCK_BYTES = 512 << 20, 4 << 20
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, package string, position long"
PREFIX = 0x70616765_0000_8000 << 64  # marks ids that hold a page number


def record_id(page: int | None, other: str = "") -> str:
    number = PREFIX | (page & (1 << 64) - 1) if page is not None else uuid.uuid5(uuid.NAMESPACE_URL, other).int
    return f"<urn:uuid:{uuid.UUID(int=number)}>"


def page_of(text: str | None) -> int | None:
    if not text:
        return None
    number = uuid.UUID(text.strip("<>").rpartition(":")[2]).int
    low = number & (1 << 64) - 1
    return (low - (1 << 64) if low >> 63 else low) if number >> 64 == PREFIX >> 64 else None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: bytes | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzipped WARC record; a revisit has no body but names the payload's digest and length."""
    is_copy = refers_to is not None
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = head if is_copy else head + payload
    lines = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if is_copy else b"response"), b"WARC-Date: " + DATE.encode(),
             b"WARC-Record-ID: " + record_id(page, digest(payload)).encode(), b"WARC-Payload-Digest: sha1:" + digest(payload).encode()]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + url.replace(b"\r", b"%0D").replace(b"\n", b"%0A"))
    if is_copy:
        lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + record_id(refers_to).encode()]
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(body)]
    return gzip.compress(b"\r\n".join(lines) + b"\r\n\r\n" + body + b"\r\n\r\n", 4, mtime=0)


def parse_record(raw: bytes) -> dict:
    """The fields of one record, with the payload checked against its digest."""
    text = gzip.decompress(raw)
    head, _, rest = text.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not version.startswith(b"WARC/"):
        raise ValueError("this range holds no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}
    body = rest[: int(fields[b"content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    said = fields[b"warc-payload-digest"].decode().partition(":")[2]
    kind = fields[b"warc-type"].decode()
    size = len(payload)
    if kind == "revisit":
        size = next(int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.lower() == b"content-length")
    elif digest(payload) != said:
        raise ValueError(f"payload of {fields[b'warc-record-id'].decode()} differs from its digest")
    uri = fields.get(b"warc-target-uri")
    refers = fields.get(b"warc-refers-to")
    return {"page_id": page_of(fields[b"warc-record-id"].decode()), "payload_bytes": size, "payload_digest": said, "record_type": kind,
            "refers_to": page_of(refers.decode()) if refers else None, "url": uri.decode("utf-8", "replace") if uri is not None else None, "payload": payload}


class _Package:
    """One package being written."""

    def __init__(self, folder: str):
        store, path = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.wacz"
        self.uri, self.out, self.index, self.at = f"{folder}/{name}", store.open_output_stream(f"{path}/{name}"), [], 0
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open("archive/data.warc.gz", "w", force_zip64=True)

    def add(self, raw: bytes, name: str) -> None:
        self.member.write(raw)
        self.index.append(f"{self.at} {len(raw)} {name}")
        self.at += len(raw)

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.zip.writestr("indexes/index.txt", "\n".join(self.index))
        self.zip.close()
        self.out.close()
        return self.uri, len(self.index)


def _writer(folder: str, package_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            rows = zip(batch.column("page_id").to_pylist(), texts_of(batch.column("url")), texts_of(batch.column("html")), batch.column("refers_to").to_pylist(), strict=True)
            for page, url, html, refers in rows:
                now = now or _Package(folder)
                now.add(record(page, url, html or b"", refers), "-" if page is None else record_id(page))
                if now.at >= package_bytes:
                    done.append(now.close())
                    now = None
        if now:
            done.append(now.close())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["package", "records"])

    return run


def write_packages(pages: DataFrame, least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write one record per row of ``pages`` (``page_id``, ``url``, ``html``); returns ``package``, ``records``.

    Payloads of at least ``least_bytes`` that occur again become revisits of the one with the smallest ``page_id``.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    body = F.col("html").cast("binary")
    summed = rows.where("page_id is not null").select("page_id", F.sha2(body, 256).alias("sum"), F.octet_length(body).alias("size")).where(F.col("size") >= least_bytes)
    summed = materialize(summed.drop("size"), "payload-sums")
    first = materialize(summed.groupBy("sum").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "payload-firsts")
    copies = materialize(summed.join(first, "sum").where("page_id <> first").select("page_id", F.col("first").alias("refers_to")).distinct(), "revisits")
    # the sum is carried by the id alone, unless ids repeat with other payloads
    twice = copies.groupBy("page_id").count().where("count > 1").limit(1).count() or rows.join(copies, "page_id", "left_semi").groupBy("page_id").count().where("count > 1").limit(1).count()
    if twice:
        keyed = summed.join(first, "sum").where("page_id <> first").select("page_id", "sum", F.col("first").alias("refers_to")).distinct()
        rows = rows.withColumn("sum", F.sha2(body, 256)).join(keyed, ["page_id", "sum"], "left")
    else:
        rows = rows.join(copies, "page_id", "left")
    folder = scratch_path(spark, "packages")
    return materialize(rows.select("page_id", "url", "html", "refers_to").mapInArrow(_writer(folder, package_bytes), "package string, records long"), "package-list")


def directory(source: pa.NativeFile, size: int) -> list[dict]:
    """The members that a ZIP file's central directory lists: name, method, size, and where the header lies."""
    tail_at = max(0, size - 22 - 0xFFFF)
    source.seek(tail_at)
    tail = source.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    count, length, begin = struct.unpack("<HLL", tail[end + 10 : end + 20])
    if count == 0xFFFF or length == 0xFFFFFFFF or begin == 0xFFFFFFFF:
        source.seek(tail_at + end - 20)
        sign, _, at, _ = struct.unpack("<4sLQL", source.read(20))
        if sign != b"PK\x06\x07":
            raise ValueError("the ZIP64 locator is missing")
        source.seek(at)
        wide = source.read(56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 end record is missing")
        count, length, begin = struct.unpack("<QQQ", wide[32:56])
    source.seek(begin)
    raw, at, out = source.read(length), 0, []
    for _ in range(count):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        method, = struct.unpack("<H", raw[at + 10 : at + 12])
        packed, whole, n_name, n_extra, n_note = struct.unpack("<LLHHH", raw[at + 20 : at + 34])
        header, = struct.unpack("<L", raw[at + 42 : at + 46])
        name = raw[at + 46 : at + 46 + n_name].decode()
        extra, k = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack("<HH", extra[k : k + 4])
            if kind == 1:  # the wide values stand in this order, each only where the narrow one is full
                wide = list(struct.unpack(f"<{n // 8}Q", extra[k + 4 : k + 4 + n // 8 * 8]))
                whole = wide.pop(0) if whole == 0xFFFFFFFF else whole
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            k += 4 + n
        out.append({"name": name, "method": method, "size": packed, "header": header})
        at += 46 + n_name + n_extra + n_note
    return out


def data_begin(source: pa.NativeFile, member: dict) -> int:
    if member["method"] != 0:
        raise ValueError(f"{member['name']} is compressed; only stored members can be read by range")
    source.seek(member["header"])
    head = source.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no header of {member['name']}")
    n_name, n_extra = struct.unpack("<HH", head[26:30])
    return member["header"] + 30 + n_name + n_extra


def _blocks(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("package").to_pylist():
                store, path = pa.fs.FileSystem.from_uri(uri)
                size = store.get_file_info(path).size
                begins, lengths = [], []
                with store.open_input_file(path) as source:
                    members = {m["name"]: m for m in directory(source, size)}
                    at = data_begin(source, members["archive/data.warc.gz"])
                    index = members["indexes/index.txt"]
                    source.seek(data_begin(source, index))
                    held, begin = [], 0
                    for line in source.read(index["size"]).decode().splitlines():
                        offset, length = map(int, line.split(" ")[:2])
                        if held and (begin + sum(held) != offset or sum(held) + length > block_bytes):
                            begins.append(at + begin)
                            lengths.append(held)
                            held = []
                        begin = begin if held else offset
                        held.append(length)
                    if held:
                        begins.append(at + begin)
                        lengths.append(held)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri] * len(begins), pa.string()), pa.array(begins, pa.int64()), pa.array(lengths, pa.list_(pa.int64()))], ["package", "begin", "lengths"])

    return run


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                store, path = pa.fs.FileSystem.from_uri(block["package"])
                with store.open_input_file(path) as source:
                    source.seek(block["begin"])
                    raw = source.read(sum(block["lengths"]))
                rows, at = [], 0
                for length in block["lengths"]:
                    row = parse_record(raw[at : at + length])
                    rows.append(row | {"payload": row["payload"] if with_payload else None, "package": block["package"], "position": block["begin"] + at})
                    at += length
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                    ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("package", pa.string()), ("position", pa.int64())]))

    return run


def read_packages(packages: DataFrame, with_payload: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per record of the packages (column ``package``: URIs), read by range."""
    spark: SparkSession = packages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = packages.select("package").repartition(parts).mapInArrow(_blocks(block_bytes), "package string, begin long, lengths array<long>")
    return blocks.repartition(parts).mapInArrow(_reader(with_payload), RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """What the packages written from ``pages`` hold, one row per page."""
    return read_packages(write_packages(pages), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ROUND_TRIP_SQL = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
    SELECT page_id, payload_bytes,
      array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
        (strpos('0123456789abcdef', substr(hex, 1 + i * 5 // 4, 1)) - 1) * 16 + greatest(strpos('0123456789abcdef', substr(hex, 2 + i * 5 // 4, 1)) - 1, 0))
        >> (3 - i * 5 % 4)) % 32, 1)), '') AS payload_digest,
      CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
    FROM h"""
