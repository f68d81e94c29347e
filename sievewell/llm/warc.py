"""WARC records in ZIP-packaged archives: a writer, and a reader that range-reads records without extraction.

An archive is a ZIP file with stored (not deflated) members: ``archive/data.warc.gz``, one gzip member for each record,
and ``indexes/index.cdxj``, a line with offset and length for each record. The reader finds the members by the end
record and the central directory, in their ZIP64 forms too, reads the index, and then only the byte ranges of records;
ranges of one archive are dealt to many tasks in chunks, and neighbouring ranges are read together.

Of records with equal payloads (by SHA-1) the one with the smallest page id is a ``response``, others ``revisit`` it;
payloads under ``least`` bytes are always responses.

A task writes whole archives of bounded size under names of its own; the manifest lists those of tasks that succeeded,
so lost executors and repeated attempts leave files that nobody reads. Spark resolves the folder's name (by its default
file system, where the name has none), and pyarrow opens what it resolves to: shared paths, S3, Google and Azure stores,
and HDFS and viewfs with its client library.

Nulls and odd inputs: a null payload is the empty payload. A null id is larger than any other; where all ids of a
payload are null, and where several rows have the smallest id, all of these rows are responses. A null url is written
as ``urn:none``. Line breaks and other controls in urls are percent-encoded. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path

# Fixed values of the formats.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

#: Bytes of records in an archive, about; bytes of an archive that one task reads; gap that is read over.
ARCHIVE_BYTES, CHUNK_BYTES, GAP = 32 << 20, 8 << 20, 64 << 10
#: Tasks that read archives, at most.
MOST_TASKS = 20_000
#: Up to so many payloads that occur more than once are broadcast (40 bytes each); more are joined by a shuffle.
BROADCAST_PAYLOADS = 500_000


def base32_sha1(c: Column) -> Column:
    """SHA-1 of binary data in base32, from the 40 hexadecimal digits: five of them are four of base32."""
    h = F.sha1(c)
    out = []
    for g in range(8):
        v = F.conv(F.substring(h, 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority, as Spark resolves it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return str(p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString())


# Names that the same stores have in Spark and in pyarrow.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfss": "abfss", "abfs": "abfs"}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path with a scheme, and the path in it."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        raise ValueError(f"{path} has no scheme; see qualified()")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


# --- writing ----------------------------------------------------------------------------------------------------


def record_bytes(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record as a gzip member; a revisit keeps the HTTP headers only."""
    url = "urn:none" if url is None else "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def archive_bytes(records: list[bytes], index: list[dict], zip64: bool = False) -> bytes:
    """A ZIP file with the records and their index as stored members."""
    out = io.BytesIO()
    lines = "".join(f"{x['url']} {DATE.translate({ord(c): None for c in '-:TZ'})} {json.dumps(x)}\n" for x in index)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in (("archive/data.warc.gz", b"".join(records)), ("indexes/index.cdxj", lines.encode()), ("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1"}).encode())):
            with z.open(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=zip64) as f:
                f.write(data)
    return out.getvalue()


def plan_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): which records are revisits."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    firsts = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("digest", "first")
    firsts, _ = materialize(firsts, "payloads")
    if firsts.count() <= BROADCAST_PAYLOADS:
        firsts = F.broadcast(firsts)
    again = ~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull()
    return rows.join(firsts, "digest", "left").select("page_id", "url", "payload", "digest", F.when(again, F.col("first")).alias("refers_to"))


def _urn(page_id: int | None) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Writes a record for every row into archives in ``folder``; returns their manifest (path, records, bytes)."""
    folder = qualified(pages.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]):
        store, at = opened(folder)
        store.create_dir(at, recursive=True)
        records: list[bytes] = []
        index: list[dict] = []
        offset = 0

        def flush() -> pa.RecordBatch:
            nonlocal records, index, offset
            name = f"{uuid.uuid4().hex}.wacz"
            data = archive_bytes(records, index)
            with store.open_output_stream(f"{at}/{name}") as f:
                f.write(data)
            done = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(records)], pa.int64()), pa.array([len(data)], pa.int64())], ["path", "records", "bytes"])
            records, index, offset = [], [], 0
            return done

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, digest, refers = (batch.column(j)[i].as_py() for j in range(5))
                r = record_bytes(_urn(page_id), url, payload, digest, None if refers is None else _urn(refers))
                index.append({"url": _urn(page_id), "offset": offset, "length": len(r), "digest": f"sha1:{digest}", "filename": "data.warc.gz"})
                records.append(r)
                offset += len(r)
                if offset >= ARCHIVE_BYTES:
                    yield flush()
        if records:
            yield flush()

    planned = plan_records(pages, id_col, url_col, payload_col, least)
    return materialize(planned.mapInArrow(run, "path string, records bigint, bytes bigint"), "manifest")[0]


# --- reading ----------------------------------------------------------------------------------------------------


def _directory(read, size: int) -> dict[str, tuple[int, int, int, int]]:
    """Members by name, (method, offset of local header, stored bytes, bytes), from the central directory.

    read(offset, length) gives bytes of the file; only its end and the directory are read.
    """
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP file, or a truncated one")
    entries, length, start = struct.unpack_from("<HII", tail, at + 10)
    if 0xFFFF == entries or 0xFFFFFFFF in (length, start):
        locator = read(tail_at + at - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        end64 = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != END64:
            raise ValueError("no ZIP64 end record")
        entries, length, start = struct.unpack_from("<QQQ", end64, 32)
    data, out, p = read(start, length), {}, 0
    for _ in range(entries):
        if data[p : p + 4] != ENTRY:
            raise ValueError("damaged central directory")
        flags, method = struct.unpack_from("<HH", data, p + 8)
        stored, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, p + 20)
        (local,) = struct.unpack_from("<I", data, p + 42)
        name = data[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        q, end = p + 46 + n_name, p + 46 + n_name + n_extra
        while q + 4 <= end:
            kind, n = struct.unpack_from("<HH", data, q)
            if kind == 1:  # 64-bit values, of those that are saturated only, in this order
                r = q + 4
                if plain == 0xFFFFFFFF:
                    (plain,), r = struct.unpack_from("<Q", data, r), r + 8
                if stored == 0xFFFFFFFF:
                    (stored,), r = struct.unpack_from("<Q", data, r), r + 8
                if local == 0xFFFFFFFF:
                    (local,) = struct.unpack_from("<Q", data, r)
            q += 4 + n
        out[name] = (method, local, stored, plain)
        p = end + n_comment
    return out


def members(read, size: int) -> dict[str, tuple[int, int]]:
    """(offset of the data, bytes) of the stored members under archive/ and indexes/."""
    out = {}
    for name, (method, local, stored, _) in _directory(read, size).items():
        if not name.startswith(("archive/", "indexes/")) or name.endswith("/"):
            continue
        if method:
            raise ValueError(f"{name} is compressed in the archive; its records can't be range-read")
        head = read(local, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"no local header for {name}")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        out[name] = (local + 30 + n_name + n_extra, stored)
    return out


def record_ranges(read, size: int) -> Iterator[tuple[int, int]]:
    """(offset in the file, length) of every record, by the archive's indexes."""
    found = members(read, size)
    for name, (at, n) in found.items():
        if not name.startswith("indexes/"):
            continue
        data = read(at, n)
        if name.endswith(".gz"):
            data = gzip.decompress(data)
        for line in data.decode().splitlines():
            if "{" not in line or line.startswith("!"):
                continue
            x = json.loads(line[line.index("{") :])
            start, stored = found[f"archive/{x['filename']}"]
            offset, length = int(x["offset"]), int(x["length"])
            if offset + length > stored:
                raise ValueError("the index points past its member")
            yield start + offset, length


def parse_record(data: bytes) -> dict:
    """Headers (lower-case names), block and HTTP payload of one gzip member."""
    plain = zlib.decompress(data, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    http_headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    return {"headers": headers, "http": http_headers, "payload": payload}


def _reader(path: str):
    store, at = opened(path)
    f = store.open_input_file(at)
    return f, lambda offset, n: bytes(f.read_at(n, offset)), f.size()


RECORDS = "page_id bigint, record_type string, url string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint"


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for every record of the archives listed in ``manifest`` (path, bytes); digests of responses are recomputed and compared."""
    total = manifest.agg(F.sum("bytes")).first()[0] or 0
    tasks = min(MOST_TASKS, -(-total // CHUNK_BYTES) + 1)  # else adaptive execution joins the ranges, which are short rows

    def ranges(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                f, read, size = _reader(path)
                with f:
                    found = list(record_ranges(read, size))
                for i in range(0, len(found), 50_000):
                    part = found[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array([x for x, _ in part], pa.int64()), pa.array([n for _, n in part], pa.int64())], ["path", "start", "length"])

    def page(urn: str | None) -> int | None:
        tail = (urn or "").strip("<>").rpartition(":")[2]
        return int(tail) if tail.lstrip("-").isdigit() else None

    def rows_of(datas: list[bytes]) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(7)]
        for data in datas:
            r = parse_record(data)
            h, kind = r["headers"], r["headers"]["warc-type"]
            digest = h["warc-payload-digest"].partition(":")[2]
            if kind == "response":
                n, actual = len(r["payload"]), base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode()
                if actual != digest:
                    raise ValueError(f"{h['warc-record-id']}: its payload does not have the digest in its header")
            else:
                n = int(r["http"]["content-length"])
            for c, v in zip(out, (page(h["warc-record-id"]), kind, h["warc-target-uri"], r["payload"] if with_payload else None, n, digest, page(h.get("warc-refers-to"))), strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["page_id", "record_type", "url", "payload", "payload_bytes", "payload_digest", "refers_to"])

    def records(batches):
        path, f, read = None, None, None
        for batch in batches:
            todo = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            i = 0
            while i < len(todo):
                j, (p, start, n) = i, todo[i]
                end = start + n
                while j + 1 < len(todo) and todo[j + 1][0] == p and 0 <= todo[j + 1][1] - end <= GAP and todo[j + 1][1] + todo[j + 1][2] - start <= CHUNK_BYTES:
                    j += 1
                    end = todo[j][1] + todo[j][2]
                if p != path:
                    if f:
                        f.close()
                    path, (f, read, _) = p, _reader(p)
                data = read(start, end - start)
                yield rows_of([data[s - start : s - start + m] for _, s, m in todo[i : j + 1]])
                i = j + 1
        if f:
            f.close()

    listed = manifest.select("path").repartition(tasks, "path").mapInArrow(ranges, "path string, start bigint, length bigint")
    dealt = listed.repartition(tasks, "path", F.floor(F.col("start") / CHUNK_BYTES)).sortWithinPartitions("path", "start")
    return dealt.mapInArrow(records, RECORDS)


def round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Writes archives of ``pages`` (in the shared folder, by default) and reads every record back."""
    folder = folder or new_path(pages.sparkSession, "archives")
    return read_archives(write_archives(pages, folder, id_col, url_col, payload_col, least), with_payload=False).select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
