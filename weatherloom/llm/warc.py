"""Web archives in ZIP packages: written by tasks, read back by byte ranges.

A package holds, without compression by ZIP itself,

    archive/data.warc.gz   WARC 1.1 records, each a gzip member of its own
    indexes/index.cdxj     one line of JSON per record: key, offset and length in the archive

so a reader needs the package's directory, the index, and then only the bytes of the records it
wants. The directory at the end of the file is parsed here, with its ZIP64 forms: where a size, an
offset or a count does not fit its field, the ZIP64 end record and the extra fields have it.
Nothing is extracted, and no package is read whole.

Paths may be in any store that pyarrow opens by URI. Packages are written under names that no other
attempt of a task uses, and count once the manifest, a Parquet table, lists them: what a lost
executor left behind is never read.
"""

import base64
import gzip
import hashlib
import json
import math
import struct
import uuid
import zipfile
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.sizing import scratch_path, written

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
# A package is closed after this many bytes of archive, and the task goes on with the next one.
PACKAGE_BYTES = 256 << 20
# Records are read back in tasks of about this many bytes of archive.
RANGE_BYTES = 8 << 20
GZIP_LEVEL = 1

# Fixed values of the ZIP format: signatures, and sizes of the fixed parts.
END_SIGNATURE, END_SIZE = b"PK\x05\x06", 22
END64_LOCATOR_SIGNATURE, END64_LOCATOR_SIZE = b"PK\x06\x07", 20
END64_SIGNATURE, END64_SIZE = b"PK\x06\x06", 56
MEMBER_SIGNATURE, MEMBER_SIZE = b"PK\x01\x02", 46
LOCAL_SIGNATURE, LOCAL_SIZE = b"PK\x03\x04", 30
ZIP64_EXTRA = 1
FULL_16, FULL_32 = 0xFFFF, 0xFFFFFFFF
LONGEST_COMMENT = 0xFFFF


class Member(NamedTuple):
    """A file in a package: where its bytes start, how many there are, and how they are stored."""

    name: str
    offset: int
    size: int
    method: int


# --- packages ----------------------------------------------------------------------------------


def open_store(uri: str):
    """(file system, path) of a URI or a local path."""
    if uri.startswith("file:"):
        uri = "file://" + "/" + uri[len("file:") :].lstrip("/")
    elif "://" not in uri:
        return pa.fs.LocalFileSystem(), uri
    return pa.fs.FileSystem.from_uri(uri)


def read_range(file, offset: int, size: int) -> bytes:
    file.seek(offset)
    data = file.read(size)
    if len(data) != size:
        raise ValueError(f"{size} bytes expected at {offset}, {len(data)} found")
    return data


def _directory_place(file, size: int) -> tuple[int, int, int]:
    """(entries, bytes, offset) of the central directory, from the end records."""
    tail_size = min(size, END_SIZE + LONGEST_COMMENT)
    tail = read_range(file, size - tail_size, tail_size)
    at = tail.rfind(END_SIGNATURE)
    while at >= 0:
        comment = tail[at + 20 : at + 22]
        if len(comment) == 2 and at + END_SIZE + struct.unpack("<H", comment)[0] == len(tail):
            break
        at = tail.rfind(END_SIGNATURE, 0, at)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP package, or cut off")
    entries, length, offset = struct.unpack("<10xHII", tail[at : at + 20])
    if entries == FULL_16 or length == FULL_32 or offset == FULL_32:
        end = size - tail_size + at
        if end < END64_LOCATOR_SIZE:
            return entries, length, offset
        locator = read_range(file, end - END64_LOCATOR_SIZE, END64_LOCATOR_SIZE)
        if locator[:4] == END64_LOCATOR_SIGNATURE:
            (at64,) = struct.unpack("<8xQ", locator[:16])
            end64 = read_range(file, at64, END64_SIZE)
            if end64[:4] != END64_SIGNATURE:
                raise ValueError("no ZIP64 end record where its locator points")
            entries, length, offset = struct.unpack("<32xQQQ", end64)
    return entries, length, offset


def _zip64_values(extra: bytes) -> bytes:
    """The ZIP64 extra field's content among a member's extra fields."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == ZIP64_EXTRA:
            return extra[at + 4 : at + 4 + size]
        at += 4 + size
    return b""


def read_directory(file, size: int) -> dict[str, Member]:
    """Members of a package by name, from its central directory and their local headers."""
    entries, length, offset = _directory_place(file, size)
    directory = read_range(file, offset, length)
    members, at = {}, 0
    for _ in range(entries):
        fixed = directory[at : at + MEMBER_SIZE]
        if fixed[:4] != MEMBER_SIGNATURE:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", fixed, 8)
        stored, plain, name_size, extra_size, comment_size = struct.unpack_from("<IIHHH", fixed, 20)
        (header,) = struct.unpack_from("<I", fixed, 42)
        at += MEMBER_SIZE
        name = directory[at : at + name_size]
        wide = _zip64_values(directory[at + name_size : at + name_size + extra_size])
        at += name_size + extra_size + comment_size
        # The wide values stand in this order, and only those whose narrow field is full.
        values = iter(struct.unpack(f"<{len(wide) // 8}Q", wide[: len(wide) // 8 * 8]))
        plain, stored, header = (next(values) if v == FULL_32 else v for v in (plain, stored, header))
        name = name.decode("utf-8" if flags & 0x800 else "cp437")
        local = read_range(file, header, LOCAL_SIZE)
        if local[:4] != LOCAL_SIGNATURE:
            raise ValueError(f"no local header for {name}")
        own_name, own_extra = struct.unpack_from("<HH", local, 26)
        members[name] = Member(name, header + LOCAL_SIZE + own_name + own_extra, stored, method)
    return members


def read_index(file, members: dict[str, Member], archive=ARCHIVE, index=INDEX) -> list[dict]:
    """Index entries with `offset` from the start of the package. Both members must be stored."""
    for name in (archive, index):
        if name not in members or members[name].method != zipfile.ZIP_STORED:
            raise ValueError(f"{name} is missing or compressed")
    lines = read_range(file, members[index].offset, members[index].size).splitlines()
    entries = [json.loads(line[line.index(b"{") :]) for line in lines if line.strip()]
    for entry in entries:
        if entry["offset"] + entry["length"] > members[archive].size:
            raise ValueError("an index entry points beyond its archive")
        entry["offset"] += members[archive].offset
    return entries


# --- records -----------------------------------------------------------------------------------


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page: dict) -> bytes:
    """A WARC record: a response with its payload, or a revisit that refers to a response."""
    payload = (page["html"] or "").encode()
    is_revisit = page["refers_to"] is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http if is_revisit else http + payload
    url = (page["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
    headers = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{page['page_id']}>"),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(body))),
    ]
    if is_revisit:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:page:{page['refers_to']}>"),
            ("X-Payload-Length", str(len(payload))),
        ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Headers and payload of a record; a revisit's payload is None."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    body = rest[: int(headers["Content-Length"])]
    if len(body) != int(headers["Content-Length"]):
        raise ValueError("a WARC record is cut off")
    payload = body.partition(b"\r\n\r\n")[2] if headers["WARC-Type"] == "response" else None
    return {"headers": headers, "payload": payload}


def _page_id(urn: str | None) -> int | None:
    value = urn.strip("<>").rpartition(":")[2] if urn else "None"
    return None if value == "None" else int(value)


# --- writing -----------------------------------------------------------------------------------

_MANIFEST = "package string, size bigint, records bigint"


def _write_packages(folder: str, package_bytes: int):
    def write(batches):
        """Write this task's pages into packages; one manifest row for each."""
        store, base = open_store(folder)
        pages = (page for batch in batches for page in batch.to_pylist())
        page = next(pages, None)
        while page is not None:
            name = f"{uuid.uuid4().hex}.wacz"
            store.create_dir(base, recursive=True)
            index, size = [], 0
            with store.open_output_stream(f"{base}/{name}") as out:
                with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
                    with package.open(ARCHIVE, "w", force_zip64=True) as archive:
                        while page is not None and size < package_bytes:
                            record = gzip.compress(build_record(page), GZIP_LEVEL, mtime=0)
                            archive.write(record)
                            entry = {"page_id": page["page_id"], "offset": size, "length": len(record)}
                            index.append(f"{page['page_id']} {json.dumps(entry)}\n")
                            size += len(record)
                            page = next(pages, None)
                    package.writestr(INDEX, "".join(index))
            length = store.get_file_info(f"{base}/{name}").size
            yield pa.record_batch(
                [pa.array([name]), pa.array([length], pa.int64()), pa.array([len(index)], pa.int64())],
                ["package", "size", "records"],
            )

    return write


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html and `refers_to`: the smallest page_id of an equal payload, if another.

    Small rows of digests are grouped and joined, by partial aggregates and with adaptive splitting
    of a digest that many pages share; the pages themselves move once, by their own id. Repeated
    rows of a page_id with the same html are one response each; a missing page_id is larger than any.
    """
    own = pages.select(
        "page_id",
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("key", F.struct("page_id", F.sha2("html", 256).alias("digest")))
    keys = written(own.select("key.page_id", "key.digest").distinct(), "payload-digests")
    firsts = keys.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    revisits = keys.join(firsts.where("n > 1"), "digest").where(
        ~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull()
    )
    revisits = revisits.select(
        F.struct("page_id", "digest").alias("key"), F.col("first_id").alias("refers_to")
    )
    joined = own.join(revisits.hint("shuffle_hash"), "key", "left")
    return joined.select("page_id", "url", "html", "refers_to")


def write_packages(
    pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES
) -> DataFrame:
    """Write a record per row of `pages` (page_id, url, html) below `folder`, a shared place.

    Returns the manifest (package, size, records), which is what makes the packages count. Runs jobs
    at once. Revisits hold no payload. No pages give no packages and an empty manifest.
    """
    packages = with_revisits(pages).mapInArrow(_write_packages(f"{folder}/packages", package_bytes), _MANIFEST)
    manifest = f"{folder}/manifest"
    packages.write.parquet(manifest)
    return read_manifest(pages.sparkSession, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


# --- reading -----------------------------------------------------------------------------------

_PLACES = "package string, offset bigint, length bigint"
_RECORDS = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint,"
    " payload_digest string, payload binary"
)
_RECORD_STRUCT = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
    ]
)


def _locate(folder: str):
    def locate(batches):
        store, base = open_store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{base}/{row['package']}") as file:
                    entries = read_index(file, read_directory(file, row["size"]))
                if len(entries) != row["records"]:
                    raise ValueError(f"{row['package']}: records are missing from the index")
                for at in range(0, len(entries), 10_000):
                    some = entries[at : at + 10_000]
                    yield pa.record_batch(
                        [
                            pa.array([row["package"]] * len(some), pa.string()),
                            pa.array([e["offset"] for e in some], pa.int64()),
                            pa.array([e["length"] for e in some], pa.int64()),
                        ],
                        ["package", "offset", "length"],
                    )

    return locate


def _read_records(folder: str, with_payload: bool):
    def read(batches):
        store, base = open_store(folder)
        name, file, rows, size = None, None, [], 0
        for batch in batches:
            for place in batch.to_pylist():
                if place["package"] != name:
                    if file is not None:
                        file.close()
                    name = place["package"]
                    file = store.open_input_file(f"{base}/{name}")
                record = gzip.decompress(read_range(file, place["offset"], place["length"]))
                parsed = parse_record(record)
                headers, payload = parsed["headers"], parsed["payload"]
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if payload is None:
                    n_bytes = int(headers["X-Payload-Length"])
                else:
                    n_bytes = len(payload)
                    if payload_digest(payload) != digest:
                        raise ValueError("a payload does not have its digest")
                rows.append(
                    {
                        "page_id": _page_id(headers["WARC-Record-ID"]),
                        "url": headers["WARC-Target-URI"],
                        "record_type": headers["WARC-Type"],
                        "refers_to": _page_id(headers.get("WARC-Refers-To")),
                        "payload_bytes": n_bytes,
                        "payload_digest": digest,
                        "payload": payload if with_payload else None,
                    }
                )
                size += len(record)
                if len(rows) == 1000 or size > RANGE_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD_STRUCT)
                    rows, size = [], 0
        if file is not None:
            file.close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _RECORD_STRUCT)

    return read


def read_packages(
    spark: SparkSession, folder: str, with_payload: bool = True, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Records of all packages in the manifest: page_id, url, record_type, refers_to,
    payload_bytes, payload_digest, payload (null for revisits).

    Packages are opened by many tasks for their directory and index; the places found are dealt out
    in ranges of about `range_bytes`, so one large package is read by many tasks. Every payload is
    held against its digest.
    """
    packages = f"{folder}/packages"
    listed = read_manifest(spark, folder)
    n, size = listed.agg(F.count(F.lit(1)), F.sum("size")).first()
    # Rows of places are tiny, and what they stand for is not: the numbers of tasks are given, so that
    # adaptive execution does not join them by the bytes of the rows.
    located = listed.repartition(max(n, 1), "package").mapInArrow(_locate(packages), _PLACES)
    piece = F.floor(F.col("offset") / range_bytes)
    tasks = max(math.ceil((size or 0) / range_bytes), 1)
    dealt = located.repartition(tasks, "package", piece).sortWithinPartitions("package", "offset")
    return dealt.mapInArrow(_read_records(packages, with_payload), _RECORDS)


def archived_pages(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Write `pages` into packages in the shared scratch folder and read their records back."""
    folder = scratch_path(pages.sparkSession, "web-archive")
    write_packages(pages, folder)
    return read_packages(pages.sparkSession, folder, with_payload)
