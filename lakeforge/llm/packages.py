"""WARC archives in ZIP packages: written by tasks, and read by ranges without unpacking.

A package holds `archive/data.warc.gz`, one gzip member a record, and `indexes/index.cdxj`, one line a record; both are
stored, not deflated, so a record's place in the package is known without reading what precedes it.

Reading goes from the end: the end record, where it overflows its ZIP64 locator and record, then the central
directory; of each stored archive the local header says where its bytes begin. The index's lines give a record's
offset and length, and records that lie next to each other are read together, up to `READ_BYTES` at once. An archive
without an index is walked member by member.

Packages lie in the folder that the cluster shares and are opened through `pyarrow.fs`. A task writes under names of
its own and reports them; names of tasks that were lost or run twice are reported by nobody and never read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeforge.llm.blocks import checkpoint, ensure_checkpoint_dir
from lakeforge.llm.hashing import sliced

#: Bytes of a package's records, before the one that goes beyond them.
PACKAGE_BYTES = 16 << 20
#: Bytes that one read asks for, beyond a larger record.
READ_BYTES = 4 << 20
#: Bytes of repeated payloads' keys up to which they are broadcast; a key and its place take some 200.
BROADCAST_BYTES, KEY_BYTES = 64 << 20, 200

#: Fixed values of the ZIP format: signatures and lengths of its records, the mark of a 32-bit field that overflows,
#: the longest comment, the id of the ZIP64 extra field.
END, END_SIZE = b"PK\5\6", 22
END64, END64_SIZE = b"PK\6\6", 56
LOCATOR, LOCATOR_SIZE = b"PK\6\7", 20
ENTRY, ENTRY_SIZE = b"PK\1\2", 46
LOCAL, LOCAL_SIZE = b"PK\3\4", 30
OVERFLOW, OVERFLOW_SHORT, COMMENT, EXTRA64 = 0xFFFFFFFF, 0xFFFF, 0xFFFF, 1
#: Fixed value of the WARC format: the profile of a revisit to an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, n_bytes long, n_records long"
PLACES = "path string, member string, offset long, n_bytes long"
RECORD = "path string, member string, offset long, n_bytes long, record_type string, record_id string, target_uri string, refers_to_id string, stated_digest string, payload_bytes long, payload_digest string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- ZIP -------------------------------------------------------------------------------------------


class Member(NamedTuple):
    name: str
    method: int
    flags: int
    n_bytes: int
    header: int
    """Where its local header begins, in the file."""


def directory(file: pa.NativeFile, size: int) -> list[Member]:
    """The central directory's entries. Bytes before the first record, and a comment after the last, don't matter."""

    def read(at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > size:
            raise ValueError("the package is cut off")
        return file.read_at(n, at)

    tail_at = max(0, size - END_SIZE - COMMENT)
    tail = read(tail_at, size - tail_at)
    found = tail.rfind(END)
    while found >= 0 and not (len(tail) - found >= END_SIZE and struct.unpack_from("<H", tail, found + 20)[0] <= len(tail) - found - END_SIZE):
        found = tail.rfind(END, 0, found)
    if found < 0:
        raise ValueError("no ZIP package: it has no end record")
    count, n, at = struct.unpack_from("<HII", tail, found + 10)
    end = tail_at + found
    locator = read(end - LOCATOR_SIZE, LOCATOR_SIZE) if end >= LOCATOR_SIZE else b""
    if locator[:4] == LOCATOR:
        stated = struct.unpack_from("<Q", locator, 8)[0]
        # where bytes precede the package, stated places are too small: the record then lies next to its locator
        for place in (stated, end - LOCATOR_SIZE - END64_SIZE):
            if 0 <= place <= size - END64_SIZE and (record := read(place, END64_SIZE))[:4] == END64:
                count, n, at = struct.unpack_from("<QQQ", record, 32)
                end = place
                break
        else:
            raise ValueError("the package's ZIP64 end record is missing")
    before = end - n - at
    if before < 0:
        raise ValueError("the package's central directory is cut off")
    raw, out, k = read(at + before, n), [], 0
    for _ in range(count):
        if raw[k : k + 4] != ENTRY or len(raw) < k + ENTRY_SIZE:
            raise ValueError("the package's central directory is broken")
        flags, method = struct.unpack_from("<HH", raw, k + 8)
        packed, full = struct.unpack_from("<II", raw, k + 20)
        names, extras, comments = struct.unpack_from("<HHH", raw, k + 28)
        header = struct.unpack_from("<I", raw, k + 42)[0]
        name = raw[k + ENTRY_SIZE : k + ENTRY_SIZE + names]
        extra = raw[k + ENTRY_SIZE + names : k + ENTRY_SIZE + names + extras]
        e = 0
        while e + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, e)
            if kind == EXTRA64:  # holds the fields that overflow, in this order
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, e + 4))
                full = next(wide) if full == OVERFLOW else full
                packed = next(wide) if packed == OVERFLOW else packed
                header = next(wide) if header == OVERFLOW else header
            e += 4 + length
        out.append(Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, flags, packed, header + before))
        k += ENTRY_SIZE + names + extras + comments
    return out


def begin_of(file: pa.NativeFile, member: Member) -> int:
    """Where a member's bytes begin: its local header may have another extra field than the directory."""
    raw = file.read_at(LOCAL_SIZE, member.header)
    if raw[:4] != LOCAL:
        raise ValueError(f"{member.name} has no local header")
    return member.header + LOCAL_SIZE + sum(struct.unpack_from("<HH", raw, 26))


# --- WARC ------------------------------------------------------------------------------------------


def write_record(record_id: str, target_uri: str | None, payload: bytes | None, length: int, payload_digest: str, refers_to: str | None) -> bytes:
    """One gzip member. A revisit has the payload's length and digest, and no payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + (b"" if refers_to else payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    # line ends in a URI would end its header
    head += [f"WARC-Target-URI: {' '.join(target_uri.split())}"] if target_uri and target_uri.strip() else []
    head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to else []
    head += [f"WARC-Payload-Digest: sha1:{payload_digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    work = zlib.compressobj(6, zlib.DEFLATED, 31)
    return work.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + work.flush()


def _headers(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class Record(NamedTuple):
    headers: dict[str, str]
    payload: bytes | None
    """None in a revisit, and in records that hold no response."""
    length: int | None


def read_record(raw: bytes) -> Record:
    """Of one record, not compressed. The payload is what follows the HTTP headers."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    headers = _headers(head)
    block = rest[: int(headers.get("content-length", len(rest)))]
    kind = headers.get("warc-type")
    if kind not in ("response", "revisit"):
        return Record(headers, None, None)
    http = headers.get("content-type", "").startswith("application/http")
    lines, _, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    stated = _headers(lines).get("content-length") if http else None
    if kind == "revisit":
        return Record(headers, None, int(stated) if stated and stated.isdigit() else None)
    return Record(headers, body, len(body))


def members_of(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member of an archive."""
    at = 0
    while at < len(raw):
        work = zlib.decompressobj(31)
        out = work.decompress(memoryview(raw)[at:])
        if not work.eof:
            raise ValueError("an archive's last record is cut off")
        n = len(raw) - at - len(work.unused_data)
        yield at, n, out
        at += n


# --- Spark -----------------------------------------------------------------------------------------


def write_packages(records: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes record_id, target_uri, payload, length and refers_to of all rows; returns path, n_bytes and n_records.

    The result is checkpointed: it names each row's package once, whatever was lost and written again.
    """
    place = folder

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa.fs.FileSystem.from_uri(place)
        data, lines = io.BytesIO(), []

        def flush() -> pa.RecordBatch:
            nonlocal data, lines
            body = io.BytesIO()
            with zipfile.ZipFile(body, "w", zipfile.ZIP_STORED) as package:
                for name, content in (("archive/data.warc.gz", data.getbuffer()), ("indexes/index.cdxj", "".join(lines).encode())):
                    with package.open(zipfile.ZipInfo(name), "w", force_zip64=True) as out:
                        out.write(content)
            name = f"{root}/{uuid.uuid4().hex}.zip"
            with store.open_output_stream(name) as out:
                out.write(body.getbuffer())
            row = pa.RecordBatch.from_pydict({"path": [f"{place}/{name.rsplit('/', 1)[1]}"], "n_bytes": pa.array([body.getbuffer().nbytes], pa.int64()), "n_records": pa.array([len(lines)], pa.int64())})
            data, lines = io.BytesIO(), []
            return row

        for batch in batches:
            for part in sliced(batch, "payload", 1 << 20):
                for row in part.to_pylist():
                    payload = row["payload"] or b""
                    sha1 = row["sha1"] or digest(payload)
                    raw = write_record(row["record_id"], row["target_uri"], payload, row["length"], sha1, row["refers_to"])
                    lines.append(json.dumps({"id": row["record_id"], "offset": data.tell(), "length": len(raw), "digest": f"sha1:{sha1}"}) + "\n")
                    data.write(raw)
                    if data.tell() >= package_bytes:
                        yield flush()
        if lines:
            yield flush()

    pa.fs.FileSystem.from_uri(place)[0].create_dir(pa.fs.FileSystem.from_uri(place)[1], recursive=True)
    return checkpoint(records.select("record_id", "target_uri", "payload", "length", "sha1", "refers_to").mapInArrow(write, MANIFEST))


def locate(packages: DataFrame) -> DataFrame:
    """Every record's place: package, archive, offset in the package and length. `packages` has a column `path`.

    Deflated archives can't be read by ranges and raise. Members of other kinds are left alone.
    """

    def places(path: str) -> Iterator[dict]:
        store, name = pa.fs.FileSystem.from_uri(path)
        with store.open_input_file(name) as file:
            found = directory(file, file.size())
            archives = [m for m in found if m.name.endswith(".warc.gz")]
            for m in archives:
                if m.method or m.flags & 1:
                    raise ValueError(f"{path}: {m.name} is not stored plainly")
            index = next((m for m in found if m.name.endswith(".cdxj") and not m.method), None)
            if index is not None and len(archives) == 1:
                start, raw = begin_of(file, archives[0]), file.read_at(index.n_bytes, begin_of(file, index))
                for line in raw.decode().splitlines():
                    entry = json.loads(line)
                    if entry["offset"] + entry["length"] > archives[0].n_bytes:
                        raise ValueError(f"{path}: a place lies beyond its archive")
                    yield {"path": path, "member": archives[0].name, "offset": start + entry["offset"], "n_bytes": entry["length"]}
            else:
                for m in archives:
                    start = begin_of(file, m)
                    for at, n, _ in members_of(file.read_at(m.n_bytes, start)):
                        yield {"path": path, "member": m.name, "offset": start + at, "n_bytes": n}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = list(places(path))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("n_bytes", pa.int64())]))

    return packages.select("path").mapInArrow(run, PLACES)


def grouped(places: Iterable[tuple], limit: int) -> Iterator[list[tuple]]:
    """Runs of (path, member, offset, n_bytes) that one read gets: they follow each other without a gap."""
    held: list[tuple] = []
    size = 0
    for p in places:
        if held and (p[0] != held[-1][0] or p[2] != held[-1][2] + held[-1][3] or size + p[3] > limit):
            yield held
            held, size = [], 0
        held.append(p)
        size += p[3]
    if held:
        yield held


def read_records(places: DataFrame, payloads: bool = True) -> DataFrame:
    """The records at `places`, with digest and length of each payload worked out anew; of a revisit, as stated."""
    kind = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in RECORD.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for batch in batches:
            for reads in grouped(zip(*(batch.column(c).to_pylist() for c in ("path", "member", "offset", "n_bytes")), strict=True), READ_BYTES):
                path = reads[0][0]
                if held[0] != path:
                    if held[1] is not None:
                        held[1].close()
                    store, name = pa.fs.FileSystem.from_uri(path)
                    held = (path, store.open_input_file(name))
                first = reads[0][2]
                raw = held[1].read_at(reads[-1][2] + reads[-1][3] - first, first)
                rows = []
                for _, member, at, n in reads:
                    record = read_record(zlib.decompress(memoryview(raw)[at - first : at - first + n], 31))
                    get = record.headers.get
                    bare = lambda value: value.strip("<>") if value else None
                    stated = (get("warc-payload-digest") or "").removeprefix("sha1:") or None
                    rows.append((path, member, at, n, get("warc-type"), bare(get("warc-record-id")), get("warc-target-uri"), bare(get("warc-refers-to")), stated, record.length, stated if record.payload is None else digest(record.payload), record.payload if payloads else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)
        if held[1] is not None:
            held[1].close()

    return places.select("path", "member", "offset", "n_bytes").mapInArrow(run, RECORD)


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("none")))


def as_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """One record a row: of equal payloads, the row with the least id is a response and the others revisit it.

    Null payloads are empty ones. Ids are numbers; null ids come last. Of rows with the least id the one with the least
    url is the response, and of equal rows one. Revisits carry no payload, so only those payloads are moved that stand
    first of several; payloads that occur once are written where they are read. Keys of payloads that occur more than
    once are broadcast up to `BROADCAST_BYTES`, and joined by a shuffle beyond. The result has record_id, target_uri,
    payload, length, sha1 (null where the payload is there to work it out) and refers_to.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    place = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("page"), F.col(url_col).isNotNull().alias("named"), F.col(url_col).alias("url"))
    rows = pages.select(place.alias("place"), payload.alias("payload")).withColumn("key", F.sha2("payload", 256))
    first = rows.select("key", "place").groupBy("key").agg(F.min("place").alias("head"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    first = checkpoint(first)
    repeated = first.count()
    if repeated * KEY_BYTES <= BROADCAST_BYTES:
        first = F.broadcast(first)
    rows = rows.join(first, "key", "left")
    written = lambda df, page, url, body, length, sha1, to: df.select(_record_id(page).alias("record_id"), url.alias("target_uri"), body.alias("payload"), length.cast("long").alias("length"), sha1.cast("string").alias("sha1"), to.alias("refers_to"))
    none, own = F.lit(None), F.col("place")
    stands = F.col("head").isNull()
    # whatever occurs once is written as it is read, and a revisit has its payload's digest only
    alone = rows.where(stands | (own != F.col("head")))
    to = F.when(~stands, _record_id(F.col("head.page")))
    sha1 = F.when(~stands, base32(F.sha1("payload")))
    out = written(alone, own["page"], own["url"], F.when(stands, F.col("payload")), F.octet_length("payload"), sha1, to)
    if not repeated:
        return out
    heads = rows.where(own == F.col("head")).groupBy("key", "place").agg(F.first("payload").alias("payload"), F.count("*").alias("copies"))
    more = heads.where("copies > 1").select("place", F.octet_length("payload").alias("length"), base32(F.sha1("payload")).alias("sha1"), F.explode(F.sequence(F.lit(2).cast("long"), F.col("copies"))))
    out = out.unionByName(written(heads, own["page"], own["url"], F.col("payload"), F.octet_length("payload"), none, none.cast("string")))
    return out.unionByName(written(more, own["page"], own["url"], none.cast("binary"), F.col("length"), F.col("sha1"), _record_id(own["page"])))


def base32(hexes: Column) -> Column:
    """Upper-case base 32 of 40 hexadecimal digits: eight groups of five digits, four signs each."""
    signs = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for k in range(1, 41, 5):
        number = F.conv(F.substring(hexes, k, 5), 16, 10).cast("int")
        parts += [signs.substr(F.shiftright(number, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None) -> DataFrame:
    """Writes all rows as records into packages, and reads them back.

    Returns what `read_records` gives and the ids: `id_col` and `refers_to`, the response's of a revisit. Other
    columns, whatever their names, are dropped; an empty table gives no package and no rows.
    """
    spark = pages.sparkSession
    manifest = write_packages(as_records(pages, id_col, url_col, payload_col), folder or new_folder(spark))
    places = locate(manifest.repartition(spark.sparkContext.defaultParallelism))
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast(pages.schema[id_col].dataType)
    return read_records(places).withColumn(id_col, number("record_id")).withColumn("refers_to", number("refers_to_id"))


def new_folder(spark: SparkSession) -> str:
    """Under the folder that the cluster shares."""
    ensure_checkpoint_dir(spark)
    shared = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if shared.startswith("file:/") and not shared.startswith("file://"):
        shared = shared.replace("file:", "file://", 1)
    return f"{shared}/packages-{uuid.uuid4().hex}"


def oracle() -> str:
    """DuckDB SQL for the query over `pages`."""
    return """
    WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
    placed AS (SELECT *, row_number() OVER w AS k, first_value(page_id) OVER w AS head FROM payloads WINDOW w AS (PARTITION BY html ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
      array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
      CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN head END AS refers_to
    FROM placed
    """
