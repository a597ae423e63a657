"""WARC archives: writing, normalising monolithic gzip files, reading by offset.

1. Records are dealt to archives by a hash of their id; each archive is one
   gzip stream over all its records.
2. The normaliser inflates such a file once, front to back, finds every record
   in the stream and writes it as a gzip member of its own, with a sidecar index
   of (record id, offset, length).
3. The reader opens an archive, goes to the offsets of its index and inflates
   single members.

Files lie in the shared folder and are opened through pyarrow's file systems by
URI, so any store that pyarrow knows will do. A task writes to a name of its own
attempt and moves the file into place, so a repeated or speculative task leaves
one whole file.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, bounded_batches

_VERSION = b"WARC/1.0\r\n"
CHUNK = 1 << 16
#: Payloads shorter than this are stored again rather than revisited.
LEAST_REVISIT = 100


PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_URI = "!#$%&'()*+,/:;=?@[]-._~"


def record_bytes(record_id: int | None, url: str | None, date: str, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """A response, its HTTP message with the payload, or a revisit that names the
    response and holds the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:record:{'none' if record_id is None else record_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url, safe=_URI) if url else 'urn:none'}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:record:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return _VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def payload_of(record: bytes) -> tuple[dict[str, str], int, bytes]:
    """(WARC head, payload bytes as the HTTP head says, body) of a whole record.
    A response whose body has another length or digest than stated is an error."""
    cut = record.index(b"\r\n\r\n")
    head = parse_head(record[: cut + 2])
    http, _, body = record[cut + 4 : -4].partition(b"\r\n\r\n")
    size = int(re.search(rb"(?mi)^Content-Length: *([0-9]+)", http)[1])
    if head["warc-type"] == "response":
        digest = hashlib.sha256(body).hexdigest()
        if len(body) != size or f"sha256:{digest}" != head["warc-payload-digest"]:
            raise ValueError(f"{head['warc-record-id']}: the payload of {len(body)} bytes, sha256:{digest}, isn't the {size} bytes, {head['warc-payload-digest']}, that its heads state")
    return head, size, body


def parse_head(head: bytes) -> dict[str, str]:
    if not head.startswith(_VERSION):
        raise ValueError("not a WARC record")
    lines = head[len(_VERSION) :].decode().split("\r\n")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines if line)}


def split_records(chunks):
    """(head, whole record) of a stream of inflated chunks; holds one record at a time."""
    held = bytearray()
    need = None
    for chunk in chunks:
        held += chunk
        while True:
            if need is None:
                at = held.find(b"\r\n\r\n")
                if at < 0:
                    break
                head = bytes(held[: at + 2])
                need = at + 4 + int(parse_head(head)["content-length"]) + 4
            if len(held) < need:
                break
            yield head, bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the stream ends within a record")


def inflate(source):
    """Chunks of a gzip stream; of one member or of several."""
    box = zlib.decompressobj(31)
    while raw := source.read(CHUNK):
        while raw:
            yield box.decompress(raw)
            raw = box.unused_data
            if box.eof:
                box = zlib.decompressobj(31)
            elif not raw:
                break
    yield box.flush()


def _open(path: str):
    system, where = fs.FileSystem.from_uri(path)
    return system, where


class _Replacing:
    """A file that takes its name when it is closed without an error."""

    def __init__(self, path: str):
        self.system, self.path = _open(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.system.create_dir(os.path.dirname(self.path), recursive=True)

    def __enter__(self):
        self.file = self.system.open_output_stream(self.part, compression=None)
        return self.file

    def __exit__(self, kind, value, trace):
        self.file.close()
        if kind is None:
            self.system.move(self.part, self.path)
        else:
            self.system.delete_file(self.part)


def _write(base: str, date: str):
    def archive(number: int, rows):
        path = f"{base}/{number:08d}.warc.gz"
        count = 0
        with _Replacing(path) as out:
            box = zlib.compressobj(6, zlib.DEFLATED, 31)
            for row in rows:
                out.write(box.compress(record_bytes(*row)))
                count += 1
            out.write(box.flush())
        return path, count

    def run(batches):
        """Rows of an archive stand together."""

        def rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True)

        def referred(stream):
            """A row without a size names the response of the records with its id and digest, which follow it."""
            of, known = None, {}
            for number, record, payload, size, digest, first, url in stream:
                if (number, record) != of:
                    of, known = (number, record), {}
                if size is None:
                    known[digest] = first
                else:
                    yield number, record, payload, size, digest, known.get(digest), url

        stream = referred(rows())
        row = next(stream, None)
        while row is not None:
            number, ahead = row[0], [row]

            def mine(number=number, ahead=ahead):
                while ahead[0] is not None and ahead[0][0] == number:
                    _, record, payload, size, digest, first, url = ahead[0]
                    yield record, url, date, (payload or "").encode(), size, digest, first
                    ahead[0] = next(stream, None)

            path, count = archive(number, mine())
            row = ahead[0]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([path]), pa.array([count], pa.int64())], names=["archive", "path", "records"])

    return run


def _normalise(replace: bool):
    def members(path: str, target: str) -> int:
        system, where = _open(path)
        at, index = 0, []
        with system.open_input_stream(where, compression=None) as source, _Replacing(target) as out:
            for head, record in split_records(inflate(source)):
                box = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = box.compress(record) + box.flush()
                out.write(member)
                index.append(f"{parse_head(head)['warc-record-id']}\t{at}\t{len(member)}\n")
                at += len(member)
        with _Replacing(target + ".idx") as out:
            out.write("".join(index).encode())
        if replace:
            system.delete_file(where)
        return len(index)

    def done(target: str) -> int:
        """Records of a target that an earlier attempt has finished, its source gone."""
        system, where = _open(target + ".idx")
        with system.open_input_stream(where, compression=None) as f:
            return f.read().count(b"\n")

    def run(batches):
        for batch in batches:
            for number, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = path.replace(".warc.gz", ".members.warc.gz")
                try:
                    count = members(path, target)
                except FileNotFoundError:
                    if not replace:
                        raise
                    count = done(target)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([target]), pa.array([count], pa.int64())], names=["archive", "path", "records"])

    return run


_ARCHIVES = "archive int, path string, records long"
_READ = "record_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, stored binary"


def _number(urn: str | None) -> int | None:
    last = urn.strip("<>").rpartition(":")[2] if urn else "none"
    return None if last == "none" else int(last)


def _read(with_payload: bool):
    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, where = _open(path)
                with system.open_input_stream(where + ".idx", compression=None) as f:
                    index = [line.split("\t") for line in f.read().decode().splitlines()]
                rows = []
                with system.open_input_file(where) as f:
                    for urn, at, length in index:
                        f.seek(int(at))
                        record = zlib.decompress(f.read(int(length)), 31)
                        head, size, body = payload_of(record)
                        if head["warc-record-id"] != urn:
                            raise ValueError(f"{path}: the index names {urn}, the record is {head['warc-record-id']}")
                        rows.append((_number(urn), size, head["warc-payload-digest"].partition(":")[2], head["warc-type"], _number(head.get("warc-refers-to")), body if with_payload else None))
                        if len(rows) == 500:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows):
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "stored"])


def write_archives(records: DataFrame, base: str, *, id_col: str, payload_col: str, url_col: str | None = None, date: str | None = None, archive_bytes: int = 16 << 20) -> DataFrame:
    """Writes monolithic archives below base; (archive, path, records) of each.
    date is every record's WARC-Date; the time of the call where none is given."""
    spark: SparkSession = records.sparkSession
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
    url = quoted(url_col).cast("string") if url_col else F.lit(None).cast("string")
    rows = records.select(quoted(id_col).cast("long").alias("id"), F.coalesce(quoted(payload_col).cast("string"), F.lit("")).alias("payload"), url.alias("url"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    # Digests that occur again are aggregated before they are shuffled and joined to ids alone;
    # the payloads are shuffled once, to their archives, where a record's reference stands before it.
    digests = rows.where(F.col("id").isNotNull() & (F.col("size") >= LEAST_REVISIT)).select("id", "digest")
    again = digests.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    revisits = digests.join(again, "digest").where("id <> first_id").distinct()
    total = rows.agg(F.sum("size")).first()[0] or 0
    count = max(1, -(-total // archive_bytes), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total >> 20))
    none = lambda kind: F.lit(None).cast(kind)
    named = revisits.select("id", none("string").alias("payload"), none("long").alias("size"), "digest", F.col("first_id").alias("refers_to"), none("string").alias("url"))
    both = named.unionByName(rows.withColumn("refers_to", none("long")))
    # Rows without an id are spread by their digests.
    number = F.pmod(F.xxhash64(F.coalesce("id", F.xxhash64("digest", "url"))), F.lit(count)).cast("int")
    dealt = both.select(number.alias("archive"), "id", "payload", "size", "digest", "refers_to", "url")
    ordered = dealt.repartitionById(count, F.col("archive")).sortWithinPartitions("archive", "id", F.col("size").asc_nulls_first())
    return ordered.mapInArrow(_write(base, date), _ARCHIVES)


def normalise_archives(paths: DataFrame, *, replace: bool = False) -> DataFrame:
    """Rewrites each monolithic archive as members with a sidecar index; (archive,
    path, records). With replace an archive goes once its members and index are whole."""
    return paths.select("archive", "path").mapInArrow(_normalise(replace), _ARCHIVES)


def read_archives(paths: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """A row per record, read member by member; stored holds a response's payload.
    Every payload is hashed; ValueError where it isn't what the record states."""
    return paths.select("path").mapInArrow(_read(with_payload), _READ)


def archive_round_trip(records: DataFrame, *, id_col: str, payload_col: str, url_col: str | None = None, with_payload: bool = False) -> DataFrame:
    """Writes, normalises and reads back a WARC record for each row.

    The payload is the text in UTF-8, of any length; null counts as empty. Of
    records with equal payloads of LEAST_REVISIT bytes or more the smallest id is
    a response, the others revisit it; shorter ones are all responses, and so are
    rows without an id. Repeated rows of one id are records of their own,
    responses all if theirs is the smallest id. Columns but the named ones are
    ignored. An empty table gives an empty result.
    """
    spark: SparkSession = records.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "warc")
    written = scratch.keep(write_archives(records, f"{scratch.base}/archives", id_col=id_col, payload_col=payload_col, url_col=url_col), "written")
    count = (written.agg(F.max("archive")).first()[0] or 0) + 1
    members = scratch.keep(normalise_archives(written.repartitionById(count, F.col("archive")), replace=True), "members")
    return read_archives(members.repartitionById(count, F.col("archive")), with_payload=with_payload)
