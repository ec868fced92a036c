"""WARC records in seekable Zstandard bundles.

Records are packed into independent Zstandard frames; a bundle is its frames and
a footer, the seek table of Zstandard's seekable format (a skippable frame), so
any reader of plain .zst files reads it from front to back, and one that knows
the footer reads single frames. An index maps record ids to (bundle, frame,
offset in the frame, length). Bundles are binary rows of a Spark table: tasks
write them through Spark's committer to whatever store the path names, and a
lost executor's bundles are written again.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import body, cut

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
#: A frame closes beyond this many raw bytes, a bundle beyond this many compressed ones; one record may be larger.
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 4 << 20
#: Payloads of at least so many bytes are written once; later ones revisit.
MIN_REVISIT_BYTES = 0
#: Fixed date of the records, so that reruns give the same bytes.
RECORD_DATE = "2000-01-01T00:00:00Z"
_NS = uuid.UUID(int=0x5EEC)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None, digest: str, nth: str = "") -> str:
    """The id of a page's record; ``nth`` tells repeated rows apart."""
    return f"<urn:uuid:{uuid.uuid5(_NS, f'{page_id}|{url}|{digest}{nth}')}>"


def _one_line(value: str) -> str:
    return "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in value)


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, refers_url: str | None = None, rid: str | None = None) -> bytes:
    """One WARC/1.1 record. A revisit holds no payload; its digest and length
    are those of the full payload, and it names the record that has it."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {rid or record_id(page_id, url, digest)}",
        f"WARC-Date: {RECORD_DATE}",
        f"WARC-Target-URI: {_one_line(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
        f"WARC-Payload-Length: {size}",
    ]
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, refers_url, digest)}",
            f"WARC-Refers-To-Target-URI: {_one_line(refers_url or '')}",
            f"WARC-Refers-To-Date: {RECORD_DATE}",
            f"WARC-Refers-To-Page-ID: {refers_to}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, offset after the record) of the record at ``at``."""
    end = raw.index(b"\r\n\r\n", at)
    lines = raw[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    start = end + 4
    stop = start + int(head["Content-Length"])
    block = raw[start:stop]
    return head, block[block.index(b"\r\n\r\n") + 4 :], stop + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (compressed, raw) sizes."""
    entries = b"".join(struct.pack("<II", c, d) for c, d in frames)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + 9) + entries + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed, raw) of each frame, from the footer alone."""
    n, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    at, out = 0, []
    for c, d in struct.iter_unpack("<II", bundle[-9 - 8 * n : -9]):
        out.append((at, c, d))
        at += c
    return out


class _Bundle:
    def __init__(self) -> None:
        self.out, self.frames, self.raw, self.index, self.done = [], [], bytearray(), [], 0

    def add(self, rid: str, rec: bytes) -> None:
        self.index.append((rid, len(self.frames), len(self.raw), len(rec)))
        self.raw += rec
        if len(self.raw) >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.raw:
            z = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(bytes(self.raw))
            self.frames.append((len(z), len(self.raw)))
            self.out.append(z)
            self.done += len(z)
            self.raw = bytearray()

    def close(self) -> tuple[bytes, list]:
        self.close_frame()
        return b"".join(self.out) + seek_table(self.frames), self.index


_BUNDLE_SCHEMA = "bundle_id string, bundle binary, index array<struct<record_id:string,frame:int,offset:long,length:long>>"
_ARROW = pa.schema(
    [
        ("bundle_id", pa.string()),
        ("bundle", pa.binary()),
        ("index", pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))),
    ]
)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(b: _Bundle) -> pa.RecordBatch:
        data, index = b.close()
        name = hashlib.sha256(data).hexdigest()[:32]
        rows = [dict(zip(("record_id", "frame", "offset", "length"), x)) for x in index]
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary()), pa.array([rows], _ARROW.field("index").type)], schema=_ARROW)

    now, times, task = _Bundle(), Counter(), TaskContext.get()
    for b in batches:
        for page_id, url, html, digest, size, ref, ref_url in zip(*(c.to_pylist() for c in b.columns)):
            rid = record_id(page_id, url, digest)
            times[rid] += 1
            if times[rid] > 1:  # a repeated row
                rid = record_id(page_id, url, digest, f"|{task.partitionId() if task else 0}|{times[rid]}")
            now.add(rid, make_record(page_id, url, html, digest, size, ref, ref_url, rid))
            if now.done >= BUNDLE_BYTES:
                yield flush(now)
                now = _Bundle()
    if now.index:
        yield flush(now)


_READ_SCHEMA = "page_id long, url string, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _unpack(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bundle, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield _read_bundle(bundle, index, with_payload)

    return run


def _read_bundle(bundle: bytes, index: list[dict], with_payload: bool) -> pa.RecordBatch:
    frames, rows, now, raw = read_seek_table(bundle), [], -1, b""
    for e in index:
        if e["frame"] != now:
            now = e["frame"]
            at, c, _ = frames[now]
            raw = zstandard.ZstdDecompressor().decompress(bundle[at : at + c])
        head, payload, after = parse_record(raw, e["offset"])
        if after != e["offset"] + e["length"] or head["WARC-Record-ID"] != e["record_id"]:
            raise ValueError(f"index and record differ: {e}")
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = head["WARC-Type"]
        if kind == "response" and (digest32(payload) != digest or len(payload) != int(head["WARC-Payload-Length"])):
            raise ValueError(f"payload of {e['record_id']} is damaged")
        number = lambda k: int(head[k]) if head.get(k) else None
        rows.append((number("WARC-Page-ID"), head["WARC-Target-URI"], e["record_id"], number("WARC-Payload-Length"), digest, kind, number("WARC-Refers-To-Page-ID"), payload if with_payload and kind == "response" else None))
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = [x.split()[0] for x in _READ_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def write_bundles(pages: DataFrame, min_revisit: int = MIN_REVISIT_BYTES, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all rows of ``pages`` as records; returns the bundles as read back
    from the shared folder: (bundle_id, bundle, index).

    Of rows with equal payloads of at least ``min_revisit`` bytes the smallest
    id is the response; the others revisit it and hold no payload. Rows that
    share that id (repeated rows) are responses too. A null payload is empty; a
    null id never is the one referred to unless all of its copies are null,
    and then each of them is a response. Repeated rows have record ids of their
    own. A very long payload is one record, held in memory. An empty table gives
    none; other columns are ignored. The bundles are written while this is
    called. Payloads are shuffled once, joined to the small table
    of digests; copies of one payload may be any share of all rows, as Spark
    splits a skewed join partition.
    """
    src = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body(html).alias("html"))
    keyed = src.withColumn("sha", F.unhex(F.sha1("html"))).withColumn("size", F.length("html").cast("long"))
    place = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    first = keyed.groupBy("sha", "size").agg(F.min(place).alias("p"), F.count("*").alias("n"))
    first = first.where((F.col("n") > 1) & (F.col("size") >= min_revisit)).select(F.col("sha").alias("f_sha"), F.col("p.page_id").alias("first"), F.col("p.url").alias("first_url"))
    joined = keyed.join(first.hint("shuffle_hash"), F.col("sha") == F.col("f_sha"), "left")
    ref = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    b32 = _base32(F.hex("sha"))
    rows = joined.select("page_id", "url", F.when(ref.isNull(), F.col("html")).alias("html"), b32.alias("digest"), "size", ref.alias("refers_to"), "first_url")
    return cut(rows.mapInArrow(_pack, _BUNDLE_SCHEMA), "bundles")


def _base32(hexed):
    """Base32 of 20 bytes in hex: 160 bits, 32 digits of 5 bits."""
    parts = [F.lpad(F.conv(F.substring(hexed, i, 5), 16, 2), 20, "0") for i in range(1, 41, 5)]
    bits = F.concat(*parts)
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    digits = [F.substr(alphabet, F.conv(F.substring(bits, i, 5), 2, 10).cast("int") + F.lit(1), F.lit(1)) for i in range(1, 161, 5)]
    return F.concat(*digits)


def read_bundles(bundles: DataFrame, payload: bool = False) -> DataFrame:
    """One row per record, through each bundle's seek table and index. Damaged
    frames, payloads or index entries raise."""
    return bundles.select("bundle", "index").mapInArrow(_unpack(payload), _READ_SCHEMA)


def lookup(bundles: DataFrame, record_ids: DataFrame) -> DataFrame:
    """The records named in ``record_ids`` (record_id), decompressing only the
    frames that hold them. Null, unknown and repeated ids add nothing; a very
    long record ends its frame; an empty list or no bundles give none."""
    at = bundles.select("bundle_id", F.inline("index")).join(record_ids.select("record_id").distinct(), "record_id")
    wanted = at.groupBy("bundle_id").agg(F.sort_array(F.collect_list(F.struct("frame", "offset", "length", "record_id"))).alias("w"))
    index = F.transform("w", lambda x: F.struct(x["record_id"].alias("record_id"), x["frame"].alias("frame"), x["offset"].alias("offset"), x["length"].alias("length")))
    return bundles.join(wanted, "bundle_id").select("bundle", index.alias("index")).mapInArrow(_unpack(True), _READ_SCHEMA)
