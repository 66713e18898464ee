"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each with some whole records, and a last skippable frame: the
seek table in the layout that Zstandard's seekable format lays down. Record identifiers map to a frame and the offset
in that frame's decompressed bytes, so that one record is read without the rest of its bundle. Bundles are rows of a
table (bundle_id, content, index), which any file system that Spark writes can hold; ``export`` writes them as files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Fixed values of the seekable format: the skippable frame's number, the footer's number.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 25
#: Pages of one payload beyond which its target is broadcast.
HOT = 100_000
BUNDLES = "bundle_id string, content binary, index array<struct<record_id:string,frame:int,offset:long,length:long>>"
READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str, place: str = "") -> str:
    """The identifier of a page's record with a payload; rows that repeat both are told apart by their place."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{payload_digest}:{place}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, place: str = "", named: bool = True) -> tuple[str, bytes]:
    """(record identifier, bytes) of one response or revisit record.

    A revisit names its target, by its record too where that is ``named`` (has no place), and carries no payload.
    """
    rid = record_id(page_id, payload_digest, place)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {rid}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page: {refers_to}"]
        if named:
            head.append(f"WARC-Refers-To: {record_id(refers_to, payload_digest)}")
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return rid, "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def bundle(records: Iterable[tuple[str, bytes]], frame_bytes: int = FRAME_BYTES, level: int = 3) -> tuple[bytes, list[tuple[str, int, int, int]]]:
    """(content, index): the records in frames of about ``frame_bytes`` with the seek table at the end."""
    pack, out, table, index, frame = zstandard.ZstdCompressor(level=level), [], [], [], bytearray()

    def close() -> None:
        if frame:
            out.append(pack.compress(bytes(frame)))
            table.append((len(out[-1]), len(frame)))
            frame.clear()

    for rid, raw in records:
        index.append((rid, len(out), len(frame), len(raw)))
        frame += raw
        if len(frame) >= frame_bytes:
            close()
    close()
    entries = b"".join(struct.pack("<II", *x) for x in table)
    footer = struct.pack("<IBI", len(table), 0, SEEKABLE)
    return b"".join(out) + struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer, index


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed bytes, decompressed bytes) of each frame, from the end of a bundle."""
    n, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE or flags & 0x80:
        raise ValueError("no seek table without checksums at the end of the bundle")
    at = len(content) - 9 - 8 * n
    if struct.unpack("<II", content[at - 8 : at]) != (SKIPPABLE, 8 * n + 9):
        raise ValueError("the seek table's frame is damaged")
    out, start = [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", content, at + 8 * i)
        out.append((start, packed, plain))
        start += packed
    return out


def frame(content: bytes, number: int) -> bytes:
    """One frame's decompressed bytes; no other frame is touched."""
    start, packed, plain = seek_table(content)[number]
    return zstandard.ZstdDecompressor().decompress(content[start : start + packed], max_output_size=plain)


def parse(plain: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record that begins at ``at``."""
    end = plain.index(b"\r\n\r\n", at)
    first, *lines = plain[at:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no record begins here")
    head = dict(line.split(": ", 1) for line in lines)
    body = end + 4
    stop = body + int(head["Content-Length"])
    if plain[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    return head, plain[body:stop], stop + 4


def lookup(content: bytes, index: list[tuple[str, int, int, int]], record_id: str) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, by its frame and offset."""
    _, number, offset, _ = next(x for x in index if x[0] == record_id)
    head, block, _ = parse(frame(content, number), offset)
    return head, block


def _write(frame_bytes: int, bundle_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple[str, bytes]] = []
        size = 0

        def out() -> pa.RecordBatch:
            content, index = bundle(held, frame_bytes)
            rows = [dict(zip(("record_id", "frame", "offset", "length"), x, strict=True)) for x in index]
            kind = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
            return pa.record_batch([pa.array([f"{part:06d}-{made:06d}"]), pa.array([content], pa.binary()), pa.array([rows], kind)], ["bundle_id", "content", "index"])

        for batch in batches:
            for page_id, url, html, sha, first, twin, named in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "twin", "named")), strict=True):
                held.append(record(page_id, url, (html or "").encode(), sha, first, f"{part}-{made}-{len(held)}" if twin else "", named))
                size += len(held[-1][1])
                if size >= bundle_bytes:
                    yield out()
                    held, size, made = [], 0, made + 1
        if held:
            yield out()

    return run


def write_bundles(pages: DataFrame, at_least: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Bundles of a record per row of (page_id, url, html).

    Of equal payloads of at least ``at_least`` bytes, the smallest page_id's is a response and the others revisit it; rows
    that repeat that page_id and payload are responses too. Null html is an empty payload; null ids sort last and never are
    a target unless all are null, when all are responses. Other columns are ignored. No rows, no bundles.
    Record identifiers are unique: page_id and digest make them, and for rows that repeat both their place in the bundles too.
    WARC-Refers-To names the target's record, WARC-Refers-To-Page its page_id; where rows repeat the target the latter alone.
    Pages meet their target by (page_id, digest), not by payload; payloads that are very frequent meet it by a broadcast, since
    at most one in HOT rows can be such a payload.
    """
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    sha = F.sha1(F.col("html").cast("binary"))
    keyed = plain.select("page_id", sha.alias("sha"), F.octet_length("html").alias("size")).groupBy("page_id", "sha").agg(F.count(F.lit(1)).alias("rows"), F.first("size").alias("size"))
    first = keyed.where(f"size >= {int(at_least)}").groupBy("sha").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", (F.col("rows") == 1).alias("named"))).alias("to"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1 AND to.page_id IS NOT NULL").select("sha", F.col("to.page_id").alias("refers_to"), F.col("to.named").alias("named"), "n")
    hot = F.broadcast(first.where(F.col("n") > HOT).drop("n"))
    cold = keyed.join(hot.select("sha"), "sha", "left_anti").join(first.where(F.col("n") <= HOT).drop("n"), "sha", "left")
    later = cold.unionByName(keyed.join(hot, "sha")).where("rows > 1 OR NOT page_id <=> refers_to AND refers_to IS NOT NULL")
    later = later.select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), F.when(~F.col("page_id").eqNullSafe(F.col("refers_to")), F.col("refers_to")).alias("refers_to"), "named", (F.col("rows") > 1).alias("twin"))
    out = plain.withColumn("sha", sha)
    out = out.join(later, out["page_id"].eqNullSafe(later["_id"]) & (out["sha"] == later["_sha"]), "left")
    return out.select("page_id", "url", "html", F.col("sha").alias("digest"), "refers_to", "twin", "named").mapInArrow(_hexed(_write(frame_bytes, bundle_bytes)), BUNDLES)


def _hexed(write):
    """WARC writes digests in base32; Spark's sha1 is hexadecimal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turned() -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = b.schema.get_field_index("digest")
                yield b.set_column(at, "digest", pa.array([base64.b32encode(bytes.fromhex(x)).decode() for x in b.column(at).to_pylist()], pa.string()))

        yield from write(turned())

    return run


def _read(check: bool, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                content = content.as_py()
                for number in range(len(seek_table(content))):
                    plain, at, rows = frame(content, number), 0, []
                    while at < len(plain):
                        head, block, at = parse(plain, at)
                        sha, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                        if check and kind == "response" and digest(block) != sha:
                            raise ValueError(f"{head['WARC-Record-ID']}: the payload does not have its digest")
                        page, to = head.get("WARC-Page-ID"), head.get("WARC-Refers-To-Page")
                        rows.append((page and int(page), head.get("WARC-Target-URI"), kind, int(head["WARC-Payload-Length"]), sha, to and int(to), block if payloads else None))
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in READ.split(", ")])

    return run


def read_bundles(bundles: DataFrame, check: bool = True, payloads: bool = True) -> DataFrame:
    """The records of bundles, frame by frame through the seek tables; digests of responses are computed anew.

    A revisit's payload is empty. Without ``payloads`` that column is null.
    """
    return bundles.select("content").mapInArrow(_read(check, payloads), READ)


def export(bundles: DataFrame, folder: str) -> int:
    """Writes every bundle to folder/<bundle_id>.warc.zst through a file system that Arrow opens by its URI; returns how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("bundle_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with store.open_output_stream(f"{base}/{name}.warc.zst", compression=None) as f:
                    f.write(content)
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], ["n"])

    return bundles.select("bundle_id", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def warc_digest(pages: DataFrame) -> DataFrame:
    """Writes the archives to the shared folder and reads them back: a row for each page.

    Null html is an empty payload; null ids are no target but among themselves; rows that repeat an id and payload are responses each;
    no rows, no archives and no rows.
    """
    written = Scratch(pages.sparkSession).save(write_bundles(pages))
    return read_bundles(written, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows by DuckDB, which has no base32: the digest's hexadecimal digits are spelt in base 32 through 5-bit groups.
SQL = """
WITH plain AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), hashed AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first_id FROM plain
), bits AS (
  SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: right(bin(('0x' || hex[i])::INTEGER + 16), 4)), 'string_agg', '') AS bits FROM hashed
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda g: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(list_sum(list_transform(range(0, 5), lambda b: (bits[g * 5 + b + 1])::INTEGER * (16 >> b)))::INTEGER + 1)]), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM bits
"""
