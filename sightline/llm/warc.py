"""WARC archives: gzip members by record, revisits for equal payloads, and a reader that salvages.

Archives are written through Spark's own text sink, so they go wherever Spark can write. Each record
is one gzip member. A member ends in the record's length, little-endian, so its last byte is 0 unless
the record has 16 MiB or more, and that byte is the sink's line end; larger records are followed by an
empty member, which ends in 0 too.

Of records with equal payloads, the one with the largest page_id is a response and the others revisit
it. Payloads move once, those of responses only, dealt by page_id; revisits are made from digests.
Null html is an empty payload. Rows with a null page_id rank below all others. Repeated rows that hold
the largest id of their payload are each a response.

The reader checks every member (gzip's checksum, the record's own length, the payload digest). Where a
check fails it searches for the next member or version line that reads as a record, goes on from there
and reports the bytes between as a gap. Within a member, also of one that breaks off, the whole records
are read, before and after a bad one; a gap's offsets are those of its member, its reason says where in
the decompressed bytes it lies. Bytes of a broken member after the break are searched like all others.
Nothing that can be read before or after a gap is lost.
"""
from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
EMPTY_MEMBER = zlib.compressobj(6, zlib.DEFLATED, 31).flush()


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def response_record(page_id, url, payload: bytes, digest: str | None = None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return _record("response", page_id, url, digest or payload_digest(payload), len(payload), http + payload, "application/http;msgtype=response")


def revisit_record(page_id, url, digest: str, length: int, refers_to) -> bytes:
    more = f"WARC-Refers-To: <urn:x-page:{'' if refers_to is None else refers_to}>\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
    return _record("revisit", page_id, url, digest, length, b"", "application/http;msgtype=response", more)


def _record(kind, page_id, url, digest, length, block: bytes, content: str, more: str = "") -> bytes:
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>\r\n"
        f"WARC-Target-URI: {uri}\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:{digest}\r\n"
        f"X-Payload-Length: {length}\r\n{more}Content-Type: {content}\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode("utf-8") + block + b"\r\n\r\n"


class Bad(ValueError):
    pass


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at `at` and where it ends; Bad if it doesn't hold."""
    if not data.startswith(VERSION, at):
        raise Bad("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Bad("header not ended")
    try:
        lines = data[at:end].decode("utf-8").split("\r\n")[1:]
    except UnicodeDecodeError:
        raise Bad("header not UTF-8") from None
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not re.fullmatch(r"\d{1,15}", head.get("content-length", "")):
        raise Bad("no length")
    start = end + 4
    stop = start + int(head["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Bad("length doesn't fit")
    block = data[start:stop]
    kind = head.get("warc-type", "")
    payload = None
    if kind == "response":
        cut = block.find(b"\r\n\r\n")
        payload = block[cut + 4 :] if cut >= 0 and block.startswith(b"HTTP/") else block
        said = head.get("warc-payload-digest", "")
        if said.startswith("sha1:") and said[5:] != payload_digest(payload):
            raise Bad("payload digest differs")
    return {"head": head, "type": kind, "payload": payload}, stop + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What a member holds as far as it decompresses, where it ends (if broken: `at`), and what broke it."""
    z, view, out, end = zlib.decompressobj(31), memoryview(data), [], at
    while not z.eof and end < len(data):
        last, step = z.copy(), 65536
        try:
            out.append(z.decompress(view[end : end + step]))
        except zlib.error as e:  # again in single bytes, for what comes before the break
            for i in range(end, min(len(data), end + step)):
                try:
                    out.append(last.decompress(view[i : i + 1]))
                except zlib.error:
                    break
            return b"".join(out), at, f"gzip: {e}"
        end = min(len(data), end + step)
    if not z.eof:
        return b"".join(out) + z.flush(), at, "gzip member not ended"
    return b"".join(out), end - len(z.unused_data), ""


def _inside(plain: bytes):
    """("record", record) and ("gap", reason) of decompressed bytes, in order."""
    at, bad_from, why = 0, None, ""
    while at < len(plain):
        try:
            rec, end = parse_record(plain, at)
        except Bad as e:
            if bad_from is None:
                bad_from, why = at, str(e)
            at = plain.find(VERSION, at + 1)
            at = len(plain) if at < 0 else at
            continue
        if bad_from is not None:
            yield "gap", f"{why} (bytes {bad_from} to {at} of the member)"
            bad_from = None
        yield "record", rec
        at = end
    if bad_from is not None:
        yield "gap", f"{why} (bytes {bad_from} to {len(plain)} of the member)"


def salvage(data: bytes):
    """("record", offset, end, record) and ("gap", offset, end, reason), in order, covering all bytes.

    Records and gaps within a member have the member's offsets; of a broken member they end at its first
    byte, where the gap of the break starts.
    """
    at, size, bad_from, why = 0, len(data), None, ""
    seen = {MAGIC: -1, VERSION: -1}  # the last finds, so that many broken members in a row cost one search
    while at < size:
        found, bad = [], ""
        if data.startswith(MAGIC, at):
            plain, end, bad = _inflate(data, at)
            found = list(_inside(plain))
            if not any(what == "record" for what, _ in found):  # the member is the gap
                bad = bad or (found[0][1].partition(" (bytes")[0] if found else "")
                found = []
            elif bad and found[-1][0] == "gap":  # the rest before the break is part of its gap
                found.pop()
        else:
            try:
                rec, end = parse_record(data, at)
                found.append(("record", rec))
            except Bad as e:
                bad = str(e)
        if bad_from is not None and (found or not bad):
            yield "gap", bad_from, at, why
            bad_from = None
        for what, x in found:
            yield what, at, end, x
        if bad:
            if bad_from is None:
                bad_from, why = at, bad
            for mark, last in seen.items():
                if last <= at:
                    here = data.find(mark, at + 1)
                    seen[mark] = size if here < 0 else here
            at = min(seen.values())
        else:
            at = end
    if bad_from is not None:
        yield "gap", bad_from, size, why


RECORDS = "archive string, offset bigint, kind string, page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, gap_bytes bigint, gap_reason string"


def _page(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:x-page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of RECORDS: kind is record or gap. Each archive is one row of a file scan, so it must be under 2 GB."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows, held = [], 0
                for what, at, end, x in salvage(content.as_py()):
                    if what == "gap":
                        rows.append((name.as_py(), at, "gap", None, None, None, None, None, None, None, end - at, x))
                    else:
                        h, body = x["head"], x["payload"]
                        n = len(body) if body is not None else int(h["x-payload-length"]) if h.get("x-payload-length", "").isdigit() else None
                        rows.append((name.as_py(), at, "record", _page(h.get("warc-record-id")), h.get("warc-target-uri"), body if payloads else None, n, h.get("warc-payload-digest", "").removeprefix("sha1:"), x["type"], _page(h.get("warc-refers-to")), None, None))
                        held += len(body or b"") if payloads else 0
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    return files.mapInArrow(run, RECORDS)


_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=[x.split()[0] for x in RECORDS.split(", ")])


def write_archives(pages: DataFrame, path: str, archive_mb: int = 32) -> None:
    """pages: page_id, url, html. About archive_mb of payload an archive."""
    spark = pages.sparkSession
    body = F.coalesce(F.encode("html", "UTF-8"), F.lit(b"").cast("binary"))
    meta = pages.select("page_id", "url", F.sha1(body).alias("sha1"), F.octet_length(body).cast("long").alias("length"))
    rank = F.coalesce("page_id", F.lit(-(1 << 63)))
    best = meta.groupBy("sha1").agg(F.max(rank).alias("best"))
    n = max(1, -(-(meta.agg(F.sum("length")).first()[0] or 0) // (archive_mb << 20)), int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    first = pages.select("page_id", "url", body.alias("body"), F.sha1(body).alias("sha1"), rank.alias("rank")).repartition(n, "rank", "sha1")  # rows without an id go by their payloads
    winners = best.select(F.col("sha1").alias("_sha1"), "best")
    # responses: by id, which is even; revisits: by digest, without payloads (a hot digest is small rows, split by AQE)
    responses = first.join(winners, (F.col("rank") == F.col("best")) & (F.col("sha1") == F.col("_sha1"))).select("page_id", "url", "body", "sha1", F.octet_length("body").cast("long").alias("length"), F.lit(None).cast("long").alias("refers_to"), F.lit(True).alias("full"))
    revisits = meta.join(winners, F.col("sha1") == F.col("_sha1")).where(rank < F.col("best")).select("page_id", "url", F.lit(None).cast("binary").alias("body"), "sha1", "length", F.col("best").alias("refers_to"), F.lit(False).alias("full"))

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                rec = response_record(r["page_id"], r["url"], r["body"], digest) if r["full"] else revisit_record(r["page_id"], r["url"], digest, r["length"], r["refers_to"])
                packed = member(rec)
                out.append((packed if not packed[-1] else packed + EMPTY_MEMBER)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = responses.unionByName(revisits).mapInArrow(run, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)
