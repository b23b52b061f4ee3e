"""WARC archives: a writer with revisit records, and a salvage reader.

Writing: every record becomes a gzip member of its own. Spark's text writer appends a fixed line end to each value; the
last byte of a member, the high byte of its length, is zero for records under 16 MB (larger ones are followed by an
empty member, which ends the same way), so the members are written without it and zero is the line end. The files so are plain
concatenations of members, written under Spark's commit protocol to any file system that Spark writes to.

Reading: each file is parsed from the start. When a member or record fails a check, the reader searches for the next valid member
or version line, goes on from there, and logs the bytes between as a quarantined gap. Inside a member it searches what was inflated,
also of a member that breaks off or fails its CRC; of such a member only records with a fitting block digest count.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, shared_dir, small_batches

# Fixed values of the format.
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/(?:0\.1[78]|1\.[01])\r\n")
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
EMPTY_MEMBER = zlib.compressobj(6, zlib.DEFLATED, 31).flush()
_NEXT = re.compile(rb"\nWARC/(?:0\.1[78]|1\.[01])\r\n")
#: Payload bytes and records of an archive file, on average and at most: a file is read as one piece.
_FILE_BYTES, _FILE_ROWS = 32 << 20, 5_000

RECORDS = "file string, offset long, length long, type string, record_id string, uri string, headers map<string,string>, payload binary, n_bytes long, sha string, gap boolean, reason string"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One uncompressed WARC/1.1 record. Line ends inside values become spaces."""
    head = "".join(f"{k}: {re.sub('[\r\n]+', ' ', v)}\r\n" for k, v in [*fields, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose last byte is zero (see the module's text)."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if not out[-1] else out + EMPTY_MEMBER


def page_record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, revisit: bool) -> bytes:
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {sha}')}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url or "about:blank"), ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http; msgtype=response"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if url is None:
        fields.append(("X-No-URI", "1"))
    if revisit:
        fields += [("WARC-Profile", PROFILE), *([("X-Refers-To-Page", str(refers_to))] if refers_to is not None else [])]
    return record_bytes(fields, HTTP if revisit else HTTP + payload)


def decide(pages: DataFrame, least: int = 0, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Add digest, n_bytes, first (smallest id of an equal payload of at least ``least`` bytes, else null) and revisit.

    Ids meet by digest without their payloads: minima combine on the map side, however many pages share a payload. Rows that repeat
    the smallest id are responses all; a null id is never smallest, and revisits the payload if any other page has it.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    own = pages.withColumn("n_bytes", F.length(payload).cast("long")).withColumn("key", F.sha1(payload))
    firsts = own.where(F.col("n_bytes") >= least).groupBy("key").agg(F.min(id_col).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    joined = own.join(settle(firsts, "firsts"), "key", "left")
    revisit = F.col("first").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("first"))
    return joined.withColumn("revisit", revisit)


def write(pages: DataFrame, path: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one record for each row to gzip archives under ``path``."""
    small_batches(pages.sparkSession)
    rows = decide(pages.select(id_col, url_col, html_col), least, id_col, html_col).select(id_col, url_col, html_col, "first", "revisit")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, url, text, first, again in zip(*(c.to_pylist() for c in b.columns)):
                payload = (text or "").encode("utf-8", "surrogatepass")
                out.append(member(page_record(i, url, payload, digest(payload), first, again))[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    data = rows.mapInArrow(members, "value binary").select(F.col("value").cast("string").alias("value"))
    mean = pages.agg(F.avg(F.octet_length(html_col))).first()[0] or 0.0
    data.write.option("lineSep", "\x00").option("maxRecordsPerFile", max(1, min(_FILE_ROWS, int(_FILE_BYTES / (mean + 500))))).text(path)


def member_at(data: bytes, at: int) -> tuple[bytes, int, bool]:
    """What the gzip member at ``at`` inflates to, the offset after it, and whether it is whole, with its CRC and length.

    Of a broken member all that inflates before the fault is given, with offset ``at``.
    """
    z, out, pos, view = zlib.decompressobj(31), [], at, memoryview(data)
    while pos < len(data) and not z.eof:
        before = z.copy()
        try:
            out.append(z.decompress(view[pos : pos + 65536]))
        except zlib.error:
            try:  # byte by byte up to the fault
                for k in range(pos, min(pos + 65536, len(data))):
                    out.append(before.decompress(view[k : k + 1]))
            except zlib.error:
                pass
            return b"".join(out), at, False
        pos = min(pos + 65536, len(data))
    return (b"".join(out), pos - len(z.unused_data), True) if z.eof else (b"".join(out), at, False)


def member_records(plain: bytes) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """Records of a member's bytes that pass all checks, and the gaps (start, end, reason) between them."""
    found, gaps, pos, gap, why = [], [], 0, None, ""
    while pos < len(plain):
        rec, after, reason = record_at(plain, pos)
        if rec is None:
            if gap is None:
                gap, why = pos, reason
            line = VERSION.search(plain, pos + 1)
            pos = line.start() if line else len(plain)
            continue
        if gap is not None:
            gaps.append((gap, pos, why))
            gap = None
        found.append(rec)
        pos = after
    if gap is not None:
        gaps.append((gap, len(plain), why))
    return found, gaps


def record_at(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """The record at ``at`` as fields and payload, the offset after it, and why it failed if it did.

    Checked: version line, header block, Content-Length, line ends after the block, block digest, and the payload digest of
    records that hold their payload.
    """
    v = VERSION.match(data, at)
    if not v:
        return None, at, "no version line"
    following = _NEXT.search(data, v.end())
    stop = data.find(b"\r\n\r\n", v.end() - 2, following.start() if following else len(data))
    if stop < 0:
        return None, at, "no end of headers"
    headers: dict[str, str] = {}
    last = ""
    for line in data[v.end() : stop].decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            headers[last] += " " + line.strip()
            continue
        k, colon, x = line.partition(":")
        if colon:
            last = k.strip().lower()
            headers[last] = x.strip()
    n = headers.get("content-length", "")
    if not n.isdigit():
        return None, at, "no Content-Length"
    start = stop + 4
    end = start + int(n)
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "block does not end where Content-Length says"
    block = data[start:end]
    said = headers.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != digest(block):
        return None, at, "block digest differs"
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        head = block.find(b"\r\n\r\n")
        payload = block[head + 4 :] if head >= 0 else b""
    said = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and said.startswith("sha1:") and said[5:] != digest(payload):
        return None, at, "payload digest differs"
    return {"headers": headers, "payload": payload}, end + 4, ""


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of an archive, plain or of gzip members or mixed, in order of their offsets.

    A record has type, headers, payload, offset and length (of its member, where compressed). Bytes from a failed check to the next
    place where a member or record passes all checks are one gap, with the first reason. Records of a broken member have the
    offset and length of the gap it is in; a gap inside a whole member has those of the member, and its bytes of the
    member in its reason. Nothing is read twice into the result and every byte belongs to a record, an empty member, or a gap.
    """
    at, gap, why = 0, None, ""
    saved: list[dict] = []  # of the broken members in the open gap

    def closed(to: int) -> Iterator[dict]:
        if gap is not None and to > gap:
            for rec in saved:
                yield {"gap": False, "offset": gap, "length": to - gap, **rec}
            yield {"gap": True, "offset": gap, "length": to - gap, "reason": why}

    while at < len(data):
        found, inner, end, reason = [], [], at, "no member or version line"
        if data.startswith(MAGIC, at):
            plain, end, whole = member_at(data, at)
            found, inner = member_records(plain)
            reason = "" if whole and (found or not inner) else inner[0][2] if whole else "member fails its check"
            if not whole:
                saved += [r for r in found if r["headers"].get("warc-block-digest", "").startswith("sha1:") and r not in saved]
        else:
            rec, end, reason = record_at(data, at)
            if rec is not None and rec not in saved:  # a broken member can hold its records uncompressed
                found.append(rec)
        if not reason:
            yield from closed(at)
            gap, saved = None, []
            for rec in found:
                yield {"gap": False, "offset": at, "length": end - at, **rec}
            for a, b, told in inner:
                yield {"gap": True, "offset": at, "length": end - at, "reason": f"{told} (bytes {a} to {b} of the member)"}
            at = end
            continue
        if gap is None:
            gap, why = at, reason
        # the next place that can start a member or a record
        line = VERSION.search(data, at + 1)
        magic = data.find(MAGIC, at + 1, line.start() if line else len(data))
        at = magic if magic >= 0 else line.start() if line else len(data)
    yield from closed(len(data))


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps of all archives under ``path``, a row each (columns: see RECORDS).

    A file is the unit of a task; gaps have gap true, their reason, and no payload. n_bytes and sha are taken from the payload
    that was read, payload itself is left null on request. Empty files give no rows.
    """
    small_batches(spark, 8)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for name, data in zip(files.column(0).to_pylist(), files.column(1)):
                rows: list[tuple] = []
                held = 0
                for r in salvage(data.as_py()):
                    h, payload = r.get("headers", {}), r.get("payload")
                    rows.append((name, r["offset"], r["length"], h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), list(h.items()), payload if payloads else None, None if payload is None else len(payload), None if payload is None else digest(payload), r["gap"], r.get("reason")))
                    held += len(payload or b"") if payloads else 500
                    if held > 1 << 24:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(records, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    text, whole = pa.string(), pa.int64()
    types = [text, whole, whole, text, text, text, pa.map_(text, text), pa.binary(), whole, text, pa.bool_(), text]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[c.split()[0] for c in RECORDS.split(", ")])


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in the shared folder and read their records back.

    Returns (page_id, url, payload_bytes, payload_digest, record_type, refers_to), a row for each page: repeated rows
    have a record each, null html is an empty payload, null urls come back null. Digests and lengths of responses are
    computed from the payload that was read, those of revisits from the record's headers. A gap in the archives raises an error.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, least)
    rows = read(spark, path, payloads=False)
    h = F.col("headers")
    revisit = F.col("type") == "revisit"
    id_type = pages.schema["page_id"].dataType
    checked = F.when(F.col("gap"), F.raise_error(F.concat(F.lit("gap in an archive just written: "), F.col("reason")))).otherwise(F.col("type"))
    sha = F.when(revisit, F.regexp_replace(h["warc-payload-digest"], "^sha1:", "")).otherwise(F.col("sha"))
    return rows.select(
        h["x-page-id"].cast(id_type).alias("page_id"), F.when(h["x-no-uri"].isNull(), F.col("uri")).alias("url"),
        F.when(revisit, h["x-payload-length"].cast("long")).otherwise(F.col("n_bytes")).alias("payload_bytes"),
        sha.alias("payload_digest"), checked.alias("record_type"), h["x-refers-to-page"].cast(id_type).alias("refers_to"))
