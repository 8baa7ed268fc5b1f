"""WARC archives: writing with revisit records, and a salvage reader.

Writing is a plain DataFrame job: payload digests, the choice of response and revisit records, and the record text
are built-in functions, and Spark's text writer stores the records (the blank lines that end a WARC record are its line
separator), so archives go to whatever file system the shared folder is on. Reading takes each archive as one of Spark's binary
files, so the writer bounds an archive to ``archive_bytes`` and a record: records are written by classes of their size, and in each as many go
to a file as there is room for the class's largest.

The reader checks each record (version line, header block, length, end marks, payload digest; for gzip members also the
member's own check sum). Plain records and gzip members may stand in one file in any order. After a failed check it searches for
the next version line or gzip magic at which a whole record is valid, goes on from there, and reports the bytes in between as a
``gap`` row with the reason. Of a member that holds more than one record, is damaged within, or was cut short, the records that can
be unpacked are salvaged in the same way, and rows of these carry the member's offset and ``inner``, the place in the unpacked data. A
member that unpacks to more than ``MOST_UNPACKED`` bytes is salvaged up to there, and the rest is a gap. A header block is sought over
``MOST_HEADER`` bytes, and of a gzip magic whose first ``MOST_PROBED`` unpacked bytes hold no version line nothing more is unpacked. So reading is
linear in an archive's size, also where every record is damaged.

Defined results: a null payload is empty; a null id is written without a record id, and reads back as null; rows
with equal id and payload are all responses; an empty table gives no archive and no row.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_path

END = b"\r\n\r\n"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MAGIC = b"\x1f\x8b\x08"
#: Where a record or member can begin.
MARK = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
EPOCH = "1970-01-01T00:00:00Z"
MOST_UNPACKED = 1 << 30
MOST_HEADER, MOST_PROBED = 1 << 24, 1 << 20
#: Upper ends of the size classes in which records are written.
SIZE_CLASSES = [1 << 14, 1 << 18, 1 << 22, 1 << 26, 1 << 31]
RECORD_SCHEMA = (
    "archive string, kind string, offset bigint, length bigint, inner bigint, reason string, record_type string, record_id string, refers_to string, "
    "target_uri string, payload_digest string, payload_bytes bigint, payload binary"
)


def base32_sha1(payload: Column) -> Column:
    """The upper-case base32 SHA-1 of a string or binary column: five hex digits are four base32 digits."""
    digest = F.sha1(payload)
    quad = lambda i: F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
    char = lambda n, shift: F.substring(F.lit(BASE32), F.shiftright(n, shift).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*[char(quad(F.lit(i)), s) for i in range(8) for s in (15, 10, 5, 0)])


def with_revisits(pages: DataFrame, key: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """Add payload, payload_digest, payload_bytes, record_type and refers_to.

    Of equal payloads of at least ``min_bytes`` that with the largest key is the response. The largest keys combine
    before the shuffle, and those of payloads that occur more than once are written: as long as that table is below the session's
    broadcast threshold no payload is shuffled, and beyond it adaptive execution splits the join's partition of a payload that
    very many rows share.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(*pages.columns, body.alias("__payload"), base32_sha1(body).alias("__digest"), F.octet_length(body).cast("bigint").alias("__bytes"))
    first = rows.where(F.col("__bytes") >= min_bytes).groupBy("__digest").agg(F.max(key).alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    first = materialize(first.select("__digest", "__first"), "payloads")
    revisit = F.col("__first").isNotNull() & ~F.col(key).eqNullSafe(F.col("__first"))
    return rows.join(first, "__digest", "left").select(
        *[F.col(c) for c in pages.columns if c not in {"payload", "payload_digest", "payload_bytes", "record_type", "refers_to"} or c in {key, payload}],
        F.col("__payload"),
        F.col("__digest").alias("payload_digest"),
        F.col("__bytes").alias("payload_bytes"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("__first")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, date: str = EPOCH, archive_bytes: int = 1 << 28) -> None:
    """Write one WARC/1.1 record for each row below ``path``. A revisit carries its payload's digest and length, not the payload."""
    rows = with_revisits(pages, key, payload, min_bytes)
    size = F.coalesce(F.octet_length(F.col(payload).cast("string")), F.lit(0)) + F.coalesce(F.octet_length(F.col(url).cast("string")), F.lit(0))
    kind = F.coalesce(*[F.when(size <= most, k) for k, most in enumerate(SIZE_CLASSES)])
    largest = {r.kind: r.largest for r in pages.groupBy(kind.alias("kind")).agg(F.max(size).alias("largest")).collect()}
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:record:"), c.cast("string"), F.lit(">"))
    response = F.col("record_type") == "response"
    content = F.when(response, F.col("__payload")).otherwise("")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn(F.col(key))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.translate(F.col(url).cast("string"), "\r\n", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Refers-To", urn(F.col("refers_to"))),
        line("WARC-Payload-Length", F.when(~response, F.col("payload_bytes").cast("string"))),
        line("Content-Length", F.octet_length(content).cast("string")),
        F.lit("\r\n"),
    )
    for k, most in sorted(largest.items()) or [(0, 0)]:  # of no pages an empty folder
        room = max(1, archive_bytes // (most + 1024))  # no header but for the url has a kilobyte
        some = rows.where(kind == k) if len(largest) > 1 else rows
        some.select(F.concat(head, content).alias("value")).write.mode("append").option("lineSep", END.decode()).option("maxRecordsPerFile", room).text(path)


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    body: bytes
    inner: int = 0  # place in the unpacked member


@dataclass
class Gap:
    start: int
    end: int
    reason: str
    inner: int = 0


def parse_record(data: bytes, at: int) -> Record | str:
    """The record at ``at``, or why there is none."""
    if not VERSION.match(data, at):
        return "no version line"
    stop = data.find(END, at, at + MOST_HEADER)
    if stop < 0:
        return "header block without an end"
    headers = {}
    for row in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = row.partition(":")
        if not colon:
            return "malformed header"
        headers[name.strip().lower()] = value.strip()
    if not re.fullmatch(r"[0-9]{1,18}", headers.get("content-length", "")):
        return "no content length"
    begin = stop + len(END)
    end = begin + int(headers["content-length"])
    if data[end : end + len(END)] != END:
        return "record cut short" if end + len(END) > len(data) else "no end marks"
    body = bytes(data[begin:end])
    kind, _, digest = headers.get("warc-payload-digest", "").partition(":")
    if kind.lower() == "sha1" and headers.get("warc-type") != "revisit" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
        return "payload digest differs"
    return Record(at, end + len(END), headers, body)


def unpack_member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at ``at`` holds, its end, and what is wrong with it (empty: nothing)."""
    unpack, parts, size, begin, probed = zlib.decompressobj(31), [], 0, at, False
    try:
        while not unpack.eof and begin < len(data) and size < MOST_UNPACKED:
            piece = data[begin : begin + (1 << 20)]
            parts.append(unpack.decompress(piece, (MOST_UNPACKED if probed else MOST_PROBED) - size))
            size += len(parts[-1])
            begin += len(piece) - len(unpack.unconsumed_tail)
            if not probed and size >= MOST_PROBED:
                if not VERSION.search(b"".join(parts)):
                    return b"", at, "no version line in gzip member"
                probed = True
    except zlib.error as e:
        return b"".join(parts), at, f"gzip: {e}"[:80]
    if not unpack.eof:
        return b"".join(parts), at, "gzip member too large" if size >= MOST_UNPACKED else "gzip member cut short"
    return b"".join(parts), begin - len(unpack.unused_data), ""


def parse_member(data: bytes, at: int) -> tuple[list[Record | Gap], int]:
    """The records and gaps in the gzip member at ``at`` (start and end are places in the file), and where the next member can begin."""
    plain, end, wrong = unpack_member(data, at)
    found = list(salvage_plain(plain))
    if not wrong and all(isinstance(f, Record) for f in found):
        return [Record(at, end, f.headers, f.body, f.start) for f in found], end
    # a damaged member's own end isn't known: the next one is searched for
    stop = end if not wrong else data.find(MAGIC, at + 1)
    stop = len(data) if stop < 0 else stop
    out: list[Record | Gap] = []
    for f in found:
        out.append(Record(at, stop, f.headers, f.body, f.start) if isinstance(f, Record) else Gap(at, stop, wrong or f.reason, f.start))
    if wrong and not any(isinstance(f, Gap) for f in out):
        out.append(Gap(at, stop, wrong, len(plain)))
    return out, stop


def salvage_plain(data: bytes, at: int = 0) -> Iterator[Record | Gap]:
    """Records of plain data in order, and a gap for what lies between them."""
    gap, why = None, ""
    while 0 <= at < len(data):
        found = parse_record(data, at)
        if isinstance(found, Record):
            if gap is not None:
                yield Gap(gap, at, why, gap)
                gap = None
            yield found
            at = found.end
            continue
        if gap is None:
            gap, why = at, found
        m = VERSION.search(data, at + 1)
        at = m.start() if m else -1
    if gap is not None:
        yield Gap(gap, len(data), why, gap)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records of an archive in order, and a gap for what lies between them."""
    at, gap, why = 0, None, ""
    while 0 <= at < len(data):
        found, end = [], at
        if data.startswith(MAGIC, at):
            found, end = parse_member(data, at)
            wrong = next((f.reason for f in found if isinstance(f, Gap)), "empty gzip member")
            if not any(isinstance(f, Record) for f in found):
                found = []
        else:
            one = parse_record(data, at)
            if isinstance(one, Record):
                found, end = [one], one.end
            else:
                wrong = one
        if found:
            if gap is not None:
                yield Gap(gap, at, why)
                gap = None
            yield from found
            at = end
            continue
        if gap is None:
            gap, why = at, wrong
        m = MARK.search(data, at + 1)  # the first of either mark, so that nothing is sought twice
        at = m.start() if m else -1
    if gap is not None:
        yield Gap(gap, len(data), why)


def _row(archive: str, found: Record | Gap, with_payload: bool) -> tuple:
    if isinstance(found, Gap):
        return archive, "gap", found.start, found.end - found.start, found.inner, found.reason, None, None, None, None, None, None, None
    h = found.headers
    name = lambda x: m[1] if (m := re.fullmatch(r"<urn:record:(.*)>", h.get(x, ""))) else h.get(x)
    size = int(h.get("warc-payload-length") or 0) if h.get("warc-type") == "revisit" else len(found.body)
    digest = h.get("warc-payload-digest", "").rpartition(":")[2] or None
    return archive, "record", found.start, found.end - found.start, found.inner, None, h.get("warc-type"), name("warc-record-id"), name("warc-refers-to"), h.get("warc-target-uri"), digest, size, found.body if with_payload else None


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps of all archives below ``path``, a row each (``RECORD_SCHEMA``)."""
    columns = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, data in zip(batch["path"], batch["content"]):
                out, size = [], 0
                for found in salvage(data):
                    out.append(_row(archive, found, with_payload))
                    size += len(out[-1][-1] or b"")
                    if len(out) >= 2000 or size > 1 << 24:
                        yield pd.DataFrame(out, columns=columns)
                        out, size = [], 0
                if out:
                    yield pd.DataFrame(out, columns=columns)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") > 0)
    return files.select("path", "content").mapInPandas(rows, RECORD_SCHEMA)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write the pages to archives in the shared folder and read these back."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path, key, url, payload)
    return read_archives(spark, path, with_payload=False)
