"""WARC archives: a deduplicating writer, and a reader that salvages.

Writing: pages are dealt to archives by what they hold, a record is a gzip
member of its own, and a page whose payload an earlier one has becomes a revisit
record.  Members go through Spark's text sink, with its commit protocol and into
any store that Spark writes to: the sink ends each row with a separator, here a
zero byte, which is also the last byte of a member of less than 16 MB (longer
ones get an empty member behind them).

Reading: a record counts only if its checks hold: the member's CRC, the version
line, a block as long as its header says and closed by an empty line, and the
digests that it names.  Where one fails, the reader looks for the next member or
version line that does hold, goes on there, and logs the bytes between as a gap
with its reason.  Of a damaged member that holds several records, those before
the damage are kept.  Archives are read as whole files, of 2 GB at most.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import cache
from .tables import saved
from .text import plain

ARCHIVE_BYTES = 128 << 20  # payloads in an archive, about
#: A key that more than one in so many rows share is joined by broadcast: at most so many keys are.
HOT_KEYS = 50_000
LEAST_HOT = 1000

#: Fixed values of the format.
VERSION, MAGIC, END = b"WARC/1.1", b"\x1f\x8b\x08", b"\r\n\r\n"
VERSION_LINE = re.compile(rb"WARC/1\.[01]")
MANDATORY = ("warc-type", "warc-record-id", "warc-date")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"
#: What a record's head and a gzip read may span.
HEAD_BYTES, CHUNK = 1 << 16, 1 << 14


def digest(data: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# writing


def name_of(key) -> str:
    return f"<urn:page:{'' if key is None else urllib.parse.quote(str(key), safe='-')}>"


def record(key, url: str | None, payload: bytes, refers_to=None, revisit: bool = False, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record; a revisit has the HTTP head alone, with the length that its payload has."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name_of(key)), ("WARC-Date", date)]
    if url is not None:
        lines.append(("WARC-Target-URI", urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")))
    if revisit:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name_of(refers_to))]
    lines += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", HTTP), ("Content-Length", str(len(block)))]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in lines)]) + END + block + END


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member that ends in a zero byte."""
    made = zlib.compressobj(level, wbits=31)
    out = made.compress(data) + made.flush()
    return out if out.endswith(b"\0") else out + member(b"")


def spread(rows: DataFrame, side: DataFrame, key: str, total: int, parts: int) -> DataFrame:
    """``rows`` left-joined to ``side`` (one row a key, ``n`` of how many rows have it).

    Keys of more than one in ``HOT_KEYS`` rows are broadcast, which bounds their
    number; rows with one, and rows with a null key, are then dealt out evenly.
    """
    hot = max(LEAST_HOT, total // HOT_KEYS)
    values = [c for c in side.columns if c not in (key, "n")]
    frequent = side.where(F.col("n") > hot).select(F.col(key).alias("__hot"), *[F.col(c).alias(f"__{c}") for c in values])
    at = rows.join(F.broadcast(frequent), F.col(key) == F.col("__hot"), "left")
    at = at.withColumn("__key", F.when(F.col("__hot").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))))
    rest = side.where(F.col("n") <= hot).select(F.col(key).alias("__key"), *[F.col(c).alias(f"__rest_{c}") for c in values]).repartition(parts, "__key")
    out = at.repartition(parts, "__key").join(rest.hint("shuffle_hash"), "__key", "left")
    return out.select(*rows.columns, *[F.coalesce(f"__{c}", f"__rest_{c}").alias(c) for c in values])


def write_archives(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, level: int = 6) -> str:
    """Writes a record for every row to archives in a new folder ``path`` (one in
    the shared folder if not given, for this session) and returns it.

    Of rows with equal payloads of at least ``min_bytes``, those of the smallest
    id are responses (several if rows repeat that id), others revisit it; shorter
    payloads are responses all.  A null payload is an empty one.  Rows with a
    null id revisit if a row with an id has their payload, and are responses
    else.  A null address leaves its header out; characters that an address
    cannot hold are percent-encoded.
    """
    spark = pages.sparkSession
    if path is None:
        path = f"{cache.shared_folder(spark)}/latentrank-warc-{uuid.uuid4().hex}"
        cache._written.append((spark, path))
    body = F.coalesce(F.col("payload").cast("binary"), F.lit(b""))
    rows = plain(pages, id_col, url_col, payload_col).toDF("id", "url", "payload").withColumn("payload", body)
    # equality by SHA-256: different payloads of one SHA-1 can be made
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= min_bytes, F.sha2("payload", 256)))
    keys = saved(rows.select("id", "key", F.octet_length("payload").cast("bigint").alias("size")))
    total, size = keys.agg(F.count("*"), F.sum("size")).first()
    firsts = keys.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    parts = int(max(2 * spark.sparkContext.defaultParallelism, -(-(size or 0) // archive_bytes)))
    marked = spread(rows, saved(firsts), "key", total, parts)
    revisits = F.coalesce(~F.col("first").eqNullSafe(F.col("id")) & F.col("first").isNotNull(), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                made = [member(record(*r), level)[:-1] for r in zip(*(c.to_pylist() for c in b.slice(at, 64).columns))]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["member"])

    made = marked.select("id", "url", "payload", "first", revisits.alias("revisit")).mapInArrow(run, "member binary")
    made.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)
    return path


# reading


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    payload: bytes
    length: int | None  # of the full payload, as the record knows it

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")


@dataclass
class Gap:
    start: int
    end: int
    reason: str


class Broken(Exception):
    """What stands at a place is no valid record."""


def headers_of(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("header without a colon")
        key = name.decode("utf-8", "replace").strip().lower()
        if key in out and key != "warc-concurrent-to":  # as when a record cut short runs into the next
            raise Broken("header stated twice")
        out[key] = value.decode("utf-8", "replace").strip()
    return out


def matches(stated: str | None, data: bytes) -> bool:
    """False only if a SHA-1 is stated that the bytes do not have."""
    return not stated or not stated.lower().startswith("sha1:") or stated[5:].upper() == digest(data)


def plain_record(data: bytes, at: int) -> Record:
    """The record that begins at a version line."""
    if not VERSION_LINE.match(data, at):
        raise Broken("no version line")
    close = data.find(END, at, at + HEAD_BYTES)
    if close < 0:
        raise Broken("no end of the header")
    headers = headers_of(data[at:close].split(b"\r\n")[1:])
    if not headers.get("content-length", "").isdigit():
        raise Broken("no length")
    if not all(headers.get(name) for name in MANDATORY):
        raise Broken("a mandatory header is missing")
    begin = close + 4
    end = begin + int(headers["content-length"])
    if data[end : end + 4] != END:
        raise Broken("cut short" if end + 4 > len(data) else "length does not fit")
    block = data[begin:end]
    if not matches(headers.get("warc-block-digest"), block):
        raise Broken("block digest differs")
    payload, length = block, len(block)
    if headers.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(END)
        length = len(payload)
        if headers.get("warc-type") == "revisit":
            said = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
            length = int(said[1]) if said else None
    if headers.get("warc-type") != "revisit" and not matches(headers.get("warc-payload-digest"), payload):
        raise Broken("payload digest differs")
    return Record(at, end + 4, headers, payload, length)


@dataclass
class Found:
    """What a place gave: its records, gaps within, and where it ends."""

    end: int
    records: list[Record]
    gaps: list[Gap] = field(default_factory=list)


def unzipped(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """(contents, end, what is wrong) of the gzip member at a place; of a damaged one, what came before."""
    flate, out, pos = zlib.decompressobj(31), [], at
    try:
        while not flate.eof:
            if pos >= len(data):
                return b"".join(out), pos, "member cut short"
            out.append(flate.decompress(data[pos : pos + CHUNK]))
            pos += CHUNK
            if sum(map(len, out[:2])) >= 5 and len(out) <= 2 and not b"".join(out).startswith(b"WARC/"):
                return b"", pos, "member without a record"
    except zlib.error as e:
        return b"".join(out), pos, "member fails its check" if "check" in str(e) else "damaged member"
    return b"".join(out), min(pos, len(data)) - len(flate.unused_data), None


def record_at(data: bytes, at: int, rest: list) -> Found:
    """The record, or the member of records, at a place; ``rest`` gets records from before a damage."""
    if data[at : at + 5] == b"WARC/":
        r = plain_record(data, at)
        return Found(r.end, [r])
    if data[at : at + 3] != MAGIC:
        raise Broken("no record")
    body, end, wrong = unzipped(data, at)
    if wrong is None and not body:
        return Found(end, [])
    inner = list(salvage(body, zipped=False)) if body.startswith(b"WARC/") else []
    records = [Record(at, end, x.headers, x.payload, x.length) for x in inner if isinstance(x, Record)]
    if wrong or not records:
        rest += records
        raise Broken(wrong or (inner[0].reason if inner else "member without a record"))
    return Found(end, records, [Gap(at, end, f"in a member: {x.reason}") for x in inner if isinstance(x, Gap)])


def candidates(data: bytes, at: int, zipped: bool) -> Iterator[int]:
    """Places from ``at`` on where a member or a version line could begin."""
    mark = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08" if zipped else rb"WARC/1\.[01]\r\n")
    return (m.start() for m in mark.finditer(data, at))


def salvage(data: bytes, zipped: bool = True) -> Iterator[Record | Gap]:
    """Everything in an archive, in order: valid records, and gaps with a reason."""
    at, n = 0, len(data)
    while at < n:
        rest: list[Record] = []
        try:
            found = record_at(data, at, rest) if zipped else Found((r := plain_record(data, at)).end, [r])
        except Broken as e:
            yield from rest
            found, begin = None, n
            for begin in candidates(data, at + 1, zipped):
                try:
                    found = record_at(data, begin, []) if zipped else Found((r := plain_record(data, begin)).end, [r])
                    break
                except Broken:
                    continue
            yield Gap(at, begin if found else n, str(e))
            if found is None:
                return
        yield from found.records
        yield from found.gaps
        at = found.end


SCHEMA = "archive string, start bigint, end bigint, reason string, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"


def read_archives(spark: SparkSession, path: str | list[str], payloads: bool = True) -> DataFrame:
    """A row for every record (``reason`` null) and every gap (``reason`` says why)
    of the archives at ``path``, gzip members or not.

    ``start`` and ``end`` are bytes of the archive.  ``payload_digest`` is worked
    out from the payload; revisits, which have none, give the stated digest and
    length.  ``payloads=False`` leaves the payload null.  Empty files, and an
    empty folder, give no rows.
    """
    kinds = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in SCHEMA.split(", "))])

    def rows(name: str, data: bytes) -> Iterator[tuple]:
        for x in salvage(data):
            if isinstance(x, Gap):
                yield (name, x.start, x.end, x.reason, *[None] * 7)
            else:
                revisit = x.kind == "revisit"
                stated = x.headers.get("warc-payload-digest", "").partition(":")[2] or None
                yield (name, x.start, x.end, None, x.kind, x.headers.get("warc-record-id"), x.headers.get("warc-target-uri"), x.headers.get("warc-refers-to"), stated if revisit else digest(x.payload), x.length, x.payload if payloads and not revisit else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0), b.column(1)):
                held, size = [], 0
                for r in rows(name.as_py(), data.as_py()):
                    held.append(r)
                    size += len(r[-1] or b"")
                    if size > 8 << 20 or len(held) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], schema=kinds)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], schema=kinds)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(run, SCHEMA)


def resolved(read: DataFrame) -> DataFrame:
    """Response and revisit records; a revisit with ``payload_bytes`` and ``payload_digest``
    of the response that it refers to (both null where no response of its digest is there)."""
    spark = read.sparkSession
    rows = read.where("reason IS NULL AND record_type IN ('response', 'revisit')")
    revisits = F.col("record_type") == "revisit"
    pointer = F.when(revisits, F.concat_ws(" ", "refers_to", "payload_digest"))
    rows = rows.withColumn("__pointer", pointer).withColumn("__own", F.when(~revisits, F.concat_ws(" ", "record_id", "payload_digest")))
    asked = rows.where("__pointer IS NOT NULL").groupBy("__pointer").agg(F.count("*").alias("n"))
    there = rows.where("__own IS NOT NULL").groupBy(F.col("__own").alias("__pointer")).agg(F.max("payload_bytes").alias("__bytes"), F.max("payload_digest").alias("__digest"))
    side = saved(asked.join(there, "__pointer"))
    out = spread(rows, side, "__pointer", rows.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = out.withColumn("payload_bytes", F.when(revisits, F.col("__bytes")).otherwise(F.col("payload_bytes"))).withColumn("payload_digest", F.when(revisits, F.col("__digest")).otherwise(F.col("payload_digest")))
    return out.drop("__pointer", "__own", "__bytes", "__digest")


def number_in(name: str):
    """The whole-number id in a record's name; null if it has none."""
    return F.regexp_extract(name, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of pages, written and read back."""
    read = saved(read_archives(pages.sparkSession, write_archives(pages, min_bytes=min_bytes), payloads=False))
    return resolved(read).select(number_in("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number_in("refers_to").alias("refers_to"))


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages)
SELECT page_id, payload_bytes,
       array_to_string(flatten(list_transform(range(0, 40, 5), lambda i: list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || h[i + 1:i + 5])::INTEGER >> s) & 31) + 1, 1)))), '') AS payload_digest,
       CASE WHEN payload_bytes >= 0 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 0 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p
"""
