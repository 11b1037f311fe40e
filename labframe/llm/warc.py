"""WARC archives: a writer that stays in the JVM and a salvage reader.

Writing: each page is one record. Payloads of at least ``MIN_REVISIT_BYTES`` bytes that several pages share are stored once,
with the largest page_id; the other pages become revisit records. Records are rows of Spark's text writer whose line
separator is the blank line that ends a WARC record, so archives go through Spark's committers to any store.

Reading: an archive is checked record by record (version line, header, length, end mark, payload digest; for compressed
members also the gzip trailer). After a failed check the reader looks for the next version line or member that passes all
checks, goes on there, and logs the bytes between as a quarantined gap. Where only the digest fails and the end mark stands
where the length says, the reader goes on behind the record, so nothing inside a damaged payload is taken for a record.
Compressed members are inflated in pieces and may hold one record, many, or a whole archive. The records and gaps inside a
member bear the bytes of the member, as the archive has no finer ones. Of a member that breaks off, those records stay whose
payload digest holds; the rest of it is a gap.

Cases: null html is an empty payload; null url leaves the header out; control characters and spaces in a url are percent-
encoded. Pages that share both page_id and payload with the largest page_id are all responses. A null page_id counts as
smaller than any other; where all are null, all are responses. Empty tables write no record and read as no rows. Other
columns of the pages, whatever their names, are ignored. An archive is read whole, so the writer bounds its bytes.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_REVISIT_BYTES = 1000
#: Records in one archive file, where none exceeds so many bytes; larger ones go to archives of fewer records.
RECORDS_PER_FILE, RECORD_BYTES = 1000, 256 << 10
#: A table of shared payloads up to so many rows (about 100 bytes each) is sent to all executors; a larger one is joined by shuffle.
BROADCAST_ROWS = 50_000
#: Members are inflated in pieces of so many bytes.
PIECE = 1 << 18
END = b"\r\n\r\n"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
RECORDS = (
    "path string, kind string, start long, end long, reason string, record_type string, page_id long, refers_to long,"
    " target_uri string, payload_digest string, payload_bytes long, payload binary"
)


def shared_payloads(pages: DataFrame) -> DataFrame:
    """payload_key (SHA-256), response_id for every payload of enough bytes that more than one page has."""
    html = F.coalesce("html", F.lit(""))
    return (
        pages.filter(F.octet_length(html) >= MIN_REVISIT_BYTES).groupBy(F.sha2(F.encode(html, "UTF-8"), 256).alias("payload_key"))
        .agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).filter("n > 1 and response_id is not null").drop("n")
    )


def records(pages: DataFrame, shared: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One column ``value``: each page as a WARC record without its end mark."""
    small = shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    html = F.coalesce("html", F.lit(""))
    p = pages.select("page_id", "url", html.alias("html"))
    big = F.octet_length("html") >= MIN_REVISIT_BYTES
    p = p.withColumn("payload_key", F.when(big, F.sha2(F.encode("html", "UTF-8"), 256)))
    p = p.join(F.broadcast(shared) if small else shared, "payload_key", "left")
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    n, digest = F.octet_length("html"), F.sha1(F.encode("html", "UTF-8"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n, F.lit("\r\n\r\n"))
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), r"[\x00-\x20\x7f]", "%20")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(f">\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Page-ID: "), F.col("page_id")), F.lit("")),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")),
        F.when(revisit, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"),
            F.col("response_id"), F.lit(">"))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), digest, F.lit("\r\nWARC-Payload-Length: "), n,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(http) + F.when(revisit, 0).otherwise(n), F.lit("\r\n\r\n"),
    )
    return p.select(F.concat(head, http, F.when(revisit, "").otherwise(F.col("html"))).alias("value"))


def write_archives(pages: DataFrame, shared: DataFrame, path: str) -> None:
    """Archives under ``path``, each of about RECORDS_PER_FILE * RECORD_BYTES bytes at most, or of one larger record."""
    size = F.octet_length(F.coalesce("html", F.lit(""))) + F.octet_length(F.coalesce("url", F.lit("")))
    largest = pages.agg(F.max(size).alias("n")).first()["n"] or 0
    step, sizes = RECORDS_PER_FILE, [(-1, RECORD_BYTES, RECORDS_PER_FILE)]
    while sizes[-1][1] < largest:  # each class of sizes is up to ten times larger, with a tenth of the records in a file
        step = max(1, step // 10)
        sizes.append((sizes[-1][1], sizes[-1][1] * 10, step))
    for above, up_to, most in sizes:
        some = pages if len(sizes) == 1 else pages.filter((size > above) & (size <= up_to))
        records(some, shared).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", most).mode("append").text(path)


class Damaged(ValueError):
    """A failed check. ``resume`` is where the next record must begin, if the frame is whole."""

    def __init__(self, reason: str, resume: int | None = None):
        super().__init__(reason)
        self.resume = resume


def _parse(data: bytes | bytearray, at: int) -> tuple[int, dict[str, str], bytes]:
    """End, header and payload of the record at ``at``; Damaged says which check failed. IndexError: the data end too early."""
    if not _VERSION.match(data, at):
        if len(data) - at < 10 and b"WARC/1.".startswith(bytes(data[at : at + 7])):
            raise IndexError("version line cut off")
        raise Damaged("no version line")
    header, line = {}, data.find(b"\r\n", at) + 2
    while (stop := data.find(b"\r\n", line)) != line:
        if stop < 0:
            raise IndexError("header without end")
        name, colon, value = data[line:stop].partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        header[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        line = stop + 2
    length = header.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damaged("no content length")
    block, end = line + 2, line + 2 + int(length)
    if data[end : end + 4] != END:
        if len(data) < end + 4:
            raise IndexError("no end mark where the length says")
        raise Damaged("no end mark where the length says")
    payload = bytes(data[block:end])
    if header.get("content-type", "").startswith("application/http"):
        payload = payload.partition(END)[2]
    if _digest_of(header) and hashlib.sha1(payload).hexdigest() != _digest_of(header):
        raise Damaged("payload digest differs", end + 4)
    return end + 4, header, payload


def _digest_of(header: dict[str, str]) -> str:
    """The SHA-1 that a response must have, in hex; empty where it names none of this kind."""
    algorithm, _, digest = header.get("warc-payload-digest", "").partition(":")
    return digest.lower() if header.get("warc-type") == "response" and algorithm == "sha1" and len(digest) == 40 else ""


def _inflated(data: bytes, at: int) -> Iterator[tuple[bytes, int]]:
    """Pieces of the member at ``at``, each with the member's end, which is -1 until the trailer has been checked."""
    unpack, view, rest = zlib.decompressobj(31), memoryview(data), at
    while not unpack.eof:
        if rest >= len(data) and not unpack.unconsumed_tail:
            raise Damaged("member without end")
        some = unpack.unconsumed_tail or view[rest : rest + PIECE]
        rest += 0 if unpack.unconsumed_tail else len(some)
        try:
            piece = unpack.decompress(some, PIECE)
        except zlib.error as e:
            raise Damaged("damaged member") from e
        yield piece, rest - len(unpack.unused_data) if unpack.eof else -1


def _member_end(data: bytes, at: int) -> int:
    """Where the member at ``at`` ends; Damaged if it is not whole. Nothing of it is kept."""
    return max(end for _, end in _inflated(data, at))


Found = tuple[str, int, int, str, dict[str, str], bytes]


def _member(data: bytes, at: int, end: int | None) -> Iterator[Found]:
    """Records and gaps inside the member at ``at``. Without ``end`` it breaks off: only records with a digest are given."""
    held, whole, until = bytearray(), end is not None, end if end is not None else at
    pieces = _inflated(data, at)
    bad, more = "", True
    while more or held:
        try:
            stop, header, payload = _parse(held, 0)
        except IndexError as e:
            if more:
                try:
                    held += next(pieces)[0]
                except (StopIteration, Damaged):
                    more = False
                continue
            bad, stop, header = bad or str(e), _next_version(held, 1), None
        except Damaged as e:
            bad, stop, header = bad or str(e), e.resume or _next_version(held, 1), None
        if header is not None and (whole or _digest_of(header)):
            if bad and whole:
                yield "gap", at, until, bad, {}, b""
            bad = ""
            yield "record", at, until, "", header, payload
        del held[:stop]
    if bad and whole:
        yield "gap", at, until, bad, {}, b""


def _next_version(data: bytes | bytearray, at: int) -> int:
    """The next version line at ``at`` or later; where there is none, all but what may be the beginning of one."""
    found = _VERSION.search(data, at)
    return found.start() if found else max(at, len(data) - 9)


def salvage(data: bytes) -> Iterator[Found]:
    """(kind, start, end, reason, header, payload) for all bytes in order; kind is record or gap, the rest empty for gaps."""
    at, bad_from, reason = 0, -1, ""
    while at < len(data):
        try:
            if data[at : at + 2] == b"\x1f\x8b":
                end = _member_end(data, at)
                inside = _member(data, at, end)
            else:
                end, header, payload = _parse(data, at)
                inside = [("record", at, end, "", header, payload)]
        except (Damaged, IndexError) as e:
            if data[at : at + 3] == b"\x1f\x8b\x08":
                for one in _member(data, at, None):
                    if 0 <= bad_from < at:
                        yield "gap", bad_from, at, reason, {}, b""
                    bad_from = -1
                    yield one
            if bad_from < 0:
                bad_from, reason = at, str(e)
            resume = getattr(e, "resume", None)
            if resume is None:
                found = _START.search(data, at + 1)
                resume = found.start() if found else len(data)
            at = resume
            continue
        if bad_from >= 0:
            yield "gap", bad_from, at, reason, {}, b""
            bad_from = -1
        yield from inside
        at = end
    if bad_from >= 0:
        yield "gap", bad_from, len(data), reason, {}, b""


def _page_number(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps (RECORDS) of all archives under ``path``, plain or with gzip members."""
    names = [c.split()[0] for c in RECORDS.split(",")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch.path, batch.content, strict=True):
                rows, held = [], 0
                for kind, start, end, reason, h, payload in salvage(data):
                    length = h.get("warc-payload-length", "")
                    rows.append((
                        name, kind, start, end, reason or None, h.get("warc-type"),
                        int(h["warc-page-id"]) if re.fullmatch(r"-?\d+", h.get("warc-page-id", "")) else None,
                        _page_number(h.get("warc-refers-to")), h.get("warc-target-uri"), h.get("warc-payload-digest", "").partition(":")[2] or None,
                        int(length) if length.isdigit() else len(payload), payload,
                    ))
                    held += len(payload)
                    if held > 4_000_000:
                        yield _frame(rows, names)
                        rows, held = [], 0
                yield _frame(rows, names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, RECORDS)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("start", "end", "page_id", "refers_to", "payload_bytes")})


def page_digests(read: DataFrame) -> DataFrame:
    """Per page, from the archives: a response's digest is computed from the payload that was read."""
    response = F.col("record_type") == "response"
    return read.filter("kind = 'record'").select(
        "page_id", F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
    )
