"""WARC archives: a writer that revisits equal payloads, and a salvage reader.

Writing: one gzip member per record, in files that Spark's own text writer makes, so that any store Spark writes to will
do. A member ends with its length modulo 2^32, lowest byte first, so that its last byte is zero for a record under 16 MiB;
a longer record gets an empty member behind it, which ends so as well. The writer is given all but that byte and a line
separator of one zero byte, which makes the file byte for byte a row of members.

Reading: archives are read member by member (or, where not compressed, version line by version line). Where a check fails,
the reader looks for the next valid member or version line, goes on there, and logs the bytes between as quarantined.
"""

from __future__ import annotations

import hashlib
import logging
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.scratch import Scratch

#: Payloads under this many bytes are never revisited.
LEAST_SHARED = 100
#: An archive is closed once it holds so many bytes; a task reads one archive whole.
ARCHIVE_BYTES = 1 << 28
#: Bytes of an archive given to the decompressor at once.
CHUNK = 65_536
MEMBER = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MARK = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
#: A header line: a name of token characters, a colon and a value; or the next line of a folded value.
HEADER = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+[ \t]*:|[ \t]")
RECORDS = "file string, start long, end long, kind string, page_id string, uri string, payload_bytes long, payload_digest string, refers_to string, reason string"
_NAME = {"page_id": b"warc-x-page-id", "uri": b"warc-target-uri", "length": b"warc-x-payload-length", "digest": b"warc-payload-digest", "refers_to": b"warc-x-refers-to-page-id"}


def member(data: bytes, level: int = 4) -> bytes:
    """data as one gzip member whose last byte is zero (with an empty member behind it where need be)."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    return out if out[-1] == 0 else out + member(b"")


def record(kind: str, page_id: str | None, uri: str | None, length: int, digest: str, payload: bytes | None, refers_to: str | None = None) -> bytes:
    """One WARC record; payload None: a revisit, which has no block."""
    block = payload if payload is not None else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-X-Payload-Length: {length}", f"Content-Length: {len(block)}"]
    if page_id is not None:
        lines.append(f"WARC-X-Page-ID: {page_id}")
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]", " ", uri))
    if refers_to is not None:
        lines += [f"WARC-X-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, least_shared: int = LEAST_SHARED, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record per row of pages (page_id, url, html) under path, in archives of about ``archive_bytes`` at most.

    Of rows with equal payloads of at least ``least_shared`` bytes, that with the smallest page_id is the response and the
    others revisit it; repeated rows of that page_id are responses too. Smaller payloads are all responses. A null html is an
    empty payload. A null page_id or url leaves its header out; where all page_ids of a payload are null, all are responses,
    and a null page_id never is what others refer to. Other columns aren't read.

    Which rows revisit is decided over page_ids and digests alone. Payloads then move once, dealt by page_id and digest, so that a
    payload that very many pages share is no single task's; revisits drop theirs before anything is compressed.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.encode("html", "utf-8"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    known = rows.filter(F.length("payload") >= least_shared).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    first = known.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("ids")).filter((F.col("ids") > 1) & F.col("first").isNotNull()).select("digest", "first")
    again = known.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "first")
    told = rows.join(again, rows["page_id"].eqNullSafe(again["again_id"]) & (rows["digest"] == again["again_digest"]), "left")
    payload = F.when(F.col("first").isNull(), F.col("payload"))
    told = told.select("page_id", "url", F.length("payload").cast("long").alias("length"), "digest", "first", payload.alias("payload"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        for batch in batches:
            out, volumes = [], []
            for page_id, url, length, sha, first, payload in zip(*[c.to_pylist() for c in batch.columns[:5]], batch.column(5)):
                own, refers = None if page_id is None else str(page_id), None if first is None else str(first)
                out.append(member(record("response" if first is None else "revisit", own, url, length, sha, payload.as_py(), refers))[:-1])
                volumes.append(written // archive_bytes)
                written += len(out[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(volumes, pa.int32()), pa.array(out, pa.binary())], ["volume", "value"])

    lines = told.mapInArrow(packed, "volume int, value binary").select("volume", F.col("value").cast("string").alias("value"))
    lines.write.partitionBy("volume").option("lineSep", "\u0000").mode("overwrite").text(path)


def _headers(head: bytes) -> dict[bytes, str]:
    found = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            found[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    return found


def _parsed(data: bytes, at: int = 0) -> tuple[dict, bytes, int] | str:
    """Headers, block and end of the record at this place; else why there is none."""
    if not VERSION.match(data, at):
        return "no version line"
    cut = data.find(b"\r\n\r\n", at)
    if cut < 0:
        return "headers without end"
    head = data[at:cut]
    if not all(HEADER.match(line) for line in head.split(b"\r\n")[1:]) or MEMBER in head:
        return "headers run into other bytes"
    headers = _headers(head)
    length = headers.get(b"content-length", "")
    if not length.isdigit():
        return "no content length"
    end = cut + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return "no record end after the block"
    return headers, data[cut + 4 : end], end + 4


def _stored(data: bytes, at: int) -> bool:
    """Whether this place is the text of a stored block, whose length and its complement stand before it.

    Such a version line belongs to a member whose checksum failed, so that its headers can't be believed.
    """
    return at >= 4 and data[at - 4] ^ data[at - 2] == data[at - 3] ^ data[at - 1] == 255


def _row(name: str, start: int, end: int, headers: dict, block: bytes) -> tuple | str:
    """The row of a record, or why its block can't be believed."""
    kind, stated = headers.get(b"warc-type", ""), headers.get(_NAME["digest"], "").removeprefix("sha256:")
    length = headers.get(_NAME["length"])
    if kind != "revisit":
        actual = hashlib.sha256(block).hexdigest()
        if stated and stated != actual:
            return "payload digest differs"
        stated, length = actual, len(block)
    return name, start, end, kind, headers.get(_NAME["page_id"]), headers.get(_NAME["uri"]), None if length is None else int(length), stated, headers.get(_NAME["refers_to"]), None


def salvage(name: str, data: bytes) -> Iterator[tuple]:
    """Rows of RECORDS for an archive: each record that passes its checks, and each gap (kind ``gap``) with the reason.

    A gzip member is checked by its own checksum and length and by the record inside, an uncompressed record by its
    version line, content length, end mark and payload digest. After a failure the next place that passes all of them is
    searched for, so that a marker inside a payload is no false start of more than its own record. Headers that run into
    another member or into bytes that are no header lines are no record's, and nor is the raw text of a damaged member. What
    a damaged member gives before its damage is read record by record.
    """
    at, size, gap, why, saved = 0, len(data), None, "", []
    while at < size:
        found: list[tuple] | str = "no member or version line"
        end = at
        if data.startswith(MEMBER, at):
            found, end, hurt = _member_rows(name, data, at)
            if hurt and not isinstance(found, str):
                # where a damaged member ends is known once the next sound place is found
                saved += found
                found = hurt
        elif VERSION.match(data, at) and not _stored(data, at):
            read = _parsed(data, at)
            found = read if isinstance(read, str) else _row(name, at, read[2], read[0], read[1])
            if not isinstance(found, str):
                found, end = [found], read[2]
        if isinstance(found, str):
            if gap is None:
                gap, why = at, found
            mark = MARK.search(data, at + 1)
            at = mark.start() if mark else size
            continue
        if gap is not None:
            yield name, gap, at, "gap", None, None, None, None, None, why
            yield from ((*r[:2], at, *r[3:]) for r in saved)
            gap, saved = None, []
        yield from found
        at = end
    if gap is not None:
        yield name, gap, size, "gap", None, None, None, None, None, why
        yield from ((*r[:2], size, *r[3:]) for r in saved)


def _member_rows(name: str, data: bytes, at: int) -> tuple[list[tuple] | str, int, str]:
    """The records in the member at this place, its end, and why the member is damaged; an empty member has none.

    Around a record that fails, those before it and behind the next version line are read, and a gap gives its place in the
    member's text. Of a damaged member only records with a payload that passes its stated digest count; where its checksum
    differs and no record fails, the damage may be in any record's headers and none counts.
    """
    unpacker, parts, fed, why = zlib.decompressobj(31), [], at, ""
    try:
        while not unpacker.eof and fed < len(data):
            parts.append(unpacker.decompress(data[fed : fed + CHUNK]))
            fed = min(fed + CHUNK, len(data))
        why = "" if unpacker.eof else "member without end"
    except zlib.error as error:
        why = f"member: {error}"
        parts = _before_error(data, at, fed)
    inside, end, rows, here, gap, failed = b"".join(parts), at if why else fed - len(unpacker.unused_data), [], 0, None, ""

    def lost() -> tuple:
        return name, at, end, "gap", None, None, None, None, None, f"in member, bytes {gap} to {here}: {failed}"

    while here < len(inside):
        read = _parsed(inside, here)
        row = read if isinstance(read, str) else _row(name, at, end, read[0], read[1])
        if why and not isinstance(row, str) and (row[3] == "revisit" or not read[0].get(_NAME["digest"])):
            row = "no digest to check in a damaged member"
        if isinstance(row, str):
            gap, failed = (here, row) if gap is None else (gap, failed)
            mark = VERSION.search(inside, here + 1)
            here = mark.start() if mark else len(inside)
            continue
        if gap is not None:
            rows.append(lost())
            gap = None
        rows.append(row)
        here = read[2]
    if gap is not None:
        rows.append(lost())
    if rows and all(r[3] == "gap" for r in rows) or "incorrect" in why and not any(r[3] == "gap" for r in rows):
        return why or failed, at, why
    return (why if why and not rows else rows), end, why


def _before_error(data: bytes, at: int, fed: int) -> list[bytes]:
    """What a member gives before its error, which comes within CHUNK bytes from fed."""
    unpacker, parts = zlib.decompressobj(31), []
    for low in range(at, fed, CHUNK):
        parts.append(unpacker.decompress(data[low : low + CHUNK]))
    try:
        for k in range(fed, min(fed + CHUNK, len(data))):
            parts.append(unpacker.decompress(data[k : k + 1]))
    except zlib.error:
        pass
    return parts


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows of RECORDS for all archives under path and its subfolders, gaps included; names that start with _ or . are skipped.

    A task holds one archive at a time, as the writer bounds their bytes (Spark's reader of whole files takes 2 GiB at most); an
    empty archive has no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "start", "end", "kind", "page_id", "uri", "payload_bytes", "payload_digest", "refers_to", "reason"]
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 3, pa.int64(), *[pa.string()] * 3]
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = list(salvage(name, content.as_py()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, RECORDS)


def page_records(spark: SparkSession, path: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The records of the archives under path, and the log of quarantined gaps (file, start, end, reason).

    Both read one written table, ``records`` of the scratch folder, so that what was left out can be looked up after the job.
    """
    rows = scratch.keep(read_archives(spark, path), "records")
    return rows.filter(F.col("kind") != "gap"), rows.filter(F.col("kind") == "gap").select("file", "start", "end", "reason")


def op3_warc_salvage(spark, sf_dir: str) -> DataFrame:
    """A record per page, written to archives and read back by the salvage reader.

    Gaps would be in the written table of ``page_records``; if there are any, the log says how many bytes were set aside.
    """
    scratch = Scratch(spark, "warc")
    path = scratch.path("archives")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records, gaps = page_records(spark, path, scratch)
    n, lost = gaps.agg(F.count("*"), F.sum(F.col("end") - F.col("start"))).first()
    if n:
        logging.getLogger(__name__).warning("%d quarantined gaps of %d bytes; see %s", n, lost, scratch.path("records"))
    return records.select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to")
    )


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
q AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha256(payload) AS payload_digest,
             min(page_id) OVER (PARTITION BY payload) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM q
"""
