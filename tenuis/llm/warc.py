"""WARC archives: pages written as captures of three records, archives read back, captures assembled again.

`write_archives` makes a request, a response (or revisit) and a metadata record for each page. Of pages with equal payloads
of at least REVISIT_BYTES bytes the one with the largest id is the response, the others are revisits without the payload.
Records are gzip members of their own. Archives are written by Spark's text writer, so its commit protocol holds: the
bytes of a page's members are one value, and the separator between values is an empty gzip member, which adds nothing to
the data. They go to any store Spark writes to, in files of at most ARCHIVE_PAGES pages.

`read_archives` reads archives, gzipped or plain, one at a time in a task, member by member. Records are framed by their
Content-Length alone, so a payload may hold anything, also what looks like a record.

`captures` is the transaction assembly. Concurrent-to identifiers are links between records, in both directions. A
response, revisit or resource is the root of its capture; records linked to it, over other records if need be, belong to
it (to the smallest root if they reach several in equally many steps). Records that reach none form captures by themselves. Then one
nested row per capture: the root, its request and its metadata. If a capture has several requests or metadata records, the
smallest record id is nested and the counts tell of the others, whose rows stay in the records.

`resolved` follows revisits to the response with the same payload digest.

Defined results: a null page is an empty payload; a null id or address leaves its field out of the records, and comes
back as null; a page with a null id is a response only if its payload has no page with an id; rows that repeat the largest
id of a payload are all responses; repeated rows are captures of their own; texts are whole; other columns are not
archived; an empty table gives no archive and no rows. Bytes that aren't a whole record give one row with `problem` set and end
their archive; such rows take part in nothing else. A record without an id has a problem too. A record id that occurs twice
as a root gives two captures with the same request and metadata. Other record types (warcinfo, conversion, continuation) are read but not assembled.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenuis.operators.graph import components
from tenuis.session import shared_path, stored

REVISIT_BYTES = 1000
ARCHIVE_PAGES = 10_000
ROOTS = ("response", "revisit", "resource")
PARTS = ("request", "metadata")
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a gzipped archive read at a time, bytes unpacked at a time, and bytes of records in a batch.
READ = 16 << 10
STEP = 1 << 20
BATCH_BYTES = 16 << 20

RECORDS = (
    "archive string, place long, record_id string, type string, date string, target_uri string, concurrent_to array<string>, "
    "fields map<string,string>, http_header string, payload binary, payload_digest string, problem string"
)


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _address(url: str | None) -> str | None:
    """The address with what a header line can't hold percent-encoded."""
    return None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~|^`{}\\\"<>", errors="surrogatepass")


def _page_records(name, page_id, url, payload: bytes, sha1: str, original, original_url, date: str) -> Iterator[bytes]:
    """Request, response or revisit, and metadata of one page; `name` gives record ids."""
    uri = _address(url)
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    root = name("response")
    common = [("WARC-Date", date), *([("WARC-Target-URI", uri)] if uri is not None else [])]
    place = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)([^#]*)", uri or "")
    request = f"GET {place[2] if place[2].startswith('/') else '/' + place[2]} HTTP/1.1\r\nHost: {place[1]}\r\n\r\n".encode()
    yield record(
        [("WARC-Type", "request"), ("WARC-Record-ID", name("request")), *common, ("WARC-Concurrent-To", root), ("Content-Type", "application/http; msgtype=request")],
        request,
    )
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = [("WARC-Type", "response")]
    if original is not None:
        kind = [("WARC-Type", "revisit"), ("WARC-Profile", SAME_PAYLOAD)]
        if original_url is not None:
            kind.append(("WARC-Refers-To-Target-URI", _address(original_url)))
    yield record(
        [*kind, ("WARC-Record-ID", root), *common, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")],
        head if original is not None else head + payload,
    )
    known = "" if page_id is None else f"page-id: {page_id}\r\n"
    yield record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", name("metadata")), *common, ("WARC-Concurrent-To", root), ("Content-Type", "application/warc-fields")],
        f"{known}fetch-bytes: {len(payload)}\r\n".encode(),
    )


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = REVISIT_BYTES) -> None:
    """Archives of the pages at `path`. The payloads are shuffled once, by their digest."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    keyed = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload")).withColumn(
        "digest", F.sha2("payload", 256)
    )
    repeated = (
        keyed.where(F.octet_length("payload") >= least).groupBy("digest")
        .agg(F.max(F.struct("page_id", "url")).alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1 and original.page_id is not null")
    )
    met = keyed.join(stored(repeated.select("digest", "original"), "repeated"), "digest", "left")
    again = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original.page_id"))
    rows = met.select("page_id", "url", "payload", F.sha1("payload").alias("sha1"), F.when(again, F.col("original")).alias("original"))
    rows = rows.select("page_id", "url", "payload", "sha1", "original.page_id", "original.url").toDF("page_id", "url", "payload", "sha1", "original", "original_url")
    run_name, date = uuid.uuid4().hex, datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        task, number = TaskContext.get(), 0
        for batch in batches:
            out = []
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                here = f"{run_name}/{task.partitionId()}/{number}"
                number += 1
                out.append(b"".join(map(_member, _page_records(lambda kind: _urn(here, kind), *row, date))))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    members = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    # Written as bytes: the separator's characters are the bytes of an empty member.
    writer = members.write.option("lineSep", _member(b"").decode("latin-1")).option("encoding", "ISO-8859-1")
    writer.option("maxRecordsPerFile", ARCHIVE_PAGES).option("compression", "none").text(path)


def _urn(here: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{here}/{kind}'.encode()).digest()[:16])}>"


def _unpacked(data: memoryview) -> Iterator[bytes]:
    """The data of an archive in steps; gzip members follow one another."""
    if bytes(data[:2]) != b"\x1f\x8b":
        for start in range(0, len(data), STEP):
            yield bytes(data[start : start + STEP])
        return
    at = 0
    while at < len(data):
        pack = zlib.decompressobj(31)
        while not pack.eof:
            chunk = pack.unconsumed_tail
            if not chunk:
                chunk = bytes(data[at : at + READ])
                at += len(chunk)
            if not chunk:
                raise zlib.error("a member is cut off")
            yield pack.decompress(chunk, STEP)
        at -= len(pack.unused_data)


def records_of(data: memoryview) -> Iterator[tuple[list[tuple[str, str]], bytes, str | None]]:
    """(fields, block, problem) of the records of an archive, in order."""
    steps, held, at = _unpacked(data), b"", 0

    def more() -> bool:
        nonlocal held, at
        got = next(steps, None)
        held, at = held[at:] + (got or b""), 0
        return got is not None

    try:
        while True:
            while held[at : at + 1] in (b"\r", b"\n"):
                at += 1
            if at == len(held):
                if not more():
                    return
                continue
            while (end := held.find(b"\r\n\r\n", at)) < 0:
                if not more():
                    yield [], b"", "a record's fields are cut off"
                    return
            lines = re.sub(r"\r\n[ \t]+", " ", held[at:end].decode("utf-8", "replace")).split("\r\n")
            fields = [(name.strip(), value.strip()) for name, _, value in (line.partition(":") for line in lines[1:])]
            length = next((value for name, value in fields if name.lower() == "content-length"), "")
            if not lines[0].startswith("WARC/") or not re.fullmatch("[0-9]+", length):
                yield fields, b"", "not a record"
                return
            start, stop = end + 4, end + 4 + int(length)
            if stop > len(held):
                pieces, size = [held[start:]], len(held)
                while size < stop and (got := next(steps, None)) is not None:
                    pieces.append(got)
                    size += len(got)
                if size < stop:
                    yield fields, b"", "a record's block is cut off"
                    return
                held, start, stop = b"".join(pieces), 0, int(length)
            yield fields, held[start:stop], None
            at = stop
    except zlib.error as error:
        yield [], b"", f"broken gzip member: {error}"


def _hex(digest: str) -> str | None:
    """SHA-1 in lower-case hex from sha1:<base 32 or hex>."""
    kind, _, value = digest.partition(":")
    if kind.lower() != "sha1" or not re.fullmatch("[A-Za-z2-7]{32}|[0-9A-Fa-f]{40}", value):
        return None
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def _row(archive: str, place: int, fields: list[tuple[str, str]], block: bytes, problem: str | None) -> dict:
    named = {name.lower(): value for name, value in fields}
    if problem is None and not (named.get("warc-record-id") and named.get("warc-type")):
        problem = "no record id or type"
    head, payload = None, block
    if named.get("content-type", "").lower().startswith("application/http"):
        raw, gap, payload = block.partition(b"\r\n\r\n")
        head = raw.decode("utf-8", "replace")
    return {
        "archive": archive, "place": place, "record_id": named.get("warc-record-id"), "type": named.get("warc-type", "").lower() or None,
        "date": named.get("warc-date"), "target_uri": named.get("warc-target-uri"),
        "concurrent_to": [value for name, value in fields if name.lower() == "warc-concurrent-to"],
        "fields": list(named.items()), "http_header": head, "payload": payload, "payload_digest": _hex(named.get("warc-payload-digest", "")), "problem": problem,
    }


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; `fields` by lower-case name, the last of equal names."""
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = spark.createDataFrame([], RECORDS)
    schema = to_arrow_schema(empty.schema)

    def run(batches):
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for place, (fields, block, problem) in enumerate(records_of(memoryview(content.as_buffer()))):
                    rows.append(_row(archive.as_py(), place, fields, block, problem))
                    size += len(block) + 1000
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORDS)


def roots_of(records: DataFrame) -> DataFrame:
    """record_id, root of the request and metadata records. `records` is read several times: store it first."""
    good = records.where(F.col("problem").isNull()).select("record_id", "type", "concurrent_to")
    is_root = F.col("type").isin(*ROOTS)
    told = good.select(F.col("record_id").alias("u"), F.explode("concurrent_to").alias("v"), is_root.alias("of_root"))
    rest = good.where(F.col("type").isin(*PARTS)).select("record_id").distinct()
    reached = good.where(is_root).select("record_id", F.col("record_id").alias("root")).distinct()
    # From a root away: what it names, and what names it.
    links = told.where("of_root").select("u", "v").unionByName(told.where("not of_root").select(F.col("v").alias("u"), F.col("u").alias("v")))
    parts = []
    while True:
        # A round for each step away from a root; usually there is one.
        near = links.join(reached.withColumnRenamed("record_id", "u"), "u").groupBy("v").agg(F.min("root").alias("root"))
        reached = stored(near.withColumnRenamed("v", "record_id").join(rest, "record_id", "left_semi"), "roots")
        rest = stored(rest.join(reached, "record_id", "left_anti"), "rest")
        parts.append(reached)
        if rest.isEmpty() or reached.isEmpty():
            break
        links = told.select("u", "v").unionByName(told.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not rest.isEmpty():
        own = rest.withColumnRenamed("record_id", "u")
        inner = told.join(own, "u", "left_semi").join(rest.withColumnRenamed("record_id", "v"), "v", "left_semi")
        parts.append(components(rest, "record_id", inner.where("u <> v").select("u", "v")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata, n_requests, n_metadata.

    `records` is scanned twice: once for what links and surrounds the roots, which is stored, and once for the roots with
    their payloads, which move once, by capture."""
    good = records.where(F.col("problem").isNull())
    part = F.col("type").isin(*PARTS)
    small = good.where(part | F.col("type").isin(*ROOTS)).select(
        "record_id", "type", "concurrent_to", F.when(part, F.struct("record_id", "date", "target_uri", "http_header", "payload")).alias("about"), "problem"
    )
    small = stored(small, "records")
    sides = [F.min(F.when(F.col("type") == side, F.col("about"))).alias(side) for side in PARTS]
    counts = [F.count_if(F.col("type") == side).alias(f"n_{name}") for side, name in zip(PARTS, ("requests", "metadata"), strict=True)]
    beside = small.where(part).select("record_id", "type", "about").join(roots_of(small), "record_id").groupBy("root").agg(*sides, *counts)
    main = good.where(F.col("type").isin(*ROOTS)).select(
        F.col("record_id").alias("root"), F.struct("record_id", "type", "date", "target_uri", "fields", "http_header", "payload", "payload_digest").alias("response")
    )
    zero = F.lit(0).cast("long")
    return main.join(beside, "root", "full").select(
        F.col("root").alias("capture_id"), "response", "request", "metadata", F.coalesce("n_requests", zero).alias("n_requests"),
        F.coalesce("n_metadata", zero).alias("n_metadata"),
    )


def _warc_field(name: str):
    """A value of the application/warc-fields block of a capture's metadata."""
    found = F.regexp_extract(F.col("metadata.payload").cast("string"), rf"(?:^|\n){name}: *([^\r\n]*)", 1)
    return F.when(found != "", found)


def resolved(nested: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and digest_ok of the captures with a response.

    Size and digest of a response come from its payload; a revisit's digest from its fields, its size from the response
    with that digest and the largest id. digest_ok tells whether a response's payload has the digest in its fields."""
    is_new = F.col("response.type") != "revisit"
    rows = nested.where(F.col("response").isNotNull()).select(
        _warc_field("page-id").cast("long").alias("page_id"), F.col("response.type").alias("record_type"),
        F.when(is_new, F.octet_length("response.payload").cast("long")).alias("bytes"), F.when(is_new, F.sha1("response.payload")).alias("own"), F.col("response.payload_digest").alias("told"),
    )
    rows = stored(rows.withColumn("digest", F.coalesce("own", "told")), "captures")
    sources = rows.where(F.col("own").isNotNull()).groupBy("digest").agg(F.max(F.struct("page_id", "bytes")).alias("source"))
    wanted = rows.where(F.col("own").isNull()).select("digest").distinct()
    sources = stored(sources.join(wanted, "digest", "left_semi"), "sources")
    later = F.col("record_type") == "revisit"
    return rows.join(sources, "digest", "left").select(
        "page_id", F.coalesce("bytes", F.col("source.bytes")).alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        "record_type", F.when(later, F.col("source.page_id")).alias("refers_to"), (F.col("told").isNull() | F.col("own").isNull() | (F.col("told") == F.col("own"))).alias("digest_ok"),
    )


def report(pages: DataFrame) -> DataFrame:
    """Archives of all pages, read back and assembled."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path)
    return resolved(captures(read_archives(spark, path))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages
), keyed AS (
  SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest, max(page_id) OVER (PARTITION BY payload) AS last
  FROM payloads
), typed AS (SELECT *, payload_bytes >= 1000 AND last IS NOT NULL AND page_id IS DISTINCT FROM last AS again FROM keyed)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN last END AS refers_to
FROM typed
"""
