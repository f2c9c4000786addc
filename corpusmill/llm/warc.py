"""WARC archives: write captures, and assemble transactions from the records read back.

A capture becomes three records: the request, the response (or a revisit, if
another capture has the same payload), and metadata.  Request and metadata
name the response in ``WARC-Concurrent-To``.  Reading parses archives by their
content lengths, and the assembly joins the three records of a capture through
that identifier into one nested row.

Each record is a gzip member of its own, and an archive is closed once it
holds ``archive_bytes``, so a file is no larger than that and one record.
Archives are written by Spark's own committer into the shared folder, so a
lost task leaves nothing behind; they are read as a stream of records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.storage import cut, discard, new_path

VERSION, LINE, END = "WARC/1.1", "\r\n", "\r\n\r\n"
#: Fixed value: the profile of revisits by equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(text: Column) -> Column:
    """SHA-1 of the text's UTF-8 bytes in upper-case base 32 without a prefix."""
    hexed = F.sha1(text.cast("binary"))
    letters = []
    for k in range(8):  # 20 bits at a time: five hexadecimal digits, four letters
        five = F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(five, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(LINE))


def _clean(value: Column) -> Column:
    """A header's value on one line."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\r\n]+", " ")


def _record(kind: str | Column, ident: Column, url: Column, extra: Column, block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(
        F.lit(VERSION + LINE), _line("WARC-Type", kind), _line("WARC-Record-ID", ident), _line("WARC-Target-URI", url),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z" + LINE), extra, _line("Content-Length", F.octet_length(block).cast("string")), F.lit(LINE), block)


def originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(row, first, first_row)`` of each row of ``pages`` (row, page_id, payload_bytes, digest) that revisits another.

    ``first`` is the smallest page_id with the same payload and ``first_row`` its
    first row.  Rows that bear the smallest page_id themselves revisit nothing,
    nor do payloads of fewer than ``min_bytes`` bytes, or those that only
    rows without a page_id hold.  Only digests and ids are grouped, and counts
    are combined before the shuffle, so copies meet in no task.
    """
    known = pages.where(F.col("payload_bytes") >= min_bytes).select("row", "page_id", "digest")
    own = F.struct("page_id", "row")
    first = known.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), own)).alias("x"), F.count("*").alias("n"))
    first = first.where("n > 1 AND x IS NOT NULL").select("digest", F.col("x.page_id").alias("first"), F.col("x.row").alias("first_row"))
    return known.join(first, "digest").where("page_id IS NULL OR page_id <> first").select("row", "first", "first_row")


def _member(data: bytes) -> bytes:
    """One gzip member, the same at any time."""
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _archives(records: DataFrame, archive_bytes: int) -> DataFrame:
    """Binary ``value``: archives of the records in all columns, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

        for batch in batches:
            for i in range(batch.num_rows):
                for column in batch.columns:
                    held.append(_member(column[i].as_py().encode("utf-8", "surrogatepass") + END.encode()))
                    size += len(held[-1])
                if size >= archive_bytes:
                    yield closed()
                    held, size = [], 0
        if held:
            yield closed()

    return records.mapInArrow(run, "value binary")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = 8 << 20) -> None:
    """Write ``pages`` (page_id, url, html) to archives of about ``archive_bytes`` compressed bytes.

    Each row is a capture of its own, whether its page_id is null or repeats:
    its number in the written table is part of its identifiers.  A null html is
    an empty payload, a null url an empty one; other columns are not read.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("row", F.monotonically_increasing_id())
    rows = cut(rows.withColumns({"digest": base32_sha1(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("long")}), "pages")
    refers = cut(originals(rows, min_bytes), "refers")
    every = rows.join(refers, "row", "left")
    urn = lambda what, row, page: F.concat(F.lit(f"<urn:capture:{what}:"), F.col(row).cast("string"), F.lit(":"), F.coalesce(F.col(page).cast("string"), F.lit("none")), F.lit(">"))
    me, url, size = urn("response", "row", "page_id"), _clean(F.col("url")), F.col("payload_bytes").cast("string")
    digest = _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    old = F.col("first_row").isNotNull()
    kind = F.when(old, "revisit").otherwise("response")
    status = F.concat(F.lit("HTTP/1.1 200 OK" + LINE + "Content-Type: text/html; charset=utf-8" + LINE), _line("Content-Length", size), F.lit(LINE))
    refer = F.concat(_line("WARC-Refers-To", urn("response", "first_row", "first")), _line("WARC-Profile", F.lit(PROFILE)))
    about = F.concat(digest, F.lit("Content-Type: application/http; msgtype=response" + LINE), F.when(old, refer).otherwise(""))
    with_me = _line("WARC-Concurrent-To", me)
    request = _record("request", urn("request", "row", "page_id"), url, F.concat(with_me, F.lit("Content-Type: application/http; msgtype=request" + LINE)), F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1" + END)))
    answer = _record(kind, me, url, about, F.concat(status, F.when(old, "").otherwise(F.col("payload"))))
    fields = F.concat(_line("page-id", F.coalesce(F.col("page_id").cast("string"), F.lit(""))), _line("payload-length", size))
    metadata = _record("metadata", urn("metadata", "row", "page_id"), url, F.concat(with_me, F.lit("Content-Type: application/warc-fields" + LINE)), fields)
    records = every.select(request.alias("request"), answer.alias("answer"), metadata.alias("metadata"))
    # A row is a whole archive; what the writer puts behind it is an empty member.
    archives = _archives(records, archive_bytes).select(F.col("value").cast("string"))
    archives.write.option("encoding", "ISO-8859-1").option("lineSep", _member(b"").decode("latin-1")).option("maxRecordsPerFile", 1).text(path)
    discard(rows, refers)


def parse_archive(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Headers (names in lower case) and block of each record, one held at a time.  Raises ValueError at a broken one."""
    plain = io.BytesIO(data)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=plain)) if data[:2] == b"\x1f\x8b" else plain
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError("no record where one should begin")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if stream.read(4) != END.encode():
            raise ValueError(f"a record's length is wrong: {head.get('warc-record-id')}")
        yield head, block


RECORD = "type string, id string, concurrent_to string, refers_to string, uri string, digest string, own_digest string, n_payload long, fields string, block binary"


def read_records(spark, path: str, blocks: bool = True) -> DataFrame:
    """One row for each record of the archives below ``path``.

    ``digest`` is the header's payload digest, ``own_digest`` and ``n_payload``
    are taken from the payload itself (null in records without one).
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")

    def payload(head: dict, block: bytes) -> bytes | None:
        return block[block.find(b"\r\n\r\n") + 4 :] if head["warc-type"] == "response" else None

    def rows(data: bytes) -> Iterator[dict]:
        for head, block in parse_archive(data):
            body, kind = payload(head, block), head["warc-type"]
            yield {
                "type": kind, "id": head.get("warc-record-id"), "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to"), "uri": head.get("warc-target-uri"),
                "digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None, "own_digest": None if body is None else b32encode(hashlib.sha1(body).digest()).decode(), "n_payload": None if body is None else len(body),
                "fields": block.decode() if kind == "metadata" else None, "block": block if blocks else None}

    kinds = pa.schema([("type", pa.string()), ("id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("digest", pa.string()), ("own_digest", pa.string()), ("n_payload", pa.int64()), ("fields", pa.string()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                held, size = [], 0
                for row in rows(x.as_py()):
                    held.append(row)
                    size += len(row["block"] or b"")
                    if len(held) >= 300 or size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=kinds)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema=kinds)

    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: ``capture`` and its ``response``, ``request`` and ``metadata``.

    Records join through the concurrent-to identifier, a response through its
    own; all three are gathered in one grouping, so each record moves once.
    Identifiers tell captures apart, whatever their pages: in archives of
    ``write_archives`` each row of the table is one.  A capture of which a record
    is missing has null there; of records that repeat an identifier and a type,
    as archives that were copied hold them, the smallest stays; records without
    any identifier belong to no capture.
    """
    capture = F.when(F.col("type").isin("response", "revisit"), F.col("id")).otherwise(F.coalesce("concurrent_to", "id"))
    whole = F.struct(*records.columns)
    part = lambda *kinds: F.min(F.when(F.col("type").isin(*kinds), whole))
    return records.withColumn("capture", capture).where("capture IS NOT NULL").groupBy("capture").agg(
        part("response", "revisit").alias("response"), part("request").alias("request"), part("metadata").alias("metadata"))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of all pages, archived and read back."""
    path = new_path(spark, "archives")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    captures = assemble(read_records(spark, path, blocks=False).drop("block"))
    number = lambda c: F.regexp_extract(c, r"(-?\d+)>$", 1).try_cast("long")
    field = lambda name: F.regexp_extract("metadata.fields", rf"(?m)^{name}: (-?\d+)\r?$", 1).try_cast("long")
    return captures.select(
        field("page-id").alias("page_id"), F.coalesce("response.n_payload", field("payload-length")).alias("payload_bytes"),
        F.coalesce("response.own_digest", "response.digest").alias("payload_digest"), F.col("response.type").alias("record_type"),
        number(F.col("response.refers_to")).alias("refers_to"), F.coalesce("request.uri", F.lit("")).alias("target_uri"))


_LETTERS = " || ".join(f"substr('{BASE32}', ((('0x' || substr(h, {1 + 5 * k}, 5))::INT >> {b}) & 31) + 1, 1)" for k in range(8) for b in (15, 10, 5, 0))
ORACLE_SQL = f"""
SELECT page_id, payload_bytes, {_LETTERS} AS payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, trim(regexp_replace(coalesce(url, ''), '[\\r\\n]+', ' ', 'g')) AS target_uri
FROM (SELECT page_id, url, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
"""
