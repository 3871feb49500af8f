"""WARC archives: records are written to gzip files, read back and joined into transactions."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galleryloom.llm.common import arrow_batches, salted_join, table
from galleryloom.session import materialize, scratch_path

# Equal payloads of at least this many bytes are written once; the others revisit it.
MIN_REVISIT_BYTES = 0
FILE_CAPTURES = 20_000
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
# Digits of base 32 as conv() writes them, and as RFC 4648 does.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = "type string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, payload_bytes long, http string, block string"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hex digits of the hash make four of base 32."""
    hexed = F.sha1(payload.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(hexed, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*groups), CONV_DIGITS, BASE32_DIGITS)


def _lines(*parts: Column | str) -> Column:
    """Header lines with their ends; a NULL line is left out."""
    ended = [F.concat(p if isinstance(p, Column) else F.lit(p), F.lit(CRLF)) for p in parts]
    return F.concat(*[F.coalesce(p, F.lit("")) for p in ended])


def _record(kind: Column | str, record_id: Column, content_type: str, block: Column, *headers: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = _lines(
        "WARC/1.1", F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <"), record_id, F.lit(">")), f"WARC-Date: {DATE}", *headers,
        f"Content-Type: {content_type}", F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(head, F.lit(CRLF), block)


def one_line(value: Column) -> Column:
    """A header value without line ends, which would end the header."""
    return F.regexp_replace(value, "[\\r\\n]+", " ")


def with_revisits(pages: DataFrame, id_col: str, payload: Column, min_bytes: int) -> DataFrame:
    """The pages with payload, bytes, digest and `_first`: the least id with an equal payload."""
    told = pages.withColumn("_payload", F.coalesce(payload, F.lit(""))).withColumn("_digest", payload_digest(F.col("_payload")))
    told = told.withColumn("_bytes", F.octet_length("_payload").cast("long"))
    firsts = materialize(
        told.groupBy("_digest", "_bytes").agg(F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("_copies"))
        .where((F.col("_copies") > 1) & (F.col("_bytes") >= min_bytes)).drop("_bytes"), "firsts",
    )
    return salted_join(told, firsts, "_digest", "_copies", F.col(id_col))


def write_warc(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES
) -> str:
    """Write a request, a response (or revisit) and a metadata record per page; return the folder of gzip files.

    Of pages with equal payloads of at least `min_bytes` bytes the one with the least id is the response and the
    others revisit it; rows that repeat that id are responses too, and so is a payload whose pages have
    no id. A NULL payload is empty; a NULL url gives no target line. Each row gets identifiers of its own,
    so repeated rows stay separate captures. A file holds FILE_CAPTURES captures at most.
    """
    spark = pages.sparkSession
    told = with_revisits(pages.select(F.col(id_col), F.col(url_col), F.col(payload_col)), id_col, F.col(payload_col), min_bytes)
    named = told.withColumn("_page", F.coalesce(F.col(id_col).cast("string"), F.lit(""))).withColumn("_uuid", F.expr("uuid()"))
    revisit = F.col("_first").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("_first"))
    own = F.concat(F.lit("urn:x-page:"), "_page", F.lit(":"), "_uuid")
    url = one_line(F.col(url_col))
    target = F.concat(F.lit("WARC-Target-URI: "), url)
    together = F.concat(F.lit("WARC-Concurrent-To: <"), own, F.lit(">"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), "_digest")
    refers = F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:x-page:"), F.col("_first").cast("string"), F.lit(">")))
    profile = F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    length = F.concat(F.lit("Content-Length: "), F.col("_bytes").cast("string"))
    status = F.concat(_lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", length), F.lit(CRLF))
    host = F.concat(F.lit("Host: "), F.regexp_extract(url, "://([^/?#]*)", 1))
    asked = F.concat(_lines(F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(" HTTP/1.1")), host), F.lit(CRLF))
    about = _lines(F.concat(F.lit("page: "), "_page"), F.concat(F.lit("payload-bytes: "), F.col("_bytes").cast("string")))
    records = F.concat_ws(
        CRLF + CRLF,
        _record("request", F.concat(own, F.lit(":request")), "application/http; msgtype=request", asked, target, together),
        _record(
            F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), own, "application/http; msgtype=response",
            F.when(revisit, status).otherwise(F.concat(status, "_payload")), target, digest, refers, profile,
        ),
        _record("metadata", F.concat(own, F.lit(":metadata")), "application/warc-fields", about, target, together),
    )
    path = scratch_path(spark, "warc")
    written = named.select(records.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip")
    written.option("maxRecordsPerFile", FILE_CAPTURES).text(path)
    return path


HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def _inflated(raw: bytes) -> Iterator[bytes]:
    """Pieces of a gzip file of one or more members."""
    source = io.BytesIO(raw)
    engine = zlib.decompressobj(31)
    while piece := source.read(1 << 20):
        while piece:
            yield engine.decompress(piece)
            piece = engine.unused_data if engine.eof else b""
            if engine.eof:
                engine = zlib.decompressobj(31)


def parse_records(pieces: Iterator[bytes]) -> Iterator[dict]:
    """Records of a WARC stream, by their stated lengths; line ends inside a payload do not matter."""
    held, at, ended = bytearray(), 0, False

    def more(wanted: int) -> bool:
        nonlocal ended, at
        while len(held) - at < wanted and not ended:
            piece = next(pieces, None)
            if piece is None:
                ended = True
            else:
                if at > 1 << 22:
                    del held[:at]
                    at = 0
                held.extend(piece)
        return len(held) - at >= wanted

    while True:
        while more(2) and held[at : at + 2] == b"\r\n":
            at += 2
        if not more(1):
            return
        reach, stop = 1024, -1
        while stop < 0:
            full = more(reach)
            stop = held.find(b"\r\n\r\n", at)
            if stop < 0 and not full:
                raise ValueError("a WARC header without end")
            reach *= 2
        head = {k.strip().lower().decode(): v.decode("utf-8", "replace") for k, v in HEADER.findall(bytes(held[at : stop + 2]))}
        size = int(head["content-length"])
        skip = stop + 4 - at
        if not more(skip + size):
            raise ValueError("a WARC record without its full block")
        yield head | {"block": bytes(held[at + skip : at + skip + size])}
        at += skip + size


def _row(record: dict) -> tuple:
    bare = lambda name: record[name].strip("<>") if name in record else None
    block, http, payload_bytes = record["block"], None, None
    if record.get("content-type", "").startswith("application/http"):
        head, _, block = block.partition(b"\r\n\r\n")
        http = head.decode("utf-8", "replace")
        found = re.search(r"(?im)^content-length: *(\d+)", http)
        payload_bytes = int(found[1]) if found else len(block)
    digest = record.get("warc-payload-digest")
    if record.get("warc-type") == "response" and http is not None:
        # What was read counts; a revisit has only the values in its headers.
        own = "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        if payload_bytes != len(block) or (digest or own).startswith("sha1:") and (digest or own) != own:
            raise ValueError(f"payload of {bare('warc-record-id')}: {len(block)} bytes, {own}; its headers say {payload_bytes} bytes, {digest}")
        digest = own
    return (
        record.get("warc-type"), bare("warc-record-id"), bare("warc-concurrent-to"), bare("warc-refers-to"), record.get("warc-target-uri"),
        digest.removeprefix("sha1:") if digest else None, payload_bytes, http, block.decode("utf-8", "replace"),
    )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in a folder."""
    arrow_batches(spark, 4)
    columns = [c.split()[0] for c in RECORD.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["content"]:
                rows, size = [], 0
                for record in parse_records(_inflated(raw)):
                    rows.append(_row(record))
                    size += len(record["block"])
                    if size > 1 << 23:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=columns).astype({"payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(parse, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: response (or revisit), request and metadata, and how many of the latter there are.

    Requests and metadata name the capture they belong to as concurrent, so all records of a capture meet under
    its id; only the columns that are used later travel. Of several requests the one with the least record id is nested and
    the number tells of the others, which stay in the record table. A request or metadata record without
    its response makes no capture.
    """
    sides = {
        "response": (F.col("type").isin("response", "revisit"), ("type", "target_uri", "payload_digest", "payload_bytes", "refers_to", "http", "block")),
        "request": (F.col("type") == "request", ("record_id", "target_uri", "http")),
        "metadata": (F.col("type") == "metadata", ("record_id", "target_uri", "block")),
    }
    capture = F.when(sides["response"][0], F.col("record_id")).otherwise(F.col("concurrent_to"))
    keyed = records.withColumn("capture_id", capture).where("capture_id IS NOT NULL")
    parts = [
        F.min_by(F.when(own, F.col(c)), F.when(own, F.col("record_id"))).alias(f"{side}_{c}")
        for side, (own, columns) in sides.items() for c in columns
    ]
    counts = [F.count(F.when(own, 1)).alias(f"{side}_records") for side, (own, _) in sides.items()]
    met = keyed.groupBy("capture_id").agg(*parts, *counts).where("response_records > 0")
    nested = [F.struct(*[F.col(f"{side}_{c}").alias(c) for c in columns]).alias(side) for side, (_, columns) in sides.items()]
    return met.select("capture_id", *nested, "request_records", "metadata_records")


def op10_warc(spark, sf_dir):
    captures = transactions(read_warc(spark, write_warc(table(spark, sf_dir, "pages"))))
    page = lambda name: F.regexp_extract(name, "^urn:x-page:(-?[0-9]*)", 1).try_cast("long")
    return captures.select(
        page("capture_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), page("response.refers_to").alias("refers_to"),
    )


_FIVE = "CAST('0x' || substr(sha1(payload), 1 + 5 * g, 5) AS BIGINT)"
_DIGITS = " || ".join(f"substr('{BASE32_DIGITS}', CAST(1 + (({_FIVE} >> {shift}) & 31) AS INTEGER), 1)" for shift in (15, 10, 5, 0))
ORACLE = f"""WITH told AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
firsts AS (SELECT payload, min(page_id) AS first FROM told WHERE strlen(payload) >= {MIN_REVISIT_BYTES} GROUP BY payload)
SELECT page_id, CAST(strlen(told.payload) AS BIGINT) AS payload_bytes,
  array_to_string([{_DIGITS.replace("payload", "told.payload")} for g in range(8)], '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM told LEFT JOIN firsts ON firsts.payload = told.payload"""

QUERIES = {"op10_warc": op10_warc}
ORACLES = {"op10_warc": ORACLE}
