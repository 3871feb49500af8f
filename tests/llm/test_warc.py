import base64
import gzip
import hashlib
import io

from galleryloom.llm import warc
from galleryloom.llm.common import table
from workload.compare import connect, difference


def brute(pages, least=0):
    first = {}
    for page, _, html in pages:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, _, html in pages:
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        origin = first.get(html or "") if len(raw) >= least else None
        copy = origin is not None and origin != page
        out.append((page, len(raw), digest, "revisit" if copy else "response", origin if copy else None))
    return sorted(out, key=repr)


def test_query_equals_brute_force(spark, sf):
    pages = [tuple(r) for r in table(spark, sf, "pages").select("page_id", "url", "html").collect()]
    got = warc.op10_warc(spark, sf)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(pages)
    assert difference(got, connect(sf), warc.ORACLE) is None


def test_edges(spark, tmp_path):
    tricky = "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n\r\n"
    pages = [(5, "http://a.b/c", "x"), (3, None, "x"), (3, "http://r\r\nX: y", "x"), (7, "u", None), (9, "u", ""), (None, "u", "null id"), (None, "u", "x"),
             (1, "http://q.example/é", tricky), (2, "", tricky + "\r\n"), (4, "u", "é" * 900_000), (-6, "u", tricky)]
    df = spark.createDataFrame([(*p, "a", "b") for p in pages], "page_id long, url string, html string, type string, _first string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, warc.op10_warc(spark, str(tmp_path)).collect()), key=repr) == brute(pages)
    path = warc.write_warc(df)
    nested = {r.capture_id.split(":")[2]: r for r in warc.transactions(warc.read_warc(spark, path)).collect()}
    one = nested["4"]
    assert one.response.block == "é" * 900_000 and one.request_records == one.metadata_records == 1
    assert one.request.http.startswith("GET u HTTP/1.1") and "payload-bytes: 1800000" in one.metadata.block
    assert nested["-6"].response.block == tricky and nested["1"].response.block == ""
    empty = warc.write_warc(df.limit(0))
    assert warc.transactions(warc.read_warc(spark, empty)).count() == 0


def test_minimum_bytes(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "b"), (4, "u", "b")], "page_id long, url string, html string")
    records = warc.read_warc(spark, warc.write_warc(df, min_bytes=2)).where("type IN ('response', 'revisit')").collect()
    assert sorted((r.record_id.split(":")[2], r.type) for r in records) == [("1", "response"), ("2", "revisit"), ("3", "response"), ("4", "response")]


def test_members_and_stray_records():
    head = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nab\r\n\r\n\r\n"
    raw = gzip.compress(head) + gzip.compress(head * 2)
    found = list(warc.parse_records(warc._inflated(io.BytesIO(raw).getvalue())))
    assert [r["block"] for r in found] == [b"ab\r\n"] * 3


def test_damaged_payloads_are_found(spark, tmp_path):
    def record(payload, digest, size):
        http = f"HTTP/1.1 200 OK\r\nContent-Length: {size}\r\n\r\n".encode() + payload
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:1:a>\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n"
        return head.encode() + http + b"\r\n\r\n"

    digest = base64.b32encode(hashlib.sha1(b"whole text").digest()).decode()
    forms = {"fine": record(b"whole text", digest, 10), "changed": record(b"whole tent", digest, 10), "cut": record(b"whole", digest, 10)}
    for name, raw in forms.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.gz").write_bytes(gzip.compress(raw))
    read = lambda name: [(r.payload_bytes, r.payload_digest) for r in warc.read_warc(spark, str(tmp_path / name)).select("payload_bytes", "payload_digest").collect()]
    assert read("fine") == [(10, digest)]
    for name in ("changed", "cut"):
        try:
            read(name)
        except Exception as error:
            assert "its headers say" in str(error)
        else:
            raise AssertionError(name)
