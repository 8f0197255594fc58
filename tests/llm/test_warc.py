import gzip
import hashlib
import io

import pytest

from lexiloom.llm import warc

PAGES = "page_id long, url string, html string"


def expected(rows):
    """The contract's columns; of repeated rows with the largest page_id one is the response."""
    top, seen = {}, set()
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= warc.LEAST_REVISIT and p is not None:
            top[b] = max(p, top.get(b, p))
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        t = top.get(b, p) if len(b) >= warc.LEAST_REVISIT else p
        first = len(b) < warc.LEAST_REVISIT or (t == p and b not in seen)
        if first and len(b) >= warc.LEAST_REVISIT:
            seen.add(b)
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "response" if first else "revisit", None if first else t))
    return out


def run(df):
    from pyspark.sql import functions as F

    made = warc.captures(warc.write_archives(df))
    return made.select("page_id", F.coalesce("main.payload_bytes", "of_bytes").alias("b"), "main.payload_digest", "main.record_type", F.when(F.col("main.record_type") == "revisit", F.col("of_page")).alias("to"), "request.http_head", "n_requests", "n_metadata", "main.digest_matches").collect()


def test_round_trip(spark):
    big, small = "<p>" + "é" * 600 + "</p>", "<p>\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(1, "http://a.example/x?y", big), (2, "https://b.example/", big), (9, "http://c.example", big), (3, "u", small), (4, "u", small), (5, None, None), (6, "bad\r\nurl", ""), (7, "z", "q" * 2000)]
    got = run(spark.createDataFrame(rows, PAGES))
    assert sorted(tuple(r[:5]) for r in got) == sorted(expected(rows))
    assert all(r["n_requests"] == 1 and r["n_metadata"] == 1 for r in got)
    assert {r["http_head"] for r in got if r["page_id"] == 1} == {"GET /x?y HTTP/1.1\r\nHost: a.example"}


def test_repeated_and_null_rows(spark):
    big = "x" * 1500
    rows = [(1, "u", big), (1, "u", big), (None, "v", big), (None, "w", "s"), (2, "u", "s"), (2, "u", "s")]
    got = run(spark.createDataFrame(rows, PAGES))
    assert sorted(map(str, (tuple(r[:5]) for r in got))) == sorted(map(str, expected(rows)))
    import duckdb
    import pandas as pd

    pages = pd.DataFrame(rows, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"})
    with duckdb.connect() as db:
        db.register("pages", pages)
        assert sorted(map(str, db.sql(warc.SQL["op5_warc_transactions"]).fetchall())) == sorted(map(str, expected(rows)))
    got = run(spark.createDataFrame(rows[:4], PAGES))
    assert sorted(r["record_type"] for r in got) == ["response", "response", "revisit", "revisit"]
    assert all(r["payload_digest"] == hashlib.sha1(big.encode()).hexdigest() for r in got if r["b"] == 1500)
    assert run(spark.createDataFrame([], PAGES)) == []


def test_payloads(spark):
    rows = [(i, f"http://h/{i}", f"<b>{i}</b>" * 300) for i in range(50)]
    made = warc.captures(warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3)), payload=True)
    assert {(r["page_id"], bytes(r["main"]["payload"]).decode()) for r in made.collect()} == {(p, h) for p, _, h in rows}


@pytest.mark.parametrize("pack", [lambda b: b, gzip.compress])
def test_parser_of_foreign_archives(pack):
    one = b"WARC/1.0\r\nWARC-Type: response\r\nwarc-record-id: <urn:a>\r\nContent-Type: application/http\r\nContent-Length: 20\r\n\r\nHTTP/1.1 200 OK\r\n\r\nA"
    data = pack(one + b"\r\n\r\n") + pack(b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Concurrent-To: <urn:a>\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    got = list(warc.parse_records(io.BytesIO(data)))
    assert [h["warc-type"] for h, _ in got] == ["response", "metadata"] and got[0][1].endswith(b"\r\n\r\nA")


def test_records_that_lead_through_a_request(spark):
    rows = [("r", "response", None), ("q", "request", "r"), ("m", "metadata", "q"), ("lone", "metadata", "gone"), ("w", "warcinfo", None), (None, "request", "r")]
    records = spark.createDataFrame(
        [(i, k, to, None, None, None, None, 1 if k == "response" else None, True, None, None, None) for i, k, to in rows], warc._RECORD
    )
    got = {r["capture_id"]: (r["main"] is not None, r["n_requests"], r["n_metadata"]) for r in warc.assemble(records).collect()}
    assert got == {"r": (True, 1, 1), "gone": (False, 0, 1)}


def _one(name, body=b"A"):
    return warc.record("metadata", name, [], body)


def test_damaged_archives(spark, tmp_path):
    """What is damaged is left out and told, and the records around it are read."""
    good = [_one(f"urn:{i}", bytes([65 + i]) * 40_000) for i in range(4)]
    hurt = bytearray(good[1])
    hurt[len(hurt) // 2 :] = bytes(len(hurt) - len(hurt) // 2)

    def kinds(data):
        return [h.get("warc-record-id", h["warc-type"]) for h, _ in warc.parse_records(io.BytesIO(data))]

    assert kinds(good[0] + bytes(hurt) + good[2] + good[3]) == ["<urn:0>", "damaged", "<urn:2>", "<urn:3>"]
    assert kinds(good[0] + good[1][:-30]) == ["<urn:0>", "damaged"]
    plain = [gzip.decompress(x) for x in good[:3]]
    for wrong in (b"x", b"-5", b""):
        bad = plain[1].replace(b"Content-Length: 40000", b"Content-Length: " + wrong)
        assert kinds(plain[0] + bad + plain[2]) == ["<urn:0>", "damaged", "<urn:2>"]
    assert kinds(plain[0] + plain[1][:100]) == ["<urn:0>", "damaged"] and kinds(b"") == []
    (tmp_path / "a.warc.gz").write_bytes(good[0] + bytes(hurt) + good[2])
    got = warc.read_records(spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",), (None,)], "path string")).collect()
    assert sorted(r["record_type"] for r in got) == ["damaged", "metadata", "metadata"]


def test_every_archive_is_a_task(spark):
    paths = spark.createDataFrame([(f"file:///no/{i}",) for i in range(37)], "path string")
    assert warc.read_records(paths).rdd.getNumPartitions() == 37
