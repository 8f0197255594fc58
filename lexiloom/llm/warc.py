"""WARC archives: write captures, read records back, and assemble transactions.

A capture is a request, a response (or a revisit of another capture with the same payload) and a metadata record; the
request and the metadata name the response by WARC-Concurrent-To.  Archives are files of gzip members, one for each
record, in the shared folder.  Assembly follows the concurrent-to identifiers and returns one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, saved, table

#: Payloads of fewer bytes are stored in full even if another capture has the same.
LEAST_REVISIT = 1000
#: An archive is closed when it holds this many bytes.
ARCHIVE_BYTES = 64 << 20
#: Tasks that read archives at most; a number given is not merged by adaptive execution, which sees but a few bytes of paths.
READERS = 100_000
_DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6b1f0f0e-5c0b-5c1e-9b57-0d9d0c1f6a11")


def record(kind: str, identifier: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{identifier}>"), ("WARC-Date", _DATE), *headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _uri(url: str | None) -> str:
    """A header value has no line breaks or spaces at its ends."""
    return re.sub(r"[\r\n]+", " ", url or "").strip()


def _digest(hexadecimal: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def _hex(digest: str | None) -> str | None:
    m = re.fullmatch(r"sha1:([A-Z2-7]{32})", digest or "")
    return base64.b32decode(m[1]).hex() if m else None


def response_id(digest: str, page_id: int | None) -> str:
    return f"urn:uuid:{uuid.uuid5(_SPACE, f'{digest}/{page_id}')}"


def _capture(page_id, url, payload: bytes, digest: str, original, is_original: bool) -> list[bytes]:
    """The records of one page; original: the page of the response if several captures share the payload."""
    target = _uri(url)
    shared = original is not None
    own = response_id(digest, page_id) if shared and is_original else f"urn:uuid:{uuid.uuid4()}"
    about = [("WARC-Target-URI", target)] if target else []
    path = re.sub(r"^[a-z]+://[^/]*", "", target) or "/"
    host = re.match(r"[a-z]+://([^/]*)", target)
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    hashed = [("WARC-Payload-Digest", _digest(digest)), ("Content-Type", "application/http; msgtype=response")]
    if shared and not is_original:
        profile = [("WARC-Refers-To", f"<{response_id(digest, original)}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        main = record("revisit", own, about + profile + hashed, status)
    else:
        main = record("response", own, about + hashed, status + payload)
    to = [("WARC-Concurrent-To", f"<{own}>")]
    request = f"GET {path} HTTP/1.1\r\nHost: {host[1] if host else ''}\r\n\r\n".encode()
    facts = (f"pageId: {page_id}\r\n" if page_id is not None else "") + f"payloadLength: {len(payload)}\r\n"
    return [
        record("request", f"urn:uuid:{uuid.uuid4()}", about + to + [("Content-Type", "application/http; msgtype=request")], request),
        main,
        record("metadata", f"urn:uuid:{uuid.uuid4()}", about + to + [("Content-Type", "application/warc-fields")], facts.encode()),
    ]


def _write(batches, folder: str):
    """Archives of one task under names of its own, so that a task that runs again leaves no half of a file to the readers."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    out, name, size, n = None, "", 0, 0
    told = []
    for batch in batches:
        for page_id, url, html, digest, original, is_original in zip(*(c.to_pylist() for c in batch.columns)):
            if out is None:
                name = f"{uuid.uuid4().hex}.warc.gz"
                out, size, n = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                out.write(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", [("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: lexiloom\r\nformat: WARC File Format 1.1\r\n"))
            for x in _capture(page_id, url, (html or "").encode(), digest, original, is_original):
                out.write(x)
                size += len(x)
                n += 1
            if size >= ARCHIVE_BYTES:
                out.close()
                told.append((f"{folder}/{name}", n))
                out = None
    if out is not None:
        out.close()
        told.append((f"{folder}/{name}", n))
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in told], pa.string()), pa.array([x[1] for x in told], pa.int64())], names=["path", "records"])


def write_archives(pages: DataFrame) -> DataFrame:
    """Write the captures of pages (page_id, url, html) to the shared folder; returns (path, records) of its archives.

    Of captures with equal payloads of at least LEAST_REVISIT bytes that with the largest page_id is the response and
    the others revisit it; of equal rows with that page_id one is the response.  A null html is an empty payload, a null
    url leaves the target out, and a null page_id counts as the smallest.  No pages, no archives.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode(F.coalesce("html", F.lit("")), "utf-8"))).withColumn("rid", F.monotonically_increasing_id())
    rows = rows.withColumn("long", F.octet_length(F.coalesce("html", F.lit(""))) >= LEAST_REVISIT)
    groups = rows.where("long").groupBy("digest").agg(F.max(F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("p"), "rid", "page_id")).alias("top"), F.count("*").alias("n")).where("n > 1")
    # Written first, so that the join has plain exchanges on both sides and a hot payload's rows can be split.
    dealt = rows.join(saved(groups.withColumn("long", F.lit(True)), "payloads"), ["digest", "long"], "left")
    dealt = dealt.select("page_id", "url", "html", "digest", F.when(F.col("n") > 1, F.coalesce("top.page_id", F.lit(-(2**63)))).alias("original"), F.coalesce(F.col("top.rid") == F.col("rid"), F.lit(False)).alias("is_original"))
    return saved(dealt.mapInArrow(lambda b: _write(b, folder), "path string, records long"), "archives")


# --- reading -------------------------------------------------------------------------------------------------------


class Damaged(Exception):
    """A record that can't be read whole; reading goes on behind it."""


class _Stream:
    """Bytes of an archive, plain or of any number of gzip members, read in pieces."""

    def __init__(self, file):
        self.file, self.held, self.z = file, bytearray(), None
        self.data, self.at = file.read(1 << 20), 0
        self.packed = self.data[:2] == b"\x1f\x8b"

    def more(self) -> bool:
        """Reads on, to the end of a member at most, so that what is held is of one member but for what wasn't taken yet.

        A member that can't be unpacked raises Damaged, and what follows is the next that begins like one.
        """
        if self.at >= len(self.data):
            self.data, self.at = self.file.read(1 << 20), 0
            if not self.data:
                return False
        piece = memoryview(self.data)[self.at : self.at + (1 << 14)]
        if not self.packed:
            self.held += piece
            self.at += len(piece)
            return True
        if self.z is None or self.z.eof:
            self.z = zlib.decompressobj(31)
        try:
            self.held += self.z.decompress(piece)
        except zlib.error:
            self.z = None
            self.held.clear()
            self._skip()
            raise Damaged("a gzip member that can't be unpacked") from None
        self.at += len(piece) - len(self.z.unused_data)
        return True

    def _skip(self) -> None:
        """To the next place that begins like a gzip member, or the end."""
        at = self.data.find(b"\x1f\x8b\x08", self.at + 1)
        while at < 0:
            more = self.file.read(1 << 20)
            self.data = self.data[-2:] + more if more else b""
            at = self.data.find(b"\x1f\x8b\x08") if more else 0
        self.at = at

    def until(self, mark: bytes) -> bytes | None:
        at, seen = -1, 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self.more():
                left = bool(self.held.strip(b"\r\n\0"))
                self.held.clear()
                if left:
                    raise Damaged("an archive that ends within a record")
                return None
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                self.held.clear()
                raise Damaged("an archive that ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse_records(file):
    """(headers with lower-case names, block) of each record of an open archive.

    Of a record that can't be read whole (a damaged gzip member, no Content-Length or one that is no number, an archive
    that ends within it) the headers are {"warc-type": "damaged"} and the block tells the reason; the next begins
    with the next record's first line.
    """
    stream = _Stream(file)
    while True:
        try:
            head = stream.until(b"\r\n\r\n")
            if head is None:
                return
            lines = head.lstrip(b"\r\n").decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                continue
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = headers.get("content-length", "")
            if not re.fullmatch("[0-9]{1,18}", size):
                raise Damaged("a Content-Length that is no number")
            yield headers, stream.take(int(size))
        except Damaged as why:
            yield {"warc-type": "damaged"}, str(why).encode()


_RECORD = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, warc_date string, payload_digest string, payload_bytes long, digest_matches boolean, http_head string, fields map<string,string>, payload binary"


def _read(batches, payload: bool):
    names = ["record_id", "record_type", "concurrent_to", "refers_to", "target_uri", "warc_date", "payload_digest", "payload_bytes", "digest_matches", "http_head", "fields", "payload"]
    kinds = [pa.string()] * 7 + [pa.int64(), pa.bool_(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    rows: list[tuple] = []
    size = 0

    def told():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, at = fs.FileSystem.from_uri(path)
            with store.open_input_stream(at, compression=None) as file:
                for h, block in parse_records(file):
                    kind = h.get("warc-type")
                    body, top, fields, digest, match = block, None, None, None, None
                    if "application/http" in h.get("content-type", ""):
                        top, _, body = block.partition(b"\r\n\r\n")
                    elif h.get("content-type") == "application/warc-fields":
                        fields = [(k.strip(), v.strip()) for k, s, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if s]
                    said = _hex(h.get("warc-payload-digest"))
                    if kind == "response":
                        digest = hashlib.sha1(body).hexdigest()
                        match = said is None or said == digest
                    rows.append(
                        (
                            h.get("warc-record-id", "").strip("<>") or None,
                            kind,
                            h.get("warc-concurrent-to", "").strip("<>") or None,
                            h.get("warc-refers-to", "").strip("<>") or None,
                            h.get("warc-target-uri"),
                            h.get("warc-date"),
                            digest or said,
                            len(body) if kind == "response" else None,
                            match,
                            top.decode("utf-8", "replace") if top is not None else None,
                            fields,
                            body if payload and kind == "response" else None,
                        )
                    )
                    size += len(body) if payload else 200
                    if size > 1 << 22:
                        yield told()
                        rows, size = [], 0
    if rows:
        yield told()


def read_records(archives: DataFrame, payload: bool = False) -> DataFrame:
    """The records of the archives (path); the digest and length of a response are those of the payload that was read.

    A damaged record is a row of record_type damaged without an identifier; the others of its archive are read.
    Every archive is a task of its own, up to READERS tasks, which then read several each.
    """
    paths = archives.select(F.col("path").cast("string").alias("path")).where("path is not null")
    return paths.repartition(max(1, min(paths.count(), READERS))).mapInArrow(lambda b: _read(b, payload), _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: (capture_id, main, request, metadata, n_requests, n_metadata).

    A record belongs to the capture of the response, revisit or resource that its concurrent-to identifier leads to,
    itself or through a request.  Of several requests or metadata records of a capture that with the largest record_id
    stands in the row and the numbers tell of the rest.  A record that leads to no response is a capture of its own,
    with a null main.  Records without an identifier are left out.
    """
    records = records.where("record_type <> 'warcinfo' and record_id is not null")
    said = ["record_id", "target_uri", "warc_date"]
    r = records.withColumn("to", F.coalesce("concurrent_to", "record_id"))
    hop = records.where("record_type = 'request' and concurrent_to is not null").select(F.col("record_id").alias("to"), F.col("concurrent_to").alias("next")).dropDuplicates(["to"])
    r = r.where("concurrent_to is null or record_type = 'request'").withColumn("next", F.lit(None).cast("string")).unionByName(r.where("concurrent_to is not null and record_type <> 'request'").join(hop, "to", "left"))
    main = F.when(F.col("record_type").isin("response", "revisit", "resource"), F.struct(*said, "record_type", "refers_to", "payload_digest", "payload_bytes", "digest_matches", "http_head", "payload"))
    request = F.when(F.col("record_type") == "request", F.struct(*said, "http_head"))
    metadata = F.when(F.col("record_type") == "metadata", F.struct(*said, F.to_json("fields").alias("fields")))
    return r.groupBy(F.coalesce("next", "to").alias("capture_id")).agg(
        F.max(main).alias("main"), F.max(request).alias("request"), F.max(metadata).alias("metadata"), F.count(request).alias("n_requests"), F.count(metadata).alias("n_metadata")
    )


def captures(archives: DataFrame, payload: bool = False) -> DataFrame:
    """assemble() of the archives with page_id, and for a revisit the page and the length of the payload that it refers to."""
    # Written once: the archives are read once, and joins know the true size of what they join.
    records = saved(read_records(archives, payload), "records")
    made = assemble(records).withColumn("fields", F.from_json("metadata.fields", "map<string,string>"))
    made = saved(made.withColumn("page_id", F.col("fields")["pageId"].cast("long")).where("main is not null"), "captures")
    full = made.where("main.record_type = 'response'").select(F.col("capture_id").alias("of"), F.col("page_id").alias("of_page"), F.col("main.payload_bytes").alias("of_bytes"))
    plain = made.where("main.refers_to is null").select("*", F.lit(None).cast("string").alias("of"), F.lit(None).cast("long").alias("of_page"), F.lit(None).cast("long").alias("of_bytes"))
    again = made.where("main.refers_to is not null").withColumn("of", F.col("main.refers_to")).join(full, "of", "left")
    return plain.unionByName(again)


def op5_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(write_archives(table(spark, sf_dir, "pages"))).select(
        "page_id",
        F.coalesce("main.payload_bytes", "of_bytes").alias("payload_bytes"),
        F.col("main.payload_digest").alias("payload_digest"),
        F.col("main.record_type").alias("record_type"),
        F.when(F.col("main.record_type") == "revisit", F.col("of_page")).alias("refers_to"),
    )


QUERIES = {"op5_warc_transactions": op5_warc_transactions}
SQL = {
    "op5_warc_transactions": """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT *, payload_bytes < 1000 OR row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) = 1 AS first,
             max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN NOT first THEN top END AS refers_to
FROM t"""
}
