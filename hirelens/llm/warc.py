"""WARC archives: write captures, read them back, assemble transactions.

``write`` turns every page into a request, a response (or revisit) and a
metadata record, linked by WARC-Concurrent-To, and writes gzip WARC/1.1 files with
Spark's text writer (its line separator is the end mark of a record), so archives
land on whatever store Spark writes to and lost tasks are simply run again. Of
equal payloads of at least ``least`` bytes the one with the smallest id is a
response; the others are revisits that refer to it and carry no payload.

``read`` parses the files record by record by Content-Length (memory: one packed
file and one record). ``assemble`` joins the records of a capture through their
concurrent-to identifiers, finds the response a revisit refers to, and emits one
nested row per capture.

``df`` must be a stored table (or deterministic read): rows are numbered by place.

Defined cases: a null payload is empty and a response; a null url gets a
``urn:page:`` target and stays null; control characters and blanks in a target are
percent-encoded, the metadata record keeps the url as it was; repeated ids are
captures of their own, a null id comes last in order; payloads may hold anything,
record marks included; other columns are not read; an empty table gives no capture.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import column, save

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = ("record_id string, kind string, concurrent_to string, refers_to string, target string, date string, "
           "digest string, payload_bytes long, payload_digest string, payload string, body string")


def _record_id(kind: str, page: Column, row: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.lit(kind), F.coalesce(page.cast("string"), F.lit("null")), row.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: Column | str, headers: list[tuple[str, Column | str]], body: Column) -> Column:
    """A record as text, without its end mark; headers that are null are left out."""
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    lines = [F.concat(F.lit(f"{name}: "), as_col(value), F.lit(CRLF)) for name, value in [("WARC-Type", kind), *headers]]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF + CRLF))
    return F.concat(F.lit("WARC/1.1" + CRLF), *[F.coalesce(x, F.lit("")) for x in lines], length, body)


def transactions(df: DataFrame, id_col: str, url_col: str, payload_col: str, least: int, date: str) -> DataFrame:
    """One row per page: its three records as one text, each but the last ended."""
    payload = F.coalesce(column(df, payload_col), F.lit(""))
    pages = df.select(F.monotonically_increasing_id().alias("row"), column(df, id_col).cast("bigint").alias("id"),
                      column(df, url_col).alias("url"), payload.alias("payload"),
                      F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("bigint").alias("bytes"))
    # The second key makes both sides plain shuffles, so AQE may split a hot payload.
    part = F.substring("digest", 1, 4).alias("part")
    lead = (pages.filter(F.col("bytes") >= least).groupBy("digest", "bytes")
            .agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("lead")).select("digest", "bytes", part, "lead"))
    j = pages.withColumn("part", F.substring("digest", 1, 4)).join(lead, ["digest", "bytes", "part"], "left")
    revisit = F.coalesce(F.col("lead.row") != F.col("row"), F.lit(False))
    own = _record_id("capture", F.col("id"), F.col("row"))
    plain = F.coalesce("url", F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    target = F.regexp_replace(plain, r"[\x00-\x20\x7F]", "%20")
    common = [("WARC-Target-URI", target), ("WARC-Date", date)]
    host = F.regexp_extract(target, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(target, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    request = _record("request", [("WARC-Record-ID", _record_id("request", F.col("id"), F.col("row"))), ("WARC-Concurrent-To", own), *common,
                                  ("Content-Type", "application/http; msgtype=request")],
                      F.concat(F.lit("GET "), F.when(path == "", F.lit("/")).otherwise(path), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2)))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    refers = F.when(revisit, _record_id("capture", F.col("lead.id"), F.col("lead.row")))
    capture = _record(F.when(revisit, "revisit").otherwise("response"),
                      [("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
                       ("WARC-Refers-To", refers), ("WARC-Profile", F.when(revisit, PROFILE)),
                       ("Content-Type", "application/http; msgtype=response")],
                      F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload"))))
    meta = _record("metadata", [("WARC-Record-ID", _record_id("metadata", F.col("id"), F.col("row"))), ("WARC-Concurrent-To", own), *common,
                                ("Content-Type", "application/json")],
                   F.to_json(F.struct(F.col("id").alias("page_id"), "url")))
    return j.select(F.concat_ws(CRLF * 2, request, capture, meta).alias("value"))


def write(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          least: int = 100, date: str = "2024-01-01T00:00:00Z", per_file: int = 5000) -> None:
    """Write the captures of ``df`` as gzip WARC files below ``path``, at most
    ``per_file`` captures a file."""
    (transactions(df, id_col, url_col, payload_col, least, date).write.option("lineSep", CRLF * 2).option("compression", "gzip")
     .option("maxRecordsPerFile", per_file).text(path))


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and body of each record of one archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        body = stream.read(length)
        if len(body) < length:
            raise ValueError(f"record {headers.get('warc-record-id')} is cut off")
        yield headers, body


def _parser(with_payload: bool):
    names = [f.split(" ")[0] for f in _RECORD.split(", ")]
    types = [pa.int64() if n == "payload_bytes" else pa.string() for n in names]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for b in batches:
            for packed in b.column("content"):
                raw = io.BytesIO(packed.as_buffer())
                stream = gzip.GzipFile(fileobj=raw) if raw.getbuffer()[:2] == b"\x1f\x8b" else raw
                for h, body in records(io.BufferedReader(stream)):
                    kind, size, sha, text, rest = h.get("warc-type"), None, None, None, None
                    if kind == "response":
                        payload = body.partition(b"\r\n\r\n")[2]
                        size, sha = len(payload), hashlib.sha256(payload).hexdigest()
                        text = payload.decode("utf-8", "replace") if with_payload else None
                    elif kind in ("request", "metadata"):
                        rest = body.decode("utf-8", "replace")
                    rows.append((h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"),
                                 h.get("warc-date"), h.get("warc-payload-digest"), size, sha, text, rest))
                    held += len(body)
                    if held > 4_000_000 or len(rows) >= 5000:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    return run


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_parser(with_payload), _RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: page_id, url, record_type, target, date,
    response (record_id, payload_bytes, payload_digest, payload; of a revisit those
    of the response it refers to), request, metadata and refers_to (record_id, page_id)."""
    own = found.filter("kind in ('response', 'revisit')")
    request = found.filter("kind = 'request'").select(F.col("concurrent_to").alias("record_id"),
                                                     F.struct("record_id", F.col("body").alias("head")).alias("request"))
    about = F.from_json("body", "page_id bigint, url string")
    meta = found.filter("kind = 'metadata'").select(F.col("concurrent_to").alias("record_id"), about.alias("about"),
                                                    F.struct("record_id", "body").alias("metadata"))
    full = own.filter("kind = 'response'").join(meta, "record_id", "left").select(
        F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("lead_bytes"), F.col("payload_digest").alias("lead_digest"),
        F.col("payload").alias("lead_payload"), F.col("about.page_id").alias("lead_page"))
    joined = own.join(request, "record_id", "left").join(meta, "record_id", "left").join(full, "refers_to", "left")
    response = F.struct("record_id", F.coalesce("payload_bytes", "lead_bytes").alias("payload_bytes"),
                        F.coalesce("payload_digest", "lead_digest", F.regexp_replace("digest", "^sha256:", "")).alias("payload_digest"),
                        F.coalesce("payload", "lead_payload").alias("payload"))
    refers = F.when(F.col("refers_to").isNotNull(), F.struct(F.col("refers_to").alias("record_id"), F.col("lead_page").alias("page_id")))
    return joined.select(F.col("about.page_id").alias("page_id"), F.col("about.url").alias("url"), F.col("kind").alias("record_type"),
                         "target", "date", response.alias("response"), "request", "metadata", refers.alias("refers_to"))


def round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               with_payload: bool = False) -> DataFrame:
    """Write ``df`` to archives in the shared checkpoint folder and assemble what
    is read back."""
    path = scratch_path(df.sparkSession, f"warc-{uuid.uuid4().hex}")
    write(df, path, id_col, url_col, payload_col)
    return assemble(save(read(df.sparkSession, path, with_payload), "records"))
