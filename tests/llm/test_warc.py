import hashlib

from hirelens.llm import warc
from hirelens.llm.common import save

BIG = "z" * 200
ROWS = [(3, "http://a/x y\r\nEvil: 1", BIG), (2, None, BIG), (2, "http://b", BIG), (4, "http://c/?q#f", None), (5, "u", "x\r\n\r\nWARC/1.1\r\n\r\n" * 20),
        (None, "n", BIG), (6, "q", "short"), (7, "q", "short"), (8, "é", "ü😀" * 80), (9, "v", "ü😀" * 80), (10, "w", "q" * 99), (11, "w", "q" * 99),
        (12, "l", "long " * 100_000)]


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 as id", "2 as record_id", "3 as digest", "4 as body").repartition(4)
    got = warc.round_trip(save(df, "pages"), with_payload=True).collect()
    assert len(got) == len(ROWS)
    assert sorted(map(str, [(r.page_id, r.url, r.response.payload) for r in got])) == sorted(map(str, [(i, u, h or "") for i, u, h in ROWS]))
    for r in got:
        raw = r.response.payload.encode()
        assert r.response.payload_bytes == len(raw) and r.response.payload_digest == hashlib.sha256(raw).hexdigest()
        assert r.request.record_id and r.metadata.record_id and "\n" not in r.target and " " not in r.target
    kind = {}
    for r in got:
        kind.setdefault((r.page_id, r.url), (r.record_type, r.refers_to.page_id if r.refers_to else None))
    assert [v for k, v in kind.items() if k[0] == 2 and v[0] == "response"] and sum(v == ("revisit", 2) for v in kind.values()) == 3
    assert kind[9, "v"] == ("revisit", 8) and kind[8, "é"] == ("response", None)
    assert all(kind[k][0] == "response" for k in [(6, "q"), (7, "q"), (10, "w"), (11, "w"), (4, "http://c/?q#f")])


def test_plain_archives_are_read(spark, tmp_path):
    def record(kind, rid, extra, body):
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{rid}>\r\n{extra}Content-Length: {len(body)}\r\n\r\n"
        return head.encode() + body + b"\r\n\r\n"

    page = b"HTTP/1.1 200 OK\r\n\r\nhi\r\n\r\nthere"
    (tmp_path / "a.warc.gz").write_bytes(b"".join([
        record("metadata", "m", "WARC-Concurrent-To: <r>\r\n", b'{"page_id":1}'), record("response", "r", "", page), record("warcinfo", "i", "", b"x: y")]))
    rows = {r.kind: r for r in warc.read(spark, str(tmp_path)).collect()}
    assert rows["response"].payload == "hi\r\n\r\nthere" and rows["warcinfo"].payload is None
    out = warc.assemble(warc.read(spark, str(tmp_path))).collect()
    assert len(out) == 1 and out[0].page_id == 1 and out[0].request is None and out[0].response.payload_bytes == 11


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
