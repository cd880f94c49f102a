"""Protobuf payloads, delivery and reports."""

import random
from http.server import BaseHTTPRequestHandler, HTTPServer
from threading import Thread

from usagelens.sources import sinks, wire

SITE = {"line": (1, "int"), "guard": (2, "int?"), "name": (3, "string")}
BATCH = {"instance": (1, "string"), "at": (2, "int"), "flags": (4, ["bool"]), "sites": (5, [SITE]), "ratio": (6, "double"), "raw": (7, "bytes"), "own": (8, SITE), "note": (9, "string?"), "ids": (16, ["int"])}


def random_message(r):
    site = lambda: {"line": r.choice([0, 1, 300, 2**40]), "guard": r.choice([None, 0, 7]), "name": r.choice(["", "é", "x" * 200])}
    return {"instance": r.choice(["", "i-1"]), "at": r.choice([0, -1, 2**62, -(2**63)]), "flags": r.choices([True, False], k=r.randrange(3)), "sites": [site() for _ in range(r.randrange(3))], "ratio": r.choice([0.0, -2.5]),
            "raw": r.choice([b"", b"\x00\xff"]), "own": r.choice([None, site()]), "note": r.choice([None, "", "n"]), "ids": [r.randrange(2**30) for _ in range(r.randrange(4))]}


def test_messages_come_back_as_they_were():
    r = random.Random(4)
    for _ in range(300):
        m = random_message(r)
        assert wire.decode(BATCH, wire.encode(BATCH, m)) == m
    # unknown fields are skipped, packed numbers unpacked, of a field given twice the last counts
    assert wire.decode({"ids": (16, ["int"]), "a": (1, "int")}, b"\x08\x05\x08\x06\x12\x01z\x82\x01\x03\x01\x96\x01") == {"ids": [1, 150], "a": 6}


def test_payload_tables(spark):
    r = random.Random(5)
    rows = [(f"p{i}", wire.encode(BATCH, random_message(r))) for i in range(20)] + [("bad", b"\x0a\x7f"), ("none", None)]
    d = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in rows], "payload_id string, payload binary")
    got = wire.decode_payloads(d, BATCH)
    errors = {x.payload_id: x.error for x in got.where("error is not null").collect()}
    assert set(errors) == {"bad", "none"} and errors["bad"].startswith("could not be decoded")
    back = {x.payload_id: bytes(x.payload) for x in wire.encode_payloads(got.where("error is null").select("payload_id", "message"), BATCH).collect()}
    assert back == {i: b for i, b in rows if i.startswith("p")}


def answers(*given):
    left, waits = list(given), []

    def post(url, body):
        a = left.pop(0)
        if a is None:
            raise OSError("no route")
        return a if isinstance(a, tuple) else (a, None)

    return post, waits


def test_delivery():
    def run(*given, **k):
        post, waits = answers(*given)
        return sinks.deliver_one("u", b"", post=post, sleep=waits.append, **k), waits

    assert run(202) == ((True, 202, 1), [])
    assert run(200) == ((False, 200, 1), []) and run(404) == ((False, 404, 1), [])
    assert run(503, None, 429, 202) == ((True, 202, 4), [0.2, 0.4, 0.8])
    assert run((503, "1"), 202) == ((True, 202, 2), [1.0]) and run((503, "60"), 202) == ((False, 503, 1), [])
    assert run(500, 500, attempts=2) == ((False, 500, 2), [0.2])


def test_partitions_post_their_own(spark):
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            seen.append((self.path, body))
            self.send_response(202 if body != b"no" else 400)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    d = spark.createDataFrame([("a", "/v1/x", bytearray(b"1")), ("b", "v1/x", bytearray(b"no"))], "payload_id string, path string, payload binary")
    got = {r.payload_id: (r.stored, r.status) for r in sinks.deliver(d, f"http://127.0.0.1:{server.server_port}/").collect()}
    server.shutdown()
    assert got == {"a": (True, 202), "b": (False, 400)} and sorted(seen) == [("/v1/x", b"1"), ("/v1/x", b"no")]


def test_reports(spark):
    rows = spark.createDataFrame([("b|c", 2, None), ("a", 1, 0.5), ("z", 3, 1.0)], "name string, n int, share double")
    assert sinks.markdown(rows, ["n"], most=2) == "| name | n | share |\n|---|---|---|\n| a | 1 | 0.5 |\n| b\\|c | 2 | n/a |\n\n... and 1 more\n"
    totals = spark.createDataFrame([("PLAIN", 2, 40.0), ("UNREAD", 1, 20.04)], "bucket string, rows long, percent double")
    lines = spark.createDataFrame([("UNREAD", "C#z"), ("PLAIN", "C#b"), ("PLAIN", "C#a")], "bucket string, text string")
    assert sinks.never_hit_report(totals, lines, ["text"]) == "PLAIN: 2 (40.0%)\nUNREAD: 1 (20.0%)\n\n== PLAIN ==\n  C#a\n  C#b\n\n== UNREAD ==\n  C#z\n"
