import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from usagelens.sources.paged import Moved, PagedSource, read_all


def server(snapshots):
    """fetch() over a list of (as_of, items) that moves on whenever a page says so."""
    state = {"n": 0}

    def fetch(url):
        q = parse_qs(urlparse(url).query)
        limit, offset = int(q["limit"][0]), int(q["offset"][0])
        as_of, items, status = snapshots[min(state["n"], len(snapshots) - 1)]
        state["n"] += 1
        return status, {"as_of": as_of, "items": items[offset : offset + limit]}

    return fetch


ROWS = [{"k": i} for i in range(7)]


def test_pages_and_waits():
    assert list(read_all("http://x/a", server([(1, ROWS, 202), (1, ROWS, 200)]), limit=3, pause=lambda s: None)) == ROWS
    with pytest.raises(TimeoutError):
        list(read_all("http://x/a", server([(1, ROWS, 202)]), limit=3, pause=lambda s: None))


def test_short_pages_and_totals():
    def capped(url):
        offset = int(parse_qs(urlparse(url).query)["offset"][0])
        return 200, {"as_of": 1, "items": ROWS[offset : offset + 2], "total": len(ROWS)}

    assert list(read_all("http://x/a", capped)) == ROWS
    live = iter([(200, {"as_of": n, "items": [ROWS[n]], "total": 3, "from_snapshot": False}) for n in range(3)])
    assert list(read_all("http://x/a", lambda url: next(live))) == ROWS[:3]


def test_a_moved_snapshot_is_read_again():
    other = [{"k": i + 100} for i in range(4)]
    assert list(read_all("http://x/a?b=1", server([(1, ROWS, 200), (2, other, 200), (2, other, 200), (2, other, 200)]), limit=3)) == other
    with pytest.raises(Moved):
        list(read_all("http://x/a", server([(n, ROWS, 200) for n in range(99)]), limit=3))


def test_data_source(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            limit, offset = int(q["limit"][0]), int(q["offset"][0])
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"as_of": 1, "items": ROWS[offset : offset + limit]}).encode())

        def log_message(self, *a):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    spark.dataSource.register(PagedSource)
    try:
        url = f"http://127.0.0.1:{http.server_port}/items"
        df = spark.read.format("paged").schema("k long, missing string").option("url", url).option("limit", 3).load()
        assert sorted((r.k, r.missing) for r in df.collect()) == [(i, None) for i in range(7)]
    finally:
        http.shutdown()
