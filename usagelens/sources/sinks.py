"""Sinks: payloads over HTTP with retries (S9), and reports as text or Markdown."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

#: The only status that means stored.
STORED = 202


def http_post(url: str, body: bytes, timeout: float = 30.0) -> tuple[int, str | None]:
    """(status, Retry-After) of an answer; no answer raises OSError."""
    request = urllib.request.Request(url, data=body, headers={"Content-Type": "application/x-protobuf"}, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, r.headers.get("Retry-After")
    except urllib.error.HTTPError as e:
        return e.code, e.headers.get("Retry-After")


def deliver_one(url: str, body: bytes, post: Callable = http_post, attempts: int = 5, backoff: float = 0.2, most_backoff: float = 30.0, most_wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> tuple[bool, int | None, int]:
    """(stored, last status, attempts made). Only 202 is stored; another 2xx isn't, and isn't tried again, nor is a 4xx but 408 and 429. Waits double
    from backoff on; a stated Retry-After counts instead, unless it is longer than most_wait: then delivery ends."""
    status = None
    for n in range(1, attempts + 1):
        wait = None
        try:
            status, after = post(url, body)
            if status == STORED:
                return True, status, n
            if status < 500 and status not in (408, 429):
                return False, status, n
            wait = float(after) if after and after.strip().isdigit() else None
            if wait is not None and wait > most_wait:
                return False, status, n
        except OSError:
            status = None
        if n < attempts:
            sleep(backoff if wait is None else wait)
            backoff = min(2 * backoff, most_backoff)
    return False, status, attempts


def deliver(payloads: DataFrame, endpoint: str, **options) -> DataFrame:
    """(payload_id, stored, status, attempts) of payloads (payload_id, path, payload); every partition posts its own. A task that is run again sends
    its payloads again, which the receiver's merge makes harmless."""

    def run(batches):
        for pdf in batches:
            out = [(i, *deliver_one(f"{endpoint.rstrip('/')}/{p.lstrip('/')}", bytes(b), **options)) for i, p, b in zip(pdf.payload_id, pdf.path, pdf.payload, strict=True)]
            yield pd.DataFrame(out, columns=["payload_id", "stored", "status", "attempts"]).astype({"status": "Int64"})

    return payloads.select("payload_id", "path", "payload").mapInPandas(run, "payload_id string, stored boolean, status int, attempts int")


def markdown(rows: DataFrame, order: list[str], most: int = 10_000) -> str:
    """A table in Markdown: a report's rows, at most ``most`` of them and a line that says how many more there are."""
    head = rows.columns
    got = rows.orderBy(*order).limit(most + 1).collect()
    cell = lambda v: "n/a" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(cell(v) for v in r) + " |" for r in got[:most])]
    return "\n".join([*lines, *([f"\n... and {rows.count() - most} more"] if len(got) > most else [])]) + "\n"


def never_hit_report(totals: DataFrame, rows: DataFrame, order: list[str], most: int = 10_000) -> str:
    """The totals of the buckets with their shares, then the rows (columns bucket and text), bucket by bucket."""
    lines = [f"{r.bucket}: {r.rows} ({r.percent:.1f}%)" for r in totals.orderBy("bucket").collect()]
    shown = rows.orderBy("bucket", *order).limit(most).collect()
    last = None
    for r in shown:
        if r.bucket != last:
            lines += ["", f"== {r.bucket} =="]
            last = r.bucket
        lines.append(f"  {r.text}")
    return "\n".join(lines) + "\n"
