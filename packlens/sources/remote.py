"""Byte ranges over HTTP: objects fetched by exact ranges, everything a server may get wrong refused.

A response counts only with status 206, the very range, total and length asked for, no encoding, and a body
of that length. Server errors and timeouts are tried again, at most ``retries`` times; what is not there
(404) is "not found", anything else is "corrupt".
"""

from __future__ import annotations

import http.client
import urllib.error
import urllib.request

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship

MOST_RETRIES = 2


def fetch(url: str, start: int, size: int, total: int, retries: int = 0, timeout: float = 5.0) -> tuple[str, bytes | None, dict[str, int]]:
    """status (ok, not found, corrupt, unavailable), the bytes, and counters of one object's requests."""
    count = {"requests": 0, "errors": 0, "timeouts": 0, "bytes": 0}
    asked = urllib.request.Request(url, headers={"Range": f"bytes={start}-{start + size - 1}", "Accept-Encoding": "identity"})
    outcome = "unavailable"
    for _ in range(min(retries, MOST_RETRIES) + 1):
        count["requests"] += 1
        try:
            with urllib.request.urlopen(asked, timeout=timeout) as response:  # noqa: S310 - the caller names the server
                head = response.headers
                exact = head.get("Content-Range") == f"bytes {start}-{start + size - 1}/{total}" and head.get("Content-Length") == str(size)
                if response.status != 206 or not exact or head.get("Content-Encoding", "identity") != "identity":
                    count["errors"] += 1
                    return "corrupt", None, count
                body = response.read(size + 1)
                count["bytes"] += len(body)
                if len(body) == size:
                    return "ok", body, count
                count["errors"] += 1
                return "corrupt", None, count
        except urllib.error.HTTPError as e:
            count["errors"] += 1
            outcome = "not found" if e.code == 404 else "corrupt"
            if not 500 <= e.code < 600:
                return outcome, None, count
        except http.client.IncompleteRead as e:
            count["errors"] += 1
            count["bytes"] += len(e.partial)
            return "corrupt", None, count
        except OSError as e:
            count["errors"] += 1
            count["timeouts"] += isinstance(e, TimeoutError) or isinstance(getattr(e, "reason", None), TimeoutError)
            outcome = "unavailable"
    return outcome, None, count


def _fetch_all(retries: int, timeout: float):
    def run(batches):
        for batch in batches:
            for digest, url, start, size, total in zip(*(batch.column(c).to_pylist() for c in ("hash", "url", "start", "size", "total"))):
                status, body, count = fetch(url, start, size, total, retries, timeout)
                row = {"hash": digest, "status": status, "payload": body, **count}
                kinds = [pa.string(), pa.string(), pa.binary()] + [pa.int64()] * 4
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))

    return run


def fetch_objects(wanted: DataFrame, retries: int = 0, timeout: float = 5.0) -> DataFrame:
    """hash, status, payload and counters for wanted: hash, url, start, size, total (the resource's length)."""
    ship(wanted.sparkSession)
    return wanted.mapInArrow(_fetch_all(retries, timeout), "hash string, status string, payload binary, requests long, errors long, timeouts long, bytes long")
