"""HTTP clients: advisory service and report portal. Nothing is called unless an address is given."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argosec.functions.text import digest
from argosec.operators.dependencies import osv_severity, vulnerable_range

BATCH, TIMEOUT = 1000, 30
_FOUND = "ecosystem string, package string, version string, manifest string, direct boolean, id string, introduced string, fixed string, severity string, summary string, aliases array<string>"


class HttpError(RuntimeError):
    def __init__(self, status: int, url: str, body: str):
        super().__init__(f"HTTP {status} from {url}: {body[:500]}")
        self.status = status


def call(method: str, url: str, body: bytes | None = None, headers: dict | None = None, pause: float = 2.0) -> bytes:
    """One request; a status of 500 or more is tried once again after a pause."""
    for last in (False, True):
        try:
            ask = urllib.request.Request(url, data=body, method=method, headers=headers or {})
            with urllib.request.urlopen(ask, timeout=TIMEOUT) as r:
                return r.read()
        except urllib.error.HTTPError as e:
            if e.code < 500 or last:
                raise HttpError(e.code, url, e.read().decode("utf-8", "replace")) from None
            time.sleep(pause)
    raise AssertionError


def first_range(advisory: dict) -> tuple[str | None, str | None]:
    """(introduced, fixed) of the first range that says either."""
    for a in advisory.get("affected") or []:
        for r in a.get("ranges") or []:
            events = r.get("events") or []
            low = next((e["introduced"] for e in events if e.get("introduced")), None)
            high = next((e["fixed"] for e in events if e.get("fixed")), None)
            if low or high:
                return low, high
    return None, None


def _ask(base: str, pause: float):
    def run(pdfs):
        known: dict[str, dict | None] = {}
        for pdf in pdfs:
            out = []
            for at in range(0, len(pdf), BATCH):
                part = pdf.iloc[at : at + BATCH]
                body = {"queries": [{"version": x.version, "package": {"name": x.package, "ecosystem": x.ecosystem}} for x in part.itertuples()]}
                got = json.loads(call("POST", f"{base}/v1/querybatch", json.dumps(body).encode(), {"Content-Type": "application/json"}, pause))
                for x, res in zip(part.itertuples(index=False), got.get("results") or []):
                    for v in (res or {}).get("vulns") or []:
                        if v["id"] not in known:
                            try:
                                known[v["id"]] = json.loads(call("GET", f"{base}/v1/vulns/{v['id']}", pause=pause))
                            except (HttpError, OSError):
                                known[v["id"]] = None  # one advisory that can't be read is passed over
                        a = known[v["id"]]
                        if a is not None:
                            low, high = first_range(a)
                            out.append((x.ecosystem, x.package, x.version, x.manifest, x.direct, v["id"], low, high, (a.get("database_specific") or {}).get("severity"), a.get("summary"), a.get("aliases") or []))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _FOUND.split(", ")])

    return run


def vulnerable(deps: DataFrame, base_url: str, pause: float = 2.0) -> DataFrame:
    """Like dependencies.vulnerable(), with the service deciding which advisories hold; asked from the executors in batches of 1000."""
    found = deps.select("ecosystem", "package", "version", "manifest", "direct").mapInPandas(_ask(base_url.rstrip("/"), pause), _FOUND)
    g = found.groupBy("ecosystem", "package", "version", "manifest", "direct").agg(F.array_sort(F.collect_set("id")).alias("advisory_ids"), F.min(F.struct("id", "introduced", "fixed", "severity")).alias("f"))
    given = F.coalesce("f.severity", F.lit("")) != ""
    return g.select(
        "ecosystem", "package", "version", "manifest", "direct", "advisory_ids", vulnerable_range(F.col("f.introduced"), F.col("f.fixed")).alias("vulnerable_range"),
        F.col("f.fixed").alias("fixed_version"), osv_severity(F.col("f.severity")).alias("severity"), F.when(given, "high").otherwise("low").alias("confidence"),
        digest(F.col("ecosystem"), F.col("package"), F.col("f.id")).alias("fingerprint"),
    )


class Portal:
    """Report portal: register a scan, send its reports, set its status."""

    def __init__(self, server: str, token: str, pause: float = 2.0):
        self.server, self.pause = server.rstrip("/"), pause
        self.auth = {"Authorization": f"Bearer {token}"}

    def _send(self, method: str, path: str, body: bytes, kind: str = "application/json") -> bytes:
        return call(method, f"{self.server}/api/v1/scans{path}", body, self.auth | {"Content-Type": kind}, self.pause)

    def create(self, **fields) -> str:
        """Registers a scan (commit, branch, label, ...); the id that the server gives."""
        return json.loads(self._send("POST", "", json.dumps({k: v for k, v in fields.items() if v}).encode()))["scan_id"]

    def send_json(self, scan: str, report: str) -> None:
        self._send("POST", f"/{scan}/upload/json", report.encode())

    def send_html(self, scan: str, report: str) -> None:
        mark = uuid.uuid4().hex
        head = f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="report.html"\r\nContent-Type: application/octet-stream\r\n\r\n'
        self._send("POST", f"/{scan}/upload/html", head.encode() + report.encode() + f"\r\n--{mark}--\r\n".encode(), f"multipart/form-data; boundary={mark}")

    def set_status(self, scan: str, status: str, error: str = "") -> None:
        self._send("PUT", f"/{scan}/status", json.dumps({"status": status} | ({"error_message": error} if error else {})).encode())
