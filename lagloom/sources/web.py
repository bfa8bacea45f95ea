"""Web archives: index pages and record ranges, over an injected fetcher.

``fetch(url, headers)`` gives (status, body); any client will do, and tests give files. Domains are dealt over tasks.
"""

from __future__ import annotations

import gzip
import json
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlencode

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Fetch = Callable[[str, dict[str, str]], tuple[int, bytes]]

INDEX = "domain string, timestamp string, url string, filename string, offset bigint, length bigint, status string"
PAGES = "domain string, timestamp string, url string, html string"
BUSY = (429, 503, 504)
#: Characters of pages that a task hands over at once (one page may be longer).
PIECE = 4 << 20


def tried(fetch: Fetch, url: str, headers: dict[str, str], attempts: int = 3, wait: float = 30, sleep: Callable[[float], None] = time.sleep) -> bytes | None:
    """The body of a page; null if it is not there. A busy server and a failing line are asked again, each time later.

    When the last attempt fails too, that is an error: an empty answer would be taken for the end of the index.
    """
    problem = ""
    for k in range(attempts):
        try:
            status, body = fetch(url, headers)
        except OSError as e:
            problem = str(e)
        else:
            if status in (200, 206):
                return body
            if status not in BUSY:
                return None
            problem = f"status {status}"
        if k + 1 < attempts:
            sleep(wait * (k + 1))
    raise OSError(f"{url}: {problem} after {attempts} attempts")


def index_pages(spark: SparkSession, domains: list[str], fetch: Fetch, api: str, since: str, until: str, limit: int = 1000, wait: float = 30) -> DataFrame:
    """The index records of each domain, page after page until one is short; lines that are no JSON object drop."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in INDEX.split(", ")]
        for batch in batches:
            for domain in batch["domain"]:
                offset, more = 0, True
                while more:
                    asked = {"url": f"*.{domain}/*", "output": "json", "from": since, "to": until, "fl": ",".join(names[1:]), "filter": "status:200", "limit": limit, "offset": offset}
                    body = tried(fetch, f"{api}?{urlencode(asked)}", {}, wait=wait)
                    lines = (body or b"").decode("utf-8", "replace").splitlines()
                    rows = [r for r in map(_record, filter(str.strip, lines)) if r]
                    if rows:
                        yield pd.DataFrame([[domain, *[r.get(n) for n in names[1:4]], int(r["offset"]), int(r["length"]), str(r.get("status"))] for r in rows], columns=names)
                    more = len(lines) >= limit
                    offset += limit

    asked = spark.createDataFrame([(d,) for d in domains], "domain string").repartition(max(1, len(domains)))
    return asked.mapInPandas(read, INDEX)


def _record(line: str) -> dict | None:
    try:
        r = json.loads(line)
        return r if isinstance(r, dict) and int(r["offset"]) >= 0 and int(r["length"]) > 0 else None
    except (ValueError, KeyError, TypeError):
        return None


def response_body(record: bytes) -> str | None:
    """The page in an archive record (plain or gzipped): behind the record's own header and that of the response."""
    try:
        record = gzip.decompress(record)
    except OSError:
        pass
    head, _, rest = record.partition(b"\r\n\r\n")
    if b"WARC-Type: response" not in head.replace(b"warc-type", b"WARC-Type"):
        return None
    return rest.partition(b"\r\n\r\n")[2].decode("utf-8", "ignore").strip()


def records(index: DataFrame, fetch: Fetch, root: str, wait: float = 30) -> DataFrame:
    """The pages of index records, each by one range request; records that are gone or no responses drop.

    Equal ranges are read once, and pages handed over ``PIECE`` characters at a time: a batch of index lines may stand for far more
    than a task's memory. Their number, not that of domains, tells the tasks, so one large domain is spread.
    """

    names = ["domain", "timestamp", "url", "html"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for r in batch.itertuples(index=False):
                body = tried(fetch, f"{root}/{r.filename}", {"Range": f"bytes={r.offset}-{r.offset + r.length - 1}"}, wait=wait)
                page = response_body(body) if body else None
                if page is None:
                    continue
                if rows and held + len(page) > PIECE:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
                rows.append((r.domain, r.timestamp, r.url, page))
                held += len(page)
            yield pd.DataFrame(rows, columns=names)

    once = index.groupBy("filename", "offset", "length").agg(F.min(F.struct("domain", "timestamp", "url")).alias("r"))
    return once.select("r.*", "filename", "offset", "length").mapInPandas(read, PAGES)
