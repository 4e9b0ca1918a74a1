"""Providers: paged notice search, award exports built on request, and large files; over any transport.

A transport is called with (method, url, params or body) and returns a ``Response``; tests and archives bring their
own. Every request goes through a ``Caller``, which waits, repeats and stops by one policy. Notice pages are a streaming
source: its offset is the next page of a plan.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, date, datetime
from pathlib import Path
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from bidweave.functions.normalize import api_date
from bidweave.session import ship

#: Places and limits of the providers.
SEARCH_URL = "https://api.sam.gov/opportunities/v2/search"
DAILY_EXTRACT_URL = "https://s3.amazonaws.com/falextracts/Contract%20Opportunities/datagov/ContractOpportunitiesFullCSV.csv"
ARCHIVE_EXTRACT_URL = "https://s3.amazonaws.com/falextracts/Contract%20Opportunities/Archived%20Data/FY{}_archived_opportunities.csv"
EXPORT_BASE = "https://api.usaspending.gov"
EXPORT_START, EXPORT_STATUS = "/api/v2/download/awards/", "/api/v2/download/status"
PAGE_ROWS = 1000
EXPORT_ROWS = 500_000
SEARCHES_A_DAY = 10
RETRY_STATUSES = (429, 500, 502, 503, 504)


class ProviderError(RuntimeError):
    """The provider's answer is no use."""


class SpentError(RuntimeError):
    """The provider takes no more requests today."""


@dataclass(frozen=True)
class Response:
    status: int
    body: Iterable[bytes]
    headers: Mapping[str, str]

    def content(self) -> bytes:
        return b"".join(self.body)


Transport = Callable[[str, str, Mapping[str, object]], Response]


def over_http(method: str, url: str, values: Mapping[str, object]) -> Response:
    """The standard library's client: parameters for GET, a JSON body for POST."""
    data = json.dumps(values).encode() if method == "POST" else None
    place = url if data or not values else f"{url}?{urllib.parse.urlencode(values)}"
    request = urllib.request.Request(place, data=data, method=method, headers={"Content-Type": "application/json"} if data else {})  # noqa: S310
    try:
        answer = urllib.request.urlopen(request, timeout=300)  # noqa: S310
    except urllib.error.HTTPError as e:
        return Response(e.code, [e.read()], dict(e.headers))
    return Response(answer.status, iter(lambda: answer.read(1 << 20), b""), dict(answer.headers))


@dataclass
class Caller:
    """Requests under one policy.

    A request is repeated after network faults and ``RETRY_STATUSES``, with pauses that double (or are what the answer's
    Retry-After says), up to ``attempts`` times; two requests start ``interval`` seconds apart at least. ``spent`` are
    statuses that end the day, ``limit`` how many requests may still be made: past either, ``SpentError``. Other answers
    of 400 and more but ``allowed`` ones are a ``ProviderError``.
    """

    transport: Transport
    attempts: int = 5
    pause: float = 1.0
    longest: float = 60.0
    interval: float = 0.0
    spent: tuple[int, ...] = ()
    allowed: tuple[int, ...] = ()
    limit: int | None = None
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    made: int = 0
    _last: float | None = field(default=None, repr=False)

    def __call__(self, method: str, url: str, values: Mapping[str, object], use: Callable[[Response], object] = Response.content):
        """``use`` of the answer, a part of the attempt; by default its bytes. The status comes first."""
        fault = ""
        for attempt in range(self.attempts):
            if attempt:
                self.sleep(min(self.longest, hint if hint is not None else self.pause * 2 ** (attempt - 1)))
            if self.limit is not None and self.made >= self.limit:
                raise SpentError(f"{self.made} requests made, and no more are allowed today")
            wait = 0.0 if self._last is None else self.interval - (self.clock() - self._last)
            if wait > 0:
                self.sleep(wait)
            self._last, hint = self.clock(), None
            self.made += 1
            try:
                answer = self.transport(method, url, values)
                if answer.status in self.spent:
                    raise SpentError(f"{_place(url)} answered {answer.status}")
                if answer.status < 400 or answer.status in self.allowed:
                    return answer.status, use(answer)
                fault = f"answered {answer.status}"
                if answer.status not in RETRY_STATUSES:
                    break
                after = {k.lower(): v for k, v in answer.headers.items()}.get("retry-after", "")
                hint = float(after) if after.isdigit() else None
            except OSError as e:
                fault = f"{type(e).__name__}: {e}"
        raise ProviderError(f"{_place(url)}: {fault}")


def _place(url: str) -> str:
    return url.partition("?")[0]


# --- notice search ------------------------------------------------------------------------------------------


def search(caller: Caller, key: str, start: date, end: date, page: int, code: str | None = None, limit: int = PAGE_ROWS) -> bytes:
    """One page of notices as JSON; no data (404) is an empty page. The caller should treat 404 as allowed."""
    values = {"postedFrom": api_date(start), "postedTo": api_date(end), "limit": str(limit), "offset": str(page)}
    if code:
        values["ncode"] = code
    status, body = caller("GET", SEARCH_URL, {**values, "api_key": key})
    return b'{"totalRecords": 0, "opportunitiesData": []}' if status == 404 else body


Fetch = Callable[[date, date, int, str | None], bytes]


def searcher(transport: Transport, key: str, **policy) -> Fetch:
    """A page by (start, end, page, code); too many requests (429) end the day."""

    def fetch(start: date, end: date, page: int, code: str | None) -> bytes:
        return search(Caller(transport, spent=(429,), allowed=(404,), interval=1.0, **policy), key, start, end, page, code)

    return fetch


def chunk_key(start: date, end: date, code: str | None) -> str:
    """Names the pages of one span and code, in plans and in the archive."""
    return f"posted:{start}:{end}:naics:{code or 'all'}"


def page_file(folder: str, key: str, page: int) -> Path:
    return Path(folder) / key.replace(":", "_") / f"{page:06}.json"


def n_records(page: bytes | str) -> int:
    return int(json.loads(page).get("totalRecords") or 0)


@dataclass
class PageOf(InputPartition):
    chunk: int
    page: int


PAGE_DDL = "chunk_key string, page_number int, page string, file string, sha256 string, bytes long, fetched_at timestamp, fetched boolean, total long"


@dataclass
class PagePlan:
    """Pages of some spans and codes, in order, and the archive folder that keeps each page once it was fetched."""

    chunks: list[tuple[date, date, str | None]]
    folder: str
    fetch: Fetch
    page_rows: int = PAGE_ROWS

    def key(self, chunk: int) -> str:
        return chunk_key(*self.chunks[chunk])

    def page(self, chunk: int, page: int) -> tuple[bytes, str, bool]:
        """A page, its file, and whether it was fetched now; a page that the archive has is not asked for again."""
        place = page_file(self.folder, self.key(chunk), page)
        if place.exists():
            return place.read_bytes(), str(place), False
        start, end, code = self.chunks[chunk]
        body = self.fetch(start, end, page, code)
        place.parent.mkdir(parents=True, exist_ok=True)
        part = place.with_name(f"{place.name}.{uuid.uuid4().hex}.part")
        part.write_bytes(body)
        os.replace(part, place)
        return body, str(place), True

    def n_pages(self, chunk: int) -> int:
        """How many pages a chunk has, by its first one; an empty chunk has one."""
        return max(1, -(-n_records(self.page(chunk, 0)[0]) // self.page_rows))

    def between(self, start: Mapping[str, int], end: Mapping[str, int]) -> list[PageOf]:
        """Pages from one offset to the next; offsets are {chunk, page}, in the order of the plan."""
        out = []
        for chunk in range(start["chunk"], min(end["chunk"] + 1, len(self.chunks))):
            first = start["page"] if chunk == start["chunk"] else 0
            last = end["page"] if chunk == end["chunk"] else self.n_pages(chunk)
            out += [PageOf(chunk, p) for p in range(first, last)]
        return out


class _PageStream(DataSourceStreamReader):
    """Advances by some pages of a chunk at a time, from where it began or was last, as long as pages are allowed."""

    def __init__(self, plan: PagePlan, start: dict, at_once: int, allowed: int) -> None:
        self.plan, self.at, self.at_once, self.allowed = plan, dict(start), at_once, allowed

    def initialOffset(self) -> dict:
        return {"chunk": 0, "page": 0}

    def latestOffset(self) -> dict:
        chunk, page = self.at["chunk"], self.at["page"]
        if chunk < len(self.plan.chunks) and self.allowed > 0:
            pages = self.plan.n_pages(chunk)
            upto = min(pages, page + min(self.at_once, self.allowed))
            self.allowed -= upto - page
            self.at = {"chunk": chunk + 1, "page": 0} if upto >= pages else {"chunk": chunk, "page": upto}
        return dict(self.at)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        # After a restart the batch that was under way comes first; go on behind it.
        self.at = max(self.at, end, key=lambda o: (o["chunk"], o["page"]))
        return self.plan.between(start, end)

    def read(self, partition: PageOf) -> Iterator[tuple]:
        yield _page_row(self.plan, partition)


def _page_row(plan: PagePlan, part: PageOf) -> tuple:
    body, place, fetched = plan.page(part.chunk, part.page)
    return plan.key(part.chunk), part.page, body.decode(), place, hashlib.sha256(body).hexdigest(), len(body), datetime.now(UTC), fetched, n_records(body)


def page_stream(spark: SparkSession, plan: PagePlan, start: Mapping[str, int], at_once: int = 4, allowed: int = 1 << 30) -> DataFrame:
    """The pages of a plan as a stream, each one row and one task.

    ``start`` is the offset that the query's checkpoint has reached (the beginning for a new one); Spark keeps the
    offsets, so a query that was killed goes on with the batch that was under way, whose pages the archive has.
    At most ``at_once`` pages of one chunk are a batch, and ``allowed`` pages are taken in all.
    """
    ship(spark)

    class NoticePages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "notice_pages"

        def schema(self) -> str:
            return PAGE_DDL

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _PageStream(plan, dict(start), at_once, allowed)

    spark.dataSource.register(NoticePages)
    return spark.readStream.format("notice_pages").load()


class _ArchivedReader(DataSourceReader):
    def __init__(self, folder: str, keys: list[str]) -> None:
        self.folder, self.keys = folder, keys

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in self.keys]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        # Pages are numbered without gaps; the first that isn't there ends the chunk, as an empty page would.
        page = 0
        while os.path.exists(place := page_file(self.folder, partition.value, page)):
            yield partition.value, page, place.read_text(encoding="utf-8"), str(place)
            page += 1


class ArchivedPages(DataSource):
    """Archived search pages: options ``path`` and ``chunks`` (a JSON list of chunk keys); (chunk_key, page_number, page, file)."""

    @classmethod
    def name(cls) -> str:
        return "archived_pages"

    def schema(self) -> str:
        return "chunk_key string, page_number int, page string, file string"

    def reader(self, schema) -> DataSourceReader:
        return _ArchivedReader(self.options["path"], json.loads(self.options["chunks"]))


def archived_pages(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """Pages of an archive folder that executors see, one partition a chunk; ``notices.page_records`` takes them."""
    ship(spark)
    spark.dataSource.register(ArchivedPages)
    return spark.read.format("archived_pages").option("path", folder).option("chunks", json.dumps(list(keys))).load()


# --- exports and files --------------------------------------------------------------------------------------


def export_filters(start: date, end: date, codes: Sequence[str], date_type: str) -> dict:
    """The filters of an export: contracts and vehicles of some codes, by a kind of date."""
    types = ["A", "B", "C", "D", "IDV_A", "IDV_B", "IDV_B_A", "IDV_B_B", "IDV_B_C", "IDV_C", "IDV_D", "IDV_E"]  # fixed values
    span = {"start_date": start.isoformat(), "end_date": end.isoformat(), "date_type": date_type}
    return {"award_type_codes": types, "naics_codes": {"require": list(codes)}, "time_period": [span]}


def ask_export(caller: Caller, filters: Mapping[str, object]) -> str:
    """Ask for an export; the name of the file that is going to be built."""
    _, body = caller("POST", urljoin(EXPORT_BASE, EXPORT_START), {"filters": dict(filters), "file_format": "csv"})
    made = _object(body)
    if not made.get("file_name"):
        raise ProviderError("the export gave no file name")
    return str(made["file_name"])


def _object(body: bytes) -> dict:
    found = json.loads(body or b"null")
    return found if isinstance(found, dict) else {}


def built_export(caller: Caller, name: str, patience: float = 3600.0) -> dict:
    """A file's status when it is built, asked for after 5 seconds and then ever more rarely; a ProviderError if it can't be had."""
    pauses = [min(60.0, 5.0 * 1.5**k) for k in range(12)]
    waited = 0.0
    while True:
        _, body = caller("GET", urljoin(EXPORT_BASE, EXPORT_STATUS), {"file_name": name})
        status = _object(body)
        if status.get("status") == "finished":
            return status
        if status.get("status") == "failed":
            raise ProviderError(f"{name} could not be built: {status.get('message')}")
        if waited >= patience:
            raise ProviderError(f"{name} was not ready after {waited:.0f} seconds")
        pause = pauses.pop(0) if pauses else 60.0
        caller.sleep(pause)
        waited += pause


def download(caller: Caller, url: str, target: str) -> dict[str, str]:
    """Stream a file to ``target``; a transfer that breaks is begun anew. The answer's status and headers."""

    def save(answer: Response) -> dict[str, str]:
        with open(target, "wb") as out:
            for block in answer.body:
                out.write(block)
        return dict(answer.headers)

    status, headers = caller("GET", url, {}, save)
    return {"http_status": str(status), **{k.lower(): v for k, v in headers.items()}}


def export_url(status: Mapping[str, object]) -> str:
    return urljoin(EXPORT_BASE, str(status.get("file_url") or ""))
