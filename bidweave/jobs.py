"""Ingest jobs. What a job takes in, and what it notes about it, becomes visible in one commit.

Plans are tables of requests. Requests of a round are asked for, awaited and fetched in tasks, side by side; notice pages
are a stream whose offsets are the place to go on from. State changes in ``commit`` calls only, and only while
the run holds its lease.
"""

from __future__ import annotations

import csv
import gzip
import io
import json
import os
import tempfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from functools import partial
from pathlib import Path

import pyarrow as pa
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidweave import schemas
from bidweave.config import MatchingConfig
from bidweave.control import BudgetExhaustedError, Run, latest_plan
from bidweave.functions import normalize as N
from bidweave.operators import versions
from bidweave.operators.merge import merge_reference
from bidweave.operators.rows import cut
from bidweave.plans import history, incremental, match, reports, requests
from bidweave.session import ship
from bidweave.sources import awards, files, notices, remote
from bidweave.store import Store, Transaction

#: Days that deltas go back, and the longest span of one query.
NOTICE_OVERLAP, AWARD_OVERLAP, SPAN_DAYS = 2, 3, 365
NOTICES, AWARDS = "sam", "usaspending"


# --- loading ------------------------------------------------------------------------------------------------


def stage_notices(t: Transaction, incoming: DataFrame, authoritative: Sequence[str] | None = None) -> dict[str, int]:
    """In a transaction, merge typed notices (with ``description`` and ``seq``) into the stored ones; steps by outcome.

    Only buckets of the incoming notices are read, and only those of changed ones written; a batch that changes nothing
    writes nothing.
    """
    return stage_snapshots(t, cut(versions.incoming_snapshots(incoming)), authoritative)


def stage_snapshots(t: Transaction, batch: DataFrame, authoritative: Sequence[str] | None = None) -> dict[str, int]:
    """``stage_notices`` for snapshots (notice_id, seq, text, snapshot), which are read several times."""
    steps = cut(versions.fold(t.near("notices", batch.select("notice_id")), batch, authoritative).steps)
    counts = {r["outcome"]: r["count"] for r in versions.Folded(steps).counts().collect()}
    if set(counts) <= {"unchanged"}:
        return counts
    written = versions.Folded(steps.join(steps.where("outcome <> 'unchanged'").select("notice_id").distinct(), "notice_id", "left_semi"))
    after, made, texts = written.current(), written.versions(), written.descriptions()
    for name, new, on in (("notice_versions", made, ["notice_id", "version"]), ("notice_descriptions", texts, ["notice_id", "version"]), ("notices", after, ["notice_id"])):
        new = cut(new)
        t.merge(name, new.select("notice_id"), lambda old, new=new, on=on: old.join(new, on, "left_anti").unionByName(new.select(*old.columns)))
    return counts


def fold_notices(store: Store, incoming: DataFrame, authoritative: Sequence[str] | None = None) -> dict[str, int]:
    """``stage_notices`` in a transaction of its own."""
    t = store.begin()
    counts = stage_notices(t, incoming, authoritative)
    t.commit()
    return counts


def stage_awards(t: Transaction, raw: DataFrame, vertical: tuple[str, ...]) -> tuple[int, int]:
    """In a transaction, merge award rows into all tables; rows read and awards written."""
    raw = cut(raw)
    for name, keys, flags in (("agencies", ["level", "code"], ()), ("offices", ["subtier_code", "office_code"], ()), ("naics", ["code"], ("in_vertical",))):
        seen = cut(awards.reference_tables(raw, vertical)[name])
        t.update(name, lambda stored, seen=seen, keys=keys, flags=flags: merge_reference(stored, seen, keys, flags))
    counts = {}
    for name, typed, upsert, key in (("entities", awards.entities, awards.upsert_entities, "uei"), ("awards", awards.typed_awards, awards.upsert_awards, "award_key")):
        keys = typed(raw).select(key)
        written = cut(upsert(t.near(name, keys), raw).written())
        counts[name] = written.count()
        if counts[name]:
            t.merge(name, written.select(key), lambda old, new=written, key=key: old.join(new.select(key), key, "left_anti").unionByName(new))
    return raw.count(), counts["awards"]


def award_rows(run: Run, paths: Sequence[str]) -> DataFrame | None:
    """The rows of award files and of all award members of zips; None if there are none. What was passed over is logged."""
    raw, missing, others = awards.read_award_files(run.store.spark, paths)
    for name in others:
        run.log(f"passed over: {name} is no award file")
    for name, columns in missing.items():
        run.log(f"{name} lacks the columns {', '.join(columns)}")
    return raw


def load_award_paths(run: Run, paths: Sequence[str], vertical: tuple[str, ...], t: Transaction | None = None) -> tuple[int, int]:
    """Award files and zips of them, merged at once; in the given transaction, which is then to be committed, or one of its own."""
    raw = award_rows(run, paths)
    if raw is None:
        return 0, 0
    own = t or run.begin()
    rows, written = stage_awards(own, raw, vertical)
    if t is None:
        own.commit()
    run.rows_in += rows
    run.rows_written += written
    return rows, written


def run_match(store: Store, cfg: MatchingConfig, vertical: tuple[str, ...], today: date, run: Run | None = None) -> dict[str, int]:
    """History links, then matches, in one commit; returns the run's counters."""
    t = run.begin() if run else store.begin()
    n = cut(notices.stored_columns(t.read("notices").select("notice_id", "snapshot.*")))
    a, d, before = t.read("awards"), t.read("notice_descriptions"), t.read("matches")
    links = cut(history.link_rows(history.find_links(n, a, vertical), a, cfg.matcher_version, before))
    table, linked = history.save_links(before, links)
    previous = cut(table)
    counts = {f"links_{k}": v for k, v in linked.first().asDict().items()}
    facts = cut(match.notice_facts(n, d, cfg, vertical, today))
    rows = cut(match.match(n, a, d, previous, cfg, vertical, today, incremental.word_counts(t, vertical)))
    table, saved = match.save(previous, facts, rows)
    counts |= reports.run_summary(facts, rows).first().asDict() | saved.first().asDict()
    t.write("matches", table)
    t.commit()
    if run is not None:
        run.rows_in += counts["notices"]
        run.rows_written += counts["written"] + counts["links_written"]
    return counts


# --- notices by pages ---------------------------------------------------------------------------------------


def day_allowance(run: Run, limit: int) -> int:
    """Requests that the source may still be sent today, by what its runs have recorded since midnight UTC."""
    used = reports.requests_today(run.store.read("runs"), run.source, run.now()).first()["requests"]
    return max(0, limit - used - run.requests)


@dataclass
class NoticeJob:
    """Pages of the notice search: ``fetch`` (start, end, page, code) gives a page as JSON; tasks call it."""

    run: Run
    fetch: remote.Fetch
    vertical: tuple[str, ...]
    limit: int = remote.SEARCHES_A_DAY
    at_once: int = 4
    page_rows: int | None = None

    def chunks(self, start: date, end: date) -> list[tuple[date, date, str]]:
        """A plan: each span of at most a year, for each code."""
        if start > end:
            raise ValueError(f"{start} is after {end}")
        return [(a, b, code) for a, b in N.windows(start, end, SPAN_DAYS) for code in sorted(self.vertical)]

    def backfill(self, today: date, since: date | None = None) -> None:
        """The latest plan, if part of it is left to do; else a new one, from ``since`` on or, with none before, over a year."""
        latest = latest_plan(self.run.store.read("runs"), NOTICES, self.run.job, "posted_from", "posted_to", self.run.id)
        open_ = latest if latest and since in (None, latest[0]) and self.left(latest) else None
        span = open_ or (None if latest and since is None else (since or today - timedelta(days=SPAN_DAYS - 1), today))
        if span:
            self.take(span, self.chunks(*span))

    def left(self, span: tuple[date, date]) -> bool:
        keys = [remote.chunk_key(*c) for c in self.chunks(*span)]
        done, total = reports.plan_progress(self.run.store.read("chunks"), NOTICES, keys).first()
        self.run.log(f"plan {span[0]} to {span[1]}: {done} of {total} chunks done")
        return done < total

    def delta(self, today: date) -> None:
        """What was posted since the last day reached, less an overlap, for all codes in one query."""
        through = reports.watermark(self.run.store.read("runs"), NOTICES, "posted_to").first()["through"]
        span = (reports.watermark_start(through, today, NOTICE_OVERLAP, SPAN_DAYS), today)
        self.take(span, [(*span, None)])

    def take(self, span: tuple[date, date], chunks: list[tuple[date, date, str | None]]) -> None:
        """Stream a plan's pages into the tables; the plan's checkpoint folder says where it goes on."""
        run = self.run
        run.note(posted_from=span[0], posted_to=span[1])
        name = f"{run.job}-{span[0]}-{span[1]}-{len(chunks)}"
        if chunks[0][2] is None:  # a delta of the same days asks anew
            name += f"-{run.id}"
        checkpoint = f"{run.store.root}/streams/{name}"
        plan = remote.PagePlan(chunks, f"{run.archive}/pages/{name}", self.fetch, self.page_rows or remote.PAGE_ROWS)
        ahead = json.loads(run.store.tags().get(f"at {name}", '{"chunk": 0, "page": 0}'))
        allowed = day_allowance(run, self.limit)
        pages = remote.page_stream(run.store.spark, plan, ahead, self.at_once, allowed)
        query = pages.writeStream.foreachBatch(partial(self.batch, name, plan)).option("checkpointLocation", checkpoint).start()
        try:
            query.processAllAvailable()
        except StreamingQueryException as e:
            if "SpentError" in str(e):
                raise BudgetExhaustedError("the notice search takes no more requests today") from e
            raise
        finally:
            query.stop()
        reached = json.loads(run.store.tags().get(f"at {name}", "{}")).get("chunk", 0)
        if reached < len(chunks):
            raise BudgetExhaustedError(f"{reached} of {len(chunks)} chunks done; {self.limit} requests a day are allowed")

    def batch(self, name: str, plan: remote.PagePlan, pages: DataFrame, batch_id: int) -> None:
        """Fold a batch of pages, and note chunks, files and the place to go on from, in one commit; once."""
        run = self.run
        t = run.begin()
        if int(t.entry["tags"].get(f"batch {name}", -1)) >= batch_id:
            return
        pages = cut(pages)
        found = pages.drop("page").orderBy("chunk_key", "page_number").collect()  # a batch has a few pages
        if not found:
            return
        records = cut(notices.page_records(pages))
        unknown = sorted(r["field"] for r in notices.unknown_fields(records).collect())
        if unknown:
            run.log(f"fields that nothing reads: {', '.join(unknown)}")
        typed = notices.parse_notices(records)
        counts = stage_notices(t, typed.where(N.in_vertical("naics", "naics_codes", self.vertical)).withColumn("description", F.lit(None).cast("string")))
        rows = {r["file"]: r["n"] for r in typed.groupBy(F.col("seq.file").alias("file")).agg(F.countDistinct("notice_id").alias("n")).collect()}
        number = {plan.key(i): i for i in range(len(plan.chunks))}
        last = max((number[r["chunk_key"]], r["page_number"], r["total"]) for r in found)
        chunks: dict[str, tuple] = {}
        for r in found:
            done = (r["page_number"] + 1) * plan.page_rows >= r["total"]
            taken = chunks.get(r["chunk_key"], ("", {}, 0, 0))[2] + rows.get(r["file"], 0)
            chunks[r["chunk_key"]] = ("done" if done else "in_progress", {"next_page": r["page_number"] + 1, "total_records": r["total"]}, taken, 0)
        run.put_chunks(t, chunks)
        keep = [r for r in found if r["fetched"] or r["page_number"] == 0]
        if keep:
            made = [{"path": os.path.relpath(r["file"], run.archive), "source": run.source, "sha256": r["sha256"], "bytes": r["bytes"], "fetched_at": r["fetched_at"],
                     "request_params": {"chunk": r["chunk_key"], "page": str(r["page_number"])}, "run_id": run.id} for r in keep]
            run.put_files(t, made)
        at = {"chunk": last[0] + 1, "page": 0} if chunks[plan.key(last[0])][0] == "done" else {"chunk": last[0], "page": last[1] + 1}
        t.commit({f"batch {name}": str(batch_id), f"at {name}": json.dumps(at)})
        # First pages were fetched when the batch was planned.
        run.requests += len(keep)
        run.rows_in += sum(rows.values())
        run.rows_written += sum(v for k, v in counts.items() if k != "unchanged")


def load_page_folder(run: Run, folder: str, vertical: tuple[str, ...]) -> dict[str, int]:
    """Merge archived pages of the notice search, a file each, in the order of their names."""
    records = notices.page_records(notices.read_pages(run.store.spark, folder))
    rows = notices.parse_notices(records).where(N.in_vertical("naics", "naics_codes", vertical))
    t = run.begin()
    counts = stage_notices(t, rows.withColumn("description", F.lit(None).cast("string")))
    t.commit()
    run.rows_in += sum(counts.values())
    run.rows_written += sum(v for k, v in counts.items() if k != "unchanged")
    return counts


# --- notices by extract -------------------------------------------------------------------------------------


def quoted_parts(kept: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(part, content): each partition's rows as gzipped CSV, every field quoted, CRLF ends; parts stand in the rows' order."""
    from pyspark import TaskContext

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, n = io.BytesIO(), 0
        with gzip.GzipFile(fileobj=packed, mode="wb", mtime=0) as out, io.TextIOWrapper(out, encoding="utf-8", newline="") as text:
            writer = csv.writer(text, quoting=csv.QUOTE_ALL, lineterminator="\r\n")
            for batch in batches:
                n += batch.num_rows
                writer.writerows(["" if v is None else v for v in row] for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        if n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], type=pa.int32()), "content": pa.array([packed.getvalue()], type=pa.binary())})

    # Names with dots don't pass mapInArrow.
    return kept.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns))).mapInArrow(pack, "part int, content binary")


def load_extract(run: Run, path: str, url: str, vertical: tuple[str, ...], since: date | None = None, force: bool = False, headers: Mapping[str, str] | None = None) -> dict[str, int] | None:
    """Merge an extract (a file that came from ``url``, with the answer's headers); None if a succeeded run has loaded the same bytes.

    The rows kept are archived as they were, gzipped, with the whole file's hash, size and provenance; tasks pack them,
    and the driver strings the packed parts together.
    """
    digest, size = files.hash_file(path)
    run.note(url=url, since=since)
    if not force and files.already_loaded(run.store.read("raw_files"), run.store.read("runs"), run.source, url, digest):
        run.log(f"{url}: this file ({digest[:12]}) is loaded")
        return None
    raw = notices.read_extract(run.store.spark, path)
    new = notices.check_header(raw.columns)
    if new:
        run.log(f"columns that nothing reads: {', '.join(new)}")
    columns = raw.columns
    numbered = raw.select(*(F.col(f"`{c}`") for c in columns), F.monotonically_increasing_id().alias("_at"))
    in_file = raw.count()
    kept = cut(notices.extract_in_scope(numbered, vertical, since))
    n_kept = kept.count()
    ship(run.store.spark)
    work = run.archive / ".work"
    work.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile(dir=work, suffix=".csv.gz", delete=False) as out:
        out.write(files.gzip_bytes(files.quoted_csv(columns, [])))
        for r in quoted_parts(kept, columns).orderBy("part").toLocalIterator():
            out.write(r["content"])
    came = {k: v for k, v in (headers or {}).items() if k in ("etag", "last-modified", "http_status")}
    run.keep_file(out.name, ".vertical.csv.gz", {"url": url, "file_sha256": digest, "file_bytes": size, "rows_in_file": in_file, "rows_kept": n_kept, "since": since or "", **came})
    t = run.begin()
    counts = stage_notices(t, notices.parse_extract(kept, "_at").withColumnRenamed("_at", "seq"), versions.CSV_AUTHORITATIVE)
    t.commit()
    run.rows_in += n_kept
    run.rows_written += sum(v for k, v in counts.items() if k != "unchanged")
    return counts


# --- awards by export ---------------------------------------------------------------------------------------


def _each(rows: DataFrame, work: Callable[[dict], dict], ddl: str) -> DataFrame:
    """``work`` on each row, a task each, done once; a provider's refusal becomes the row's ``fault``."""

    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    out.append({"fault": None, **work(row), "key": row["key"]})
                except remote.ProviderError as e:
                    out.append({"key": row["key"], "fault": str(e)})
            yield pa.RecordBatch.from_pylist(out, schema)

    n = max(1, rows.count())
    return cut(rows.repartitionByRange(n, "key").mapInArrow(run, ddl))


@dataclass
class AwardJob:
    """Award exports: rounds of requests, each asked for, awaited, and then loaded or cut in parts, all at once.

    ``transport`` is called in tasks. A file that was asked for is noted before it is awaited, so a run that dies is
    followed by one that waits for the same files.
    """

    run: Run
    transport: remote.Transport
    vertical: tuple[str, ...]
    policy: Mapping[str, object] | None = None
    patience: float = 3600.0

    def backfill(self, today: date, years: int) -> None:
        start = N.years_ago(today, years)
        self.run.note(since=start, through=today)
        self.take(requests.fiscal_plan(self.run.store.spark, start, today, self.vertical, "action_date"), resume=True)

    def delta(self, today: date) -> None:
        """What changed since the last day reached, less an overlap."""
        through = reports.watermark(self.run.store.read("runs"), AWARDS, "through").first()["through"]
        start = reports.watermark_start(through, today, AWARD_OVERLAP)
        self.run.note(since=start, through=today)
        self.take(requests.plan(self.run.store.spark, [(start, today)], self.vertical, "last_modified_date"), resume=False)

    def caller(self) -> remote.Caller:
        return remote.Caller(self.transport, **(self.policy or {}))

    def take(self, plan: DataFrame, resume: bool) -> None:
        """Rounds until no request is left: those of a year, then of its codes, then of their quarters."""
        run, spark = self.run, self.run.store.spark
        t = run.begin()
        t.update("naics", lambda stored: awards.seed_vertical_naics(stored, self.vertical))
        t.commit()
        ship(spark)
        pending = cut(plan)
        while not pending.isEmpty():
            known = run.chunks() if resume else {}
            notes = spark.createDataFrame([(k, s, bool(v.get("split")), v.get("file_name")) for k, (s, v) in known.items()], "key string, status string, cut boolean, file_name string")
            here = cut(pending.join(notes, "key", "left"))
            built = self.await_files(here.where(F.coalesce(F.col("status") != "done", F.lit(True))), resume)
            big = built.where(F.col("total") >= remote.EXPORT_ROWS)
            over = cut(pending.join(big.select("key").unionByName(here.where("status = 'done' AND cut").select("key")), "key", "left_semi"))
            stuck = [r["key"] for r in over.where(~requests.splittable()).select("key").collect()]
            if stuck:
                raise ValueError(f"{', '.join(stuck)}: a quarter of one code exceeds the limit of {remote.EXPORT_ROWS} rows")
            self.load(built.where(F.col("total") < remote.EXPORT_ROWS), [r["key"] for r in big.select("key").collect()], resume)
            pending = cut(requests.split(over))

    def await_files(self, wanted: DataFrame, resume: bool) -> DataFrame:
        """(key, file_name, url, total, filters) of every request's built file; those noted by a run before are awaited first."""
        run = self.run
        noted = self.built(wanted.where(F.col("file_name").isNotNull()))
        for r in noted.where("fault IS NOT NULL").collect():
            run.log(f"{r['key']}: {r['fault']}; asked for again")
        fresh = wanted.join(noted.where("fault IS NULL").select("key"), "key", "left_anti")
        caller = self.caller()
        asked = _each(fresh, lambda row: _asked(caller, row), "key string, fault string, file_name string")
        self.refuse(asked)
        names = {r["key"]: r["file_name"] for r in asked.collect()}
        run.requests += len(names)
        if resume and names:
            t = run.begin()
            run.put_chunks(t, {k: ("in_progress", {"file_name": n}, 0, 0) for k, n in names.items()})
            t.commit()
        done = self.built(fresh.drop("file_name").join(asked.select("key", "file_name"), "key"))
        self.refuse(done)
        return cut(noted.where("fault IS NULL").unionByName(done))

    def built(self, named: DataFrame) -> DataFrame:
        caller, patience = self.caller(), self.patience

        def wait(row: dict) -> dict:
            status = remote.built_export(caller, row["file_name"], patience)
            return {"file_name": row["file_name"], "url": remote.export_url(status), "total": int(status.get("total_rows") or 0)}

        return _each(named.select("key", "file_name"), wait, "key string, fault string, file_name string, url string, total long")

    def refuse(self, done: DataFrame) -> None:
        faults = [f"{r['key']}: {r['fault']}" for r in done.where("fault IS NOT NULL").collect()]
        if faults:
            raise remote.ProviderError("; ".join(faults))

    def load(self, files_: DataFrame, cut_keys: Sequence[str], resume: bool) -> None:
        """Fetch the round's files in tasks, merge them at once, and note requests loaded or cut, in one commit."""
        run, caller = self.run, self.caller()
        root, source, run_id = str(run.archive), run.source, run.id

        def fetch(row: dict) -> dict:
            with tempfile.TemporaryDirectory(dir=_work(root)) as folder:
                came = remote.download(caller, row["url"], f"{folder}/file")
                params = {"request": row["key"], "file_name": row["file_name"], "url": row["url"], "http_status": came["http_status"], "etag": came.get("etag", "")}
                meta = files.archive_file(root, source, f"{folder}/file", ".zip", datetime.now(UTC), params, run_id)
            return {"path": meta["path"], "meta": json.dumps(meta, default=str)}

        got = _each(files_, fetch, "key string, fault string, path string, meta string")
        self.refuse(got)
        found = sorted(got.collect(), key=lambda r: r["key"])
        names = {r["key"]: r["file_name"] for r in files_.select("key", "file_name").collect()}
        run.requests += len(found)
        t = run.begin()
        rows = written = 0
        if found:
            rows, written = load_award_paths(run, [f"{root}/{r['path']}" for r in found], self.vertical, t)
            metas = [json.loads(r["meta"]) for r in found]
            run.put_files(t, [{**m, "fetched_at": datetime.fromisoformat(m["fetched_at"])} for m in metas])
        if resume:
            made = {k: ("done", {"split": True}, 0, 0) for k in cut_keys}
            made |= {r["key"]: ("done", {"file_name": names[r["key"]], "path": r["path"]}, 0, 0) for r in found}
            run.put_chunks(t, made)
        t.commit()
        run.log(f"{len(found)} files, {rows} rows, {written} awards written; {len(cut_keys)} requests cut in parts")


def _work(root: str) -> str:
    """A folder for files under way, beside the archive that the tasks write to."""
    folder = Path(root) / ".work"
    folder.mkdir(parents=True, exist_ok=True)
    return str(folder)


def _asked(caller: remote.Caller, row: dict) -> dict:
    return {"file_name": remote.ask_export(caller, remote.export_filters(row["start"], row["end"], list(row["codes"]), row["date_type"]))}


# --- samples ------------------------------------------------------------------------------------------------


def counted_in(first: Sequence[Mapping[str, object]], second: Sequence[Mapping[str, object]]) -> str:
    """What the search's offset counts, from its pages 0 and 1 of the same small size: records, pages, or it can't be told."""
    place = {r.get("noticeId"): i for i, r in reversed(list(enumerate(first)))}
    moved = [place.get(r.get("noticeId")) for r in second]
    if not moved or len(first) < 2:
        return "too few records to tell"
    if all(at is None for at in moved):
        return "pages"
    return "records" if moved[0] == 1 else "pages that overlap"


def header_report(header: Sequence[str], documented: Sequence[str] = awards.WANTED) -> dict[str, list[str]]:
    """Columns that the loader wants and a file lacks, and columns beyond the documented ones."""
    return {"missing": [c for c in awards.WANTED if c not in header], "new": sorted(set(header) - set(documented))}


def sample_search(run: Run, transport: remote.Transport, key: str, today: date, rows: int = 3) -> list[str]:
    """Archive two small pages of the search; what they say of its paging and fields, a line each."""
    caller = remote.Caller(transport, spent=(429,), allowed=(404,), limit=2)
    pages = []
    for i in range(2):
        body = remote.search(caller, key, today - timedelta(days=7), today, i, limit=rows)
        run.requests += 1
        run.keep_bytes(files.redact_text(body.decode(), (key,)).encode(), ".json", {"sample": i})
        pages.append([r for r in json.loads(body).get("opportunitiesData") or [] if isinstance(r, dict)])
    new = sorted({k for rows_ in pages for r in rows_ for k in r} - set(notices.KNOWN_FIELDS))
    return [f"the offset counts {counted_in(*pages)}", f"fields that nothing reads: {', '.join(new) or 'none'}"]


def sample_export(run: Run, transport: remote.Transport, code: str, today: date, **policy) -> list[str]:
    """Build, archive and look into an export of one week and code."""
    caller = remote.Caller(transport, **policy)
    name = remote.ask_export(caller, remote.export_filters(today - timedelta(days=7), today, [code], "action_date"))
    url = remote.export_url(remote.built_export(caller, name))
    with tempfile.TemporaryDirectory(dir=_work(str(run.archive))) as folder:
        remote.download(caller, url, f"{folder}/file")
        run.requests += caller.made
        meta = run.keep_file(f"{folder}/file", ".zip", {"file_name": name, "url": url})
    return [f"{member}: {header_report(header)}" for member, header in awards.member_headers(str(run.archive / meta["path"])).items()]


def doctor(store: Store) -> list[str]:
    """Whether the parts that jobs rely on are there, a line each."""
    spark = store.spark
    lines = [f"spark {spark.version}, time zone {spark.conf.get('spark.sql.session.timeZone')}"]
    lines.append(f"checkpoint folder {spark.conf.get('spark.checkpoint.dir', None) or 'not set'}")
    lines += [f"{name}: version {store.version(name)}" for name in ("awards", "notices", "matches", "runs", "chunks")]
    lines.append(f"key of the notice search {'set' if os.environ.get('NOTICE_API_KEY') else 'not set'}; {len(schemas.NOTICE_CSV_COLUMNS)} extract columns known")
    return lines
