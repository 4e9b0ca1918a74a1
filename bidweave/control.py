"""Run control: leases, runs, chunks of a plan, and archived files."""

from __future__ import annotations

import datetime as dt
import threading
import time
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidweave import schemas
from bidweave.sources import files
from bidweave.store import ConflictError, LostLeaseError, Store

__all__ = ["BudgetExhaustedError", "JobRunningError", "Lease", "LostLeaseError", "Run", "latest_plan", "leased", "running"]

STALE = "the run ended without a result"
#: Seconds without a sign of life after which a lease is anyone's.
LEASE = 120.0


class JobRunningError(RuntimeError):
    """Another run of the job holds its lease."""


class BudgetExhaustedError(RuntimeError):
    """The provider takes no more requests today; what was loaded stays, and the next run goes on from there."""


def save_chunk(chunks: DataFrame, source: str, chunk_key: str, status: str, state: dict[str, str], rows_in: int = 0, rows_out: int = 0, now=None) -> DataFrame:
    """The control table with a chunk's new status and state; row counters add up."""
    spark = chunks.sparkSession
    new = spark.createDataFrame([(source, chunk_key, status, state, rows_in, rows_out, now)], chunks.schema)
    old = chunks.select("source", "chunk_key", F.col("rows_in").alias("_in"), F.col("rows_out").alias("_out"))
    summed = new.join(old, ["source", "chunk_key"], "left").select(
        "source", "chunk_key", "status", "state", (F.col("rows_in") + F.coalesce("_in", F.lit(0))).alias("rows_in"), (F.col("rows_out") + F.coalesce("_out", F.lit(0))).alias("rows_out"), "updated_at"
    )
    return chunks.join(new.select("source", "chunk_key"), ["source", "chunk_key"], "left_anti").unionByName(summed)


@dataclass(frozen=True)
class Lease:
    """The right to run a job, the number-th of its kind: commits with a lower number are refused."""

    job: str
    number: int


@contextmanager
def leased(store: Store, job: str, length: float | None = None) -> Iterator[Lease]:
    """One run of a job at a time.

    A run takes the next number by a commit to the store's log and touches a file while it lives. Where that file is
    gone (the run ended) or too old (it died, or hangs), the next run takes the number after; from then on commits of the
    old run fail, whether it is dead or only slow. The clocks of the machines should agree to a fraction of a lease.
    """
    length = LEASE if length is None else length
    files_ = store.files
    t = store.begin()
    now = t.entry["fences"].get(job, 0)
    touched = files_.names("leases").get(f"{job}-{now}")
    if touched is not None and time.time() - touched / 1000 < length:
        raise JobRunningError(f"{job} is running; a run without a sign of life for {length:.0f} seconds is taken over")
    t.fences[job] = now + 1
    # The sign of life comes first, so that nobody takes the number for an ended run's.
    sign = f"leases/{job}-{now + 1}"
    files_.write(sign, "")
    try:
        t.commit()
    except ConflictError as e:
        raise JobRunningError(f"{job} was started by another run") from e
    if now:
        files_.delete(f"leases/{job}-{now}")
    ended = threading.Event()

    def beat() -> None:
        while not ended.wait(length / 4):
            if not files_.names("leases").get(f"{job}-{now + 1}"):
                return  # taken over
            files_.write(sign, "")

    thread = threading.Thread(target=beat, daemon=True)
    thread.start()
    try:
        yield Lease(job, now + 1)
    finally:
        ended.set()
        thread.join()
        files_.delete(sign)


@dataclass
class Run:
    """An open run: its counters and parameters are written when it ends."""

    store: Store
    id: int
    source: str
    job: str
    archive: Path
    log: Callable[[str], None] = print
    params: dict[str, str] = field(default_factory=dict)
    rows_in: int = 0
    rows_written: int = 0
    requests: int = 0
    now: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC)
    lease: Lease | None = None

    def begin(self):
        """A transaction that commits only while this run holds its lease."""
        return self.store.begin(self.lease)

    def note(self, **params: object) -> None:
        """Add to the run's parameters, now: a run that is killed has said what it was about."""
        self.params |= {k: str(v) for k, v in params.items() if v is not None}
        own = F.create_map(*(F.lit(x) for item in self.params.items() for x in item))
        t = self.begin()
        t.update("runs", lambda runs: runs.withColumn("params", F.when(F.col("id") == self.id, own).otherwise(F.col("params"))))
        t.commit()

    def chunk(self, key: str) -> tuple[str, dict[str, str]] | None:
        """A chunk's status and state."""
        return self.chunks().get(key)

    def chunks(self) -> dict[str, tuple[str, dict[str, str]]]:
        """Status and state of this source's chunks (a plan has some hundreds)."""
        rows = self.store.read("chunks").where(F.col("source") == self.source).select("chunk_key", "status", "state").collect()
        return {r["chunk_key"]: (r["status"], dict(r["state"] or {})) for r in rows}

    def put_chunks(self, t, made: Mapping[str, tuple[str, Mapping[str, object], int, int]]) -> None:
        """In a transaction, new status and state of chunks (and rows in and out, which add up)."""

        def change(table: DataFrame) -> DataFrame:
            for key, (status, state, rows_in, rows_out) in made.items():
                table = save_chunk(table, self.source, key, status, {k: str(v) for k, v in state.items()}, rows_in, rows_out, self.now())
            return table

        t.update("chunks", change)

    def save_chunk(self, key: str, status: str, state: Mapping[str, object], rows_in: int = 0, rows_out: int = 0) -> None:
        """Replace a chunk's status and state; its counters add up."""
        t = self.begin()
        self.put_chunks(t, {key: (status, state, rows_in, rows_out)})
        t.commit()

    def keep_bytes(self, content: bytes, suffix: str, params: Mapping[str, object] | None = None) -> dict:
        """Archive bytes and record them."""
        return self._record(files.archive_bytes(str(self.archive), self.source, content, suffix, self.now(), params, self.id))

    def keep_file(self, path: str, suffix: str, params: Mapping[str, object] | None = None) -> dict:
        """Move a file into the archive and record it."""
        return self._record(files.archive_file(str(self.archive), self.source, path, suffix, self.now(), params, self.id))

    def put_files(self, t, metas) -> None:
        """In a transaction, rows of archived files."""
        rows = self.store.spark.createDataFrame(list(metas), schemas.table(schemas.RAW_FILE_DDL))
        t.update("raw_files", lambda table: table.unionByName(rows))

    def _record(self, meta: dict) -> dict:
        t = self.begin()
        self.put_files(t, [meta])
        t.commit()
        return meta


def _put_run(store: Store, lease: Lease, row: Mapping[str, object]) -> None:
    t = store.begin(lease)
    new = store.spark.createDataFrame([dict(row)], schemas.table(schemas.RUN_DDL))
    t.update("runs", lambda runs: runs.where(F.col("id") != row["id"]).unionByName(new))
    t.commit()


def _close_dead(store: Store, lease: Lease, source: str, job: str, at: dt.datetime) -> None:
    """Runs of the job that never ended have failed: whoever holds the lease knows that none of them goes on."""
    dead = (F.col("source") == source) & (F.col("job") == job) & (F.col("status") == "running")
    if not store.read("runs").where(dead).isEmpty():
        end = {"error": F.coalesce("error", F.lit(STALE)), "finished_at": F.lit(at), "status": F.lit("failed")}
        t = store.begin(lease)
        t.update("runs", lambda runs: runs.withColumns({c: F.when(dead, v).otherwise(F.col(c)) for c, v in end.items()}))
        t.commit()


@contextmanager
def running(store: Store, source: str, job: str, archive: str, params: Mapping[str, object] | None = None, log: Callable[[str], None] = print, now: Callable[[], dt.datetime] | None = None) -> Iterator[Run]:
    """A run from its first row to its last: succeeded, partial (the budget is spent) or failed.

    Earlier runs of the job that never ended are marked failed first. A run that lost its lease writes nothing more.
    """
    now = now or (lambda: dt.datetime.now(dt.UTC))
    with leased(store, f"{source}-{job}") as lease:
        _close_dead(store, lease, source, job, now())
        last = store.read("runs").agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).first()["last"]
        run = Run(store, last + 1, source, job, Path(archive), log, {k: str(v) for k, v in (params or {}).items() if v is not None}, now=now, lease=lease)
        row = {"id": run.id, "source": source, "job": job, "status": "running", "params": run.params, "started_at": now(), "finished_at": None, "error": None, "requests": 0, "rows_in": 0, "rows_written": 0}
        _put_run(store, lease, row)

        def finish(status: str, error: str | None) -> None:
            row.update(status=status, error=error, params=run.params, finished_at=now(), requests=run.requests, rows_in=run.rows_in, rows_written=run.rows_written)
            _put_run(store, lease, row)

        try:
            yield run
        except BudgetExhaustedError as e:
            log(str(e))
            finish("partial", str(e))
        except LostLeaseError:
            raise
        except BaseException as e:
            finish("failed", f"{type(e).__name__}: {e}")
            raise
        else:
            finish("succeeded", None)


def latest_plan(runs: DataFrame, source: str, job: str, first: str, last: str, without: int) -> tuple[dt.date, dt.date] | None:
    """The span of the newest run of a job that had one, finished or not, but one run."""
    rows = runs.where((F.col("source") == source) & (F.col("job") == job) & (F.col("id") != without) & F.col("params")[first].isNotNull())
    r = rows.orderBy(F.col("started_at").desc(), F.col("id").desc()).select(F.col("params")[first].alias("a"), F.col("params")[last].alias("b")).first()
    return r and (dt.date.fromisoformat(r["a"]), dt.date.fromisoformat(r["b"]))
