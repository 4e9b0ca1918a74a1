"""Stores, leases, streams of pages and rounds of exports, with runs that die."""

from __future__ import annotations

import csv
import datetime as dt
import functools
import gzip
import json
import os
import subprocess
import sys
import time
import zipfile
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from bidweave import control, jobs, schemas, store
from bidweave.functions import normalize as N
from bidweave.operators import versions
from bidweave.plans import reports, requests
from bidweave.sources import awards, files, notices, remote

#: Providers below are called in tasks, which can't import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
ROOT = Path(__file__).resolve().parents[1]
CODES = ("541512", "541519")


def quiet(*_):
    pass


def award_csv(path, *keys):
    with open(path, "w", newline="") as out:
        writer = csv.DictWriter(out, awards.WANTED)
        writer.writeheader()
        for key in keys:
            writer.writerow({c: "" for c in awards.WANTED} | {"contract_award_unique_key": key, "award_id_piid": f"P-{key}", "naics_code": "541512", "recipient_uei": f"U{key}", "last_modified_date": "2026-01-02 00:00:00+00"})
    return str(path)


def extract(path, *rows):
    base = {c: "" for c in schemas.NOTICE_CSV_COLUMNS} | {"NoticeId": "N1", "Title": "Title", "NaicsCode": "541512", "PostedDate": "2026-10-01", "Active": "Yes", "Type": "Solicitation"}
    with open(path, "w", encoding="cp1252", newline="") as out:
        writer = csv.DictWriter(out, schemas.NOTICE_CSV_COLUMNS)
        writer.writeheader()
        writer.writerows([base | r for r in rows])
    return str(path)


# --- store --------------------------------------------------------------------------------------------------


def entity_rows(spark, rows):
    return spark.createDataFrame([(k, v, None, None, None, None, None, None) for k, v in rows], store.TABLES["entities"]())


def merge_entities(s, rows):
    t = s.begin()
    new = entity_rows(s.spark, rows)
    touched = t.merge("entities", new, lambda old: old.join(new.select("uei"), "uei", "left_anti").unionByName(new))
    t.commit()
    return touched


def names(s):
    return {r["uei"]: r["name"] for r in s.read("entities").collect()}


def test_merges_touch_their_buckets_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "BUCKET_ROWS", 50)
    s = store.Store(spark, f"file://{tmp_path}/root")
    want = {}
    for k in range(6):
        rows = [(f"k{i}", f"v{k}") for i in range(k * 100, k * 100 + 200)]
        want |= dict(rows)
        merge_entities(s, rows)
        assert names(s) == want
    before = s.manifest("entities", s.entry(s.last()))
    assert before["buckets"] > 1 and sum(before["rows"].values()) == len(want) == s.read("entities").count()
    touched, buckets = merge_entities(s, [("k3", "new")])
    after = s.manifest("entities", s.entry(s.last()))
    assert (touched, buckets) == (1, before["buckets"])
    assert sum(before["files"][b] != after["files"][b] for b in before["files"]) == 1
    assert names(s) == want | {"k3": "new"}
    # A table ten times as large: one row costs one bucket again.
    merge_entities(s, [(f"x{i}", "y") for i in range(7000)])
    merge_entities(s, [("z", "y")])
    touched, buckets = merge_entities(s, [("k4", "new")])
    m = s.manifest("entities", s.entry(s.last()))
    assert touched == 1 and buckets >= 64 and max(m["rows"].values()) < 4 * 50 + 100
    t = s.begin()
    assert t.near("entities", spark.createDataFrame([("k4",)], "uei string")).count() < 300


def test_commits_are_whole_or_not_at_all(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/root")
    assert s.read("naics").count() == 0 and s.version("naics") == 0 and s.tags() == {}
    one = spark.createDataFrame([("1", "t", True)], store.TABLES["naics"]())
    t = s.begin()
    t.write("naics", one)
    merged = entity_rows(spark, [("a", "b")])
    t.merge("entities", merged, lambda old: old.unionByName(merged))
    assert s.read("naics").count() == s.read("entities").count() == 0  # staged, not committed
    assert t.read("naics").count() == 1
    reader = s.begin()
    t.commit({"x": "1"})
    assert reader.read("naics").count() == 0 and s.read("naics").count() == s.read("entities").count() == 1 and s.tags() == {"x": "1"}
    # Two transactions that read one table: the second is refused; of different tables both go through.
    a, b, c = s.begin(), s.begin(), s.begin()
    a.write("naics", a.read("naics").unionByName(one))
    b.write("naics", b.read("naics").limit(0))
    c.write("offices", c.read("offices"))
    c.update("naics", lambda table: table.unionByName(one))  # late: on whatever is there at the commit
    a.commit()
    with pytest.raises(store.ConflictError, match="naics"):
        b.commit()
    c.commit()
    assert s.read("naics").count() == 3 and s.tags() == {"x": "1"}


def test_old_files_are_cleared(spark, tmp_path, monkeypatch):
    s = store.Store(spark, f"file://{tmp_path}/root")
    for i in range(4):
        merge_entities(s, [("a", str(i))])
    s.clear()
    assert len(s.files.names("log")) == 4  # within the grace
    s.clear(time.time() + 2 * store.GRACE)
    assert [n for n in s.files.names("log") if n.isdigit()] == ["4"] and len(s.files.names("entities/data")) == 1 and names(s) == {"a": "3"}


def test_leases_run_out_and_fence(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/root")
    one = spark.createDataFrame([("1", "t", True)], store.TABLES["naics"]())
    with control.leased(s, "job", 30) as mine, pytest.raises(control.JobRunningError), control.leased(s, "job", 30):
        pass
    assert mine.number == 1
    with control.leased(s, "job", 1.5) as mine:
        time.sleep(2.5)  # the run is alive, so its lease goes on
        with pytest.raises(control.JobRunningError), control.leased(s, "job", 1.5):
            pass
        t = s.begin(mine)
        t.write("naics", one)
        t.commit()
    slow = s.begin(control.Lease("job", mine.number))
    slow.write("offices", slow.read("offices"))
    s.files.write(f"leases/job-{mine.number}", "")  # a run that hangs: its sign of life grows old
    time.sleep(1.2)
    with control.leased(s, "job", 1.0) as later:
        assert later.number == mine.number + 1
        with pytest.raises(control.LostLeaseError):
            slow.commit()
    assert s.version("offices") == 0 and s.version("naics") > 0


# --- notice pages -------------------------------------------------------------------------------------------


def served_page(folder, served, start, end, page, code):
    """A provider that notes what it was asked for in a file, and may refuse or hang."""
    asked = Path(folder) / "asked"
    lines = asked.read_text().split() if asked.exists() else []
    with open(asked, "a") as out:
        out.write(f"{code}/{page}\n")
    if (Path(folder) / f"refuse-{len(lines)}").exists():
        raise remote.SpentError("later")
    if (Path(folder) / "hang").exists() and page == 1:
        time.sleep(600)
    every = served[code] if code else [r for rows in served.values() for r in rows]
    return json.dumps({"totalRecords": len(every), "opportunitiesData": every[2 * page : 2 * page + 2]}).encode()


def notice(i, code="541512"):
    return {"noticeId": i, "title": f"T {i}", "type": "Solicitation", "naicsCode": code, "postedDate": "2026-09-09", "active": "Yes"}


SERVED = {"541512": [notice(f"A{i}") for i in range(5)], "541519": [notice("B", "541519"), notice("C", "111111")]}


def backfill(spark, root, folder, today, since=None, limit=50, served=SERVED):
    s = store.Store(spark, root)
    with control.running(s, jobs.NOTICES, "backfill", f"{folder}/arc", log=quiet) as run:
        jobs.NoticeJob(run, functools.partial(served_page, str(folder), served), CODES, limit, at_once=1).backfill(today, since)
    return s


TODAY, SINCE = dt.date(2026, 10, 6), dt.date(2026, 9, 1)


def asked(folder):
    return (folder / "asked").read_text().split()


def test_pages_stream_into_the_tables_and_resume(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(remote, "PAGE_ROWS", 2)
    root = f"file://{tmp_path}/root"
    (tmp_path / "refuse-1").touch()
    s = backfill(spark, root, tmp_path, TODAY, SINCE)
    assert s.read("runs").first()["status"] == "partial" and {r["notice_id"] for r in s.read("notices").collect()} == {"A0", "A1"}
    backfill(spark, root, tmp_path, TODAY)
    # Every page that was taken in was asked for once, the refused one twice.
    assert asked(tmp_path) == ["541512/0", "541512/1", "541512/1", "541512/2", "541519/0"]
    assert {r["notice_id"] for r in s.read("notices").collect()} == {"A0", "A1", "A2", "A3", "A4", "B"}
    assert {r["chunk_key"]: (r["status"], r["rows_in"]) for r in s.read("chunks").collect()} == {remote.chunk_key(SINCE, TODAY, "541512"): ("done", 5), remote.chunk_key(SINCE, TODAY, "541519"): ("done", 2)}
    assert s.read("notice_versions").count() == 6 and s.read("raw_files").count() == 4
    backfill(spark, root, tmp_path, TODAY)  # the plan is done
    assert len(asked(tmp_path)) == 5
    with control.running(s, jobs.NOTICES, "delta", str(tmp_path / "arc"), log=quiet) as run:
        jobs.NoticeJob(run, functools.partial(served_page, str(tmp_path), SERVED), CODES, 50).delta(TODAY)
    params = {r["job"]: r["params"] for r in s.read("runs").collect()}["delta"]
    assert params == {"posted_from": "2026-10-04", "posted_to": "2026-10-06"} and s.read("notices").count() == 6
    before = s.version("notices")
    assert s.last() > before  # pages that changed nothing left the notices' files alone


def test_a_day_has_a_budget(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(remote, "PAGE_ROWS", 2)
    root = f"file://{tmp_path}/root"
    s = backfill(spark, root, tmp_path, TODAY, SINCE, limit=2)
    assert asked(tmp_path) == ["541512/0", "541512/1"]
    backfill(spark, root, tmp_path, TODAY, limit=2)  # the same day
    assert len(asked(tmp_path)) == 2 and [r["status"] for r in s.read("runs").orderBy("id").collect()] == ["partial", "partial"]
    backfill(spark, root, tmp_path, TODAY, limit=3)
    backfill(spark, root, tmp_path, TODAY, limit=9)
    assert asked(tmp_path) == ["541512/0", "541512/1", "541512/2", "541519/0"] and s.read("notices").count() == 6


CHILD = """
import sys, datetime as dt
sys.path[:0] = [{tests!r}, {root!r}]
from pyspark.sql import SparkSession
import test_jobs
from bidweave import control
from bidweave.sources import remote
control.LEASE, remote.PAGE_ROWS = 3.0, 2
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", {checkpoints!r}).getOrCreate()
test_jobs.backfill(spark, {store!r}, test_jobs.Path({folder!r}), test_jobs.TODAY, test_jobs.SINCE)
"""


def test_a_killed_run_is_followed_by_one_that_goes_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(remote, "PAGE_ROWS", 2)
    monkeypatch.setattr(control, "LEASE", 3.0)
    (tmp_path / "hang").touch()
    root = f"file://{tmp_path}/root"
    code = CHILD.format(tests=str(ROOT / "tests"), root=str(ROOT), checkpoints=f"file://{tmp_path}/ck", store=root, folder=str(tmp_path))
    child = subprocess.Popen([sys.executable, "-c", code], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    try:
        end = time.time() + 120
        while time.time() < end and child.poll() is None and not ((tmp_path / "asked").exists() and "541512/1" in asked(tmp_path)):
            time.sleep(0.3)
        assert child.poll() is None and "541512/1" in asked(tmp_path)
        with pytest.raises(control.JobRunningError):
            backfill(spark, root, tmp_path, TODAY)
    finally:
        child.kill()
        child.wait()
    (tmp_path / "hang").unlink()
    end = time.time() + 60
    while True:
        try:
            s = backfill(spark, root, tmp_path, TODAY)
            break
        except control.JobRunningError:
            assert time.time() < end
            time.sleep(0.5)
    assert asked(tmp_path) == ["541512/0", "541512/1", "541512/1", "541512/2", "541519/0"]  # the page that hung is asked for again
    assert {r["notice_id"] for r in s.read("notices").collect()} == {"A0", "A1", "A2", "A3", "A4", "B"} and s.read("notice_versions").count() == 6
    assert [(r["id"], r["status"]) for r in s.read("runs").orderBy("id").collect()] == [(1, "failed"), (2, "succeeded")]


def test_page_offsets(tmp_path):
    plan = remote.PagePlan([(SINCE, TODAY, c) for c in CODES], str(tmp_path), functools.partial(served_page, str(tmp_path), SERVED), 2)
    stream = remote._PageStream(plan, {"chunk": 0, "page": 0}, 2, 4)
    steps = [stream.latestOffset() for _ in range(5)]
    assert steps == [{"chunk": 0, "page": 2}, {"chunk": 1, "page": 0}, {"chunk": 2, "page": 0}, {"chunk": 2, "page": 0}, {"chunk": 2, "page": 0}]
    of = [[(p.chunk, p.page) for p in stream.partitions(a, b)] for a, b in zip([stream.initialOffset(), *steps], steps, strict=False)]
    assert of == [[(0, 0), (0, 1)], [(0, 2)], [(1, 0)], [], []]
    again = remote._PageStream(plan, {"chunk": 0, "page": 0}, 2, 9)
    again.partitions({"chunk": 0, "page": 0}, {"chunk": 0, "page": 2})  # the batch under way when the query died
    assert again.latestOffset() == {"chunk": 1, "page": 0}


# --- extracts -----------------------------------------------------------------------------------------------


def test_extracts_load_once(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/root")
    path = extract(tmp_path / "e.csv", {}, {"NoticeId": "N2", "NaicsCode": "111111"}, {"Title": "Later, “quoted”"}, {"Title": "Later, “quoted”", "Description": "two\nlines"})

    def load(**kwargs):
        with control.running(s, jobs.NOTICES, "extract", str(tmp_path / "arc"), log=quiet) as run:
            return jobs.load_extract(run, path, "http://x/e.csv", ("541512",), headers={"etag": "E", "http_status": "200", "date": "x"}, **kwargs)

    assert load() == {"inserted": 1, "changed": 1, "updated": 1} and load() is None
    assert [(r["version"], r["snapshot"]["title"]) for r in s.read("notice_versions").orderBy("version").collect()] == [(1, "Title"), (2, "Later, “quoted”")]
    assert load(force=True) == {"changed": 2, "unchanged": 1}  # the older row comes first again, as it does in the file
    meta = s.read("raw_files").first()
    assert {k: meta["request_params"][k] for k in ("rows_kept", "rows_in_file", "etag", "http_status")} == {"rows_kept": "3", "rows_in_file": "4", "etag": "E", "http_status": "200"}
    assert meta["path"].endswith(".vertical.csv.gz") and "date" not in meta["request_params"]
    text = gzip.decompress((tmp_path / "arc" / meta["path"]).read_bytes()).decode()
    rows = list(csv.DictReader(text.splitlines(keepends=True)))
    assert [(r["NoticeId"], r["Title"], r["Description"]) for r in rows] == [("N1", "Title", ""), ("N1", "Later, “quoted”", ""), ("N1", "Later, “quoted”", "two\nlines")]
    assert text.startswith('"NoticeId","Title"') and text.endswith('"\r\n') and not list((tmp_path / "arc" / ".work").iterdir())


# --- exports ------------------------------------------------------------------------------------------------


def provider(folder, method, url, values):
    """Files that are built at once, or not at all; what they hold and who asked is kept in a folder."""
    folder = Path(folder)
    if method == "POST":
        (span,) = values["filters"]["time_period"]
        codes = values["filters"]["naics_codes"]["require"]
        name = f"{span['start_date']}_{span['end_date']}_{'-'.join(codes)}"
        with open(folder / "asked", "a") as out:
            out.write(name + "\n")
        return remote.Response(200, [json.dumps({"file_name": name}).encode()], {})
    if "status" in url:
        name = values["file_name"]
        if (folder / f"slow-{name}").exists():
            os.remove(folder / f"slow-{name}")
            return remote.Response(503, [b""], {"Retry-After": "7"})
        state = "failed" if (folder / f"broken-{name}").exists() else "finished"
        a, b, codes = name.split("_")
        days = (dt.date.fromisoformat(b) - dt.date.fromisoformat(a)).days + 1
        total = 500_000 if "-" in codes or (codes == "541519" and days > 92) else 10
        return remote.Response(200, [json.dumps({"status": state, "file_url": f"/f/{name}", "total_rows": total}).encode()], {})
    name = url.rsplit("/", 1)[1]
    with zipfile.ZipFile(folder / f"{name}.zip", "w") as z:
        for part in ("x", "y"):
            z.write(award_csv(folder / f"{name}-{part}.csv", f"{name}-{part}"), f"{part}.csv")
        z.writestr("notes.csv", "a,b\n1,2\n")
    return remote.Response(200, [(folder / f"{name}.zip").read_bytes()], {"ETag": "E"})


def run_exports(s, folder, name, f):
    with control.running(s, jobs.AWARDS, name, str(folder / "arc"), log=quiet) as run:
        f(jobs.AwardJob(run, functools.partial(provider, str(folder)), CODES, {"sleep": quiet}))


def test_exports_are_cut_and_resumed(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/root")
    today = dt.date(2026, 9, 30)
    first = "2025-10-01_2026-09-30_541512-541519"
    (tmp_path / f"slow-{first}").touch()
    run_exports(s, tmp_path, "backfill", lambda j: j.backfill(today, 1))
    names_ = asked(tmp_path)
    quarters = [f"{a}_{b}_541519" for a, b in N.quarters(dt.date(2025, 10, 1), today)]
    assert sorted(names_) == sorted(["2025-09-30_2025-09-30_541512-541519", first, "2025-09-30_2025-09-30_541512", "2025-09-30_2025-09-30_541519", "2025-10-01_2026-09-30_541512", "2025-10-01_2026-09-30_541519", *quarters])
    leaves = [n for n in names_ if "-541519" not in n and n != "2025-10-01_2026-09-30_541519"]
    assert {r["award_key"] for r in s.read("awards").collect()} == {f"{n}-{p}" for n in leaves for p in "xy"}
    assert s.read("naics").where("in_vertical").count() == 2 and s.read("chunks").where("status <> 'done'").count() == 0
    assert s.read("raw_files").count() == len(leaves) and s.read("raw_files").first()["request_params"]["etag"] == "E"
    run_exports(s, tmp_path, "backfill", lambda j: j.backfill(today, 1))
    assert len(asked(tmp_path)) == len(names_)  # every request is done
    # One that was asked for but not loaded is awaited again, or asked for anew if it is no longer to be had.
    open_again = F.col("chunk_key").endswith("2026-09-30:naics:541512")
    for broken in (False, True):
        s.write("chunks", s.read("chunks").withColumn("status", F.when(open_again, "in_progress").otherwise(F.col("status"))))
        if broken:
            (tmp_path / "broken-2025-10-01_2026-09-30_541512").touch()
            with pytest.raises(remote.ProviderError, match="could not be built"):
                run_exports(s, tmp_path, "backfill", lambda j: j.backfill(today, 1))
            (tmp_path / "broken-2025-10-01_2026-09-30_541512").unlink()
        run_exports(s, tmp_path, "backfill", lambda j: j.backfill(today, 1))
        assert len(asked(tmp_path)) == len(names_) + broken and s.read("chunks").where("status <> 'done'").count() == 0
    run_exports(s, tmp_path, "delta", lambda j: j.delta(dt.date(2026, 10, 3)))
    assert sorted(asked(tmp_path)[-3:]) == ["2026-09-27_2026-10-03_541512", "2026-09-27_2026-10-03_541512-541519", "2026-09-27_2026-10-03_541519"]


def test_parts_cover_their_requests(spark):
    spans = [(dt.date(2024, 2, 28), dt.date(2026, 3, 1)), (dt.date(2026, 5, 5), dt.date(2026, 5, 5))]
    plan = requests.plan(spark, spans, ["2", "1", "3"], "action_date")

    def days(df):
        rows = df.select(F.explode("codes").alias("c"), F.explode(F.sequence("start", "end")).alias("d")).collect()
        assert len(set(rows)) == len(rows)
        return set(rows)

    by_code = requests.split(plan)
    by_quarter = requests.split(by_code)
    assert by_code.count() == 6 and days(by_code) == days(plan)
    whole = requests.plan(spark, spans[:1], ["1", "2", "3"], "action_date")
    assert days(by_quarter) == days(whole)  # a single day of one code can't be cut
    assert [(r["start"], r["end"]) for r in by_quarter.where("codes[0] = '2'").orderBy("start").collect()] == N.quarters(*spans[0])
    assert requests.overlaps(by_quarter).count() == 0 and requests.overlaps(plan.unionByName(by_code)).count() == 6
    assert [r["key"] for r in requests.fiscal_plan(spark, dt.date(2025, 9, 30), dt.date(2025, 10, 1), ["9"], "x").orderBy("key").collect()] == ["x:2025-09-30:2025-09-30:naics:9", "x:2025-10-01:2025-10-01:naics:9"]


# --- requests -----------------------------------------------------------------------------------------------


def answers(*made):
    left = list(made)

    def give(method, url, values):
        one = left.pop(0)
        if isinstance(one, Exception):
            raise one
        return one

    return give


def r(status, body=b"", **headers):
    return remote.Response(status, [body], {k.replace("_", "-"): v for k, v in headers.items()})


def test_callers_wait_repeat_and_stop():
    pauses = []
    call = remote.Caller(answers(r(503), OSError("reset"), r(429, retry_after="9"), r(500), r(200, b"x")), sleep=pauses.append)
    assert call("GET", "http://u", {}) == (200, b"x") and pauses == [1.0, 2.0, 9.0, 8.0] and call.made == 5
    for made in ([r(503)] * 5, [r(403)], [OSError("no")] * 5):
        with pytest.raises(remote.ProviderError, match="http://u: "):
            remote.Caller(answers(*made), sleep=quiet)("GET", "http://u?key=secret", {})
    with pytest.raises(remote.SpentError):
        remote.Caller(answers(r(429)), spent=(429,))("GET", "http://u", {})
    limited = remote.Caller(answers(r(200), r(200)), limit=1)
    limited("GET", "u", {})
    with pytest.raises(remote.SpentError):
        limited("GET", "u", {})
    now, waits = [0.0], []
    paced = remote.Caller(answers(r(200), r(200), r(200)), interval=10.0, clock=lambda: now[0], sleep=waits.append)
    for at in (0.0, 4.0, 50.0):
        now[0] = at
        paced("GET", "u", {})
    assert waits == [6.0]


def test_providers(spark, tmp_path):
    day = dt.date(2026, 2, 3)
    fetch = remote.searcher(answers(r(404)), "k")
    assert json.loads(fetch(day, day, 0, None))["totalRecords"] == 0
    with pytest.raises(remote.SpentError):
        remote.searcher(answers(r(429)), "k")(day, day, 0, None)
    pauses = []
    assert remote.searcher(answers(r(500), r(200, b"{}")), "k", sleep=pauses.append)(day, day, 0, None) == b"{}" and pauses[0] == 1.0
    got = {}
    remote.search(remote.Caller(lambda m, u, v: got.update(v) or r(200, b"{}")), "k", day, day, 2, "541512")
    assert got == {"postedFrom": "02/03/2026", "postedTo": "02/03/2026", "limit": "1000", "offset": "2", "ncode": "541512", "api_key": "k"}
    pauses.clear()
    running = [r(200, b'{"status": "running"}')]
    call = remote.Caller(answers(*running * 8, r(502), r(200, b'{"status": "finished"}')), sleep=pauses.append)
    assert remote.built_export(call, "f")["status"] == "finished" and pauses[:2] == [5.0, 7.5] and max(pauses) == 60.0
    with pytest.raises(remote.ProviderError, match="not ready"):
        remote.built_export(remote.Caller(answers(*running * 3), sleep=quiet), "f", patience=6)
    with pytest.raises(remote.ProviderError, match="no file name"):
        remote.ask_export(remote.Caller(answers(r(200, b"[]"))), {})
    assert remote.ask_export(remote.Caller(answers(r(502), r(200, b'{"file_name": "n"}')), sleep=quiet), {}) == "n"
    target = str(tmp_path / "f")

    def broken():
        yield b"da"
        raise OSError("cut off")

    came = remote.download(remote.Caller(answers(remote.Response(200, broken(), {}), r(200, b"data", ETag="e")), sleep=quiet), "u", target)
    assert open(target, "rb").read() == b"data" and came == {"http_status": "200", "etag": "e"}
    key = remote.chunk_key(day, day, "541512")
    for i in range(3):
        place = remote.page_file(str(tmp_path), key, i)
        place.parent.mkdir(exist_ok=True)
        place.write_text(json.dumps({"totalRecords": 3, "opportunitiesData": [notice(f"N{i}")]}))
    pages = remote.archived_pages(spark, str(tmp_path), [key, "posted:none"])
    assert pages.rdd.getNumPartitions() == 2
    assert {x["notice_id"] for x in notices.parse_notices(notices.page_records(pages)).collect()} == {"N0", "N1", "N2"}


def test_samples(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/root")
    pages = [json.dumps({"opportunitiesData": [{"noticeId": i, "novel": "the key"} for i in ids]}).encode() for ids in ("12", "23")]
    with control.running(s, "sam", "sample", str(tmp_path / "arc"), log=quiet) as run:
        assert jobs.sample_search(run, answers(*(r(200, p) for p in pages)), "the key", TODAY) == ["the offset counts records", "fields that nothing reads: novel"]
    assert b"the key" not in files.read_archived(str(tmp_path / "arc"), s.read("raw_files").first()["path"])
    with control.running(s, "usaspending", "sample", str(tmp_path / "arc"), log=quiet) as run:
        lines = jobs.sample_export(run, functools.partial(provider, str(tmp_path)), "541512", TODAY)
    assert lines[0].startswith("notes.csv: {'missing': [") and lines[1] == "x.csv: {'missing': [], 'new': []}" and s.read("runs").where("status = 'succeeded'").count() == 2
    lines = reports.status({"runs": s.read("runs")}, s.read("runs"), s.read("chunks"), s.read("raw_files"), s.sizes(), 1, 10, dt.datetime.now(dt.UTC)) if s.sizes() else []
    assert "sam: 2 of 10 requests today" in lines and any(x.startswith("largest tables: ") for x in lines)
    assert "WARNING" in reports.status({"runs": s.read("runs")}, s.read("runs"), s.read("chunks"), s.read("raw_files"), {"awards": 9_000_000, "notices": 5_000}, 10)[-1]


def test_folds_of_one_batch_are_one_commit(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/root")
    rows = notices.parse_extract(notices.read_extract(spark, extract(tmp_path / "e.csv", {}, {"NoticeId": "N2"}))).withColumn("seq", F.lit(1))
    assert jobs.fold_notices(s, rows, versions.CSV_AUTHORITATIVE) == {"inserted": 2} and s.last() == 1
    assert jobs.fold_notices(s, rows, versions.CSV_AUTHORITATIVE) == {"unchanged": 2} and s.last() == 1
    assert jobs.fold_notices(s, rows.limit(0)) == {}
