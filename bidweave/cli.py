"""Command line over a folder of versioned tables.

    python -m bidweave.cli --root DIR ingest-awards FILE...          award CSV or zip files
    python -m bidweave.cli --root DIR awards-backfill | awards-delta exports built by the provider
    python -m bidweave.cli --root DIR ingest-extract [FILE]          a notice extract; without FILE the daily one is fetched
    python -m bidweave.cli --root DIR notice-archive YEAR [FILE]     a fiscal year's archived notices
    python -m bidweave.cli --root DIR ingest-pages FOLDER            archived pages of the search
    python -m bidweave.cli --root DIR ingest-notices [--backfill]    pages of the search, since the last day reached
    python -m bidweave.cli --root DIR sample-fixtures                  small answers of the providers, archived, and what they show
    python -m bidweave.cli --root DIR match | recompetes | diagnose | reset | status | doctor | version
    python -m bidweave.cli --root DIR label-sheet OUT | import-labels SHEET --labels FILE | eval --labels FILE [--report FILE]
    python -m bidweave.cli --root DIR review NOTICE AWARD confirmed|rejected --reviewer NAME

The key of the notice search is read from NOTICE_API_KEY.
"""

from __future__ import annotations

import argparse
import datetime as dt
import os
import tempfile
from pathlib import Path

from bidweave import control, jobs, schemas, session
from bidweave.config import MatchingConfig, load_matching_config, load_verticals, vertical_naics
from bidweave.operators.rows import cut, union_override
from bidweave.plans import incremental, match, reports
from bidweave.sources import files, remote
from bidweave.store import TABLES, Store, current_schema

__all__ = ["TABLES", "Store", "current_schema", "main"]

VERSION = "0.3.0"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bidweave", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--root", required=True)
    p.add_argument("--archive", help="folder of raw files; by default 'archive' beside the tables")
    p.add_argument("--config")
    p.add_argument("--verticals")
    p.add_argument("--today", type=dt.date.fromisoformat, default=dt.date.today())
    sub = p.add_subparsers(dest="job", required=True)
    sub.add_parser("ingest-awards").add_argument("files", nargs="+")
    sub.add_parser("awards-backfill").add_argument("--years", type=int, default=5)
    sub.add_parser("awards-delta")
    sub.add_parser("ingest-pages").add_argument("folder")
    x = sub.add_parser("ingest-notices")
    x.add_argument("--backfill", action="store_true")
    x.add_argument("--since", type=dt.date.fromisoformat)
    x.add_argument("--requests", type=int, default=remote.SEARCHES_A_DAY, help="requests a day that the search allows")
    for name in ("ingest-extract", "notice-archive"):
        x = sub.add_parser(name)
        if name == "notice-archive":
            x.add_argument("year", type=int)
        x.add_argument("file", nargs="?")
        x.add_argument("--since", type=dt.date.fromisoformat)
        x.add_argument("--force", action="store_true")
    for name in ("match", "recompetes", "diagnose", "reset", "doctor", "version", "sample-fixtures"):
        sub.add_parser(name)
    sub.add_parser("status").add_argument("--size-limit-mb", type=int)
    x = sub.add_parser("label-sheet")
    x.add_argument("out")
    x.add_argument("--size", type=int, default=100)
    x.add_argument("--seed", default="m2")
    x = sub.add_parser("import-labels")
    x.add_argument("sheet")
    x.add_argument("--labels", required=True)
    x = sub.add_parser("eval")
    x.add_argument("--labels", required=True)
    x.add_argument("--report")
    x.add_argument("--target", type=float, default=0.9, help="the precision aimed at")
    x = sub.add_parser("review")
    x.add_argument("notice")
    x.add_argument("award")
    x.add_argument("decision", choices=("confirmed", "rejected"))
    x.add_argument("--reviewer", required=True)
    x.add_argument("--note")
    return p


def _extract(run: control.Run, a: argparse.Namespace, vertical: tuple[str, ...], transport: remote.Transport) -> dict | None:
    url = remote.ARCHIVE_EXTRACT_URL.format(a.year) if a.job == "notice-archive" else remote.DAILY_EXTRACT_URL
    if a.file:
        return jobs.load_extract(run, a.file, url, vertical, a.since, a.force)
    work = run.archive / ".work"
    work.mkdir(parents=True, exist_ok=True)
    with tempfile.TemporaryDirectory(dir=work) as folder:
        target = str(Path(folder) / "extract.csv")
        came = remote.download(remote.Caller(transport), url, target)
        run.requests += 1
        return jobs.load_extract(run, target, url, vertical, a.since, a.force, came)


def _ingest(store: Store, a: argparse.Namespace, vertical: tuple[str, ...], archive: str, transport: remote.Transport) -> None:
    kinds = {"ingest-awards": (jobs.AWARDS, "files"), "awards-backfill": (jobs.AWARDS, "backfill"), "awards-delta": (jobs.AWARDS, "delta"), "ingest-pages": (jobs.NOTICES, "pages")}
    kinds |= {"ingest-notices": (jobs.NOTICES, "backfill" if getattr(a, "backfill", False) else "delta"), "ingest-extract": (jobs.NOTICES, "extract"), "notice-archive": (jobs.NOTICES, "archive")}
    with control.running(store, *kinds[a.job], archive) as run:
        if a.job == "ingest-awards":
            print("{} rows, {} awards written".format(*jobs.load_award_paths(run, a.files, vertical)))
        elif a.job == "ingest-pages":
            print(jobs.load_page_folder(run, a.folder, vertical))
        elif a.job in ("ingest-extract", "notice-archive"):
            print(_extract(run, a, vertical, transport))
        elif a.job == "ingest-notices":
            job = jobs.NoticeJob(run, remote.searcher(transport, os.environ.get("NOTICE_API_KEY", "")), vertical, a.requests)
            job.backfill(a.today, a.since) if a.backfill else job.delta(a.today)
        else:
            job = jobs.AwardJob(run, transport, vertical)
            job.backfill(a.today, a.years) if a.job == "awards-backfill" else job.delta(a.today)


def main(argv: list[str] | None = None, transport: remote.Transport = remote.over_http) -> int:
    a = _parser().parse_args(argv)
    if a.job == "version":
        print(VERSION)
        return 0
    cfg = load_matching_config(a.config) if a.config else MatchingConfig()
    vertical = vertical_naics(load_verticals(a.verticals) if a.verticals else None)
    spark = session.build()
    store = Store(spark, a.root)
    archive = a.archive or f"{a.root.removeprefix('file://')}/archive"
    if a.job in ("ingest-awards", "awards-backfill", "awards-delta", "ingest-pages", "ingest-notices", "ingest-extract", "notice-archive"):
        _ingest(store, a, vertical, archive, transport)
    elif a.job == "sample-fixtures":
        key = os.environ.get("NOTICE_API_KEY")
        if key:
            with control.running(store, jobs.NOTICES, "sample", archive) as run:
                print("\n".join(jobs.sample_search(run, transport, key, a.today)))
        else:
            print("NOTICE_API_KEY is not set: no sample of the search")
        with control.running(store, jobs.AWARDS, "sample", archive) as run:
            print("\n".join(jobs.sample_export(run, transport, vertical[0], a.today)))
    elif a.job == "match":
        with control.running(store, "matcher", "match", archive) as run:
            print(jobs.run_match(store, cfg, vertical, a.today, run))
    elif a.job == "recompetes":
        with control.running(store, "matcher", "recompetes", archive) as run:
            t = run.begin()
            run.rows_written = incremental.recompetes(t, cfg, vertical, a.today)
            t.commit()
    elif a.job == "diagnose":
        print("\n".join(reports.diagnose(store.notices(), store.read("awards"), store.read("notice_descriptions"), store.read("matches"), store.read("chunks"), cfg, vertical, a.today)))
    elif a.job == "reset":
        store.write("matches", match.reset_automatic(store.read("matches")))
    elif a.job == "status":
        print("\n".join(reports.status({n: store.read(n) for n in TABLES}, store.read("runs"), store.read("chunks"), store.read("raw_files"), store.sizes(), a.size_limit_mb, remote.SEARCHES_A_DAY, dt.datetime.now(dt.UTC))))
    elif a.job == "doctor":
        print("\n".join(jobs.doctor(store)))
    elif a.job == "label-sheet":
        write_label_sheet(store, a.out, a.size, a.seed)
    elif a.job == "import-labels":
        found = spark.createDataFrame(files.read_answers(a.sheet, "sheet", a.today), schemas.table(schemas.LABEL_DDL))
        after = cut(union_override(found, files.load_labels(spark, a.labels), ["notice_id"]))  # read before the file is written anew
        files.save_labels(after, a.labels)
        print("; ".join(f"{r['answer']} {r['count']}" for r in reports.answer_counts(found).orderBy("answer").collect()))
    elif a.job == "eval":
        labels = cut(reports.effective_labels(files.load_labels(spark, a.labels), store.read("reviews")))
        matches = store.read("matches")
        c = cut(reports.stored_candidates(matches, labels))
        text = reports.render(reports.scorecards(labels, c, cfg, reports.thresholds(c)), reports.explicit_check(reports.stored_candidates(matches), cfg), cfg, a.today, a.target)
        if a.report:
            Path(a.report).write_text(text, encoding="utf-8")
        print(text)
    elif a.job == "review":
        after, log = reports.record_review(store.read("matches"), store.read("reviews"), a.notice, a.award, a.decision, a.reviewer, dt.datetime.now(), a.note)
        t = store.begin()
        t.write("reviews", log)
        t.write("matches", after)
        t.commit()
    return 0


def write_label_sheet(store: Store, out: str, size: int, seed: str) -> None:
    """A spreadsheet for labelling: a row a notice with its candidates shuffled (at most a thousand notices)."""
    if not 1 <= size <= 1000:
        raise ValueError("a sheet has 1 to 1000 notices")
    n, m = store.notices(), store.read("matches")
    chosen = reports.sheet_notices(n, m, size, seed)
    by: dict[str, list] = {}
    for r in reports.sheet_candidates(chosen, m, store.read("awards")).orderBy("notice_id", "at").collect():
        by.setdefault(r["notice_id"], []).append(r)
    fields = dict(zip(files.CANDIDATE_COLUMNS, ("piid", "recipient_name", "value", "ends", "awarding_office_name", "description", "reasons", "usaspending_url", "award_key"), strict=True))
    rows = []
    for r in n.join(chosen, "notice_id").collect():
        row = {"notice_id": r["notice_id"], "sam_link": r["ui_link"], "title": r["title"], "agency": r["full_parent_path_name"], "deadline": r["response_deadline"], "solicitation_number": r["solicitation_number"]}
        for i, c in enumerate(reports.shuffled(by.get(r["notice_id"], []), seed, r["notice_id"]), start=1):
            row |= {f"c{i}_{k}": "; ".join(c[f] or []) if k == "why" else c[f] for k, f in fields.items()}
        rows.append(row)
    files.write_sheet(rows, files.sheet_columns(reports.PER_NOTICE), out)


if __name__ == "__main__":
    raise SystemExit(main())
