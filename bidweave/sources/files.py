"""Raw archives, label sheets and byte-exact files: thin, driver-side, for bounded data."""

from __future__ import annotations

import csv
import gzip
import hashlib
import io
import os
import re
import shutil
from collections.abc import Iterable, Mapping, Sequence
from datetime import UTC, date, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave import schemas

_SECRET = re.compile(r"(?i)(api[_-]?key|token|password|secret|authorization)")


def redact_params(params: Mapping[str, object]) -> dict[str, str]:
    """Parameters with secrets blotted out."""
    return {k: "***" if _SECRET.search(k) else str(v) for k, v in params.items()}


def redact_url(url: str) -> str:
    return re.sub(r"([?&])([^=&#]+)=([^&#]*)", lambda m: f"{m[1]}{m[2]}={'***' if _SECRET.search(m[2]) else m[3]}", url)


def redact_text(text: str, secrets: Iterable[str] = ()) -> str:
    for s in secrets:
        if s:
            text = text.replace(s, "***")
    return redact_url(text)


def _archived_path(root: str, source: str, digest: str, suffix: str, now: datetime) -> Path:
    now = now.astimezone(UTC)
    path = Path(root) / source / now.strftime("%Y/%m/%d") / f"{now:%H%M%S%f}_{digest[:12]}{suffix}"
    path.parent.mkdir(parents=True, exist_ok=True)
    return path


def _metadata(root: str, path: Path, source: str, digest: str, size: int, now: datetime, params: Mapping[str, object] | None, run_id: int | None) -> dict:
    relative = str(path.relative_to(root))
    return {"path": relative, "source": source, "sha256": digest, "bytes": size, "fetched_at": now.astimezone(UTC), "request_params": redact_params(params or {}), "run_id": run_id}


def archive_bytes(root: str, source: str, content: bytes, suffix: str, now: datetime, params: Mapping[str, object] | None = None, run_id: int | None = None) -> dict:
    """Store raw bytes once, under their time and hash, by an atomic rename; returns the file's metadata row."""
    digest = hashlib.sha256(content).hexdigest()
    path = _archived_path(root, source, digest, suffix, now)
    part = path.with_name(path.name + ".part")
    part.write_bytes(content)
    os.replace(part, path)
    return _metadata(root, path, source, digest, len(content), now, params, run_id)


def hash_file(path: str) -> tuple[str, int]:
    """A file's SHA-256 and size, a megabyte at a time."""
    digest, size = hashlib.sha256(), 0
    with open(path, "rb") as lines:
        while block := lines.read(1 << 20):
            digest.update(block)
            size += len(block)
    return digest.hexdigest(), size


def archive_file(root: str, source: str, path: str, suffix: str, now: datetime, params: Mapping[str, object] | None = None, run_id: int | None = None) -> dict:
    """Move a downloaded file into the archive; returns its metadata row."""
    digest, size = hash_file(path)
    target = _archived_path(root, source, digest, suffix, now)
    part = target.with_name(target.name + ".part")
    shutil.move(path, part)  # may cross file systems; the rename that shows it does not
    os.replace(part, target)
    return _metadata(root, target, source, digest, size, now, params, run_id)


def read_archived(root: str, path: str) -> bytes:
    """A stored file's bytes, unpacked if gzipped."""
    raw = (Path(root) / path).read_bytes()
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def already_loaded(raw_files: DataFrame, runs: DataFrame, source: str, url: str, sha256: str) -> bool:
    """Whether a succeeded run has loaded the file that this place had, by the hash of the whole file."""
    done = runs.where(F.col("status") == "succeeded").select(F.col("id").alias("run_id"))
    same = (F.col("source") == source) & (F.col("request_params")["url"] == url) & (F.col("request_params")["file_sha256"] == sha256)
    return bool(raw_files.where(same).join(done, "run_id", "left_semi").take(1))


def quoted_csv(header: Sequence[str], rows: Iterable[Sequence[str]]) -> bytes:
    """UTF-8 CSV with every field quoted and CRLF ends."""
    out = io.StringIO()
    writer = csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\r\n")
    writer.writerow(header)
    writer.writerows(rows)
    return out.getvalue().encode()


def gzip_bytes(content: bytes) -> bytes:
    """Gzip that depends on the content alone."""
    return gzip.compress(content, mtime=0)


def write_sheet(rows: Sequence[Mapping[str, object]], columns: Sequence[str], path: str) -> None:
    """A spreadsheet's CSV: UTF-8 with a byte-order mark."""
    with open(path, "w", encoding="utf-8-sig", newline="") as out:
        writer = csv.DictWriter(out, columns)
        writer.writeheader()
        writer.writerows({k: "" if r.get(k) is None else r[k] for k in columns} for r in rows)


#: Columns of a labelling sheet, those of each candidate, and what answers mean.
SHEET_COLUMNS = ("notice_id", "sam_link", "title", "agency", "deadline", "solicitation_number")
CANDIDATE_COLUMNS = ("contract", "company", "value", "ends", "office", "description", "why", "link", "id")
CHOICES = {"none": "none", "other": "other", "unsure": "unsure", "": "unsure"}


def sheet_columns(candidates: int = 5) -> list[str]:
    """All columns of a labelling sheet, in order."""
    own = [f"c{i}_{name}" for i in range(1, candidates + 1) for name in CANDIDATE_COLUMNS]
    return [*SHEET_COLUMNS, *own, "answer", "notes"]


def read_answers(path: str, source: str, today: date) -> list[dict]:
    """Labels from a filled sheet: a candidate's number names the incumbent; else other, none, unsure (or nothing).

    Rows without notice_id are passed over. All problems are collected and raised at once.
    """
    problems, found = [], []
    with open(path, encoding="utf-8-sig", newline="") as lines:
        for n, row in enumerate(csv.DictReader(lines), start=2):
            cell = {k: (row.get(k) or "").strip() for k in ("notice_id", "answer", "notes")}
            said = cell["answer"].lower()
            if not cell["notice_id"]:
                continue
            award = (row.get(f"c{said}_id") or "").strip() if said.isdigit() else None
            if said.isdigit() and not award:
                problems.append(f"line {n}: candidate {said} is empty")
            elif award is None and said not in CHOICES:
                problems.append(f"line {n}: unknown answer {said!r}")
            else:
                answer = "incumbent" if award else CHOICES[said]
                found.append({"notice_id": cell["notice_id"], "award_key": award or None, "answer": answer, "source": source, "labeled_at": today, "notes": cell["notes"] or None})
    if problems:
        raise ValueError("; ".join(problems))
    return found


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """Stored labels; none if there is no file."""
    if not os.path.exists(path):
        return spark.createDataFrame([], schemas.table(schemas.LABEL_DDL))
    return spark.read.options(header=True, dateFormat="yyyy-MM-dd").schema(schemas.table(schemas.LABEL_DDL)).csv(path)


def save_labels(labels: DataFrame, path: str) -> None:
    """Labels (a bounded sheet) sorted by notice, with LF ends."""
    columns = labels.columns
    with open(path, "w", encoding="utf-8", newline="") as out:
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(columns)
        for r in labels.orderBy("notice_id").toLocalIterator():
            writer.writerow(["" if r[c] is None else r[c] for c in columns])
