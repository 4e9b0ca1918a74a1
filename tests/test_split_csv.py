"""Ranges of quoted CSV files and members of zips against one reader for the whole."""

from __future__ import annotations

import csv
import io
import random
import zipfile

import pytest

from bidweave.sources import split_csv

PIECES = ["a", "bc", ",", '"', '""', "\n", "\r\n", "\r", " ", "é", "€", "x" * 9, ""]


def fuzzed(rng, rows, columns, end, encoding):
    """A file in which some fields are quoted, whatever they hold, and others hold quotes as letters; and its rows."""
    lines, want = [], []
    for _ in range(rows):
        fields, values = [], []
        for _ in range(columns):
            text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(6)))
            plain = text.replace(",", "").replace("\n", "").replace("\r", "").lstrip('"')
            if rng.random() < 0.6:
                fields.append('"' + text.replace('"', '""') + '"')
                values.append(text or None)
            else:
                fields.append(plain)
                values.append(plain or None)
        if len(fields) > 1 or fields[0]:
            lines.append(",".join(fields))
            want.append(tuple(values))
    head = ",".join(f"c{i}" for i in range(columns))
    return (head + end + end.join(lines) + rng.choice(["", end])).encode(encoding), want


def read(path, size):
    """All ranges of a file, one after the other, as the tasks do it."""
    with open(path, "rb") as source:
        total = source.seek(0, 2)
        cuts = sorted({split_csv.cut_at(source, k, total) for k in range(0, total + size, size)})
        rows, inside, parts = [], False, []
        for start, end in zip(cuts, cuts[1:], strict=False):
            parts.append(split_csv.Span(start, end, inside))
            source.seek(max(0, start - 1))
            before = source.read(1) if start else b"\n"
            source.seek(start)
            inside = split_csv.ends_inside(source.read(end - start), before, inside)
        for part in parts:
            found = split_csv.records(source, part)
            if part.start == 0:
                next(found)
            rows += [r for b in split_csv._rows((x.decode("cp1252", "replace") for x in found), [(c, i) for i, c in enumerate('abc')]) for r in zip(*b.to_pydict().values(), strict=True)]
    return rows


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_ranges_of_any_size_give_the_same_rows(tmp_path, monkeypatch, end):
    monkeypatch.setattr(split_csv, "MORE", 7)
    rng = random.Random(end)
    for case in range(60):
        data, want = fuzzed(rng, rng.randrange(1, 14), 3, end, "cp1252")
        path = tmp_path / f"{case}.csv"
        path.write_bytes(data)
        assert [tuple(v or None for v in r) for r in csv.reader(io.StringIO(data.decode("cp1252"), newline=""))][1:] == want
        for size in (1, 2, 3, 5, 11, 40, 10_000):
            assert read(path, size) == want, (case, size, data)


def test_tasks_read_ranges(spark, tmp_path):
    rng = random.Random(3)
    data, want = fuzzed(rng, 3000, 3, "\r\n", "cp1252")
    path = tmp_path / "big.csv"
    path.write_bytes(data + b'\r\n"broken \x81",short')
    got = split_csv.read_split(spark, str(path), "cp1252", range_bytes=(len(data) + 30) // 8 + 1)
    assert got.rdd.getNumPartitions() == 8 and got.columns == ["c0", "c1", "c2"]
    rows = [tuple(r) for r in got.collect()]
    assert rows == [*want, ("broken �", "short", None)]
    # The one-task reader agrees where quotes stand around fields only.
    plain = [[f"{i}", 'say "x", é\nnext' if i % 3 else "", None if i % 5 else "€"] for i in range(500)]
    with open(tmp_path / "p.csv", "w", encoding="cp1252", newline="") as out:
        csv.writer(out, quoting=csv.QUOTE_NOTNULL).writerows([["a", "b#", "c"], *plain])
    ours = split_csv.read_split(spark, f"file://{tmp_path}/p.csv", "cp1252", range_bytes=1000)
    theirs = spark.read.options(header=True, multiLine=True, quote='"', escape='"', encoding="windows-1252").csv(str(tmp_path / "p.csv"))
    assert ours.columns == theirs.columns and ours.rdd.getNumPartitions() > 8
    assert sorted(map(str, ours.collect())) == sorted(map(str, theirs.collect())) and ours.count() == 500
    assert split_csv.read_split(spark, str(tmp_path / "p.csv"), wanted=["c", "zzz", "a"]).columns == ["c", "a"]


def test_odd_files(spark, tmp_path):
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfa,b,a\n1,2,3\n\n\n4\n5,6,7,8\n")
    assert [tuple(r) for r in split_csv.read_split(spark, str(tmp_path / "bom.csv"), wanted=["a", "b"]).collect()] == [("1", "2"), ("4", None), ("5", "6")]
    (tmp_path / "open.csv").write_bytes(b'a,b\n1,"never closed\n2,3\n')
    assert [tuple(r) for r in split_csv.read_split(spark, str(tmp_path / "open.csv")).collect()] == [("1", "never closed\n2,3\n")]
    (tmp_path / "head.csv").write_bytes(b"a,b\n")
    assert split_csv.read_split(spark, str(tmp_path / "head.csv")).count() == 0
    (tmp_path / "none.csv").write_bytes(b"")
    with pytest.raises(ValueError, match="none of the columns"):
        split_csv.read_split(spark, str(tmp_path / "none.csv"))


def test_overlong_records_are_an_error(tmp_path, monkeypatch):
    monkeypatch.setattr(split_csv, "LONGEST", 50)
    monkeypatch.setattr(split_csv, "MORE", 20)
    (tmp_path / "x.csv").write_bytes(b'a\n"' + b"y" * 500)
    with open(tmp_path / "x.csv", "rb") as source, pytest.raises(ValueError, match="left open"):
        list(split_csv.records(source, split_csv.Span(0, 4, False)))


def test_members_run_side_by_side(spark, tmp_path):
    def text(names, rows):
        out = io.StringIO(newline="")
        csv.writer(out).writerows([names, *rows])
        return "﻿" + out.getvalue()

    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("b.csv", text(["other", "key"], [["x\r\ny", f"b{i}"] for i in range(9000)]))
        z.writestr("a/a.CSV", text(["key", "value"], [["a0", 'q"uote'], ["a1", ""], ["a2"]]))
        z.writestr("notes.csv", text(["nothing"], [["1"]]))
        z.writestr("empty.csv", "")
        z.writestr("readme.txt", "key")
    found, others, missing = split_csv.members(str(tmp_path / "z.zip"), ["key", "value"], "key")
    assert [m.name for m in found] == ["a/a.CSV", "b.csv"] and others == ["empty.csv", "notes.csv"] and missing == {"b.csv": ["value"]}
    df = split_csv.read_members(spark, found, ["key", "value"])
    assert df.rdd.getNumPartitions() == 2 and df.count() == 9003
    assert sorted(map(tuple, df.where("key like 'a%'").collect())) == [("a0", 'q"uote'), ("a1", None), ("a2", None)]
    assert split_csv.read_members(spark, [], ["key"]).columns == ["key"]
    assert [p.name for p in tmp_path.iterdir()] == ["z.zip"]  # nothing was unpacked
