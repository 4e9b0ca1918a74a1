"""Readers, merges, versioned notices, streams and files."""

from __future__ import annotations

import csv
import datetime as dt
import json
import random
import zipfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidweave import cli, control, jobs, schemas, store
from bidweave.operators import merge, rows, versions
from bidweave.operators.rows import cut
from bidweave.functions import normalize as N
from bidweave.sources import awards, files, notices, remote
from bidweave.streaming import ingest, windows

WHEN = dt.datetime(2026, 10, 6, 12, 30, 15, 123456, tzinfo=dt.UTC)


def award_file(path, *overrides, columns=awards.WANTED):
    base = {c: "" for c in columns} | {
        "contract_award_unique_key": "K1", "award_id_piid": "47QT-26-F-0001", "award_type_code": "C", "awarding_agency_code": "047", "awarding_agency_name": "GSA",
        "awarding_sub_agency_code": "4732", "awarding_sub_agency_name": "FAS", "awarding_office_code": "47QTCA", "awarding_office_name": "Office", "recipient_uei": "U1",
        "recipient_name": "Firm", "naics_code": "541512", "naics_description": "Design", "potential_total_value_of_award": "1000.50",
        "period_of_performance_potential_end_date": "2027-06-30", "last_modified_date": "2026-01-02 00:00:00+00", "women_owned_small_business": "t",
    }
    with open(path, "w", newline="") as out:
        writer = csv.DictWriter(out, columns, extrasaction="ignore")
        writer.writeheader()
        writer.writerows([base | o for o in overrides])
    return str(path)


def empty(spark, name):
    return spark.createDataFrame([], store.TABLES[name]())


def test_award_file_types_and_references(spark, tmp_path):
    p = award_file(
        tmp_path / "a.csv", {}, {"contract_award_unique_key": "K2", "number_of_offers_received": "3.0", "last_modified_date": "never", "potential_total_value_of_award": "x", "naics_code": "bad", "awarding_office_name": ""},
        {"contract_award_unique_key": "K1", "last_modified_date": "2025-01-01", "award_id_piid": "STALE"}, {"contract_award_unique_key": " "},
    )
    raw, missing = awards.read_award_csv(spark, p)
    assert missing == [] and awards.csv_header(spark, p) == list(awards.WANTED)
    got = {r["award_key"]: r for r in awards.typed_awards(raw).collect()}
    assert set(got) == {"K1", "K2"} and got["K1"]["piid_norm"] == "47QT26F0001" and got["K1"]["ultimate_end"] == dt.date(2027, 6, 30)
    assert got["K2"]["number_of_offers"] is None and got["K2"]["total_value"] is None and got["K2"]["last_modified"] is None
    refs = awards.reference_tables(raw, ("541512",))
    assert {tuple(r) for r in refs["offices"].collect()} == {("4732", "47QTCA", "Office")}
    assert {tuple(r) for r in refs["naics"].collect()} == {("541512", "Design", True)}
    assert refs["agencies"].count() == 2
    e = awards.entities(raw).collect()
    assert len(e) == 1 and json.loads(e[0]["business_types"]) == {"women_owned_small_business": True}
    stored = {n: empty(spark, n) for n in ("agencies", "offices", "naics", "entities", "awards")}
    loaded = awards.load_awards(stored, raw, ("541512",))
    assert {n: df.count() for n, df in loaded.items()} == {"agencies": 2, "offices": 1, "naics": 1, "entities": 1, "awards": 2}
    assert awards.seed_vertical_naics(loaded["naics"], ("541512", "541519")).where("in_vertical").count() == 2


def test_award_upsert_rules(spark, tmp_path):
    def merged(stored, *overrides):
        return awards.upsert_awards(stored, awards.read_award_csv(spark, award_file(tmp_path / "u.csv", *overrides))[0])

    first = merged(empty(spark, "awards"), {})
    assert first.count_written() == 1
    stored = first.result().cache()
    stored.count()
    assert merged(stored, {}).count_written() == 0
    older = merged(stored, {"last_modified_date": "2025-12-31", "award_id_piid": "OLD"})
    assert older.count_written() == 0 and older.result().first()["piid"] == "47QT-26-F-0001"
    assert merged(stored, {"award_id_piid": "SAME TIME"}).count_written() == 1
    assert merged(stored, {"last_modified_date": "", "award_id_piid": "NO TIME"}).count_written() == 0


def test_zip_and_bad_files(spark, tmp_path):
    a = award_file(tmp_path / "b.csv", {"contract_award_unique_key": "Z1"}, columns=("contract_award_unique_key", "award_id_piid", "extra"))
    (tmp_path / "c.csv").write_text("x,y\n1,2\n")
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.write(a, "b.csv")
        z.write(tmp_path / "c.csv", "c.csv")
    raw, missing, others = awards.read_award_files(spark, [str(tmp_path / "all.zip"), a, str(tmp_path / "c.csv")])
    assert raw.count() == 2 and sorted(others) == sorted([str(tmp_path / "c.csv"), "c.csv"]) and "recipient_uei" in missing["b.csv"]
    assert awards.read_award_files(spark, [str(tmp_path / "c.csv")])[0] is None
    assert "recipient_uei" in awards.read_award_csv(spark, a)[1]
    with pytest.raises(awards.NotAnAwardFileError):
        awards.read_award_csv(spark, str(tmp_path / "c.csv"))


def page(*records):
    return json.dumps({"totalRecords": len(records), "limit": 1000, "offset": 0, "opportunitiesData": list(records), "links": []})


RECORD = {
    "noticeId": "N1", "title": "Help  desk", "solicitationNumber": "AB-1", "postedDate": "2026-10-01", "type": "Solicitation", "reponseDeadLine": "2026-10-20T17:00:00-04:00",
    "naicsCode": "541512", "setAsideCode": "SBA", "department": "GSA", "subTier": "FAS", "office": "X", "active": "Yes", "resourceLinks": ["b", "a", None],
    "pointofContact": [{"type": "primary", "email": "x@y"}, None], "placeOfPerformance": {"state": {"code": "VA", "name": "Virginia"}}, "award": None, "novel": 1,
}


def test_api_pages(spark, tmp_path):
    (tmp_path / "p1.json").write_text(page(RECORD, "junk", {"title": "no id"}, {**RECORD, "noticeId": "N2", "responseDeadLine": "2026-10-21", "naicsCodes": ["541519", "541512"]}))
    records = notices.page_records(notices.read_pages(spark, str(tmp_path)))
    assert records.count() == 4 and {r[0] for r in notices.unknown_fields(records).collect()} == {"novel"}
    got = {r["notice_id"]: r for r in notices.parse_notices(records).collect()}
    a, b = got["N1"], got["N2"]
    assert a["response_deadline"] == dt.datetime(2026, 10, 20, 21) and a["response_deadline_has_time"] is True
    assert b["response_deadline_has_time"] is False and b["naics_codes"] == ["541519", "541512"] and a["naics_codes"] == ["541512"]
    assert a["full_parent_path_name"] == "GSA.FAS.X" and a["attachment_links"] == ["b", "a"] and len(a["contacts"]) == 1 and a["pop_state"] == "VA" and a["award"] is None


def extract(path, *overrides):
    base = {c: "" for c in schemas.NOTICE_CSV_COLUMNS} | {
        "NoticeId": "N1", "Title": "Help – desk", "Sol#": "AB-1", "CGAC": "047", "FPDS Code": "4732", "AAC Code": "47QTCA", "PostedDate": "2026-10-01 10:00:00.000-04",
        "Type": "Solicitation", "NaicsCode": "541512", "Active": "Yes", "ResponseDeadLine": "2026-10-20", "PopState": "VA", "PrimaryContactEmail": "x@y", "Description": 'line one\nsaid "two"',
    }
    with open(path, "w", newline="", encoding="cp1252") as out:
        w = csv.DictWriter(out, schemas.NOTICE_CSV_COLUMNS, quoting=csv.QUOTE_ALL)
        w.writeheader()
        w.writerows([base | o for o in overrides])
    return str(path)


def test_extract(spark, tmp_path):
    p = extract(tmp_path / "e.csv", {}, {"NoticeId": "N2", "NaicsCode": "111111"}, {"NoticeId": "null"}, {"NoticeId": "N3", "PostedDate": "2020-01-01"})
    raw = notices.read_extract(spark, p)
    assert raw.count() == 4
    kept = notices.extract_in_scope(raw, ("541512",), dt.date(2026, 1, 1))
    r = notices.parse_extract(kept).collect()
    assert [x["notice_id"] for x in r] == ["N1"]
    r = r[0]
    assert r["title"] == "Help – desk" and r["description"] == 'line one\nsaid "two"' and r["full_parent_path_code"] == "047.4732.47QTCA"
    assert r["attachment_links"] is None and r["award"] is None and r["contacts"][0]["email"] == "x@y" and r["place_of_performance"]["state"]["code"] == "VA"
    with pytest.raises(ValueError):
        notices.check_header(["NoticeId"])


def snapshots(spark, *rows):
    types = {f.name: f for f in schemas.notice()}
    made = [{**{f: None for f in types}, "description": None, "seq": i, **r} for i, r in enumerate(rows)]
    schema = schemas.notice().add("description", T.StringType()).add("seq", T.IntegerType())
    return versions.incoming_snapshots(spark.createDataFrame(made, schema))


def test_ordered_fold(spark):
    day = dt.datetime(2026, 10, 20)
    v1 = {"notice_id": "N", "title": "A  b", "response_deadline": day, "response_deadline_has_time": False, "psc": "D1", "description": " text "}
    batch = snapshots(
        spark, v1, v1, {**v1, "title": "A b"}, {**v1, "response_deadline": day.replace(hour=17), "response_deadline_has_time": True}, v1,
        {**v1, "attachment_links": ["x"]}, {**v1, "attachment_links": ["y"], "title": "New"}, {"notice_id": "M", "title": "other"}, {**v1, "psc": None},
    )
    none = spark.createDataFrame([], store.current_schema())
    steps = {r["seq"]: r for r in versions.fold(none, batch).steps.collect()}
    outcome = [(steps[i]["outcome"], steps[i]["version"]) for i in range(9)]
    # A title's spaces and a deadline's precision are no new version; a first list of links is a fill-in.
    assert outcome[:4] == [("inserted", 1), ("unchanged", 1), ("updated", 1), ("updated", 1)]
    assert outcome[5][0] == "updated" and outcome[6] == ("changed", 2) and outcome[7] == ("inserted", 1)
    assert {c["field"] for c in steps[6]["changes"]} == {"title", "attachment_links"}
    assert steps[4]["snapshot"]["response_deadline"] == day.replace(hour=17)
    assert steps[8]["outcome"] == "changed" and {c["field"] for c in steps[8]["changes"]} == {"title", "psc"} | ({"attachment_links"} if steps[8]["snapshot"]["attachment_links"] is None else set())
    done = versions.fold(none, batch)
    assert done.descriptions().count() == 1 and {r["notice_id"]: r["version"] for r in done.current().collect()} == {"N": 3, "M": 1}


def test_partial_source_never_blanks(spark):
    full = {"notice_id": "N", "title": "T", "psc": "D1", "contacts": [], "ui_link": "u", "description": "d"}
    none = spark.createDataFrame([], store.current_schema())
    stored = versions.fold(none, snapshots(spark, full)).current()
    part = snapshots(spark, {"notice_id": "N", "title": "T2", "psc": None, "ui_link": "other", "pop_state": "VA"})
    r = versions.fold(stored, part, versions.CSV_AUTHORITATIVE).steps.first()
    s = r["snapshot"]
    assert (s["title"], s["psc"], s["ui_link"], s["pop_state"], s["contacts"]) == ("T2", "D1", "u", "VA", [])
    assert s["description_sha256"] and [c["field"] for c in r["changes"]] == ["title"] and r["version"] == 2


def test_streams_equal_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    s = store.Store(spark, f"file://{tmp_path}/root")
    wide = [*(f"other_{i}" for i in range(120)), *reversed(awards.WANTED), *(f"more_{i}" for i in range(117))]  # 286 columns in another order
    award_file(folder / "1.csv", {"award_id_piid": "NEW", "last_modified_date": "2026-05-05", "prime_award_base_transaction_description": "two\nlines", "other_3": "x"}, columns=wide)
    (folder / "0.csv").write_text("x,y\n1,2\n")
    ingest.replay_awards(s, str(folder), str(tmp_path / "cp"), ("541512",))
    award_file(folder / "2.csv", {"award_id_piid": "LATE", "last_modified_date": "2026-01-01"}, {"contract_award_unique_key": "K9"})
    with zipfile.ZipFile(folder / "3.zip", "w") as z:
        z.write(award_file(tmp_path / "k8.csv", {"contract_award_unique_key": "K8"}), "k8.csv")
    ingest.replay_awards(s, str(folder), str(tmp_path / "cp"), ("541512",))
    assert {(r["award_key"], r["piid"], r["description"]) for r in s.read("awards").collect()} == {("K1", "NEW", "two\nlines"), ("K9", "47QT-26-F-0001", None), ("K8", "47QT-26-F-0001", None)}
    assert s.read("entities").count() == 1
    batch = snapshots(spark, {"notice_id": "N", "title": "a"}, {"notice_id": "N", "title": "b"})
    batch.write.parquet(str(tmp_path / "snap"))
    for _ in range(2):
        ingest.replay_snapshots(s, str(tmp_path / "snap"), batch.schema, str(tmp_path / "cp2"))
    assert s.read("notices").first()["version"] == 2 and s.read("notice_versions").count() == 2
    # A batch that was committed before its stream could note it changes nothing when it runs again.
    import shutil

    before, at = {str(r) for r in s.read("notice_versions").collect()}, s.last()
    shutil.rmtree(tmp_path / "cp2" / "commits")
    ingest.replay_snapshots(s, str(tmp_path / "snap"), batch.schema, str(tmp_path / "cp2"))
    assert s.last() == at and {str(r) for r in s.read("notice_versions").collect()} == before


def test_repeated_pages_cost_no_merge(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/root")
    folder = str(tmp_path / "snap")
    schema = snapshots(spark, {"notice_id": "N"}).withColumn("at", F.lit(WHEN)).schema

    def serve(seq, *titles, hours=0):
        rows = snapshots(spark, *({"notice_id": f"N{i}", "title": t} for i, t in enumerate(titles)))
        rows.withColumn("seq", F.col("seq") + seq).withColumn("at", F.lit(WHEN + dt.timedelta(hours=hours))).write.mode("append").parquet(folder)
        ingest.replay_snapshots(s, folder, schema, str(tmp_path / "cp"), at="at")
        return s.version("notices"), {r["notice_id"]: (r["version"], r["snapshot"]["title"]) for r in s.read("notices").collect()}

    first, _ = serve(0, "a", "b")
    second, now = serve(10, "a2", "b", hours=1)
    assert second > first and now == {"N0": (2, "a2"), "N1": (1, "b")}
    # Both pages again, the older one late: nothing is merged, and nothing changes.
    assert serve(20, "a", "b", hours=2) == (second, now) and serve(30, "a2", "b", hours=3) == (second, now)
    assert serve(40, "a3", hours=4)[1] == {"N0": (3, "a3"), "N1": (1, "b")}


def test_many_versions_of_one_notice(spark, monkeypatch):
    made = [{"notice_id": "N", "title": f"t{i // 3}", "psc": "D1"} for i in range(300)] + [{"notice_id": f"M{i}", "title": "x"} for i in range(20)]
    batch = snapshots(spark, *made).cache()
    none = spark.createDataFrame([], store.current_schema())
    done = versions.fold(none, batch).steps.collect()
    assert {r["notice_id"]: r["version"] for r in done if r["seq"] == 299} == {"N": 100} and len(done) == 320
    monkeypatch.setattr(versions, "FOLD_AT_ONCE", 64)
    again = versions.fold(none, batch).steps.collect()
    assert sorted(map(str, again)) == sorted(map(str, done))


@pytest.mark.parametrize("authoritative", [None, versions.CSV_AUTHORITATIVE, ("title", "psc")])
def test_windows_fold_as_steps_do(spark, authoritative):
    rng = random.Random(str(authoritative))
    day = dt.datetime(2026, 10, 20)

    def one(i):
        deadline = rng.choice([None, day, day.replace(hour=17), day.replace(hour=9), day + dt.timedelta(days=1)])
        told = None if deadline is None else rng.choice([deadline.hour > 0, deadline.hour > 0, True, False])
        if rng.random() < 0.05:
            told = rng.choice([None, True, False])  # at odds with the deadline
        return {
            "notice_id": f"N{i}", "title": rng.choice(["a", "a ", "b", None]), "psc": rng.choice([None, "D1", "D2"]), "description": rng.choice([None, "x", "y"]),
            "response_deadline": deadline, "response_deadline_has_time": told, "attachment_links": rng.choice([None, ["p"], ["p", "q"], ["q", "p"]]), "ui_link": rng.choice([None, "u", "v"]),
            "active": rng.choice([True, False, None]), "award": rng.choice([None, {"number": "A-1", "date": None, "amount": None, "awardee": None}]), "archive_date": rng.choice([None, dt.date(2026, 11, 1)]),
        }

    none = spark.createDataFrame([], store.current_schema())
    stored = cut(versions.fold(none, snapshots(spark, *(one(i) for i in range(30)))).current())
    made = [one(i) for i in range(60) for _ in range(rng.choice([1, 2, 3, 9]))]
    rng.shuffle(made)
    batch = snapshots(spark, *made).cache()
    w = Window.partitionBy("notice_id").orderBy("seq")
    numbered = cut(batch.withColumn("_k", F.row_number().over(w) - 1))
    state = stored.select("notice_id", F.col("version").alias("_v"), F.col("snapshot").alias("_s"))
    want = versions._fold_rows(numbered, state, authoritative)
    got = versions.fold(stored, batch, authoritative).steps
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and got.count() == len(made)


def test_window_stream(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    events = spark.createDataFrame([(t + dt.timedelta(minutes=m), m % 2, float(m)) for m in range(0, 90, 10)], "ts timestamp, k int, v double")
    events.write.parquet(str(tmp_path / "ev"))
    batch = {tuple(r) for r in windows.tumbling(events, "ts", "30 minutes", ["k"], "v").collect()}
    stream = windows.tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")), "ts", "30 minutes", ["k"], "v", "5 minutes")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("wins").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("wins").collect()} == batch
    assert windows.sessions(events, "ts", "15 minutes", ["k"], "v").count() == 1


def test_chunks(spark):
    chunks = spark.createDataFrame([], schemas.table(schemas.CHUNK_DDL))
    chunks = control.save_chunk(chunks, "s", "c", "in_progress", {"page": "1"}, 5, 2)
    r = control.save_chunk(chunks, "s", "c", "done", {}, 3, 1).collect()
    assert [(x["status"], x["rows_in"], x["rows_out"]) for x in r] == [("done", 8, 3)]


def test_row_helpers(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 1, "c")], "k int, v int, x string")
    assert {tuple(r) for r in rows.latest(df, ["k"], "v", "x").collect()} == {(1, None), (2, "c")}
    found = spark.createDataFrame([("n", "a", "m2"), ("n", "a", "m1"), ("n", "b", "m1"), ("o", "a", "m1")], "n string, a string, m string")
    assert {tuple(r) for r in rows.links_within(found, "n", ["n", "a"], "m", 2).collect()} == {("o", "a", "m1")}


def test_files(spark, tmp_path):
    meta = files.archive_bytes(str(tmp_path), "src", files.gzip_bytes(b"hello"), ".json.gz", WHEN, {"api_key": "s3cret", "q": 1})
    assert meta["path"].startswith("src/2026/10/06/123015123456_") and meta["request_params"] == {"api_key": "***", "q": "1"}
    assert files.read_archived(str(tmp_path), meta["path"]) == b"hello"
    assert files.quoted_csv(["a", "b"], [["1", 'x"y']]) == b'"a","b"\r\n"1","x""y"\r\n'
    assert files.redact_text("see http://x/?api_key=abc&y=2 tok", ["tok"]) == "see http://x/?api_key=***&y=2 ***"
    (tmp_path / "down.zip").write_bytes(b"zip")
    moved = files.archive_file(str(tmp_path), "src", str(tmp_path / "down.zip"), ".zip", WHEN, {"token": "t"}, 7)
    assert files.read_archived(str(tmp_path), moved["path"]) == b"zip" and moved["bytes"] == 3 and moved["run_id"] == 7 and not (tmp_path / "down.zip").exists()
    sheet = tmp_path / "s.csv"
    answers = [{"notice_id": "N1", "c1_id": "A", "answer": "1"}, {"notice_id": "N2", "answer": "None"}, {"notice_id": "N3"}, {"answer": "nonsense"}]
    files.write_sheet(answers, files.sheet_columns(), str(sheet))
    assert sheet.read_bytes().startswith(b"\xef\xbb\xbf")
    got = files.read_answers(str(sheet), "sheet", dt.date(2026, 1, 1))
    assert [(g["notice_id"], g["award_key"], g["answer"]) for g in got] == [("N1", "A", "incumbent"), ("N2", None, "none"), ("N3", None, "unsure")]
    labels = spark.createDataFrame(got, schemas.table(schemas.LABEL_DDL))
    files.save_labels(labels, str(tmp_path / "l.csv"))
    assert files.load_labels(spark, str(tmp_path / "l.csv")).count() == 3 and files.load_labels(spark, str(tmp_path / "no.csv")).count() == 0
    files.write_sheet([{"notice_id": "N", "answer": "maybe"}, {"notice_id": "O", "answer": "2"}], ["notice_id", "answer"], str(sheet))
    with pytest.raises(ValueError, match="line 2: unknown answer.*line 3: candidate 2 is empty"):
        files.read_answers(str(sheet), "sheet", dt.date(2026, 1, 1))
    raw = spark.createDataFrame([("p", "s", "other", 1, None, {"url": "u", "file_sha256": "h"}, 1)], schemas.table(schemas.RAW_FILE_DDL))
    runs = spark.createDataFrame([(1, "s", "j", "succeeded", {}, None, None, None, 0, 0, 0)], schemas.table(schemas.RUN_DDL))
    assert files.already_loaded(raw, runs, "s", "u", "h") and not files.already_loaded(raw, runs, "s", "u", "x") and not files.already_loaded(raw, runs, "s", "v", "h")
    assert not files.already_loaded(raw, runs.withColumn("status", F.lit("failed")), "s", "u", "h")


def quiet(*_):
    pass


def test_whole_jobs(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/root")
    with control.running(s, "x", "files", str(tmp_path / "arc"), log=quiet) as run:
        path = award_file(tmp_path / "a.csv", {"period_of_performance_potential_end_date": "2027-01-15", "potential_total_value_of_award": "100000"})
        assert jobs.load_award_paths(run, [path], ("541512",)) == (1, 1)
        assert jobs.load_award_paths(run, [path], ("541512",)) == (1, 0)
    raw = notices.read_extract(spark, extract(tmp_path / "e.csv", {}))
    incoming = notices.parse_extract(raw).withColumn("seq", F.lit(1))
    assert jobs.fold_notices(s, incoming, versions.CSV_AUTHORITATIVE) == {"inserted": 1}
    assert jobs.fold_notices(s, incoming, versions.CSV_AUTHORITATIVE) == {"unchanged": 1}
    first = jobs.run_match(s, cli.MatchingConfig(), ("541512",), dt.date(2026, 10, 6))
    assert (first["notices"], first["with_candidates"], first["written"], first["deleted"]) == (1, 1, 1, 0)
    again = jobs.run_match(s, cli.MatchingConfig(), ("541512",), dt.date(2026, 10, 6))
    assert (again["written"], again["deleted"], again["links_written"]) == (0, 0, 0)
    cli.write_label_sheet(s, str(tmp_path / "sheet.csv"), 10, "m2")
    with open(tmp_path / "sheet.csv", encoding="utf-8-sig", newline="") as lines:
        rows = list(csv.DictReader(lines))
    assert [r["c1_id"] for r in rows] == ["K1"] and list(rows[0]) == files.sheet_columns()
    rows[0]["answer"] = "1"
    files.write_sheet(rows, files.sheet_columns(), str(tmp_path / "sheet.csv"))
    assert [g["award_key"] for g in files.read_answers(str(tmp_path / "sheet.csv"), "sheet", dt.date(2026, 1, 1))] == ["K1"]


def test_runs_are_recorded(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/root")
    archive = str(tmp_path / "arc")
    with pytest.raises(KeyError), control.running(s, "x", "j", archive, {"a": 1}, quiet) as run:
        run.rows_in += 5
        raise KeyError("boom")
    with control.running(s, "x", "j", archive, log=quiet) as run, pytest.raises(control.JobRunningError), control.running(s, "x", "j", archive, log=quiet):
        pass
    with control.running(s, "x", "j", archive, log=quiet) as run:
        run.keep_bytes(b"abc", ".json", {"password": "p"})
        run.save_chunk("c", "in_progress", {"next_page": 2}, 3, 1)
        run.save_chunk("c", "done", {"next_page": 3}, 4, 0)
        raise control.BudgetExhaustedError("enough")
    got = {r["id"]: r for r in s.read("runs").collect()}
    assert [(got[i]["status"], got[i]["rows_in"]) for i in (1, 2, 3)] == [("failed", 5), ("succeeded", 0), ("partial", 0)]
    assert "boom" in got[1]["error"] and got[1]["params"] == {"a": "1"} and got[3]["error"] == "enough"
    assert run.chunk("c") == ("done", {"next_page": "3"}) and run.chunk("d") is None
    assert s.read("raw_files").first()["request_params"] == {"password": "***"} and s.read("chunks").first()["rows_in"] == 7
    # A run that died leaves a row that says it is running; the next one closes it.
    s.write("runs", s.read("runs").withColumn("status", F.when(F.col("id") == 3, "running").otherwise(F.col("status"))))
    with control.running(s, "x", "j", archive, log=quiet):
        pass
    assert {r["id"]: r["status"] for r in s.read("runs").collect()} == {1: "failed", 2: "succeeded", 3: "failed", 4: "succeeded"}


def test_command_line(spark, tmp_path, capsys):
    root = f"file://{tmp_path}/root"
    path = award_file(tmp_path / "a.csv", {"period_of_performance_potential_end_date": "2027-06-15", "potential_total_value_of_award": "100000"})

    def run(*words):
        assert cli.main(["--root", root, "--archive", str(tmp_path / "arc"), "--today", "2026-10-06", *words]) == 0
        return capsys.readouterr().out

    assert run("version").strip() == cli.VERSION
    assert "1 rows, 1 awards written" in run("ingest-awards", path)
    assert "'inserted': 1" in run("ingest-extract", extract(tmp_path / "e.csv", {})) and "is loaded" in run("ingest-extract", str(tmp_path / "e.csv"))
    assert "'written': 1" in run("match")
    run("recompetes")
    s = store.Store(spark, root)
    assert s.read("recompetes").count() == 1
    status = run("status")
    assert "sam/extract: succeeded" in status and "usaspending/files: succeeded" in status and "awards: 1" in status
    assert "in_scope: 1" in run("diagnose") and "matches: version" in run("doctor")
    key = s.read("matches").where("kind = 'incumbent'").first()
    run("review", key["notice_id"], key["award_key"], "confirmed", "--reviewer", "me")
    run("label-sheet", str(tmp_path / "sheet.csv"))
    report = run("eval", "--labels", str(tmp_path / "none.csv"), "--report", str(tmp_path / "report.md"))
    assert "A precision of 90%" in report and (tmp_path / "report.md").read_text() in report
    run("reset")
    assert s.read("matches").count() == 1  # the confirmed one


def test_samples_and_texts(spark):
    a = [{"noticeId": "1"}, {"noticeId": "2"}]
    assert [jobs.counted_in(a, b) for b in ([{"noticeId": "2"}], [{"noticeId": "3"}], [{"noticeId": "3"}, {"noticeId": "1"}], [])] == ["records", "pages", "pages that overlap", "too few records to tell"]
    report = jobs.header_report([*awards.WANTED[1:], "novel"])
    assert report == {"missing": [awards.WANTED[0]], "new": ["novel"]}
    assert N.api_date(dt.date(2026, 2, 3)) == "02/03/2026"
    df = spark.createDataFrame([("1234567.5", dt.datetime(2026, 10, 6), "0.125", "12"), (" ", None, None, "12x"), ("x", None, "0.974", "1" * 19), ("-3", None, "y", "")], "a string, d timestamp, p string, i string")
    got = df.select(N.usd("a"), N.long_date("d"), N.percent("p"), N.numeric_id("i")).collect()
    assert [tuple(r) for r in got] == [("$1,234,568", "Oct 6, 2026", "13%", "12"), ("Not stated", "Not stated", "–", None), ("Not stated", "Not stated", "97%", None), ("-$3", "Not stated", "–", None)]
