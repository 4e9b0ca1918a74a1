"""The matcher, history links, recompetes and reports on a small world with known answers."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bidweave import schemas
from bidweave.config import MatchingConfig
from bidweave.operators.merge import VersionedTable
from bidweave.plans import history, match, recompetes, reports
from bidweave.sources.notices import stored_columns

VERTICAL = ("541611", "541690")
TODAY = dt.date(2025, 3, 10)
CFG = MatchingConfig()
NOTICE = {
    "title": "Payroll modernisation advice", "type": "Combined Synopsis/Solicitation", "posted_at": dt.datetime(2025, 3, 3), "response_deadline": dt.datetime(2025, 4, 15, 12),
    "response_deadline_has_time": True, "naics": "541611", "naics_codes": ["541611"], "psc": "R408", "set_aside_code": "WOSB", "full_parent_path_code": "036.3600.36C10B", "active": True,
}
AWARD = {
    "award_type_code": "B", "awarding_sub_agency_code": "3600", "awarding_office_code": "36C10B", "awarding_office_name": "Purchasing Desk", "naics": "541611", "psc": "R408",
    "set_aside_code": "WOSB", "total_value": Decimal(640_000), "ultimate_end": dt.date(2025, 6, 20), "description": "PAYROLL ADVICE AND TRAINING", "recipient_uei": "UEIX",
}


def rows_of(schema, base, made):
    """Rows of a schema: what is common, and what each has of its own."""
    return [{f.name: None for f in schema} | base | own for own in made]


def awards_of(*made):
    def plain(x):
        return x.replace("-", "") if x else None

    out = rows_of(schemas.award(), AWARD, ({"piid": own["award_key"]} | own for own in made))
    for r in out:
        r |= {"piid_norm": plain(r["piid"]), "referenced_idv_piid_norm": plain(r["referenced_idv_piid"]), "solicitation_id_norm": plain(r["solicitation_id"])}
    return out


@pytest.fixture(scope="module")
def world(spark):
    asked = [
        {"notice_id": "adv", "solicitation_number": "36C10B-25-R-0031"},
        {"notice_id": "map", "title": "Coastal survey drones", "full_parent_path_code": "014.1400.140L06", "solicitation_number": "140L0625R0009"},
        {"notice_id": "closed", "active": False, "solicitation_number": "36C10B-24-Q-0450"},
        {"notice_id": "given", "type": "Award Notice", "active": False, "award": {"number": "36C10B-19-D-0007", "date": None, "amount": None, "awardee": None}},
        {"notice_id": "stale", "archive_date": dt.date(2025, 3, 9)},
    ]
    held = [
        {"award_key": "PAY1", "referenced_idv_piid": "GS00Q17D0042"},
        {"award_key": "LAPTOPS", "ultimate_end": dt.date(2025, 1, 5), "description": "LAPTOP PURCHASE", "naics": "541690", "psc": "7435"},
        {"award_key": "FAR", "awarding_sub_agency_code": "9999", "awarding_office_code": "Z"},
        {"award_key": "GS00Q17D0042", "award_type_code": "IDV_A", "ultimate_end": dt.date(2031, 1, 1)},
        {"award_key": "OTHERIDV20D0001", "award_type_code": "IDV_B", "awarding_sub_agency_code": "9999", "ultimate_end": dt.date(2031, 1, 1)},
        {"award_key": "PAY2", "referenced_idv_piid": "OTHERIDV20D0001", "description": "SERVER ROOM COOLING"},
        {"award_key": "140L0620C0015", "award_type_code": "D", "awarding_sub_agency_code": "1400", "awarding_office_code": "140L06", "ultimate_end": dt.date(2028, 1, 1), "description": "SURVEY DRONES"},
        {"award_key": "TAKEN", "solicitation_id": "36C10B24Q0450", "ultimate_end": dt.date(2030, 1, 1)},
        {"award_key": "OTHERS", "solicitation_id": "36C10B24Q0450", "ultimate_end": dt.date(2030, 1, 1), "awarding_sub_agency_code": "9999"},
        {"award_key": "36C10B19D0007", "ultimate_end": dt.date(2023, 1, 1)},
    ]
    told = [
        ("adv", 1, "Work is ordered under GS00Q17D0042 or OTHERIDV-20-D-0001. The budget is $0.7 million."),
        ("map", 1, "older"),
        ("map", 2, "This is a recompete of 140L06-20-C-0015, now a bridge."),
    ]
    return {
        "notices": stored_columns(spark.createDataFrame(rows_of(schemas.notice(), NOTICE, asked), schemas.notice())).cache(),
        "awards": spark.createDataFrame(awards_of(*held), schemas.award()).cache(),
        "descriptions": spark.createDataFrame(told, "notice_id string, version int, text string").cache(),
        "none": spark.createDataFrame([], schemas.match()),
    }


def run(w, previous=None):
    return match.match(w["notices"], w["awards"], w["descriptions"], w["none"] if previous is None else previous, CFG, VERTICAL, TODAY)


@pytest.fixture(scope="module")
def found(spark, world, tmp_path_factory):
    # Later runs take earlier results as finished snapshots, never as plans.
    path = f"file://{tmp_path_factory.mktemp('found')}/m"
    run(world).write.parquet(path)
    return spark.read.schema(schemas.match()).parquet(path)


def test_known_answers(found):
    rows = {(r["notice_id"], r["award_key"]): r for r in found.collect()}
    assert set(rows) == {("adv", "PAY1"), ("adv", "LAPTOPS"), ("adv", "PAY2"), ("map", "140L0620C0015")}
    first = rows["adv", "PAY1"]
    assert (first["shown"], first["rank"], first["method"]) == ("incumbent", 1, "candidate")
    assert rows["adv", "LAPTOPS"]["shown"] == "hidden" and rows["adv", "PAY2"]["evidence"]["features"]["vehicle"] == 1.0
    cited = rows["map", "140L0620C0015"]
    assert (cited["method"], cited["shown"], cited["score"]) == ("explicit_reference", "incumbent", Decimal("0.9700"))
    assert cited["evidence"]["cited_as"] == "140L06-20-C-0015" and cited["evidence"]["context_words"] == ["bridge", "recompete"]
    reasons = first["evidence"]["reasons"]
    assert reasons[0] == "Same contracting office (Purchasing Desk)" and "Current contract ends Jun 2025, 2 months after the response deadline" in reasons
    assert "Contract value is in line with the amount in the notice" in reasons


def test_save_is_idempotent_and_spares_reviews(world, found):
    facts = match.notice_facts(world["notices"], world["descriptions"], CFG, VERTICAL, TODAY)
    table, counts = match.save(world["none"], facts, found)
    assert tuple(counts.first()) == (4, 0)
    again, counts = match.save(table, facts, found)
    assert tuple(counts.first()) == (0, 0) and again.count() == 4
    fewer, counts = match.save(table, facts, found.where("award_key <> 'LAPTOPS'"))
    assert tuple(counts.first()) == (0, 1) and fewer.count() == 3
    judged = table.withColumn("status", F.when(F.col("award_key") == "LAPTOPS", "rejected").otherwise(F.col("status")))
    kept, counts = match.save(judged, facts, found.where("award_key <> 'LAPTOPS'"))
    assert tuple(counts.first()) == (0, 0) and kept.count() == 4
    assert match.reset_automatic(judged).count() == 1


def test_reviews_change_decisions(world, found):
    def judged(key, status):
        return world["none"].unionByName(found.where(F.col("award_key") == key).withColumn("status", F.lit(status)))

    rows = {r["award_key"]: r for r in run(world, judged("PAY1", "rejected")).where("notice_id = 'adv'").collect()}
    assert "PAY1" not in rows and rows["PAY2"]["rank"] == 2 and rows["PAY2"]["shown"] in ("possible", "incumbent")
    rows = run(world, judged("LAPTOPS", "confirmed")).where("notice_id = 'adv'").collect()
    assert {r["shown"] for r in rows} == {"hidden"} and "LAPTOPS" not in {r["award_key"] for r in rows}


def superseded(world, found, key):
    """A snapshot in which the closed, already awarded notice has replaced an award."""
    done = found.where("award_key = 'PAY1'").withColumns({"notice_id": F.lit("closed"), "award_key": F.lit(key)})
    return done.unionByName(done.withColumns({"kind": F.lit("resulting_award"), "award_key": F.lit("TAKEN")}))


def test_superseded_awards_go(world, found):
    rows = run(world, superseded(world, found, "PAY1")).where("notice_id = 'adv'").collect()
    assert {r["award_key"] for r in rows} == {"LAPTOPS", "PAY2"}
    # A vehicle of another agency goes too, and with it what it spoke for.
    features = {r["award_key"]: r["evidence"]["features"]["vehicle"] for r in run(world, superseded(world, found, "OTHERIDV20D0001")).where("notice_id = 'adv'").collect()}
    assert features == {"PAY1": 1.0, "PAY2": 0.0, "LAPTOPS": 0.0}
    # The notice that replaced it keeps it, unless another one has it as well.
    gone = match.excluded_awards(superseded(world, found, "PAY1"))
    pairs = found.sparkSession.createDataFrame([("closed", "PAY1"), ("adv", "PAY1"), ("closed", "TAKEN"), ("adv", "TAKEN")], "notice_id string, award_key string")
    assert {tuple(r) for r in gone.without(pairs).collect()} == {("closed", "PAY1"), ("adv", "TAKEN")}


def test_history_links(world):
    links = history.find_links(world["notices"], world["awards"], VERTICAL)
    assert {tuple(r) for r in links.collect()} == {("closed", "TAKEN", "same_solicitation"), ("given", "36C10B19D0007", "award_notice_number")}
    rows = history.link_rows(links, world["awards"], "v1", world["none"])
    table, counts = history.save_links(world["none"], rows)
    assert tuple(counts.first()) == (2, 0) and tuple(history.save_links(table, rows)[1].first()) == (0, 0)
    assert tuple(history.save_links(table, rows.where("notice_id = 'closed'"))[1].first()) == (0, 1)
    assert history.find_links(world["notices"], world["awards"], VERTICAL, most=0).count() == 0


def test_recompetes_window(spark, world, found):
    edge = [("EARLY", dt.date(2025, 9, 9)), ("EDGE_IN", dt.date(2025, 9, 10)), ("LATE_IN", dt.date(2027, 3, 10)), ("LATE", dt.date(2027, 3, 11))]
    made = [{"award_key": k, "ultimate_end": d} for k, d in edge]
    made += [{"award_key": "IDC", "ultimate_end": None, "ordering_period_end": dt.date(2026, 1, 1), "award_type_code": "IDV_B", "recipient_name": "Own"}]
    made += [{"award_key": "CHEAP", "ultimate_end": dt.date(2026, 1, 1), "total_value": Decimal(24_999)}, {"award_key": "VEH", "award_type_code": "IDV_A", "ultimate_end": dt.date(2026, 1, 1)}]
    shown = found.where("award_key = 'PAY1'").withColumn("award_key", F.lit("EDGE_IN"))
    entities = spark.createDataFrame([("UEIX", "Known Name")], "uei string, name string")
    out = recompetes.recompetes(spark.createDataFrame(awards_of(*made), schemas.award()), entities, shown, world["notices"], CFG, VERTICAL, TODAY)
    assert {(r["award_key"], r["linked_notice_id"], r["recipient_name"]) for r in out.collect()} == {("EDGE_IN", "adv", "Known Name"), ("LATE_IN", None, "Known Name"), ("IDC", None, "Own")}


def test_scorecard_and_sheet(spark, world, found):
    labels = spark.createDataFrame([("adv", "PAY1", "incumbent"), ("map", None, "none"), ("X", "Y", "incumbent"), ("Z", None, "unsure")], "notice_id string, award_key string, answer string")
    c = reports.stored_candidates(found)
    card = reports.scorecards(labels, c, CFG, reports.thresholds(c, (0.8,))).first()
    assert (card["labeled"], card["shown"], card["correct"], card["with_incumbent"], card["found"], card["precision"], card["recall"]) == (3, 2, 1, 2, 1, 0.5, 0.5)
    none = reports.scorecards(labels.where("answer = 'unsure'"), c, CFG, reports.thresholds(c, (0.8,)))
    assert none.count() == 0
    check = reports.explicit_check(c, CFG).first()
    assert (check["notices"], check["ranked_first"]) == (1, 1)
    assert "| 0.80 | 3 | 2 | 1 | 50% | 50% | - |" in reports.render(reports.scorecards(labels, c, CFG, reports.thresholds(c, (0.8,))), reports.explicit_check(c, CFG), CFG, TODAY)
    chosen = reports.sheet_notices(world["notices"], found, 5)
    assert sorted(r["notice_id"] for r in chosen.collect()) == ["adv", "map"]
    assert reports.sheet_candidates(chosen, found, world["awards"]).count() == 4
    items = [{"award_key": k} for k in "abcdef"]
    once = reports.shuffled(items, "m2", "adv")
    assert once == reports.shuffled(items[::-1], "m2", "adv") != items and sorted(x["award_key"] for x in once) == list("abcdef")
    summary = reports.run_summary(match.notice_facts(world["notices"], world["descriptions"], CFG, VERTICAL, TODAY), found).first()
    assert tuple(summary) == (2, 2, 2, 0)
    some = reports.stored_candidates(found.withColumn("status", F.lit("rejected")), spark.createDataFrame([("map",)], "notice_id string"))
    assert [r["notice_id"] for r in some.collect()] == ["map"]


def test_reviews_and_queue(spark, world, found):
    waiting = found.withColumn("shown", F.lit("possible"))
    queue = reports.review_queue(waiting, world["notices"], world["awards"])
    assert [(r["notice_id"], r["rank"]) for r in queue.collect()] == [("adv", 1), ("adv", 2), ("adv", 3), ("map", 1)]
    assert [len(r["items"]) for r in reports.group_by_notice(queue).orderBy("notice_id").collect()] == [3, 1]
    log = spark.createDataFrame([], schemas.table(schemas.REVIEW_DDL))
    now = dt.datetime(2026, 10, 6)
    after, log = reports.record_review(waiting, log, "adv", "PAY2", "confirmed", "me", now)
    shown = {r["award_key"]: (r["shown"], r["status"]) for r in after.collect()}
    assert shown == {"PAY2": ("incumbent", "confirmed"), "PAY1": ("hidden", "auto"), "LAPTOPS": ("hidden", "auto"), "140L0620C0015": ("possible", "auto")}
    assert log.count() == 1 and reports.record_review(after, log, "adv", "??", "rejected", "me", now)[1].count() == 1
    labels = reports.effective_labels(spark.createDataFrame([], schemas.table(schemas.LABEL_DDL)), log)
    assert [(r["notice_id"], r["award_key"], r["answer"]) for r in labels.collect()] == [("adv", "PAY2", "incumbent")]


def test_diagnose_and_status(spark, world, found, tmp_path):
    chunks = spark.createDataFrame([("s", "c1", "done", {"total_records": "7"}, 1, 1, None)], schemas.table(schemas.CHUNK_DDL))
    lines = reports.diagnose(world["notices"], world["awards"], world["descriptions"], found, chunks, CFG, VERTICAL, TODAY)
    assert {"in_scope: 2", "c1 done: 7", "incumbent_shown: 2 (100% of 2)", "linked_notices: 0", "Award Notice archived: 1"} <= set(lines)
    keys = ["c1", "c2"]
    assert tuple(reports.plan_progress(chunks, "s", keys).first()) == (1, 2) and tuple(reports.plan_progress(chunks, "s", []).first()) == (0, 0)
    t = dt.datetime(2026, 10, 6, 12)
    runs = [(1, "s", "j", "succeeded", {"through": "2026-10-01"}, t, t, None, 3, 5, 4), (2, "s", "j", "failed", {"through": "2026-10-05"}, t, t, "boom", 2, 0, 0)]
    runs = spark.createDataFrame(runs, schemas.table(schemas.RUN_DDL))
    assert reports.watermark(runs, "s", "through").first()[0] == dt.date(2026, 10, 1)
    assert reports.watermark_start(dt.date(2026, 10, 1), t.date(), 2, 365) == dt.date(2026, 9, 29)
    assert reports.watermark_start(dt.date(2020, 1, 1), t.date(), 2, 365) == dt.date(2025, 10, 7) and reports.watermark_start(None, t.date(), 3) == dt.date(2026, 10, 3)
    assert reports.requests_today(runs, "s", t).first()[0] == 5
    files = spark.createDataFrame([("p", "s", "h", 10, t, {}, 1)], schemas.table(schemas.RAW_FILE_DDL))
    lines = reports.status({"awards": world["awards"]}, runs, chunks, files)
    assert "awards: 10" in lines and "s: last error boom" in lines and "raw files: 10 bytes" in lines


def test_versioned_table(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", spark.range(0).schema)
    assert table.version() == 0 and table.read().count() == 0 and table.tags() == {}
    for n in (3, 4, 5):
        table.write(spark.range(n), grace=0, tags={f"t{n}": "x"} if n < 5 else None)
    assert table.version() == 3 and table.read().count() == 5 and table.tags() == {"t3": "x", "t4": "x"}
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("v=")) == ["v=2", "v=3"]
    # A snapshot that was never committed, or whose commit was cut short, is not read; old ones stay for their readers.
    (tmp_path / "t" / "v=4").mkdir()
    (tmp_path / "t" / "committed" / "_half").write_text("")
    assert table.version() == 3 and table.read().count() == 5
    before = table.read()
    table.write(spark.range(6))
    table.write(spark.range(7))
    assert before.count() == 5 and table.read().count() == 7


def test_awards_with_one_number_are_told_apart(spark):
    """A number that several awards have: each is a vehicle, an explicit reference or neither by itself."""
    held = spark.createDataFrame([("V", "IDV_A", "9"), ("SAME", "C", "1"), ("OTHER", "C", "2"), ("IDV", "IDV_B", "2")], "award_key string, a_type string, a_subtier string").withColumn("a_piid_norm", F.lit("W91Q100000C"))
    asked = spark.createDataFrame([("n", "1", "under w91q-100000-c", None)], "notice_id string, n_subtier string, n_text string, n_solicitation string")
    none = match.Excluded(spark.createDataFrame([], "notice_id string, award_key string"), spark.createDataFrame([], "award_key string, times long, by string"))
    found = match.citations(asked, held, CFG, none)
    assert {(r["award_key"], r["kind"]) for r in found.collect()} == {("V", "vehicle"), ("SAME", "explicit"), ("IDV", "vehicle")}


def test_cited_awards_with_one_number_equal_sql(spark, tmp_path):
    """Order keys of seven digits share their first six, and so their number, with others."""
    import duckdb

    from bidweave import queries

    keys = ", ".join(f"({k}, {k % 7}, 'O')" for k in (100000, 1000000, 1000001, 1000002, 1000003, 1000004, 1000005, 123456, 1234567))
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {keys}) t(o_orderkey, o_custkey, o_orderstatus)) TO '{tmp_path}/orders.parquet'")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    columns = ["notice_id", "award_key", "kind"]
    got = sorted(tuple(r) for r in queries.QUERIES["explicit_reference_join"](spark, str(tmp_path)).select(*columns).collect())
    assert got == sorted(c.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL['explicit_reference_join']})").fetchall())


def test_candidates_near_and_far_equal_a_search_of_the_whole_window(spark, monkeypatch):
    """Dense and sparse offices, notices without an office, own and replaced awards: the nearest few, as by brute force."""
    from dataclasses import replace

    day = dt.date(2025, 1, 1)
    awards = [(f"A{k:04}", "B", ("1", "2")[k % 11 == 0], (None, "X", "Y", "X")[k % 4], ("5415xx", "2362xx", None)[k % 3], ("R408", "D302")[k % 5 > 1], 50_000.0, day + dt.timedelta(days=(k * k * 7) % 900 - 300)) for k in range(1200)]
    asked = [(f"N{k}", ("1", "2", "1")[k % 3], ("X", None, "Z", "Y")[k % 4], day + dt.timedelta(days=k * 3), [["541511"], ["541511", "236220"], []][k % 3], ("R499", None)[k % 2]) for k in range(40)]
    known = spark.createDataFrame(awards, "award_key string, a_type string, a_subtier string, a_office string, a_naics string, a_psc string, a_value double, a_end date")
    notices = spark.createDataFrame(asked, "notice_id string, n_subtier string, n_office string, n_reference date, n_codes array<string>, n_psc string")
    own = [(f"N{k % 40}", f"A{k:04}") for k in range(0, 1200, 3)]
    gone = [(f"A{k:04}", 1 + k % 2, f"N{k % 40}") for k in range(1, 1200, 7)]
    exclude = match.Excluded(spark.createDataFrame(own, "notice_id string, award_key string"), spark.createDataFrame(gone, "award_key string, times long, by string"))
    cfg = replace(CFG, candidates=replace(CFG.candidates, max_per_notice=12))
    asks = []
    reach = match._reach
    monkeypatch.setattr(match, "_reach", lambda *a: asks.append(reach(*a)) or asks[-1])
    got = {tuple(r) for r in match.candidates(notices, known, cfg, exclude).collect()}
    out, times, mine = set(), {a: (n, by) for a, n, by in gone}, set(own)
    bounds = {r[0]: r for r in notices.selectExpr("notice_id", "add_months(n_reference, -6)", "add_months(n_reference, 18)").collect()}
    for n, sub, office, ref, codes, psc in asked:
        able = []
        for a, _, a_sub, a_office, a_naics, a_psc, _, end in awards:
            related = (office is not None and office == a_office) or (a_naics or "-")[:4] in {c[:4] for c in codes} or (psc is not None and psc[:2] == a_psc[:2])
            free = (n, a) not in mine and (a not in times or times[a] == (1, n))
            if sub == a_sub and related and free and bounds[n][1] <= end <= bounds[n][2]:
                able.append((office != a_office, abs((end - ref).days), a))
        out |= {(n, a) for _, _, a in sorted(able)[:12]}
    assert got == out
    # Not every notice looks through its whole window.
    assert 0 < asks[0].where(F.col("near") < 400).count() < 40


def test_vectors_meet_within_a_pair(spark, world):
    """Pairs are dealt out by award and by notice, never once more for each of their words; other columns stay."""
    import re

    facts = match.notice_facts(world["notices"], world["descriptions"], CFG, VERTICAL, TODAY)
    pairs = spark.createDataFrame([("adv", "PAY1"), ("adv", "PAY2"), ("map", "140L0620C0015")], "notice_id string, award_key string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = match.similarities(facts, match.award_facts(world["awards"]), pairs, world["awards"])
        assert not re.search(r"hashpartitioning\(notice_id#\d+, word#", out._jdf.queryExecution().executedPlan().toString())
        assert {(r["award_key"], tuple(r["shared_terms"])) for r in out.collect()} == {("PAY1", ("advice", "payroll")), ("140L0620C0015", ("drones", "survey"))}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_pairs_are_kept_without_texts(world, monkeypatch):
    """What the matcher keeps of each pair holds no text of a notice or award."""
    kept = []
    cut = match.cut
    monkeypatch.setattr(match, "cut", lambda df: kept.append(set(df.columns)) or cut(df))
    match.match(world["notices"], world["awards"], world["descriptions"], world["none"], CFG, VERTICAL, TODAY)
    pairs = [c for c in kept if {"notice_id", "award_key"} <= c]
    assert pairs and not any(c & {"n_text", "n_title", "a_description"} for c in pairs)


def _moved(spark, run):
    """Records that Spark's stages wrote to shuffles meanwhile."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (lambda found: [found.apply(k) for k in range(found.size())])(store.stageList(None, False, False, none, None))}
    before = stages()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return out, sum(n for k, n in stages().items() if k not in before)


def test_awards_that_no_pair_has_stay_where_they_are(spark, world, found):
    """Many awards that are neither able nor cited: the matcher never shuffles them; nor what earlier matches say of them."""
    many = 20_000
    rest = world["awards"].where("award_key = 'FAR'").withColumns({"award_type_code": F.lit("X"), "naics": F.lit("111110")}).crossJoin(spark.range(many).withColumnRenamed("id", "_k"))
    rest = rest.withColumns({c: F.concat(F.lit("W91Q"), F.lpad(F.col("_k").cast("string"), 8, "0")) for c in ("award_key", "piid", "piid_norm")}).drop("_k")
    large = world | {"awards": world["awards"].unionByName(rest).cache()}
    assert large["awards"].count() == many + world["awards"].count()
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, moved = _moved(spark, lambda: run(large).select("notice_id", "award_key", "shown").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert {tuple(r) for r in rows} == {(r["notice_id"], r["award_key"], r["shown"]) for r in found.collect()}
    assert 0 < moved < many


def test_many_keys_are_shuffled_with_the_same_result(world, found, monkeypatch):
    """Where keys are too many to be sent to every task, the matcher finds the same."""
    from bidweave.operators import rows

    monkeypatch.setattr(rows, "FEW", 0)
    done = superseded(world, found, "OTHERIDV20D0001")
    own = found.where("award_key = 'LAPTOPS'").withColumn("kind", F.lit("resulting_award"))
    few = {(r["award_key"], r["score"], r["shown"]) for r in run(world, done.unionByName(own)).where("notice_id = 'adv'").collect()}
    monkeypatch.undo()
    assert few == {(r["award_key"], r["score"], r["shown"]) for r in run(world, done.unionByName(own)).where("notice_id = 'adv'").collect()}
    assert {k for k, _, _ in few} == {"PAY1", "PAY2"}
