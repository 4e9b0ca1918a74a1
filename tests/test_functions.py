"""Scalar functions on single values."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bidweave.config import IT_PROFESSIONAL_SERVICES, MatchingConfig, Vertical, Weights, load_matching_config, load_verticals, vertical_naics
from bidweave.functions import features as X
from bidweave.functions import normalize as N
from bidweave.functions import text as T

CFG = MatchingConfig()


def values(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_ids_and_clean_text(spark):
    assert values(spark, N.normalize_contract_id, [" w91q-uz 21\tc ", "- -", None, "", "a b"]) == ["W91QUZ21C", None, None, None, "AB"]
    assert values(spark, N.clean_text, [" x ", "NULL", "  ", None, " null\n", "nullable"]) == ["x", None, None, None, None, "nullable"]


def test_dates(spark):
    at = values(spark, N.parse_datetime, ["2024-05-04", "2024-05-04 13:00:00", "2024-05-04T13:00:00-04:00", "soon", "2026", None, "2024-02-30"])
    assert at == [dt.datetime(2024, 5, 4), dt.datetime(2024, 5, 4, 13), dt.datetime(2024, 5, 4, 17), None, None, None, None]
    days = values(spark, N.parse_date, ["2024-05-04T13:00", "2024-05-04 x", "2024-13-01", "2026", None])
    assert days == [dt.date(2024, 5, 4), dt.date(2024, 5, 4), None, None, None]
    assert values(spark, N.has_time, ["2024-05-04", "2024-05-04 13:00:00", "x"]) == [False, True, None]
    assert values(spark, N.yes_no, ["Yes", "TRUE", "y", "no", "", None]) == [True, True, True, False, None, None]


def test_safe_types(spark):
    assert values(spark, N.safe_int, ["12", " 7 ", "3.0", "x", "", "99999999999"]) == [12, 7, None, None, None, None]
    assert values(spark, N.safe_date, ["2027-06-30", "2027-06-30 junk", "2026", "2027-02-30"]) == [dt.date(2027, 6, 30), None, None, None]
    assert values(spark, N.flag, ["T", "no", "1", "maybe", "0", None]) == [True, False, True, None, False, None]
    assert [str(x) for x in values(spark, N.safe_decimal, ["1250000.505", "x", "-.5"])] == ["1250000.5050", "None", "-0.5000"]


def test_org_path(spark):
    def path(codes, names):
        return one(spark, N.org_path(F.lit(codes), F.lit(names))).asDict()

    p = path("097.97AS.DLA LAND.COLUMBUS.SPE7L1", "DOD.DLA.LAND.COL.OFFICE")
    assert (p["department_code"], p["subtier_code"], p["office_code"], p["office_name"]) == ("097", "97AS", "SPE7L1", "OFFICE")
    p = path("070.7008", "DHS.U.S. COAST GUARD")
    assert (p["subtier_code"], p["subtier_name"], p["office_code"]) == ("7008", None, None)


def test_windows():
    assert N.years_ago(dt.date(2024, 2, 29), 1) == dt.date(2023, 2, 28)
    spans = N.windows(dt.date(2024, 1, 1), dt.date(2024, 3, 1), 30)
    assert spans[0] == (dt.date(2024, 1, 1), dt.date(2024, 1, 30)) and spans[-1][1] == dt.date(2024, 3, 1)
    assert N.fiscal_year_windows(dt.date(2024, 9, 1), dt.date(2025, 10, 2)) == [
        (dt.date(2024, 9, 1), dt.date(2024, 9, 30)), (dt.date(2024, 10, 1), dt.date(2025, 9, 30)), (dt.date(2025, 10, 1), dt.date(2025, 10, 2)),
    ]
    assert all((b - a).days <= 91 for a, b in N.quarters(dt.date(2024, 1, 1), dt.date(2024, 12, 31)))


def test_tokens_and_amounts(spark):
    assert values(spark, T.tokens, ["The IGF::OT::IGF Help-Desk 24 x a1", None]) == [["help", "desk", "a1"], []]
    assert values(spark, T.stated_amounts, ["$1,250,000 or $2.5 million, $5k, $12K, $1,250,000", None, "$3 Bn"]) == [[1250000.0, 2500000.0, 12000.0], [], [3e9]]


def test_citations(spark):
    text = "Follow-on to the incumbent contract W91QUZ-21-C-0001, not 2024-01-01; again w91quz21c0001. Own ABCD1234567."
    rows = spark.createDataFrame([(text, "abcd-1234567")], "text string, own string")
    c = [r["c"] for r in T.cited_numbers(rows, "text", "own").orderBy("c.at").collect()]
    assert [(x["piid_norm"], x["raw"], x["at"]) for x in c] == [("W91QUZ21C0001", "W91QUZ-21-C-0001", text.index("W91") + 1)]
    words = one(spark, T.context_words(F.lit(text), F.lit(c[0]["at"]), F.lit(len(c[0]["raw"])), CFG.explicit_reference.context_words, 120))
    assert words == ["incumbent", "follow-on"]
    assert values(spark, T.looks_like_contract_number, ["47QTCA20F0001", "12345678", "ABCDEFGH", "A1B2C3D4", "A1234"]) == [True, False, False, True, False]


def test_feature_curves(spark):
    f, c = CFG.features, CFG.candidates
    ref = dt.date(2026, 12, 1)

    def end(days):
        return one(spark, X.end_date(F.lit(ref), F.lit(ref + dt.timedelta(days=days)), c, f))

    assert [end(d) for d in (-30, 0, 270)] == [1.0, 1.0, 1.0]
    assert end(-184) == 0 and end(600) == 0 and 0 < end(-100) < 1 and 0 < end(400) < 1
    assert one(spark, X.psc(F.lit("da01"), F.lit("DA10"), f)) == 0.6
    assert one(spark, X.psc(F.lit(None).cast("string"), F.lit("DA10"), f)) == 0.5
    assert one(spark, X.naics(F.array(F.lit("541512")), F.lit("541519"), f)) == 0.6
    assert one(spark, X.set_aside(F.lit("sbp"), F.lit("SBA"))) == 1.0
    assert one(spark, X.set_aside(F.lit("8A"), F.lit("SBA"))) == 0.5
    assert one(spark, X.set_aside(F.lit(None).cast("string"), F.lit("NONE"))) == 1.0
    assert one(spark, X.value(F.array(F.lit(1e6)), F.lit(3e6), f)) == 1.0
    assert one(spark, X.value(F.array(F.lit(1e6)), F.lit(3.1e6), f)) == 0.2
    assert one(spark, X.vehicle(F.array(F.lit("V")), F.lit(None).cast("string"), f)) == 0.0


def test_settings_are_checked(tmp_path):
    with pytest.raises(ValueError):
        Weights(office=0.5)
    with pytest.raises(ValueError):
        Vertical("x", "x", ("54x",))
    p = tmp_path / "m.json"
    p.write_text('{"decision": {"margin": 0.1}, "notice_types": ["Solicitation"]}')
    cfg = load_matching_config(str(p))
    assert cfg.decision.margin == 0.1 and cfg.notice_types == ("Solicitation",)
    p.write_text('{"decision": {"margins": 0.1}}')
    with pytest.raises(ValueError):
        load_matching_config(str(p))
    p.write_text('{"verticals": [{"key": "a", "name": "A", "naics": ["541512", "54"]}]}')
    assert vertical_naics(load_verticals(str(p))) == ("54", "541512")
    assert len(vertical_naics()) == len(IT_PROFESSIONAL_SERVICES.naics)
