"""The driver's tables as procurement data in the engine's own schemas, and the same in SQL.

Orders are awards (customers their recipients and offices, nations their sub-tiers), suppliers are notices that cite
orders and ask for their like, lines are matches of an earlier run, and events are runs, chunks and versions.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave import schemas
from bidweave.operators.rows import top_n
from bidweave.sources.notices import stored_columns

TODAY = dt.date(1996, 2, 1)
VERTICAL = ("541511", "541512", "541519", "541611")
NAICS = (*VERTICAL, "236220")
TYPES = ("A", "B", "C", "D", "IDV_B", "IDV_A", "IDV_C")
PSC = ("D302", "D399", "R408")
TOPICS = ("network", "payroll", "training", "cloud", "logistics", "survey")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
NOTICE_TYPES = ("Solicitation", "Combined Synopsis/Solicitation", "Presolicitation", "Sources Sought", "Special Notice", "Award Notice", "Justification")


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _array(values) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _as(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of a schema by name; those that ``df`` lacks are null."""
    kinds = schemas.table(ddl)
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds))


def awards(spark: SparkSession, sf: str) -> DataFrame:
    o = _read(spark, sf, "orders").join(_read(spark, sf, "customer"), F.expr("c_custkey = o_custkey")).join(_read(spark, sf, "nation"), F.expr("n_nationkey = c_nationkey"))
    made = o.selectExpr(
        "cast(o_orderkey as string) award_key", "'W91Q-' || lpad(o_orderkey, 6, '0') || '-C' piid", "'W91Q' || lpad(o_orderkey, 6, '0') || 'C' piid_norm",
        "case when o_orderkey % 8 = 7 then 'W91Q' || lpad(o_orderkey % 40, 6, '0') || 'C' end referenced_idv_piid_norm",
        f"{_array(TYPES)}[int(o_orderkey % 7)] award_type_code", "cast(n_regionkey as string) awarding_agency_code", "cast(c_nationkey as string) awarding_sub_agency_code",
        "n_name awarding_sub_agency_name", "cast(c_custkey % 7 as string) awarding_office_code", "'Office ' || (c_custkey % 7) awarding_office_name", "'U' || c_custkey recipient_uei",
        "case when o_orderkey % 4 > 0 then c_name end recipient_name", f"{_array(NAICS)}[int(c_custkey % 5)] naics", f"{_array(PSC)}[int(o_orderkey % 3)] psc",
        "case when o_custkey % 3 < 2 then 'SOLA' || lpad(o_orderkey % 100, 8, '0') end solicitation_id_norm", "case when c_custkey % 2 = 0 then 'SBA' end set_aside_code",
        "case when o_orderkey % 10 > 0 then o_totalprice end total_value", "case when o_orderkey % 20 > 0 then o_totalprice end current_total_value", "1000 obligated_total",
        "case when o_orderkey % 9 > 0 then to_date(o_orderdate) end ultimate_end", "case when o_orderkey % 2 = 0 then to_date(o_orderdate) end ordering_period_end",
        f"c_mktsegment || ' ' || {_array(TOPICS)}[int(o_orderkey % 6)] || ' support' description",
    )
    return _as(made, schemas.AWARD_DDL)


_A = f"""
    w_a AS (SELECT CAST(o_orderkey AS VARCHAR) AS award_key, o_orderkey AS k, 'W91Q-' || lpad(o_orderkey::VARCHAR, 6, '0') || '-C' AS piid, 'W91Q' || lpad(o_orderkey::VARCHAR, 6, '0') || 'C' AS piid_norm,
        CASE WHEN o_orderkey % 8 = 7 THEN 'W91Q' || lpad((o_orderkey % 40)::VARCHAR, 6, '0') || 'C' END AS ref_norm, {_list(TYPES)}[o_orderkey % 7 + 1] AS type,
        CAST(c_nationkey AS VARCHAR) AS sub, n_name AS sub_name, CAST(c_custkey % 7 AS VARCHAR) AS office, 'Office ' || (c_custkey % 7) AS office_name, 'U' || c_custkey AS uei,
        CASE WHEN o_orderkey % 4 > 0 THEN c_name END AS recipient, c_name, {_list(NAICS)}[c_custkey % 5 + 1] AS naics, {_list(PSC)}[o_orderkey % 3 + 1] AS psc,
        CASE WHEN o_custkey % 3 < 2 THEN 'SOLA' || lpad((o_orderkey % 100)::VARCHAR, 8, '0') END AS sol, CASE WHEN c_custkey % 2 = 0 THEN 'SBA' END AS set_aside,
        coalesce(CASE WHEN o_orderkey % 10 > 0 THEN CAST(o_totalprice AS DECIMAL(24,4)) END, CASE WHEN o_orderkey % 20 > 0 THEN CAST(o_totalprice AS DECIMAL(24,4)) END, CAST(1000 AS DECIMAL(24,4))) AS val,
        coalesce(CASE WHEN o_orderkey % 10 > 0 THEN CAST(o_totalprice AS DECIMAL(24,4)) END, CASE WHEN o_orderkey % 20 > 0 THEN CAST(o_totalprice AS DECIMAL(24,4)) END) AS shown_val,
        coalesce(CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_orderdate AS DATE) END, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END) AS ends,
        c_mktsegment || ' ' || {_list(TOPICS)}[o_orderkey % 6 + 1] || ' support' AS description
      FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""


def notices(spark: SparkSession, sf: str) -> DataFrame:
    """Raw columns of notices, without the stored ones."""
    s = _read(spark, sf, "supplier").join(_read(spark, sf, "nation"), F.expr("n_nationkey = s_nationkey")).join(_read(spark, sf, "region"), F.expr("r_regionkey = n_regionkey"))
    posted = "case when s_suppkey % 13 > 0 then timestamp_ntz'1996-01-01 00:00:00' + make_dt_interval(int(s_suppkey % 300)) end"
    made = s.selectExpr(
        "'N' || s_suppkey notice_id", "'SOLA' || lpad(s_suppkey % 100, 8, '0') solicitation_number", f"{_array(SEGMENTS)}[int(s_suppkey % 5)] || ' ' || {_array(TOPICS)}[int(s_suppkey % 6)] || ' support' title",
        f"{_array(NOTICE_TYPES)}[int(s_suppkey % 7)] type", f"cast({posted} as timestamp) posted_at",
        f"cast(case when s_suppkey % 4 > 0 then {posted} + make_dt_interval(45, 17) end as timestamp) response_deadline", "s_suppkey % 4 > 0 response_deadline_has_time",
        f"{_array(NAICS)}[int(s_suppkey % 5)] naics", f"case when s_suppkey % 3 = 0 then array({_array(NAICS)}[int(s_suppkey % 5)], '541512') when s_suppkey % 3 = 1 then array('236220') end naics_codes",
        f"case when s_suppkey % 4 < 3 then {_array(PSC)}[int(s_suppkey % 4)] end psc", "case s_suppkey % 3 when 0 then 'SBP' when 1 then '8A' end set_aside_code",
        "r_regionkey || '.' || s_nationkey || '.' || (s_suppkey % 7) full_parent_path_code", "r_name || '.' || n_name || '.Desk' full_parent_path_name",
        "case when s_suppkey % 7 = 5 then named_struct('number', 'W91Q-' || lpad(s_suppkey * 3, 6, '0') || '-C', 'date', null, 'amount', null, 'awardee', null) end award",
        "'http://n/' || s_suppkey ui_link", "s_suppkey % 9 > 0 active", "case when s_suppkey % 10 = 0 then date'1996-01-15' end archive_date",
    )
    return _as(made, schemas.NOTICE_DDL)


_N = f"""
    w_n AS (SELECT 'N' || s_suppkey AS notice_id, s_suppkey AS k, 'SOLA' || lpad((s_suppkey % 100)::VARCHAR, 8, '0') AS sol, {_list(SEGMENTS)}[s_suppkey % 5 + 1] || ' ' || {_list(TOPICS)}[s_suppkey % 6 + 1] || ' support' AS title,
        {_list(NOTICE_TYPES)}[s_suppkey % 7 + 1] AS type, CASE WHEN s_suppkey % 13 > 0 THEN DATE '1996-01-01' + CAST(s_suppkey % 300 AS INTEGER) END AS posted,
        CASE WHEN s_suppkey % 4 > 0 AND s_suppkey % 13 > 0 THEN DATE '1996-01-01' + CAST(s_suppkey % 300 AS INTEGER) + 45 END AS deadline, {_list(NAICS)}[s_suppkey % 5 + 1] AS naics,
        list_distinct(list_concat([{_list(NAICS)}[s_suppkey % 5 + 1]], CASE s_suppkey % 3 WHEN 0 THEN ['541512'] WHEN 1 THEN ['236220'] ELSE [] END)) AS codes,
        CASE WHEN s_suppkey % 4 < 3 THEN {_list(PSC)}[s_suppkey % 4 + 1] END AS psc, CASE s_suppkey % 3 WHEN 0 THEN 'SBP' WHEN 1 THEN '8A' END AS set_aside,
        CAST(s_nationkey AS VARCHAR) AS sub, CAST(s_suppkey % 7 AS VARCHAR) AS office, r_name || '.' || n_name || '.Desk' AS agency, CASE WHEN s_suppkey % 7 = 5 THEN 'W91Q' || lpad((s_suppkey * 3)::VARCHAR, 6, '0') || 'C' END AS number,
        s_suppkey % 9 > 0 AS active, CASE WHEN s_suppkey % 10 = 0 THEN DATE '1996-01-15' END AS archived
      FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
    w_vertical AS (SELECT * FROM w_n WHERE list_has_any(codes, {_list(VERTICAL)})),
    w_scope AS (SELECT * FROM w_vertical WHERE active AND type IN {NOTICE_TYPES[:5]} AND (archived IS NULL OR archived >= DATE '{TODAY}'))"""


def stored_notices(spark: SparkSession, sf: str) -> DataFrame:
    return stored_columns(notices(spark, sf))


def descriptions(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions each; the newer cites the first two orders of the supplier's nation, or those of the one after."""
    own = awards(spark, sf).select(F.col("awarding_sub_agency_code").cast("int").alias("nation"), F.col("award_key").cast("long").alias("k"))
    own = top_n(own, ["nation"], [F.col("k")], 2, "at")
    first = own.groupBy("nation").agg(F.min("k").alias("k0"), F.max(F.when(F.col("at") == 2, F.col("k"))).alias("k1"))
    s = _read(spark, sf, "supplier").join(first, F.expr("nation = (s_nationkey + case when s_suppkey % 3 = 0 then 1 else 0 end) % 25"), "left")
    newer = s.selectExpr(
        "'N' || s_suppkey notice_id", "2 version",
        "case when s_suppkey % 5 < 4 then 'Follow-on to the incumbent contract w91q-' || lpad(k0, 6, '0') || '-c, also W91Q' || lpad(k1, 6, '0') || 'C of ' || (2024) || '. Estimated value $' || (s_suppkey % 9 + 1) || '00,000.' end text",
    )
    return newer.unionByName(_read(spark, sf, "supplier").selectExpr("'N' || s_suppkey notice_id", "1 version", "'an older text' text"))


_D = """
    w_first AS (SELECT sub, min(k) AS k0, min(k) FILTER (WHERE rn = 2) AS k1 FROM (SELECT sub, k, row_number() OVER (PARTITION BY sub ORDER BY k) AS rn FROM w_a) GROUP BY 1),
    w_d AS (SELECT 'N' || s_suppkey AS notice_id, s_suppkey AS k, k0, k1, CASE WHEN s_suppkey % 5 < 4 THEN 'Follow-on to the incumbent contract w91q-' || lpad(k0::VARCHAR, 6, '0') || '-c, also W91Q' || lpad(k1::VARCHAR, 6, '0') || 'C of 2024. Estimated value $' || (s_suppkey % 9 + 1) || '00,000.' END AS text
      FROM supplier LEFT JOIN w_first ON sub = CAST((s_nationkey + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END) % 25 AS VARCHAR))"""


def matches(spark: SparkSession, sf: str) -> DataFrame:
    """What an earlier run and its reviewers left."""
    li = _read(spark, sf, "lineitem").select("l_suppkey", "l_orderkey").distinct()
    x = "(l_orderkey * 7 + l_suppkey)"
    made = li.selectExpr(
        "'N' || l_suppkey notice_id", "cast(l_orderkey as string) award_key", "'W91Q-' || lpad(l_orderkey, 6, '0') || '-C' piid", f"case when {x} % 5 = 0 then 'resulting_award' else 'incumbent' end kind",
        f"case when {x} % 6 = 0 then 'explicit_reference' else 'candidate' end method", f"cast({x} % 1000 / 1000 as decimal(5,4)) score", "int(l_orderkey % 50) rank",
        f"case when {x} % 5 = 0 then 'hidden' when {x} % 12 = 1 then 'incumbent' when {x} % 4 = 2 then 'possible' else 'hidden' end shown",
        f"named_struct('reasons', array('r' || ({x} % 3), null), 'base_score', case when {x} % 7 > 0 then {x} % 500 / 500 end) e", "'v1' matcher_version",
        f"case {x} % 11 when 0 then 'rejected' when 1 then 'confirmed' else 'auto' end status",
    )
    kind = schemas.match()["evidence"].dataType
    parts = [(F.col(f"e.{f.name}") if f.name in ("reasons", "base_score") else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind]
    return _as(made.withColumn("evidence", F.struct(*parts)), schemas.MATCH_DDL)


_M = """
    w_m AS (SELECT 'N' || l_suppkey AS notice_id, CAST(l_orderkey AS VARCHAR) AS award_key, l_orderkey AS ak, l_suppkey AS nk, 'W91Q-' || lpad(l_orderkey::VARCHAR, 6, '0') || '-C' AS piid, CASE WHEN x % 5 = 0 THEN 'resulting_award' ELSE 'incumbent' END AS kind,
        CASE WHEN x % 6 = 0 THEN 'explicit_reference' ELSE 'candidate' END AS method, x % 1000 / 1000.0 AS score, CAST(l_orderkey % 50 AS INTEGER) AS rank,
        CASE WHEN x % 5 = 0 THEN 'hidden' WHEN x % 12 = 1 THEN 'incumbent' WHEN x % 4 = 2 THEN 'possible' ELSE 'hidden' END AS shown, 'r' || (x % 3) AS reason, CASE WHEN x % 7 > 0 THEN x % 500 / 500.0 END AS base_score,
        CASE x % 11 WHEN 0 THEN 'rejected' WHEN 1 THEN 'confirmed' ELSE 'auto' END AS status
      FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_orderkey * 7 + l_suppkey AS x FROM lineitem))"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    made = _read(spark, sf, "events").selectExpr(
        "event_id id", "event_type source", "'j' || (user_id % 3) job", "case when value > 20 then 'succeeded' else 'failed' end status", "map('through', cast(to_date(ts) as string)) params",
        "cast(case when event_id % 17 > 0 then ts end as timestamp) started_at", "case when event_id % 5 = 0 then 'e' || event_id end error", "event_id % 4 requests",
    )
    return _as(made, schemas.RUN_DDL)


_R = "w_r AS (SELECT event_id AS id, event_type AS source, 'j' || (user_id % 3) AS job, CASE WHEN value > 20 THEN 'succeeded' ELSE 'failed' END AS status, CAST(ts AS DATE) AS day, CASE WHEN event_id % 17 > 0 THEN ts END AS started, CASE WHEN event_id % 5 = 0 THEN 'e' || event_id END AS error, event_id % 4 AS requests FROM events)"


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    made = _read(spark, sf, "events").selectExpr("event_type source", "'c' || event_id chunk_key", "case when value > 20 then 'done' else 'in_progress' end status", "map('total_records', cast(event_id as string)) state")
    return _as(made, schemas.CHUNK_DDL)


def raw_awards(spark: SparkSession, sf: str) -> DataFrame:
    """An award file's columns as text, several rows a key."""
    from bidweave.sources.awards import project_wanted

    o = _read(spark, sf, "lineitem").join(_read(spark, sf, "orders"), F.expr("o_orderkey = l_orderkey"))
    made = o.selectExpr(
        "case when l_linenumber % 9 > 0 then cast(l_orderkey as string) else ' ' end contract_award_unique_key", "' w91q-' || l_orderkey || '-' || l_linenumber || ' ' award_id_piid",
        "case when l_linenumber % 2 = 0 then cast(l_quantity as string) else '3' end number_of_offers_received", "cast(cast(l_extendedprice as decimal(14,2)) as string) potential_total_value_of_award",
        "case when l_linenumber % 3 > 0 then cast(to_date(l_shipdate) as string) else 'soon' end period_of_performance_potential_end_date",
        "case when l_linenumber % 5 > 0 then cast(cast(l_shipdate as timestamp_ntz) + make_dt_interval(0, 0, 0, l_partkey) as string) || '+00' end last_modified_date", "'U' || o_custkey recipient_uei", "case when l_partkey % 3 > 0 then 'Firm ' || l_partkey end recipient_name",
        "cast(o_custkey % 5 as string) awarding_agency_code", "case when l_partkey % 4 > 0 then 'Agency ' || (l_partkey % 50) end awarding_agency_name", "'S' || (o_custkey % 25) awarding_sub_agency_code",
        "'Sub ' || (l_partkey % 50) awarding_sub_agency_name", "'O' || (o_custkey % 90) awarding_office_code", "case when l_partkey % 7 > 0 then 'Office ' || (l_partkey % 80) else '' end awarding_office_name",
        "case when l_partkey % 6 = 0 then 'bad' else cast(541500 + l_partkey % 20 as string) end naics_code", "case when l_partkey % 5 > 0 then 'Title ' || (l_partkey % 30) end naics_description",
        "case l_linenumber % 4 when 0 then 't' when 1 then 'No' when 2 then 'maybe' end women_owned_small_business",
    )
    return project_wanted(made)[0]


_RAW = """
    w_raw AS (SELECT CASE WHEN l_linenumber % 9 > 0 THEN CAST(l_orderkey AS VARCHAR) END AS award_key, 'w91q-' || l_orderkey || '-' || l_linenumber AS piid, CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE 3 END AS offers,
        CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS DOUBLE) AS val, CASE WHEN l_linenumber % 3 > 0 THEN CAST(l_shipdate AS DATE) END AS ends, CASE WHEN l_linenumber % 5 > 0 THEN CAST(epoch(l_shipdate) AS BIGINT) + l_partkey END AS modified, 'U' || o_custkey AS uei,
        CASE WHEN l_partkey % 3 > 0 THEN 'Firm ' || l_partkey END AS name, CAST(o_custkey % 5 AS VARCHAR) AS agency, CASE WHEN l_partkey % 4 > 0 THEN 'Agency ' || (l_partkey % 50) END AS agency_name, 'S' || (o_custkey % 25) AS sub, 'Sub ' || (l_partkey % 50) AS sub_name,
        'O' || (o_custkey % 90) AS office, CASE WHEN l_partkey % 7 > 0 THEN 'Office ' || (l_partkey % 80) END AS office_name, CASE WHEN l_partkey % 6 > 0 THEN CAST(541500 + l_partkey % 20 AS VARCHAR) END AS naics, CASE WHEN l_partkey % 5 > 0 THEN 'Title ' || (l_partkey % 30) END AS title,
        CASE l_linenumber % 4 WHEN 0 THEN true WHEN 1 THEN false END AS women
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def sql(*parts: str) -> str:
    """The common table expressions of these parts, in order: a n d m r raw."""
    known = {"a": _A, "n": _N, "d": _D, "m": _M, "r": _R, "raw": _RAW}
    return ", ".join(known[p].strip() for p in parts)
