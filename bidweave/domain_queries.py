"""The engine's plans over the driver's tables in its own schemas (``world``), each beside its SQL twin."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave import schemas, world
from bidweave.config import MatchingConfig
from bidweave.functions import features as X
from bidweave.functions import normalize as N
from bidweave.functions import text as T
from bidweave.operators import rows as R
from bidweave.operators import versions as V
from bidweave.plans import history as H
from bidweave.plans import match as M
from bidweave.plans import recompetes as C
from bidweave.plans import reports as P
from bidweave.queries import QUERIES, SQL, _list, _t, query
from bidweave.sources import awards as A
from bidweave.sources import notices as S

CFG = MatchingConfig()
TODAY, VERTICAL = world.TODAY, world.VERTICAL
NOW = dt.datetime(2024, 1, 2, 12)
W = world.sql
_TODAY = f"DATE '{TODAY}'"


def _facts(spark, sf) -> DataFrame:
    return M.notice_facts(world.stored_notices(spark, sf), world.descriptions(spark, sf), CFG, VERTICAL, TODAY)


# --- notices and awards -----------------------------------------------------------------------------------------


@query(f"""
    WITH {W('a', 'n', 'd')} SELECT s.notice_id, title || CASE WHEN text IS NULL THEN '' ELSE chr(10) || text END AS n_text, list_aggregate(list_sort(codes), 'string_agg', ',') AS n_codes, sub AS n_subtier, office AS n_office, psc AS n_psc,
      coalesce(deadline, posted + 30, {_TODAY}) AS n_reference, deadline IS NOT NULL AS n_has_deadline FROM w_scope s LEFT JOIN w_d ON w_d.notice_id = s.notice_id""")
def notices_in_scope(spark, sf):
    return _facts(spark, sf).select("notice_id", "n_text", F.array_join(F.array_sort("n_codes"), ",").alias("n_codes"), "n_subtier", "n_office", "n_psc", F.to_date("n_reference").alias("n_reference"), "n_has_deadline")


@query(f"WITH {W('a')} SELECT award_key, CAST(val AS DOUBLE) AS a_value, ends AS a_end FROM w_a")
def award_value_and_end(spark, sf):
    return M.award_facts(world.awards(spark, sf)).select("award_key", "a_value", "a_end")


@query("""
    SELECT s_suppkey, 'N' || s_suppkey AS notice_id, 'AB-' || s_suppkey AS solicitation_number, s_name AS title, CASE WHEN s_suppkey % 3 > 0 THEN epoch(TIMESTAMP '2026-10-20 21:00:00')::BIGINT END AS deadline, CASE s_suppkey % 4 WHEN 0 THEN 'a,' || s_nationkey WHEN 1 THEN CAST(s_nationkey AS VARCHAR) ELSE '' END AS codes,
      'GSA.FAS.' || s_nationkey AS path, s_suppkey % 2 = 0 AS active, CASE WHEN s_suppkey % 5 > 0 THEN 'x@' || s_suppkey END AS email FROM supplier WHERE s_suppkey % 11 > 0""")
def notice_pages(spark, sf):
    k = "s_suppkey"
    record = F.expr(f"""to_json(named_struct('noticeId', case when {k} % 11 > 0 then 'N' || {k} else ' ' end, 'solicitationNumber', 'AB-' || {k}, 'title', ' ' || s_name, 'reponseDeadLine', case when {k} % 3 = 1 then '2026-10-20T17:00:00-04:00' end,
        'responseDeadLine', case when {k} % 3 = 2 then '2026-10-20 21:00:00' when {k} % 3 = 0 then 'soon' end, 'naicsCode', case when {k} % 4 = 1 then cast(s_nationkey as string) when {k} % 4 = 2 then 'null' end,
        'naicsCodes', case when {k} % 4 = 0 then array('a', null, cast(s_nationkey as string)) end, 'department', 'GSA', 'subTier', 'FAS', 'office', cast(s_nationkey as string), 'active', case when {k} % 2 = 0 then 'Yes' else 'No' end,
        'pointofContact', case when {k} % 5 > 0 then array(named_struct('type', 'primary', 'email', 'x@' || {k}), null) end, 'novel', 1), map('ignoreNullFields', 'false'))""")
    pages = _t(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", record.alias("record")).groupBy((F.col(k) % 7).alias("file")).agg(
        F.to_json(F.struct(F.count("*").alias("totalRecords"), F.collect_list("record").alias("opportunitiesData"))).alias("page")
    )
    rows = S.parse_notices(S.page_records(pages.select("page", F.col("file").cast("string").alias("file"))))
    return rows.select(
        F.substring("notice_id", 2, 20).cast("long").alias("s_suppkey"), "notice_id", "solicitation_number", "title", F.unix_timestamp("response_deadline").alias("deadline"), F.array_join("naics_codes", ",").alias("codes"),
        F.col("full_parent_path_name").alias("path"), "active", F.try_element_at("contacts", F.lit(1))["email"].alias("email"),
    )


@query("SELECT DISTINCT unnest(list_filter(['novel', CASE WHEN event_id % 2 = 0 THEN 'k' END, CASE WHEN event_id % 3 = 0 THEN 'extra' END], lambda x: x IS NOT NULL)) AS field FROM events")
def unknown_record_fields(spark, sf):
    e = _t(spark, sf, "events")
    record = F.to_json(F.struct(F.lit("N").alias("noticeId"), F.lit(1).alias("novel"), F.when(F.col("event_id") % 2 == 0, F.get_json_object("props", "$.k")).alias("k"), F.when(F.col("event_id") % 3 == 0, 1).alias("extra")))
    return S.unknown_fields(e.select(record.alias("record")))


@query("""
    SELECT 'N' || s_suppkey AS notice_id, CASE WHEN s_suppkey % 3 > 0 THEN '0.' || s_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN '.Q' ELSE '' END ELSE '0' || CASE WHEN s_suppkey % 2 = 0 THEN '.Q' ELSE '' END END AS codes, CASE WHEN s_suppkey % 4 > 0 THEN s_name END AS number,
      CASE WHEN s_suppkey % 5 > 0 THEN 'VA' END AS state, (s_suppkey % 6 > 0)::INTEGER + 0 AS contacts, s_name || chr(10) || 'x' AS description FROM supplier WHERE s_nationkey % 2 = 0 AND s_suppkey % 9 > 0""")
def notice_extract(spark, sf):
    k = "s_suppkey"
    made = {
        "NoticeId": f"case when {k} % 9 > 0 then 'N' || {k} end", "CGAC": "'0'", "FPDS Code": f"case when {k} % 3 > 0 then cast(s_nationkey as string) else ' ' end", "AAC Code": f"case when {k} % 2 = 0 then 'Q' end",
        "NaicsCode": "case when s_nationkey % 2 = 0 then '541511' else '111111' end", "AwardNumber": f"case when {k} % 4 > 0 then s_name else 'null' end", "PopState": f"case when {k} % 5 > 0 then 'VA' end",
        "PrimaryContactEmail": f"case when {k} % 6 > 0 then 'x@y' end", "Description": "s_name || '\n' || 'x'", "PostedDate": "'2026-10-01'",
    }
    raw = _t(spark, sf, "supplier").select(*(F.expr(made.get(c, "cast(null as string)")).alias(c) for c in schemas.NOTICE_CSV_COLUMNS))
    rows = S.parse_extract(S.extract_in_scope(raw, VERTICAL, dt.date(2026, 1, 1)))
    return rows.select("notice_id", F.col("full_parent_path_code").alias("codes"), F.col("award.number").alias("number"), F.col("place_of_performance.state.code").alias("state"), F.size("contacts").alias("contacts"), "description")


_NEWEST = "SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY modified DESC NULLS LAST) AS rn FROM w_raw WHERE {key} IS NOT NULL"


@query(f"WITH {W('raw')} SELECT award_key, upper(replace(piid, '-', '')) AS piid_norm, offers, val AS total_value, ends AS ultimate_end, modified AS last_modified FROM ({_NEWEST.format(key='award_key')}) WHERE rn = 1 AND modified IS NOT NULL")
def typed_awards(spark, sf):
    rows = A.typed_awards(world.raw_awards(spark, sf)).where(F.col("last_modified").isNotNull())
    return rows.select("award_key", "piid_norm", F.col("number_of_offers").alias("offers"), F.col("total_value").cast("double").alias("total_value"), "ultimate_end", F.unix_timestamp("last_modified").alias("last_modified"))


_ENTITY = f"WITH {W('raw')}, e AS (SELECT uei, name, CASE WHEN women IS NULL THEN '{{}}' ELSE '{{\"women_owned_small_business\":' || women || '}}' END AS business_types, modified FROM ({_NEWEST.format(key='uei')}) WHERE rn = 1)"


@query(f"{_ENTITY} SELECT uei, name, business_types, modified AS last_modified FROM e WHERE modified IS NOT NULL")
def recipients(spark, sf):
    return A.entities(world.raw_awards(spark, sf)).where(F.col("last_modified").isNotNull()).select("uei", "name", "business_types", F.unix_timestamp("last_modified").alias("last_modified"))


_STORED = "SELECT 'U' || c_custkey AS uei, c_name AS name, '{}' AS business_types, CASE WHEN c_custkey % 4 > 0 THEN 946684800 + (c_custkey % 3) * 100000000 END AS modified FROM customer"


@query(f"""
    {_ENTITY}, s AS ({_STORED}), j AS (SELECT coalesce(s.uei, e.uei) AS uei, s.uei IS NULL OR (e.uei IS NOT NULL AND coalesce(s.modified IS NULL OR e.modified >= s.modified, false)) AS w, s.name AS a, e.name AS b FROM s FULL JOIN e ON e.uei = s.uei)
    SELECT uei, CASE WHEN w THEN b ELSE a END AS name, w AS written FROM j""")
def recipient_upsert(spark, sf):
    stored = _t(spark, sf, "customer").selectExpr("'U' || c_custkey uei", "c_name name", "'{}' business_types", "case when c_custkey % 4 > 0 then timestamp_seconds(946684800 + (c_custkey % 3) * 100000000) end last_modified")
    columns = ("uei", "name", "parent_uei", "parent_name", "cage", "state", "business_types", "last_modified")
    stored = stored.select(*(F.col(c) if c in stored.columns else F.lit(None).cast("string").alias(c) for c in columns))
    # The newest record of a recipient without dates is any of them; those are left to the tests.
    return A.upsert_entities(stored, world.raw_awards(spark, sf)).table.select("uei", "name", F.col("_written").alias("written"))


@query(f"""
    WITH {W('raw')}, ag AS (SELECT 'department' AS level, agency AS code, agency_name AS name, NULL AS parent FROM w_raw UNION ALL SELECT 'subtier', sub, sub_name, agency FROM w_raw)
    SELECT 'agencies' AS relation, level || ':' || code AS key, min(name) AS name, false AS flag FROM ag GROUP BY ALL UNION ALL SELECT 'offices', sub || ':' || office, min(office_name), false FROM w_raw GROUP BY sub, office
    UNION ALL SELECT 'naics', naics, min(title), naics IN ({_list(VERTICAL)}) FROM w_raw WHERE naics IS NOT NULL GROUP BY naics""")
def reference_tables(spark, sf):
    seen = A.reference_tables(world.raw_awards(spark, sf), VERTICAL)
    rows = seen["agencies"].select(F.lit("agencies").alias("relation"), F.concat_ws(":", "level", "code").alias("key"), "name", F.lit(False).alias("flag"))
    rows = rows.unionByName(seen["offices"].select(F.lit("offices").alias("relation"), F.concat_ws(":", "subtier_code", "office_code").alias("key"), "name", F.lit(False).alias("flag")))
    return rows.unionByName(seen["naics"].select(F.lit("naics").alias("relation"), F.col("code").alias("key"), F.col("title").alias("name"), F.col("in_vertical").alias("flag")))


@query(f"WITH {W('raw')} SELECT count(*) AS codes, count(*) FILTER (WHERE in_vertical) AS in_vertical, count(title) AS titled FROM (SELECT naics AS code, min(title) AS title, naics IN ({_list((*VERTICAL, '541990'))}) AS in_vertical FROM w_raw WHERE naics IS NOT NULL GROUP BY 1 UNION ALL SELECT v, NULL, true FROM (SELECT unnest([{_list((*VERTICAL, '541990'))}]) AS v) WHERE v NOT IN (SELECT naics FROM w_raw WHERE naics IS NOT NULL))")
def seeded_codes(spark, sf):
    vertical = (*VERTICAL, "541990")
    out = A.seed_vertical_naics(A.reference_tables(world.raw_awards(spark, sf), VERTICAL)["naics"], vertical)
    return out.agg(F.count("*").alias("codes"), F.count_if("in_vertical").alias("in_vertical"), F.count("title").alias("titled"))


@query(f"""
    WITH {W('a')}, o AS (SELECT sub, office, min(office_name) AS name FROM w_a WHERE CAST(office AS INTEGER) < 5 GROUP BY ALL)
    SELECT award_key, o.name AS resolved FROM w_a LEFT JOIN o USING (sub, office)""")
def office_resolution(spark, sf):
    a = world.awards(spark, sf)
    offices = A.first_named(a.where("awarding_office_code < '5'").select(F.col("awarding_sub_agency_code").alias("subtier_code"), F.col("awarding_office_code").alias("office_code"), F.col("awarding_office_name").alias("name")), ["subtier_code", "office_code"], "name")
    return A.with_offices(a, offices).select("award_key", F.col("office_name").alias("resolved"))


# --- history links ----------------------------------------------------------------------------------------------

_SHAPE = "regexp_matches({0}, '^[A-Z0-9]{{8,20}}$') AND regexp_matches({0}, '[A-Z]') AND regexp_matches({0}, '([0-9][^0-9]*){{4}}')"
_LINKS = f"""
    found AS (SELECT n.notice_id, award_key, 'same_solicitation' AS method FROM w_vertical n JOIN w_a a ON a.sol = n.sol AND a.sub = n.sub WHERE {_SHAPE.format('n.sol')}
      UNION ALL SELECT n.notice_id, award_key, 'award_notice_number' FROM w_vertical n JOIN w_a a ON a.piid_norm = n.number AND a.sub = n.sub WHERE {_SHAPE.format('n.number')}
      UNION ALL SELECT n.notice_id, award_key, 'award_notice_number' FROM w_vertical n JOIN w_a a ON a.piid_norm = n.sol AND a.sub = n.sub WHERE n.type = 'Award Notice' AND {_SHAPE.format('n.sol')}),
    links AS (SELECT notice_id, award_key, min(method) AS method FROM (SELECT *, count(*) OVER (PARTITION BY notice_id) AS c FROM found) WHERE c <= 8 GROUP BY ALL)"""


def _found(spark, sf) -> DataFrame:
    return H.find_links(world.stored_notices(spark, sf), world.awards(spark, sf), VERTICAL, most=8)


@query(f"WITH {W('a', 'n')}, {_LINKS} SELECT * FROM links")
def history_links(spark, sf):
    return _found(spark, sf)


@query(f"""
    WITH {W('a', 'n', 'm')}, {_LINKS}, s AS (SELECT * FROM w_m WHERE kind = 'resulting_award')
    SELECT count(*) FILTER (WHERE links.notice_id IS NOT NULL AND coalesce(status, 'auto') = 'auto') AS written, count(*) FILTER (WHERE links.notice_id IS NULL AND status = 'auto') AS deleted FROM s FULL JOIN links ON links.notice_id = s.notice_id AND links.award_key = s.award_key""")
def history_links_saved(spark, sf):
    stored, a = R.cut(world.matches(spark, sf)), world.awards(spark, sf)
    return H.save_links(stored, H.link_rows(_found(spark, sf), a, "v2", stored))[1]


# --- the matcher ------------------------------------------------------------------------------------------------

_GONE = """
    resulting AS (SELECT notice_id, award_key FROM w_m WHERE kind = 'resulting_award' AND status <> 'rejected'),
    gone AS (SELECT award_key, count(DISTINCT notice_id) AS times, min(notice_id) AS who FROM w_m WHERE kind = 'incumbent' AND (status = 'confirmed' OR (status = 'auto' AND shown = 'incumbent')) AND notice_id IN (SELECT notice_id FROM resulting) GROUP BY 1)"""


@query(f"""
    WITH {W('m')}, {_GONE}, p AS (SELECT notice_id, award_key FROM w_m UNION SELECT 'N' || (nk + 1), award_key FROM w_m)
    SELECT notice_id, award_key FROM p WHERE NOT EXISTS (SELECT 1 FROM resulting r WHERE r.notice_id = p.notice_id AND r.award_key = p.award_key)
      AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.award_key = p.award_key AND NOT (times = 1 AND who = p.notice_id))""")
def excluded_pairs(spark, sf):
    m = world.matches(spark, sf)
    pairs = m.select("notice_id", "award_key")
    pairs = pairs.union(m.select(F.concat(F.lit("N"), (F.substring("notice_id", 2, 20).cast("long") + 1).cast("string")), "award_key")).distinct()
    return M.excluded_awards(m).without(pairs)


_CITED = f"""
    c AS (SELECT s.notice_id, s.sub, 'W91Q' || lpad(unnest([k0, k1])::VARCHAR, 6, '0') || 'C' AS norm, unnest([k0, k1]) AS ck, unnest([0, 1]) AS pl FROM w_scope s JOIN w_d d ON d.notice_id = s.notice_id WHERE text IS NOT NULL),
    hit AS (SELECT c.notice_id, a.award_key, pl, ck, norm, CASE WHEN a.type IN ('IDV_A', 'IDV_C', 'IDV_D') OR (a.type LIKE 'IDV%' AND a.sub IS DISTINCT FROM c.sub) THEN 'vehicle' WHEN a.sub IS NOT DISTINCT FROM c.sub THEN 'explicit' END AS kind
      FROM c JOIN w_a a ON a.piid_norm = norm WHERE NOT EXISTS (SELECT 1 FROM resulting r WHERE r.notice_id = c.notice_id AND r.award_key = a.award_key) AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.award_key = a.award_key AND NOT (times = 1 AND who = c.notice_id)))"""


@query(f"""
    WITH {W('a', 'n', 'd', 'm')}, {_GONE}, {_CITED} SELECT notice_id, norm, kind, CASE WHEN kind = 'explicit' THEN CASE pl WHEN 0 THEN 'w91q-' || lpad(ck::VARCHAR, 6, '0') || '-c' ELSE 'W91Q' || lpad(ck::VARCHAR, 6, '0') || 'C' END END AS cited_as, CASE WHEN kind = 'explicit' THEN 'incumbent,follow-on' END AS context FROM hit WHERE kind IS NOT NULL""")
def cited_awards(spark, sf):
    found = M.cited_awards(_facts(spark, sf), M.award_facts(world.awards(spark, sf)), CFG, M.excluded_awards(world.matches(spark, sf)))
    explicit = found.explicit.join(world.awards(spark, sf).select("award_key", F.col("piid_norm").alias("norm")), "award_key")
    explicit = explicit.select("notice_id", "norm", F.lit("explicit").alias("kind"), "cited_as", F.array_join("context", ",").alias("context"))
    none = F.lit(None).cast("string")
    return explicit.unionByName(found.vehicles.select("notice_id", F.explode("vehicles").alias("norm"), F.lit("vehicle").alias("kind"), none.alias("cited_as"), none.alias("context")))


def _near_sql(pairs: str) -> str:
    stop = _list(T.STOPWORDS)
    tokens = f"list_filter(regexp_extract_all(lower(x), '[a-z0-9]+'), lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN ({stop}))"
    return f"""
    corpus AS (SELECT award_key AS id, description AS x FROM w_a WHERE naics IN ({_list(VERTICAL)})), nn AS (SELECT count(*) AS n FROM corpus),
    df AS (SELECT word, count(DISTINCT id) AS df FROM (SELECT id, unnest({tokens}) AS word FROM corpus) GROUP BY 1),
    docs AS (SELECT 'a' AS side, award_key AS id, 'a' AS kind, description AS x FROM w_a UNION ALL SELECT 'n', s.notice_id, 'title', title FROM w_scope s UNION ALL SELECT 'n', s.notice_id, 'text', title || coalesce(chr(10) || text, '') FROM w_scope s LEFT JOIN w_d d ON d.notice_id = s.notice_id),
    tf AS (SELECT side, id, kind, word, count(*) AS tf FROM (SELECT side, id, kind, unnest({tokens}) AS word FROM docs) GROUP BY ALL),
    raw AS (SELECT side, id, kind, tf.word, (1 + ln(tf)) * (ln((1 + n) / (1 + coalesce(df, 0))) + 1) AS raw FROM tf LEFT JOIN df ON df.word = tf.word, nn),
    vec AS (SELECT side, id, kind, word, raw / sqrt(sum(raw * raw) OVER (PARTITION BY side, id, kind)) AS w FROM raw),
    dots AS (SELECT p.notice_id, p.award_key, x.kind, x.word, x.w * y.w AS p FROM {pairs} p JOIN vec x ON x.side = 'n' AND x.id = p.notice_id JOIN vec y ON y.side = 'a' AND y.id = p.award_key AND y.word = x.word),
    top AS (SELECT *, row_number() OVER (PARTITION BY notice_id, award_key, kind ORDER BY p DESC, word) AS rn FROM dots),
    cosine AS (SELECT notice_id, award_key, kind, sum(p) AS c, string_agg(word, ', ' ORDER BY rn) FILTER (WHERE rn <= 3) AS terms FROM top GROUP BY ALL),
    sim AS (SELECT notice_id, award_key, c AS similarity, terms FROM (SELECT *, row_number() OVER (PARTITION BY notice_id, award_key ORDER BY c DESC, kind DESC) AS k FROM cosine) WHERE k = 1)"""


_CAND = f"""
    scope AS (SELECT s.*, coalesce(deadline, posted + 30, {_TODAY}) AS ref FROM w_scope s),
    spans AS (SELECT *, CAST(ref - INTERVAL 6 MONTH AS DATE) AS low, CAST(ref + INTERVAL 18 MONTH AS DATE) AS high FROM scope),
    near AS (SELECT n.notice_id, a.award_key, row_number() OVER (PARTITION BY n.notice_id ORDER BY (a.office IS NOT DISTINCT FROM n.office) DESC, abs(date_diff('day', ref, ends)), a.award_key) AS rn
      FROM spans n JOIN w_a a ON a.sub = n.sub AND ends BETWEEN low AND high AND a.type IN ({_list(CFG.candidates.award_types)}) AND val >= {CFG.candidates.min_total_value}
        AND (a.office = n.office OR list_contains(list_transform(codes, lambda c: left(c, 4)), left(a.naics, 4)) OR left(a.psc, 2) = left(n.psc, 2))
      WHERE NOT EXISTS (SELECT 1 FROM resulting r WHERE r.notice_id = n.notice_id AND r.award_key = a.award_key) AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.award_key = a.award_key AND NOT (times = 1 AND who = n.notice_id))),
    pairs AS (SELECT notice_id, award_key FROM near WHERE rn <= {CFG.candidates.max_per_notice} UNION SELECT notice_id, award_key FROM hit WHERE kind = 'explicit')"""


@query(f"WITH {W('a', 'n', 'd', 'm')}, {_GONE}, {_CITED}, {_CAND}, {_near_sql('pairs')} SELECT notice_id, award_key, round(similarity, 6) AS similarity, terms FROM sim")
def text_similarities(spark, sf):
    facts, known = R.cut(_facts(spark, sf)), M.award_facts(world.awards(spark, sf))
    exclude = M.excluded_awards(world.matches(spark, sf)).cut_for(facts)
    pairs = R.cut(M.candidates(facts, known, CFG, exclude).unionByName(M.cited_awards(facts, known, CFG, exclude).explicit.select("notice_id", "award_key")).distinct())
    out = M.similarities(facts, known, pairs, world.awards(spark, sf).where(F.col("naics").isin(*VERTICAL)))
    return out.select("notice_id", "award_key", F.round("similarity", 6).alias("similarity"), F.array_join("shared_terms", ", ").alias("terms"))


_W, _F = CFG.weights, CFG.features
_MATCH = f"""
    full_rows AS (SELECT p.notice_id, p.award_key, s.*, a.office AS a_office, a.office_name, a.sub AS a_sub, a.sub_name, a.naics AS a_naics, a.psc AS a_psc, a.set_aside AS a_set, a.ref_norm, CAST(a.val AS DOUBLE) AS val, a.ends, a.piid,
        coalesce(similarity, 0) AS similarity, terms, e.pl IS NOT NULL AS explicit, CASE e.pl WHEN 0 THEN 'w91q-' || lpad(e.ck::VARCHAR, 6, '0') || '-c' WHEN 1 THEN 'W91Q' || lpad(e.ck::VARCHAR, 6, '0') || 'C' END AS cited_as,
        CASE WHEN d.text IS NOT NULL THEN (d.k % 9 + 1) * 100000.0 END AS stated, v.vs, d.text IS NULL AS no_text
      FROM pairs p JOIN spans s ON s.notice_id = p.notice_id JOIN w_a a ON a.award_key = p.award_key LEFT JOIN sim ON sim.notice_id = p.notice_id AND sim.award_key = p.award_key LEFT JOIN (SELECT * FROM hit WHERE kind = 'explicit') e ON e.notice_id = p.notice_id AND e.award_key = p.award_key
      LEFT JOIN w_d d ON d.notice_id = p.notice_id LEFT JOIN (SELECT notice_id, list(norm) AS vs FROM hit WHERE kind = 'vehicle' GROUP BY 1) v ON v.notice_id = p.notice_id),
    feat AS (SELECT *, CASE WHEN sub = a_sub AND office = a_office THEN 1.0 WHEN sub = a_sub THEN {_F.office_same_subtier_only} ELSE 0.0 END AS f_office, least(1.0, greatest(0.0, similarity / {_F.text_full_at})) AS f_text,
        CASE WHEN list_contains(codes, a_naics) THEN 1.0 WHEN list_contains(list_transform(codes, lambda c: left(c, 4)), left(a_naics, 4)) THEN {_F.naics_same_group} ELSE 0.0 END AS f_naics,
        CASE WHEN psc IS NULL THEN {_F.psc_missing} WHEN psc = a_psc THEN 1.0 WHEN left(psc, 2) = left(a_psc, 2) THEN {_F.psc_same_prefix2} WHEN left(psc, 1) = left(a_psc, 1) THEN {_F.psc_same_prefix1} ELSE 0.0 END AS f_psc,
        date_diff('day', ref, ends) AS off, date_diff('day', ref, low) AS lo, date_diff('day', ref, high) AS hi,
        CASE set_aside WHEN 'SBP' THEN 'small' WHEN '8A' THEN '8a' ELSE 'none' END AS nf, CASE WHEN a_set = 'SBA' THEN 'small' ELSE 'none' END AS af,
        CASE WHEN stated IS NULL OR val <= 0 THEN {_F.value_missing} WHEN val / stated >= 1.0 / 3 AND val / stated <= 3 THEN 1.0 ELSE 0.2 END AS f_value,
        CASE WHEN vs IS NULL THEN {_F.vehicle_missing} WHEN coalesce(list_contains(vs, ref_norm), false) THEN 1.0 ELSE 0.0 END AS f_vehicle FROM full_rows),
    feat2 AS (SELECT *, CASE WHEN ends IS NULL OR off < lo OR off > hi THEN 0.0 WHEN off < -30 THEN CAST(off - lo AS DOUBLE) / (-30 - lo) WHEN off > 270 THEN CAST(hi - off AS DOUBLE) / (hi - 270) ELSE 1.0 END AS f_end, CASE WHEN nf = af THEN 1.0 WHEN nf <> 'none' AND af <> 'none' THEN 0.5 ELSE 0.0 END AS f_set FROM feat),
    base AS (SELECT *, CAST({_W.office} * f_office + {_W.text} * f_text + {_W.naics} * f_naics + {_W.end_date} * f_end + {_W.psc} * f_psc + {_W.set_aside} * f_set + {_W.value} * f_value + {_W.vehicle} * f_vehicle AS DOUBLE) AS base_score FROM feat2),
    scored AS (SELECT *, least(CASE WHEN explicit THEN greatest(base_score, {CFG.explicit_reference.score}) ELSE base_score END, 1.0) AS score FROM base),
    ranked AS (SELECT scored.*, m.status AS review, row_number() OVER (PARTITION BY scored.notice_id ORDER BY round(scored.score, 6) DESC, explicit DESC, f_office DESC, coalesce(abs(off), 1000000), coalesce(val, 0) DESC, scored.award_key) AS position
      FROM scored LEFT JOIN (SELECT * FROM w_m WHERE kind = 'incumbent' AND status <> 'auto') m ON m.notice_id = scored.notice_id AND m.award_key = scored.award_key),
    pool AS (SELECT *, coalesce(review <> 'rejected', true) AS p, row_number() OVER (PARTITION BY notice_id ORDER BY coalesce(review <> 'rejected', true) DESC, position) AS pl FROM ranked),
    best AS (SELECT *, max(CASE WHEN pl = 1 THEN CASE WHEN p THEN score ELSE 0 END END) OVER (PARTITION BY notice_id) AS s1, coalesce(max(CASE WHEN pl = 2 THEN CASE WHEN p THEN score ELSE 0 END END) OVER (PARTITION BY notice_id), 0) AS s2 FROM pool),
    decided AS (SELECT *, CASE WHEN notice_id IN (SELECT notice_id FROM w_m WHERE kind = 'incumbent' AND status = 'confirmed') OR NOT p THEN 'hidden' WHEN s1 >= {CFG.decision.incumbent_threshold} AND s1 - s2 >= {CFG.decision.margin} THEN CASE WHEN pl = 1 THEN 'incumbent' ELSE 'hidden' END
        WHEN pl <= {CFG.decision.max_possible} AND score >= {CFG.decision.possible_floor} THEN 'possible' ELSE 'hidden' END AS shown FROM best),
    kept AS (SELECT *, row_number() OVER (PARTITION BY notice_id ORDER BY position) AS rank FROM decided WHERE explicit OR (position <= {CFG.decision.store_max} AND score >= {CFG.decision.store_floor})),
    told AS (SELECT *, CAST(round_even(off / 30.44, 0) AS INTEGER) AS months FROM kept WHERE review IS NULL)"""
_REASONS = """
    array_to_string(list_filter([
      CASE WHEN explicit THEN 'The notice mentions this contract (' || cited_as || ') near the words “incumbent”' END,
      CASE WHEN f_office = 1 THEN 'Same contracting office (' || office_name || ')' WHEN f_office > 0 THEN 'Same agency (' || sub_name || '), different office' END,
      CASE WHEN f_end > 0 THEN CASE WHEN months = 0 THEN 'Current contract ends ' || strftime(ends, '%b %Y') || ', around ' || CASE WHEN deadline IS NOT NULL THEN 'the response deadline' ELSE 'the notice date' END
        ELSE 'Current contract ends ' || strftime(ends, '%b %Y') || ', ' || abs(months) || ' ' || CASE WHEN abs(months) = 1 THEN 'month' ELSE 'months' END || ' ' || CASE WHEN months > 0 THEN 'after' ELSE 'before' END || ' ' || CASE WHEN deadline IS NOT NULL THEN 'the response deadline' ELSE 'the notice date' END END END,
      CASE WHEN f_naics = 1 THEN 'Same industry code (NAICS ' || a_naics || ')' WHEN f_naics > 0 THEN 'Related industry code (NAICS ' || a_naics || ')' END,
      CASE WHEN f_text >= 0.3 AND terms IS NOT NULL THEN 'Similar work: ' || terms END,
      CASE WHEN f_psc = 1 THEN 'Same product or service code (' || a_psc || ')' END,
      CASE WHEN f_vehicle = 1 THEN 'Ordered under the same contract vehicle the notice names' END,
      CASE WHEN f_set = 1 AND af <> 'none' THEN 'Same set-aside (' || a_set || ')' END,
      CASE WHEN f_value = 1 THEN 'Contract value is in line with the amount in the notice' END], lambda x: x IS NOT NULL), '|')"""
_ALL = f"WITH {W('a', 'n', 'd', 'm')}, {_GONE}, {_CITED}, {_CAND}, {_near_sql('pairs')}, {_MATCH}"


def matched(spark, sf) -> DataFrame:
    """The matcher over all notices."""
    return M.match(world.stored_notices(spark, sf), world.awards(spark, sf), world.descriptions(spark, sf), world.matches(spark, sf), CFG, VERTICAL, TODAY)


@query(f"""
    {_ALL} SELECT notice_id, award_key, piid, CASE WHEN explicit THEN 'explicit_reference' ELSE 'candidate' END AS method, CAST(round(round(CAST(round(score, 9) AS DECIMAL(12,9)), 4), 3) AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank, shown, {_REASONS} AS reasons,
      CAST(round(round(CAST(round(base_score, 9) AS DECIMAL(12,9)), 4), 3) AS DOUBLE) AS base_score, CAST(f_vehicle AS DOUBLE) AS vehicle, ref AS reference_date, ends AS end_date, cited_as FROM told""")
def incumbent_matches(spark, sf):
    """The matcher's rows; scores, which it keeps with four digits, to three, since the order of additions differs from SQL's."""
    rounded = lambda c: F.round(F.round(c, 9).cast("decimal(12,9)"), 3).cast("double")
    e = F.col("evidence")
    out = matched(spark, sf)
    return out.select("notice_id", "award_key", "piid", "method", rounded(F.col("score").cast("double")).alias("score"), "rank", "shown", F.array_join(e["reasons"], "|").alias("reasons"), rounded(e["base_score"]).alias("base_score"),
                      e["features"]["vehicle"].alias("vehicle"), F.to_date(e["reference_date"]).alias("reference_date"), e["end_date"].alias("end_date"), e["cited_as"].alias("cited_as"))


@query(f"""
    {_ALL}, seen AS (SELECT notice_id, bool_or(shown = 'incumbent') AS i, bool_or(shown = 'possible') AS p FROM told GROUP BY 1)
    SELECT count(*) AS notices, count(i) AS with_candidates, count(*) FILTER (WHERE i) AS incumbents, count(*) FILTER (WHERE p) AS possible FROM w_scope LEFT JOIN seen USING (notice_id)""")
def run_summary(spark, sf):
    return P.run_summary(_facts(spark, sf), matched(spark, sf))


@query(f"""
    WITH {W('n', 'm')}, s AS (SELECT * FROM w_m), n AS (SELECT notice_id, award_key, nk, ak FROM w_m WHERE kind = 'incumbent' AND ak % 3 > 0 UNION ALL SELECT notice_id, award_key, nk, ak FROM w_m WHERE kind = 'resulting_award' AND ak % 2 = 0),
    j AS (SELECT n.notice_id AS fresh, s.status, coalesce(s.notice_id, n.notice_id) AS notice_id FROM (SELECT * FROM s WHERE kind = 'incumbent') s FULL JOIN n ON n.notice_id = s.notice_id AND n.award_key = s.award_key)
    SELECT count(*) FILTER (WHERE fresh IS NOT NULL AND coalesce(status, 'auto') = 'auto') AS written, count(*) FILTER (WHERE fresh IS NULL AND status = 'auto' AND notice_id IN (SELECT notice_id FROM w_scope)) AS deleted FROM j""")
def matches_saved(spark, sf):
    m = R.cut(world.matches(spark, sf))
    k = F.col("award_key").cast("long")
    rows = m.where(((F.col("kind") == "incumbent") & (k % 3 > 0)) | ((F.col("kind") == "resulting_award") & (k % 2 == 0)))
    rows = rows.withColumns({"kind": F.lit("incumbent"), "matcher_version": F.lit("v2"), "status": F.lit("auto")})
    return M.save(m, _facts(spark, sf), rows)[1]


@query(f"WITH {W('m')} SELECT status, count(*) AS n FROM w_m WHERE status <> 'auto' GROUP BY 1")
def matches_reset(spark, sf):
    return M.reset_automatic(world.matches(spark, sf)).groupBy("status").agg(F.count("*").alias("n"))


# --- recompetes -------------------------------------------------------------------------------------------------

_LINKED = "linked AS (SELECT award_key, notice_id AS linked_notice_id FROM (SELECT m.award_key, m.notice_id, row_number() OVER (PARTITION BY m.award_key ORDER BY posted DESC NULLS LAST, m.notice_id) AS rn FROM w_m m JOIN w_n n ON n.notice_id = m.notice_id WHERE n.active AND m.kind = 'incumbent' AND m.shown = 'incumbent' AND m.status <> 'rejected') WHERE rn = 1)"


@query(f"WITH {W('n', 'm')}, {_LINKED} SELECT * FROM linked")
def linked_latest_notice(spark, sf):
    return C.linked_notices(world.matches(spark, sf), world.stored_notices(spark, sf))


@query(f"""
    WITH {W('a', 'n', 'm')}, {_LINKED} SELECT a.award_key, type AS award_type_code, coalesce(recipient, c_name) AS recipient_name, CAST(val AS DOUBLE) AS total_value, ends AS ultimate_end, linked_notice_id FROM w_a a LEFT JOIN linked ON linked.award_key = a.award_key
    WHERE naics IN ({_list(VERTICAL)}) AND type IN ({_list(CFG.candidates.award_types)}) AND val >= {CFG.candidates.min_total_value} AND ends BETWEEN CAST({_TODAY} + INTERVAL {C.MONTHS_FROM} MONTH AS DATE) AND CAST({_TODAY} + INTERVAL {C.MONTHS_TO} MONTH AS DATE)""")
def recompetes(spark, sf):
    """Contracts of the vertical that end in the window, with names and the newest linked notice."""
    names = _t(spark, sf, "customer").select(F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("uei"), F.col("c_name").alias("name"))
    out = C.recompetes(world.awards(spark, sf), names, world.matches(spark, sf), world.stored_notices(spark, sf), CFG, VERTICAL, TODAY)
    return out.select("award_key", "award_type_code", "recipient_name", F.col("total_value").cast("double").alias("total_value"), "ultimate_end", "linked_notice_id")


# --- reports ----------------------------------------------------------------------------------------------------


@query(f"WITH {W('n')} SELECT type, count(*) FILTER (WHERE active) AS active, count(*) FILTER (WHERE NOT active) AS archived FROM w_vertical GROUP BY 1")
def notices_by_type(spark, sf):
    return P.notices_by_type(world.stored_notices(spark, sf), VERTICAL)


@query(f"WITH {W('n')} SELECT min(posted) AS first, max(posted) AS last FROM w_vertical")
def posted_span(spark, sf):
    return P.posted_span(world.stored_notices(spark, sf), VERTICAL)


_COVER = f"""
    cover AS (SELECT count(*) AS in_scope, count(*) FILTER (WHERE sub IN (SELECT sub FROM w_a)) AS subtier_known, count(*) FILTER (WHERE (sub, office) IN (SELECT (sub, office) FROM w_a)) AS office_known, count(*) FILTER (WHERE notice_id IN (SELECT 'N' || s_suppkey FROM supplier)) AS with_text,
      count(*) FILTER (WHERE notice_id IN (SELECT notice_id FROM w_m WHERE kind = 'incumbent' AND shown = 'incumbent')) AS incumbent_shown, count(*) FILTER (WHERE notice_id IN (SELECT notice_id FROM w_m WHERE kind = 'incumbent' AND shown = 'possible')) AS possible_shown,
      count(*) FILTER (WHERE notice_id IN (SELECT notice_id FROM w_m WHERE method = 'explicit_reference')) AS cites FROM w_scope)"""


@query(f"WITH {W('a', 'n', 'm')}, {_COVER} SELECT * FROM cover")
def coverage(spark, sf):
    return P.coverage(world.stored_notices(spark, sf), world.awards(spark, sf), world.descriptions(spark, sf), world.matches(spark, sf), CFG, VERTICAL, TODAY)


@query(f"""
    WITH {W('a', 'n', 'm')}, {_COVER}, t AS (SELECT type, count(*) FILTER (WHERE active) AS active, count(*) FILTER (WHERE NOT active) AS archived FROM w_vertical GROUP BY 1)
    SELECT 'types' AS section, type || ' active' AS item, CAST(active AS VARCHAR) AS value, CAST(NULL AS BIGINT) AS of FROM t UNION ALL SELECT 'types', type || ' archived', CAST(archived AS VARCHAR), NULL FROM t
    UNION ALL SELECT 'posted', unnest(['first', 'last']), CAST(unnest([min(posted), max(posted)]) AS VARCHAR), NULL FROM w_vertical UNION ALL SELECT 'scope', 'in_scope', CAST(in_scope AS VARCHAR), NULL FROM cover
    UNION ALL SELECT 'scope', unnest(['subtier_known', 'office_known', 'with_text', 'incumbent_shown', 'possible_shown', 'cites']), CAST(unnest([subtier_known, office_known, with_text, incumbent_shown, possible_shown, cites]) AS VARCHAR), in_scope FROM cover
    UNION ALL SELECT 'history', 'linked_notices', CAST(count(DISTINCT notice_id) AS VARCHAR), NULL FROM w_m WHERE kind = 'resulting_award'
    UNION ALL SELECT 'chunks', 'c' || event_id || CASE WHEN value > 20 THEN ' done' ELSE ' in_progress' END, CAST(event_id AS VARCHAR), NULL FROM events""")
def diagnosis(spark, sf):
    return P.diagnosis(world.stored_notices(spark, sf), world.awards(spark, sf), world.descriptions(spark, sf), world.matches(spark, sf), world.chunks(spark, sf), CFG, VERTICAL, TODAY)


@query(f"WITH {W('r')} SELECT source, job, id, status FROM (SELECT *, row_number() OVER (PARTITION BY source, job ORDER BY started DESC NULLS LAST, id DESC) AS rn FROM w_r) WHERE rn = 1")
def last_runs(spark, sf):
    return P.last_runs(world.runs(spark, sf)).select("source", "job", "id", "status")


@query(f"WITH {W('r')} SELECT source, error FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started DESC NULLS LAST, id DESC) AS rn FROM w_r WHERE error IS NOT NULL) WHERE rn = 1")
def last_errors(spark, sf):
    return P.last_errors(world.runs(spark, sf)).select("source", "error")


@query(f"WITH {W('r')} SELECT (SELECT max(day) FROM w_r WHERE source = 'click' AND status = 'succeeded') AS through, (SELECT coalesce(sum(requests), 0)::BIGINT FROM w_r WHERE source = 'click' AND started >= date_trunc('day', TIMESTAMP '{NOW}')) AS requests")
def watermark_and_requests(spark, sf):
    runs = world.runs(spark, sf)
    return P.watermark(runs, "click", "through").crossJoin(F.broadcast(P.requests_today(runs, "click", NOW)))


@query("SELECT count(*) FILTER (WHERE value > 20 AND event_type = 'click') AS done, 501 AS total FROM events WHERE event_id <= 500")
def plan_progress(spark, sf):
    return P.plan_progress(world.chunks(spark, sf), "click", [f"c{i}" for i in range(501)]).select("done", F.col("total").cast("int").alias("total"))


_QUEUE = f"""
    queue AS (SELECT m.notice_id, n.title AS notice_title, n.agency, deadline, m.award_key, m.piid, recipient AS company, CAST(shown_val AS DOUBLE) AS value, ends, CAST(score AS DOUBLE) AS score, rank, reason AS reasons FROM w_m m JOIN w_n n ON n.notice_id = m.notice_id AND n.active JOIN w_a a ON a.award_key = m.award_key
      WHERE m.kind = 'incumbent' AND m.status = 'auto' AND m.shown = 'possible' ORDER BY deadline NULLS LAST, m.notice_id, rank, m.award_key LIMIT {P.QUEUE})"""


@query(f"WITH {W('a', 'n', 'm')}, {_QUEUE} SELECT * FROM queue")
def review_queue(spark, sf):
    q = P.review_queue(world.matches(spark, sf), world.stored_notices(spark, sf), world.awards(spark, sf))
    return q.select("notice_id", "notice_title", "agency", F.to_date("deadline").alias("deadline"), "award_key", "piid", "company", F.col("value").cast("double").alias("value"), "ends", F.col("score").cast("double").alias("score"), "rank", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {W('a', 'n', 'm')}, {_QUEUE} SELECT notice_id, count(*) AS n, string_agg(award_key, ',' ORDER BY rank, award_key) AS items FROM queue GROUP BY notice_id, notice_title, agency, deadline")
def queue_by_notice(spark, sf):
    q = P.group_by_notice(P.review_queue(world.matches(spark, sf), world.stored_notices(spark, sf), world.awards(spark, sf)))
    return q.select("notice_id", F.size("items").cast("long").alias("n"), F.array_join(F.transform("items", lambda x: x["award_key"]), ",").alias("items"))


_SHEET = f"""
    inc AS (SELECT notice_id, row_number() OVER (ORDER BY md5(notice_id || 'm2'), notice_id) AS rn FROM w_n n WHERE active AND EXISTS (SELECT 1 FROM w_m m WHERE m.notice_id = n.notice_id AND kind = 'incumbent' AND shown = 'incumbent')),
    pos AS (SELECT notice_id, row_number() OVER (ORDER BY md5(notice_id || 'm2'), notice_id) AS rn FROM w_n n WHERE active AND EXISTS (SELECT 1 FROM w_m m WHERE m.notice_id = n.notice_id AND kind = 'incumbent' AND shown = 'possible')),
    sheet AS (SELECT notice_id, 'incumbent' AS stratum FROM inc WHERE rn <= 18 UNION ALL SELECT notice_id, 'possible' FROM pos WHERE rn <= 30 - (SELECT count(*) FROM inc WHERE rn <= 18))"""


@query(f"WITH {W('n', 'm')}, {_SHEET} SELECT * FROM sheet")
def sheet_notices(spark, sf):
    return P.sheet_notices(world.stored_notices(spark, sf), world.matches(spark, sf), 30)


@query(f"""
    WITH {W('a', 'n', 'm')}, {_SHEET}, r AS (SELECT m.*, row_number() OVER (PARTITION BY notice_id ORDER BY rank NULLS LAST, award_key) AS pl FROM w_m m WHERE kind = 'incumbent' AND status <> 'rejected' AND notice_id IN (SELECT notice_id FROM sheet))
    SELECT notice_id, CAST(pl AS INTEGER) AS "at", r.award_key, r.piid, CAST(shown_val AS DOUBLE) AS value, ends FROM r JOIN w_a a ON a.award_key = r.award_key WHERE pl <= {P.PER_NOTICE}""")
def sheet_candidates(spark, sf):
    m = world.matches(spark, sf)
    out = P.sheet_candidates(P.sheet_notices(world.stored_notices(spark, sf), m, 30), m, world.awards(spark, sf))
    return out.select("notice_id", "at", "award_key", "piid", F.col("value").cast("double").alias("value"), "ends")


@query("""
    WITH s AS (SELECT 'N' || s_suppkey AS notice_id, 'none' AS answer, 'sheet' AS source, NULL AS award_key FROM supplier WHERE s_suppkey % 2 = 0),
    v AS (SELECT 'N' || (user_id % 200) AS notice_id, 'A' || (event_id % 3) AS award_key, CASE WHEN value > 20 THEN 'confirmed' ELSE 'rejected' END AS decision, ts, event_id FROM events),
    l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY notice_id, award_key ORDER BY ts DESC, event_id DESC) AS rn FROM v) WHERE rn = 1 AND decision = 'confirmed'),
    c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY notice_id ORDER BY ts DESC, event_id DESC) AS k FROM l) WHERE k = 1)
    SELECT notice_id, award_key, answer, source FROM s UNION ALL SELECT notice_id, award_key, 'incumbent', 'review' FROM c WHERE notice_id NOT IN (SELECT notice_id FROM s)""")
def effective_labels(spark, sf):
    sheet = _t(spark, sf, "supplier").where("s_suppkey % 2 = 0").selectExpr("'N' || s_suppkey notice_id", "cast(null as string) award_key", "'none' answer", "'sheet' source", "date'2024-01-01' labeled_at", "cast(null as string) notes")
    reviews = _t(spark, sf, "events").selectExpr("'N' || (user_id % 200) notice_id", "'A' || (event_id % 3) award_key", "case when value > 20 then 'confirmed' else 'rejected' end decision", "'me' reviewer", "cast(null as string) note", "cast(ts as timestamp) created_at", "event_id id")
    return P.effective_labels(sheet, reviews).select("notice_id", "award_key", "answer", "source")


@query(f"WITH {W('m')} SELECT notice_id, award_key, CAST(score AS DOUBLE) AS score, CAST(coalesce(base_score, score) AS DOUBLE) AS base_score, method FROM w_m WHERE kind = 'incumbent' AND nk % 2 = 0")
def stored_candidates(spark, sf):
    wanted = _t(spark, sf, "lineitem").where("l_suppkey % 2 = 0").select(F.concat(F.lit("N"), F.col("l_suppkey").cast("string")).alias("notice_id"))
    return P.stored_candidates(world.matches(spark, sf), wanted)


@query("SELECT CASE o_orderkey % 4 WHEN 0 THEN 'incumbent' WHEN 1 THEN 'other' WHEN 2 THEN 'none' ELSE 'unsure' END AS answer, count(*) AS count FROM orders GROUP BY 1")
def answer_counts(spark, sf):
    return P.answer_counts(_t(spark, sf, "orders").selectExpr("case o_orderkey % 4 when 0 then 'incumbent' when 1 then 'other' when 2 then 'none' else 'unsure' end answer"))


_PICK = "pick AS (SELECT notice_id, award_key FROM w_m WHERE kind = 'incumbent' AND status = 'auto' AND shown = 'possible' ORDER BY nk, ak LIMIT 1)"


@query(f"""
    WITH {W('m')}, {_PICK} SELECT m.notice_id, m.award_key, CASE WHEN p.award_key IS NOT NULL THEN 'incumbent' WHEN m.notice_id = (SELECT notice_id FROM pick) AND kind = 'incumbent' AND status = 'auto' THEN 'hidden' ELSE shown END AS shown, CASE WHEN p.award_key IS NOT NULL THEN 'confirmed' ELSE status END AS status
    FROM w_m m LEFT JOIN pick p ON p.notice_id = m.notice_id AND p.award_key = m.award_key AND kind = 'incumbent'""")
def record_review(spark, sf):
    m = world.matches(spark, sf)
    waiting = m.where("kind = 'incumbent' and status = 'auto' and shown = 'possible'")
    one = waiting.orderBy(F.substring("notice_id", 2, 20).cast("long"), F.col("award_key").cast("long")).first()
    log = spark.createDataFrame([], schemas.table(schemas.REVIEW_DDL))
    return P.record_review(m, log, one["notice_id"], one["award_key"], "confirmed", "me", NOW)[0].select("notice_id", "award_key", "shown", "status")


# --- versions ---------------------------------------------------------------------------------------------------


def _snapshot(**have: Column) -> Column:
    types = {f.name: f.dataType for f in schemas.notice()}
    return F.struct(*(have.get(f, F.lit(None)).cast(types.get(f, "string")).alias(f) for f in V.fields()))


def _two_snapshots(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    day = F.lit("2024-05-04").cast("timestamp")
    old = _snapshot(title=F.col("c_name"), psc=F.when(k % 2 == 0, "D1"), ui_link=F.when(k % 3 > 0, F.lit("u")), response_deadline=F.timestamp_add("HOUR", F.lit(17), day), response_deadline_has_time=F.lit(True), description_sha256=F.lit("h"))
    new = _snapshot(title=F.when(k % 4 > 0, F.upper("c_name")), psc=F.lit("D2"), ui_link=F.lit("w"), response_deadline=F.when(k % 5 > 0, day).otherwise(F.lit("2024-06-01").cast("timestamp")), response_deadline_has_time=F.lit(False), description_sha256=F.lit(None))
    return _t(spark, sf, "customer").select("c_custkey", old.alias("old"), new.alias("new"))


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN upper(c_name) END AS title, 'D2' AS psc, 'w' AS link, CASE WHEN c_custkey % 5 > 0 THEN 17 ELSE 0 END AS hour, c_custkey % 5 > 0 AS timed, 'h' AS hash,
      CASE WHEN c_custkey % 4 > 0 THEN upper(c_name) ELSE c_name END AS part_title, 'D2' AS part_psc, CASE WHEN c_custkey % 3 > 0 THEN 'u' ELSE 'w' END AS part_link FROM customer""")
def merged_snapshots(spark, sf):
    rows = _two_snapshots(spark, sf).select("c_custkey", V.merged(F.col("old"), F.col("new"), None).alias("a"), V.merged(F.col("old"), F.col("new"), V.CSV_AUTHORITATIVE).alias("b"))
    return rows.select("c_custkey", "a.title", "a.psc", F.col("a.ui_link").alias("link"), F.hour("a.response_deadline").alias("hour"), F.col("a.response_deadline_has_time").alias("timed"), F.col("a.description_sha256").alias("hash"),
                       F.col("b.title").alias("part_title"), F.col("b.psc").alias("part_psc"), F.col("b.ui_link").alias("part_link"))


@query("""
    SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 7 > 0 THEN 'description_sha256' END, CASE WHEN c_custkey % 2 = 0 THEN 'psc' END, CASE WHEN c_custkey % 5 > 0 THEN 'response_deadline,response_deadline_has_time' END,
      CASE WHEN c_custkey % 4 > 0 THEN 'title' END, CASE WHEN c_custkey % 3 = 0 THEN 'ui_link' END) AS fields FROM customer""")
def snapshot_diff(spark, sf):
    k = F.col("c_custkey")
    day = F.lit("2024-05-04").cast("timestamp")
    old = _snapshot(title=F.lower("c_name"), psc=F.lit("D2"), ui_link=F.lit("w"), response_deadline=day, response_deadline_has_time=F.lit(False), description_sha256=F.lit("h"))
    later = F.when(k % 5 > 0, F.timestamp_add("HOUR", F.lit(17), day)).otherwise(day)
    new = _snapshot(title=F.when(k % 4 == 0, F.lower("c_name")).when(k % 8 < 4, F.col("c_name")), psc=F.when(k % 2 > 0, "D2"), ui_link=F.when(k % 3 > 0, F.lit("w")).otherwise("v"), response_deadline=later,
                    response_deadline_has_time=k % 5 > 0, description_sha256=F.when(k % 7 > 0, "g").otherwise("h"))
    found = V.diff(F.col("old"), F.col("new"))
    return _t(spark, sf, "customer").select("c_custkey", old.alias("old"), new.alias("new")).select("c_custkey", F.array_join(F.transform(found, lambda x: x["field"]), ",").alias("fields"))


_STEPS = """
    e AS (SELECT user_id, event_id, event_type, CASE WHEN event_id % 3 = 0 THEN 'p' || (event_id % 2) END AS psc, CASE WHEN event_id % 4 = 0 THEN 'text ' || (event_id % 8) END AS text, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    c AS (SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER w OR psc IS DISTINCT FROM lag(psc) OVER w AS other, last_value(text IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    s AS (SELECT *, k = 1 AS new, text IS NOT NULL AND known IS NOT NULL AND text <> known AS retold, text IS NOT NULL AND known IS NULL AND k > 1 AS filled FROM c),
    v AS (SELECT *, CASE WHEN new THEN 'inserted' WHEN other OR retold THEN 'changed' WHEN filled THEN 'updated' ELSE 'unchanged' END AS outcome FROM s),
    n AS (SELECT *, CAST(1 + count(*) FILTER (WHERE outcome = 'changed') OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS version FROM v)"""


def _folded(spark, sf) -> V.Folded:
    e = _t(spark, sf, "events").selectExpr("cast(user_id as string) notice_id", "event_id seq", "event_type title", "case when event_id % 3 = 0 then 'p' || (event_id % 2) end psc", "case when event_id % 4 = 0 then 'text ' || (event_id % 8) end description")
    types = {f.name: f.dataType for f in schemas.notice()}
    rows = e.select("notice_id", "seq", "description", *(F.col(f) if f in e.columns else F.lit(None).cast(t).alias(f) for f, t in types.items() if f != "notice_id"))
    first = V.fields()
    stored = spark.createDataFrame([], "notice_id string, version int").withColumn("snapshot", _snapshot(**{f: F.lit(None) for f in first}))
    return V.fold(stored, V.incoming_snapshots(rows))


@query(f"WITH {_STEPS} SELECT event_id, outcome, version FROM n")
def version_numbering(spark, sf):
    """The ordered fold of a history: every event is a snapshot of its user."""
    return _folded(spark, sf).steps.select(F.col("seq").alias("event_id"), "outcome", "version")


@query(f"""
    WITH {_STEPS}, w AS (SELECT user_id, version, max(event_id) AS pl FROM n WHERE outcome <> 'unchanged' GROUP BY ALL), t AS (SELECT user_id, version, max_by(text, event_id) AS text FROM n WHERE text IS NOT NULL AND (new OR filled OR retold) GROUP BY ALL)
    SELECT CAST(w.user_id AS VARCHAR) AS notice_id, w.version, e.event_type AS title, t.text FROM w JOIN e ON e.event_id = w.pl LEFT JOIN t ON t.user_id = w.user_id AND t.version = w.version""")
def versions_and_texts(spark, sf):
    done = _folded(spark, sf)
    done = V.Folded(R.cut(done.steps))
    return done.versions().select("notice_id", "version", F.col("snapshot.title").alias("title")).join(done.descriptions(), ["notice_id", "version"], "left")


@query("SELECT c_custkey, sha256('{\"c_mktsegment\":\"' || c_mktsegment || '\",\"c_name\":' || CASE WHEN c_custkey % 3 > 0 THEN '\"' || c_name || '\"' ELSE 'null' END || ',\"c_nationkey\":' || c_nationkey || '}') AS hash FROM customer")
def hash_snapshot(spark, sf):
    c = _t(spark, sf, "customer").withColumn("c_name", F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")))
    return c.select("c_custkey", N.snapshot_hash(["c_nationkey", "c_name", "c_mktsegment"]).alias("hash"))


# --- texts for people -------------------------------------------------------------------------------------------


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'Not stated' ELSE '$' || format('{:,}', CAST(round(CAST(o_totalprice AS DECIMAL(18,4))) AS BIGINT)) END AS usd, strftime(o_orderdate, '%b %-d, %Y') AS day,
      CASE WHEN o_orderkey % 7 = 0 THEN '–' ELSE CAST(CAST(floor(o_orderkey % 1000 / 1000.0 * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%' END AS share, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey AS VARCHAR) END AS id FROM orders""")
def formatted_values(spark, sf):
    k = F.col("o_orderkey")
    return _t(spark, sf, "orders").select(
        "o_orderkey", N.usd(F.when(k % 5 > 0, F.col("o_totalprice").cast("decimal(18,4)"))).alias("usd"), N.long_date("o_orderdate").alias("day"),
        N.percent(F.when(k % 7 > 0, (k % 1000 / 1000).cast("string")).otherwise("x")).alias("share"), N.numeric_id(F.when(k % 3 > 0, k.cast("string")).otherwise(F.concat(k.cast("string"), F.lit(" ")))).alias("id"),
    )


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0.5::DOUBLE WHEN p_size % 5 = 1 THEN 1.0 ELSE 0.0 END AS vehicle, CAST(least(1.0, greatest(0.0, (p_size - 10) / 50.0 / 0.5)) AS DOUBLE) AS text FROM part")
def vehicle_and_text_features(spark, sf):
    k = F.col("p_size") % 5
    named = F.when(k > 0, F.array(F.lit("V1"), F.lit("V2")))
    return _t(spark, sf, "part").select("p_partkey", X.vehicle(named, F.when(k == 1, "V2").when(k > 2, "W"), CFG.features).alias("vehicle"), X.text((F.col("p_size") - 10) / 50.0, CFG.features).alias("text"))

