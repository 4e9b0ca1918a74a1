"""Every operator as a query over the driver's tables, beside the same thing in SQL.

The tables play the parts of procurement data: orders are awards (their key the award's, their date its end,
their price its value, their priority its type), customers are recipients and offices, nations are sub-tiers,
regions departments, documents descriptions, and events the versions of things.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidweave import schemas
from bidweave.config import MatchingConfig
from bidweave.functions import features as X
from bidweave.functions import normalize as N
from bidweave.functions import text as T
from bidweave.operators import rows as R
from bidweave.operators.merge import merge_reference, replace_automatic, upsert
from bidweave.plans import match as M
from bidweave.plans import reports as P
from bidweave.sources.awards import project_wanted
from bidweave.streaming import windows as W

CFG = MatchingConfig()
TODAY = dt.date(1997, 6, 15)
SQL: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


# --- scans and projections ------------------------------------------------------------------------------------


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CAST(NULL AS VARCHAR) AS p_missing, CAST(p_size AS VARCHAR) AS p_size FROM part")
def scan_project_fill_missing(spark, sf):
    return project_wanted(_t(spark, sf, "part"), ["p_partkey", "p_name", "p_missing", "p_size"])[0]


@query("""
    WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_orderdate, c_mktsegment,
        CASE WHEN o_orderkey % 3 = 0 THEN [c_mktsegment, o_orderstatus] WHEN o_orderkey % 3 = 1 THEN [o_orderpriority] END AS codes
      FROM orders JOIN customer ON c_custkey = o_custkey)
    SELECT o_orderkey, o_orderpriority FROM o
    WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') AND o_orderdate >= DATE '1996-01-01'
      AND (c_mktsegment IN ('BUILDING', 'F') OR coalesce(list_has_any(codes, ['BUILDING', 'F']), false))""")
def filter_vertical(spark, sf):
    o = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    k = F.col("o_orderkey") % 3
    codes = F.when(k == 0, F.array("c_mktsegment", "o_orderstatus")).when(k == 1, F.array("o_orderpriority"))
    o = o.withColumn("codes", codes)
    return o.where(
        (F.col("o_orderstatus") == "O")
        & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "5-LOW")
        & (F.col("o_orderdate") >= dt.datetime(1996, 1, 1))
        & N.in_vertical("c_mktsegment", "codes", ("BUILDING", "F"))
    ).select("o_orderkey", "o_orderpriority")


@query("""
    SELECT c_custkey, nullif(upper(regexp_replace(' ' || lower(c_name) || ' - x', '[\\s-]+', '', 'g')), '') AS norm,
      nullif(upper(regexp_replace(CASE WHEN c_custkey % 5 = 0 THEN ' - ' ELSE c_name END, '[\\s-]+', '', 'g')), '') AS blank_norm FROM customer""")
def norm_contract_id(spark, sf):
    raw = F.concat(F.lit(" "), F.lower("c_name"), F.lit(" - x"))
    some = F.when(F.col("c_custkey") % 5 == 0, " - ").otherwise(F.col("c_name"))
    return _t(spark, sf, "customer").select("c_custkey", N.normalize_contract_id(raw).alias("norm"), N.normalize_contract_id(some).alias("blank_norm"))


@query("""
    WITH r AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '  NULL ' WHEN 1 THEN '   ' WHEN 2 THEN chr(9) || c_name || chr(10) ELSE c_name END AS raw FROM customer),
    s AS (SELECT c_custkey, raw, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS t FROM r)
    SELECT c_custkey, CASE WHEN t <> '' AND lower(t) <> 'null' THEN t END AS cleaned, nullif(trim(raw, ' '), '') AS trimmed FROM s""")
def clean_text_null_literal(spark, sf):
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, "  NULL ").when(k == 1, "   ").when(k == 2, F.concat(F.lit("\t"), "c_name", F.lit("\n"))).otherwise(F.col("c_name"))
    return _t(spark, sf, "customer").select("c_custkey", N.clean_text(raw).alias("cleaned"), N.blank_to_null(raw).alias("trimmed"))


@query("""
    WITH r AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN '3.0' WHEN 2 THEN 'x' WHEN 3 THEN ' 12 ' WHEN 4 THEN '-7.25' ELSE '' END AS num,
        CASE event_id % 5 WHEN 0 THEN '2027-06-30' WHEN 1 THEN '2027-02-30' WHEN 2 THEN '2026' WHEN 3 THEN '2027-06-30 junk' ELSE ' 1999-12-31 ' END AS day,
        CASE event_id % 7 WHEN 0 THEN 'T' WHEN 1 THEN 'no' WHEN 2 THEN '1' WHEN 3 THEN 'maybe' WHEN 4 THEN ' Yes ' WHEN 5 THEN '' ELSE 'False' END AS flag FROM events),
    t AS (SELECT event_id, nullif(trim(num), '') AS num, nullif(trim(day), '') AS day, lower(nullif(trim(flag), '')) AS flag FROM r)
    SELECT event_id, CASE WHEN regexp_matches(num, '^[+-]?[0-9]+$') THEN try_cast(num AS INTEGER) END AS as_int,
      CASE WHEN regexp_matches(num, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN CAST(try_cast(num AS DECIMAL(24,4)) AS DOUBLE) END AS as_number,
      CASE WHEN regexp_matches(day, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN try_cast(day AS DATE) END AS as_date,
      CASE WHEN flag IN ('t','true','y','yes','1') THEN true WHEN flag IN ('f','false','n','no','0') THEN false END AS as_flag FROM t""")
def safe_casts(spark, sf):
    e = F.col("event_id")
    num = F.when(e % 6 == 0, e.cast("string")).when(e % 6 == 1, "3.0").when(e % 6 == 2, "x").when(e % 6 == 3, " 12 ").when(e % 6 == 4, "-7.25").otherwise("")
    day = F.when(e % 5 == 0, "2027-06-30").when(e % 5 == 1, "2027-02-30").when(e % 5 == 2, "2026").when(e % 5 == 3, "2027-06-30 junk").otherwise(" 1999-12-31 ")
    flag = F.when(e % 7 == 0, "T").when(e % 7 == 1, "no").when(e % 7 == 2, "1").when(e % 7 == 3, "maybe").when(e % 7 == 4, " Yes ").when(e % 7 == 5, "").otherwise("False")
    return _t(spark, sf, "events").select(
        "event_id", N.safe_int(num).alias("as_int"), N.safe_decimal(num).cast("double").alias("as_number"), N.safe_date(day).alias("as_date"), N.flag(flag).alias("as_flag")
    )


@query("""
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ref, CAST(CAST(o_orderdate AS DATE) - INTERVAL 6 MONTH AS DATE) AS low,
      CAST(CAST(o_orderdate AS DATE) + INTERVAL 18 MONTH AS DATE) AS high FROM orders""")
def parse_dates_window(spark, sf):
    ref = N.parse_date(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return _t(spark, sf, "orders").select("o_orderkey", ref.alias("ref"), X.window_low(ref, CFG.candidates).alias("low"), X.window_high(ref, CFG.candidates).alias("high"))


@query("""
    WITH r AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '2024-05-04' WHEN 1 THEN '2024-05-04 13:00:00' WHEN 2 THEN '2024-05-04T13:00:00-04:00' WHEN 3 THEN 'soon' WHEN 4 THEN 'null' ELSE '2024-13-01' END AS raw,
        CASE c_custkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'y' WHEN 2 THEN 'No' WHEN 3 THEN '' ELSE 'TRUE' END AS yn FROM customer)
    SELECT c_custkey, epoch(CASE c_custkey % 6 WHEN 0 THEN TIMESTAMP '2024-05-04 00:00:00' WHEN 1 THEN TIMESTAMP '2024-05-04 13:00:00' WHEN 2 THEN TIMESTAMP '2024-05-04 17:00:00' END)::BIGINT AS at,
      CASE WHEN c_custkey % 6 < 3 THEN length(raw) > 10 END AS timed, CASE WHEN yn <> '' THEN lower(yn) IN ('yes','true','y') END AS said FROM r""")
def parse_datetimes(spark, sf):
    k = F.col("c_custkey")
    raw = F.when(k % 6 == 0, "2024-05-04").when(k % 6 == 1, "2024-05-04 13:00:00").when(k % 6 == 2, "2024-05-04T13:00:00-04:00").when(k % 6 == 3, "soon").when(k % 6 == 4, "null").otherwise("2024-13-01")
    yn = F.when(k % 5 == 0, "Yes").when(k % 5 == 1, "y").when(k % 5 == 2, "No").when(k % 5 == 3, "").otherwise("TRUE")
    return _t(spark, sf, "customer").select("c_custkey", F.unix_timestamp(N.parse_datetime(raw)).alias("at"), N.has_time(raw).alias("timed"), N.yes_no(yn).alias("said"))


@query("""
    WITH l AS (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1)
    SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN CAST(shipped AS DATE) END, CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) END, DATE '1997-06-15') AS reference
    FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def reference_date_coalesce(spark, sf):
    shipped = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    o = _t(spark, sf, "orders").join(shipped, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    k = F.col("o_orderkey")
    return o.select("o_orderkey", N.reference_date(F.when(k % 3 > 0, F.col("shipped")), F.when(k % 2 == 0, F.col("o_orderdate")), 30, TODAY).alias("reference"))


@query("""
    WITH p AS (SELECT n_nationkey, CAST(r_regionkey AS VARCHAR) || '.' || CAST(n_nationkey AS VARCHAR) || CASE WHEN n_nationkey % 3 > 0 THEN '.MID.X' || n_nationkey ELSE '' END AS codes,
        r_name || '.' || n_name || CASE WHEN n_nationkey % 3 = 1 THEN '.Middle.Office' ELSE '' END AS names FROM nation JOIN region ON r_regionkey = n_regionkey),
    s AS (SELECT n_nationkey, string_split(codes, '.') AS c, string_split(names, '.') AS n FROM p)
    SELECT n_nationkey, c[1] AS department_code, c[2] AS subtier_code, CASE WHEN len(c) >= 3 THEN c[-1] END AS office_code,
      CASE WHEN len(c) = len(n) THEN n[1] END AS department_name, CASE WHEN len(c) = len(n) THEN n[2] END AS subtier_name, CASE WHEN len(c) = len(n) AND len(c) >= 3 THEN n[-1] END AS office_name FROM s""")
def org_path_split(spark, sf):
    n = _t(spark, sf, "nation").join(_t(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    k = F.col("n_nationkey")
    codes = N.joined(F.col("r_regionkey").cast("string"), k.cast("string"), F.when(k % 3 > 0, F.concat(F.lit("MID.X"), k.cast("string"))))
    names = N.joined("r_name", "n_name", F.when(k % 3 == 1, F.lit("Middle.Office")))
    return n.select("n_nationkey", N.org_path(codes, names).alias("o")).select("n_nationkey", "o.*")


@query("""
    WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS p, CASE o_orderkey % 3 WHEN 0 THEN [o_orderstatus, o_orderpriority] WHEN 1 THEN [NULL, 'zz'] END AS l FROM orders),
    e AS (SELECT o_orderkey, list_concat([p], coalesce(l, [])) AS every FROM r)
    SELECT o_orderkey, list_aggregate(list_sort(list_distinct(list_filter(every, lambda x: x IS NOT NULL AND x <> ''))), 'string_agg', ',') AS codes FROM e""")
def distinct_codes(spark, sf):
    k = F.col("o_orderkey")
    listed = F.when(k % 3 == 0, F.array("o_orderstatus", "o_orderpriority")).when(k % 3 == 1, F.array(F.lit(None).cast("string"), F.lit("zz")))
    codes = N.naics_codes(F.when(k % 4 != 0, F.col("o_orderpriority")), listed)
    return _t(spark, sf, "orders").select("o_orderkey", F.nullif(F.array_join(F.array_sort(codes), ","), F.lit("")).alias("codes"))


# --- text -------------------------------------------------------------------------------------------------------

_TOKENS = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN ({_list(T.STOPWORDS)}))"
_TF = f"""
    tok AS (SELECT doc_id, unnest({_TOKENS}) AS word FROM documents), tf AS (SELECT doc_id, word, count(*) AS tf FROM tok GROUP BY ALL),
    df AS (SELECT word, count(DISTINCT doc_id) AS df FROM tok GROUP BY 1), n AS (SELECT count(*) AS n FROM documents)"""
_VEC = f"""{_TF}, raw AS (SELECT doc_id, word, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS raw FROM tf JOIN df USING (word), n),
    norm AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY 1), vec AS (SELECT doc_id, word, raw / norm AS w FROM raw JOIN norm USING (doc_id))"""


@query(f"SELECT doc_id, len({_TOKENS}) AS n_tokens, len(list_distinct({_TOKENS})) AS n_distinct FROM documents")
def tokens_count(spark, sf):
    words = T.tokens("text")
    return _t(spark, sf, "documents").select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


@query(f"WITH {_TF} SELECT word, df, round(ln((1 + n) / (1 + df)) + 1, 6) AS idf FROM df, n")
def doc_frequency_idf(spark, sf):
    df, n = T.document_frequency(_t(spark, sf, "documents"), "text")
    return df.crossJoin(F.broadcast(n)).select("word", "df", F.round(F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1, 6).alias("idf"))


@query(f"WITH {_VEC} SELECT doc_id, round(norm, 6) AS norm, round(max(w), 6) AS top FROM vec JOIN norm USING (doc_id) GROUP BY ALL")
def tfidf_norms(spark, sf):
    docs = _t(spark, sf, "documents")
    tf = R.cut(T.term_counts(docs, ["doc_id"], "text"))
    vec = T.weights(tf, ["doc_id"], T.frequency_of_counts(tf), docs.agg(F.count("*").alias("n")))
    return vec.groupBy("doc_id").agg(F.round(F.first("norm"), 6).alias("norm"), F.round(F.max("w"), 6).alias("top"))


@query(f"""
    WITH {_VEC}, pairs AS (SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents),
    dot AS (SELECT a, b, x.word, x.w * y.w AS p FROM pairs JOIN vec x ON x.doc_id = a JOIN vec y ON y.doc_id = b AND y.word = x.word),
    ranked AS (SELECT a, b, word, p, row_number() OVER (PARTITION BY a, b ORDER BY p DESC, word) AS rn FROM dot)
    SELECT a, b, round(sum(p), 6) AS cosine, string_agg(word, ',' ORDER BY rn) FILTER (WHERE rn <= 3) AS terms FROM ranked GROUP BY a, b""")
def cosine_shared_terms(spark, sf):
    docs = _t(spark, sf, "documents")
    tf = R.cut(T.term_counts(docs, ["doc_id"], "text"))
    vec = R.cut(T.weights(tf, ["doc_id"], T.frequency_of_counts(tf), docs.agg(F.count("*").alias("n"))))
    # Pairs are formed first; vectors meet for them only.
    pairs = docs.select(F.col("doc_id").alias("a"), F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id")).alias("b")).where("b IS NOT NULL")
    x = vec.select(F.col("doc_id").alias("a"), "word", F.col("w").alias("wa"))
    y = vec.select(F.col("doc_id").alias("b"), "word", F.col("w").alias("wb"))
    p = F.col("wa") * F.col("wb")
    out = pairs.join(x, "a").join(y, ["b", "word"]).groupBy("a", "b").agg(F.sum(p).alias("cosine"), T.shared_terms(p, F.col("word")).alias("terms"))
    return out.select("a", "b", F.round("cosine", 6).alias("cosine"), F.array_join("terms", ",").alias("terms"))


def _cited_text(status):
    k = F.col("o_orderkey").cast("string")
    return F.concat(
        F.lit("Follow-on to the incumbent contract w91q-"), F.lpad(k, 6, "0"), F.lit("-c, order "), k, F.lit(" of 2024-01-01; own no. AB"), F.lpad(k, 8, "0"), F.lit("; again W91Q"), F.lpad(k, 6, "0"), F.lit("C "), status
    )


@query("""
    SELECT o_orderkey, 'W91Q' || lpad(o_orderkey::VARCHAR, 6, '0') || 'C' AS numbers, 'w91q-' || lpad(o_orderkey::VARCHAR, 6, '0') || '-c' AS raw, 'incumbent,follow-on' AS context FROM orders""")
def contract_numbers(spark, sf):
    own = F.concat(F.lit("ab-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
    rows = _t(spark, sf, "orders").select("o_orderkey", _cited_text(F.col("o_orderstatus")).alias("text"), own.alias("own"))
    found = T.cited_numbers(rows, "text", "own")
    ref = CFG.explicit_reference
    words = T.context_words("text", F.col("c.at"), F.length("c.raw"), ref.context_words, ref.context_chars)
    return found.select("o_orderkey", F.col("c.piid_norm").alias("numbers"), F.col("c.raw").alias("raw"), F.array_join(words, ",").alias("context"))


@query("""
    WITH t AS (SELECT p_partkey, 'Cost $' || CAST(p_size AS VARCHAR) || CASE p_partkey % 4 WHEN 0 THEN ' million' WHEN 1 THEN 'k' WHEN 2 THEN '' ELSE ' Bn' END || ' or $1,250,000.50 and $9,999' AS text,
        p_size * CASE p_partkey % 4 WHEN 0 THEN 1e6 WHEN 1 THEN 1e3 WHEN 2 THEN 1 ELSE 1e9 END AS v FROM part)
    SELECT p_partkey, list_sum(list_filter([v, 1250000.5], lambda x: x >= 10000)) AS total, len(list_distinct(list_filter([v, 1250000.5], lambda x: x >= 10000))) AS n FROM t""")
def stated_amounts(spark, sf):
    k = F.col("p_partkey") % 4
    unit = F.when(k == 0, " million").when(k == 1, "k").when(k == 2, "").otherwise(" Bn")
    text = F.concat(F.lit("Cost $"), F.col("p_size").cast("string"), unit, F.lit(" or $1,250,000.50 and $9,999"))
    amounts = T.stated_amounts(text)
    return _t(spark, sf, "part").select("p_partkey", F.aggregate(amounts, F.lit(0.0), lambda a, x: a + x).alias("total"), F.size(amounts).cast("long").alias("n"))


# --- joins ------------------------------------------------------------------------------------------------------

_AWARDS = """awards AS (SELECT o_orderkey AS award_key, n_nationkey AS subtier, CAST(c_custkey % 7 AS VARCHAR) AS office, CAST(o_orderdate AS DATE) AS ends, o_totalprice AS val,
      o_orderpriority AS type, c_mktsegment AS naics, o_orderstatus AS psc FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
    notices AS (SELECT s_suppkey AS notice_id, s_nationkey AS subtier, CAST(s_suppkey % 7 AS VARCHAR) AS office, CAST(DATE '1995-01-01' + CAST(s_suppkey % 900 AS INTEGER) AS DATE) AS ref,
      CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'AUTOMOBILE' END AS naics, CASE s_suppkey % 2 WHEN 0 THEN 'P' END AS psc FROM supplier)"""
_CAND = f"""{_AWARDS}, cand AS (SELECT notice_id, award_key, a.office IS NOT DISTINCT FROM n.office AS same, abs(date_diff('day', ref, ends)) AS distance,
      row_number() OVER (PARTITION BY notice_id ORDER BY (a.office IS NOT DISTINCT FROM n.office) DESC, abs(date_diff('day', ref, ends)), CAST(award_key AS VARCHAR)) AS rn
    FROM notices n JOIN awards a USING (subtier) WHERE ends BETWEEN CAST(ref - INTERVAL 6 MONTH AS DATE) AND CAST(ref + INTERVAL 18 MONTH AS DATE) AND type IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND val >= 25000
      AND (a.office = n.office OR left(a.naics, 4) = left(n.naics, 4) OR left(a.psc, 2) = left(n.psc, 2)))"""


def _award_like(spark, sf) -> DataFrame:
    o = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(_t(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return o.select(
        F.col("o_orderkey").cast("string").alias("award_key"), F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("a_piid"),
        F.col("n_nationkey").cast("string").alias("a_subtier"), F.col("n_name").alias("a_subtier_name"), (F.col("c_custkey") % 7).cast("string").alias("a_office"),
        F.to_date("o_orderdate").alias("a_end"), F.col("o_totalprice").alias("a_value"), F.col("o_orderpriority").alias("a_type"),
        F.col("c_mktsegment").alias("a_naics"), F.col("o_orderstatus").alias("a_psc"), F.when(F.col("c_custkey") % 2 == 0, "SBA").alias("a_set_aside_code"),
    )


def _notice_like(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    return _t(spark, sf, "supplier").select(
        k.cast("string").alias("notice_id"), F.col("s_nationkey").cast("string").alias("n_subtier"), (k % 7).cast("string").alias("n_office"),
        F.date_add(F.lit(dt.date(1995, 1, 1)), (k % 900).cast("int")).alias("n_reference"),
        F.array(F.when(k % 3 == 0, "BUILDING").when(k % 3 == 1, "MACHINERY").otherwise("AUTOMOBILE")).alias("n_codes"), F.when(k % 2 == 0, "P").alias("n_psc"),
        F.when(k % 3 == 0, "8A").when(k % 3 == 1, "SBP").alias("n_set_aside_code"),
    )


def _cfg() -> MatchingConfig:
    return replace(CFG, candidates=replace(CFG.candidates, award_types=("1-URGENT", "2-HIGH", "3-MEDIUM")))


def _none(spark) -> M.Excluded:
    return M.Excluded(spark.createDataFrame([], "notice_id string, award_key string"), spark.createDataFrame([], "award_key string, times long, by string"))


@query(f"WITH {_CAND} SELECT CAST(notice_id AS VARCHAR) AS notice_id, CAST(award_key AS VARCHAR) AS award_key FROM cand WHERE rn <= {CFG.candidates.max_per_notice}")
def candidate_blocking_join(spark, sf):
    return M.candidates(_notice_like(spark, sf), _award_like(spark, sf), _cfg(), _none(spark))


_SCORE = """
    CASE WHEN same THEN 1.0 ELSE 0.4 END AS f_office, CASE WHEN a.naics = n.naics THEN 1.0 WHEN left(a.naics, 4) = left(n.naics, 4) THEN 0.6 ELSE 0.0 END AS f_naics,
    CASE WHEN n.psc IS NULL THEN 0.5 WHEN a.psc = n.psc THEN 1.0 WHEN left(a.psc, 1) = left(n.psc, 1) THEN 0.3 ELSE 0.0 END AS f_psc,
    date_diff('day', ref, ends) AS off, date_diff('day', ref, CAST(ref - INTERVAL 6 MONTH AS DATE)) AS lo, date_diff('day', ref, CAST(ref + INTERVAL 18 MONTH AS DATE)) AS hi,
    CASE notice_id % 3 WHEN 0 THEN '8a' WHEN 1 THEN 'small' ELSE 'none' END AS nf, CASE WHEN office_even THEN 'small' ELSE 'none' END AS af"""
_SCORED = f"""{_CAND}, even AS (SELECT o_orderkey AS award_key, o_custkey % 2 = 0 AS office_even FROM orders),
    f AS (SELECT cand.notice_id, cand.award_key, ends, ref, val, {_SCORE} FROM cand JOIN notices n USING (notice_id) JOIN awards a ON a.award_key = cand.award_key JOIN even ON even.award_key = cand.award_key WHERE rn <= {CFG.candidates.max_per_notice}),
    g AS (SELECT *, CASE WHEN off < -30 THEN CAST(off - lo AS DOUBLE) / (-30 - lo) WHEN off > 270 THEN CAST(hi - off AS DOUBLE) / (hi - 270) ELSE 1.0 END AS f_end,
        CASE WHEN nf = af THEN 1.0 WHEN nf <> 'none' AND af <> 'none' THEN 0.5 ELSE 0.0 END AS f_set, CASE WHEN val BETWEEN 50000 AND 450000 THEN 1.0 ELSE 0.2 END AS f_val FROM f),
    s AS (SELECT *, 0.2 * f_office + 0.1 * f_naics + 0.15 * f_end + 0.1 * f_psc + 0.04 * f_set + 0.03 * f_val + 0.03 * 0.5 AS score FROM g)"""


def _scored(spark, sf) -> DataFrame:
    cfg = _cfg()
    n, a = _notice_like(spark, sf), _award_like(spark, sf)
    pairs = M.candidates(n, a, cfg, _none(spark)).join(n, "notice_id").join(a, "award_key")
    pairs = pairs.withColumns({
        "similarity": F.lit(0.0), "stated": F.array(F.lit(150000.0)), "vehicles": F.array().cast("array<string>"),
        "a_referenced_norm": F.lit(None).cast("string"), "explicit": F.lit(False),
    })
    return M.scored_pairs(pairs, cfg)


@query(f"WITH {_SCORED} SELECT CAST(notice_id AS VARCHAR) AS notice_id, CAST(award_key AS VARCHAR) AS award_key, CAST(f_office AS DOUBLE) AS f_office, CAST(f_naics AS DOUBLE) AS f_naics, CAST(f_psc AS DOUBLE) AS f_psc, round(f_end, 6) AS f_end_date, CAST(f_set AS DOUBLE) AS f_set_aside, CAST(f_val AS DOUBLE) AS f_value, round(CAST(score AS DOUBLE), 6) AS score FROM s")
def feature_scores(spark, sf):
    return _scored(spark, sf).select("notice_id", "award_key", "f_office", "f_naics", "f_psc", F.round("f_end_date", 6).alias("f_end_date"), "f_set_aside", "f_value", F.round("score", 6).alias("score"))


@query(f"""
    WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY notice_id ORDER BY round(CAST(score AS DOUBLE), 6) DESC, f_office DESC, abs(off), val DESC, CAST(award_key AS VARCHAR)) AS position FROM s),
    j AS (SELECT *, award_key % 11 = 3 AS rejected FROM r),
    p AS (SELECT *, row_number() OVER (PARTITION BY notice_id ORDER BY rejected, position) AS pos FROM j),
    q AS (SELECT *, max(CASE WHEN pos = 1 AND NOT rejected THEN score ELSE 0 END) OVER (PARTITION BY notice_id) AS top, max(CASE WHEN pos = 2 AND NOT rejected THEN score ELSE 0 END) OVER (PARTITION BY notice_id) AS second FROM p),
    d AS (SELECT *, CASE WHEN rejected THEN 'hidden' WHEN top >= 0.5 AND top - second >= 0.004 THEN CASE WHEN pos = 1 THEN 'incumbent' ELSE 'hidden' END WHEN pos <= 3 AND score >= 0.35 THEN 'possible' ELSE 'hidden' END AS shown FROM q),
    k AS (SELECT *, row_number() OVER (PARTITION BY notice_id ORDER BY position) AS rank FROM d WHERE position <= 10 AND score >= 0.2)
    SELECT CAST(notice_id AS VARCHAR) AS notice_id, CAST(award_key AS VARCHAR) AS award_key, CAST(rank AS INTEGER) AS rank, shown FROM k WHERE NOT rejected""")
def rank_decide(spark, sf):
    cfg = replace(CFG, decision=replace(CFG.decision, incumbent_threshold=0.5, margin=0.004))
    ranked = _scored(spark, sf).withColumn("position", F.row_number().over(Window.partitionBy("notice_id").orderBy(*M.rank_order())))
    judged = ranked.withColumn("review", F.when(F.col("award_key").cast("long") % 11 == 3, "rejected"))
    return M.prune(M.decide(judged, cfg), cfg).select("notice_id", "award_key", "rank", "shown")


@query("""
    WITH a AS (SELECT CAST(o_orderkey AS VARCHAR) AS award_key, 'W91Q' || lpad(o_orderkey::VARCHAR, 6, '0') || 'C' AS norm, CASE WHEN o_orderkey % 5 = 0 THEN 'IDV_A' WHEN o_orderkey % 5 = 1 THEN 'IDV_B' ELSE 'C' END AS type, CAST(o_custkey % 3 AS VARCHAR) AS sub FROM orders),
    c AS (SELECT CAST(o_orderkey AS VARCHAR) AS notice_id, 'W91Q' || lpad(o_orderkey::VARCHAR, 6, '0') || 'C' AS norm, CAST((o_orderkey + o_custkey) % 3 AS VARCHAR) AS sub FROM orders)
    SELECT notice_id, award_key, CASE WHEN type = 'IDV_A' OR (type LIKE 'IDV%' AND c.sub <> a.sub) THEN 'vehicle' ELSE 'explicit' END AS kind FROM c JOIN a USING (norm)
    WHERE type = 'IDV_A' OR (type LIKE 'IDV%' AND c.sub <> a.sub) OR c.sub = a.sub""")
def explicit_reference_join(spark, sf):
    o = _t(spark, sf, "orders")
    k = F.col("o_orderkey")
    number = F.concat(F.lit("W91Q"), F.lpad(k.cast("string"), 6, "0"), F.lit("C"))
    a = o.select(
        k.cast("string").alias("award_key"), number.alias("a_piid_norm"), F.when(k % 5 == 0, "IDV_A").when(k % 5 == 1, "IDV_B").otherwise("C").alias("a_type"), (F.col("o_custkey") % 3).cast("string").alias("a_subtier")
    )
    n = o.select(k.cast("string").alias("notice_id"), ((k + F.col("o_custkey")) % 3).cast("string").alias("n_subtier"), _cited_text(F.col("o_orderstatus")).alias("n_text"), F.concat(F.lit("AB"), F.lpad(k.cast("string"), 8, "0")).alias("n_solicitation"))
    return M.citations(n, a, CFG, _none(spark)).select("notice_id", "award_key", "kind")


@query("""
    WITH found AS (SELECT l_orderkey AS notice_id, l_partkey AS award_key, 'same_solicitation' AS method FROM lineitem WHERE l_returnflag = 'R'
      UNION ALL SELECT l_orderkey, l_partkey, 'award_notice_number' FROM lineitem WHERE l_linestatus = 'F'
      UNION ALL SELECT l_orderkey, l_partkey, 'award_notice_number' FROM lineitem WHERE l_quantity > 25),
    c AS (SELECT *, count(*) OVER (PARTITION BY notice_id) AS links FROM found)
    SELECT notice_id, award_key, min(method) AS method FROM c WHERE links <= 8 GROUP BY ALL""")
def history_links_union(spark, sf):
    li = _t(spark, sf, "lineitem")

    def side(condition, method):
        return li.where(condition).select(F.col("l_orderkey").alias("notice_id"), F.col("l_partkey").alias("award_key"), F.lit(method).alias("method"))

    found = side(F.col("l_returnflag") == "R", "same_solicitation").unionByName(side(F.col("l_linestatus") == "F", "award_notice_number")).unionByName(side(F.col("l_quantity") > 25, "award_notice_number"))
    return R.links_within(found, "notice_id", ["notice_id", "award_key"], "method", 8)


@query("""
    SELECT user_id, max(CASE WHEN rn = 1 THEN v END) AS value FROM (SELECT user_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) GROUP BY 1""")
def latest_per_key(spark, sf):
    e = _t(spark, sf, "events").select("user_id", F.struct("ts", "event_id").alias("version"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("value"))
    return R.latest(e, ["user_id"], "version", "value")


# --- aggregation and windows ------------------------------------------------------------------------------------


@query(" UNION ALL ".join(f"SELECT '{t}' AS relation, count(*) AS rows FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")))
def relation_counts(spark, sf):
    return P.row_counts({t: _t(spark, sf, t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")})


_DECIDED = """
    th AS (SELECT unnest([0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]::DOUBLE[]) AS threshold),
    c AS (SELECT user_id AS notice_id, CAST(event_id AS VARCHAR) AS award_key, round(abs(value) / (1 + abs(value)), 4) AS score, row_number() OVER (PARTITION BY user_id ORDER BY round(abs(value) / (1 + abs(value)), 4) DESC, CAST(event_id AS VARCHAR)) AS pos FROM events),
    b AS (SELECT notice_id, max(CASE WHEN pos = 1 THEN award_key END) AS k1, max(CASE WHEN pos = 1 THEN score END) AS s1, coalesce(max(CASE WHEN pos = 2 THEN score END), 0) AS s2, list(award_key) FILTER (WHERE pos <= 3 AND score >= 0.35) AS possible FROM c GROUP BY 1),
    d AS (SELECT threshold, notice_id, CASE WHEN s1 >= threshold AND round(s1 - s2, 9) >= 0.15 THEN k1 END AS incumbent, CASE WHEN s1 >= threshold AND round(s1 - s2, 9) >= 0.15 THEN [] ELSE coalesce(possible, []) END AS possible FROM b, th),
    l AS (SELECT notice_id, CASE WHEN notice_id % 7 = 0 THEN 'none' WHEN notice_id % 7 = 1 THEN 'other' WHEN notice_id % 7 = 2 THEN 'unsure' ELSE 'incumbent' END AS answer, CASE WHEN notice_id % 2 = 0 THEN k1 ELSE 'x' END AS truth0 FROM b),
    j AS (SELECT th.threshold, answer, CASE WHEN answer = 'incumbent' THEN truth0 END AS truth, incumbent, possible FROM l CROSS JOIN th LEFT JOIN d ON d.threshold = th.threshold AND d.notice_id = l.notice_id WHERE answer <> 'unsure'),
    s AS (SELECT threshold, count(*) AS labeled, count(incumbent) AS shown, count(*) FILTER (WHERE incumbent = truth) AS correct, count(*) FILTER (WHERE answer IN ('incumbent', 'other')) AS with_incumbent,
      count(*) FILTER (WHERE answer IN ('incumbent', 'other') AND incumbent = truth) AS found, count(*) FILTER (WHERE answer IN ('incumbent', 'other') AND incumbent IS NULL AND len(possible) > 0 AND truth <> '') AS possible_cases,
      count(*) FILTER (WHERE answer IN ('incumbent', 'other') AND incumbent IS NULL AND list_contains(possible, truth)) AS possible_hits FROM j GROUP BY 1)"""


def _labelled(spark, sf):
    score = F.round(F.abs("value") / (1 + F.abs("value")), 4)
    c = _t(spark, sf, "events").select(F.col("user_id").alias("notice_id"), F.col("event_id").cast("string").alias("award_key"), score.alias("score"))
    best = R.distinct_on(c, ["notice_id"], [F.col("score").desc(), F.col("award_key")])
    k = F.col("notice_id")
    answer = F.when(k % 7 == 0, "none").when(k % 7 == 1, "other").when(k % 7 == 2, "unsure").otherwise("incumbent")
    labels = best.select("notice_id", answer.alias("answer"), F.when(k % 2 == 0, F.col("award_key")).otherwise("x").alias("award_key"))
    return labels, c


@query(f"WITH {_DECIDED} SELECT threshold, labeled, shown, correct, with_incumbent, found, possible_cases, possible_hits, round(correct / nullif(shown, 0), 6) AS precision, round(found / nullif(with_incumbent, 0), 6) AS recall FROM s")
def threshold_sweep(spark, sf):
    labels, c = _labelled(spark, sf)
    cards = P.scorecards(labels, c, CFG, P.thresholds(c))
    return cards.select("threshold", "labeled", "shown", "correct", "with_incumbent", "found", "possible_cases", "possible_hits", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("""
    WITH c AS (SELECT user_id AS notice_id, CAST(event_id AS VARCHAR) AS award_key, round(abs(value) / (1 + abs(value)), 4) AS score, event_id % 5 = 0 AS cited FROM events),
    one AS (SELECT notice_id, min(award_key) AS cited FROM c WHERE cited GROUP BY 1 HAVING count(*) = 1),
    r AS (SELECT c.notice_id, one.cited, award_key, score, row_number() OVER (PARTITION BY c.notice_id ORDER BY score DESC, award_key) AS pos FROM c JOIN one ON one.notice_id = c.notice_id),
    b AS (SELECT notice_id, cited, max(CASE WHEN pos = 1 THEN award_key END) AS k1, max(CASE WHEN pos = 1 THEN score END) AS s1, coalesce(max(CASE WHEN pos = 2 THEN score END), 0) AS s2 FROM r GROUP BY ALL)
    SELECT count(*) AS notices, count(*) FILTER (WHERE k1 = cited) AS ranked_first, count(*) FILTER (WHERE k1 = cited AND s1 >= 0.8 AND round(s1 - s2, 9) >= 0.15) AS would_show FROM b""")
def explicit_check(spark, sf):
    c = _labelled(spark, sf)[1]
    method = F.when(F.col("award_key").cast("long") % 5 == 0, "explicit_reference").otherwise("candidate")
    return P.explicit_check(c.select("notice_id", "award_key", "score", F.col("score").alias("base_score"), method.alias("method")), CFG)


@query("""
    SELECT p_brand, p_name AS name FROM (SELECT p_brand, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS p_name, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_partkey % 3 > 0 THEN p_name END NULLS LAST, p_partkey) AS rn FROM part) WHERE rn = 1""")
def first_nonnull_name(spark, sf):
    p = _t(spark, sf, "part").select("p_brand", "p_partkey", F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).alias("name"))
    return R.distinct_on(p, ["p_brand"], [F.col("name").asc_nulls_last(), F.col("p_partkey")]).select("p_brand", "name")


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY md5(CAST(c_custkey AS VARCHAR) || 'm2'), c_custkey) AS rn FROM customer) WHERE rn <= 60")
def sample_md5_limit(spark, sf):
    return R.sample_order(_t(spark, sf, "customer"), "c_custkey", "m2", 60).select("c_custkey")


@query("""
    SELECT p_partkey, p_name FROM part WHERE p_size < 30 UNION ALL SELECT p_partkey, upper(p_name) FROM part WHERE p_size >= 30""")
def union_override(spark, sf):
    p = _t(spark, sf, "part")
    return R.union_override(p.where(F.col("p_size") < 30).select("p_partkey", "p_name"), p.select("p_partkey", F.upper("p_name").alias("p_name")), ["p_partkey"])


# --- merges -----------------------------------------------------------------------------------------------------


@query("""
    SELECT coalesce(s.c_custkey, i.c_custkey) AS c_custkey, coalesce(i.name, s.name) AS name, coalesce(s.flag, false) OR coalesce(i.flag, false) AS flag
    FROM (SELECT c_custkey, c_name AS name, c_acctbal > 0 AS flag FROM customer WHERE c_custkey % 4 > 0) s FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN upper(c_name) END AS name, c_nationkey > 12 AS flag FROM customer WHERE c_custkey % 3 > 0) i USING (c_custkey)""")
def merge_fields(spark, sf):
    c = _t(spark, sf, "customer")
    s = c.where(F.col("c_custkey") % 4 > 0).select("c_custkey", F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("flag"))
    i = c.where(F.col("c_custkey") % 3 > 0).select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, F.upper("c_name")).alias("name"), (F.col("c_nationkey") > 12).alias("flag"))
    return merge_reference(s, i, ["c_custkey"], flags=["flag"])


@query("""
    WITH d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, event_id % 2 AS half FROM events),
    s AS (SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value, max_by(CASE WHEN event_id % 10 = 0 THEN NULL ELSE epoch_us(ts) END, event_id) AS modified FROM events WHERE event_id % 2 = 0 GROUP BY 1),
    s2 AS (SELECT e.user_id, e.event_type, e.value, CASE WHEN e.event_id % 10 = 0 THEN NULL ELSE epoch_us(e.ts) END AS modified FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_id % 2 = 0) e WHERE k = 1),
    i AS (SELECT e.user_id, e.event_type, e.value, CASE WHEN e.event_id % 7 = 0 THEN NULL ELSE epoch_us(e.ts) END AS modified FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_id % 2 = 1) e WHERE k = 1)
    SELECT coalesce(s2.user_id, i.user_id) AS user_id, CASE WHEN w THEN i.event_type ELSE s2.event_type END AS event_type, CASE WHEN w THEN i.value ELSE s2.value END AS value, w AS written
    FROM (SELECT s2.user_id AS su, i.user_id AS iu, i.user_id IS NOT NULL AND (s2.user_id IS NULL OR (coalesce(s2.modified IS NULL OR i.modified >= s2.modified, false) AND (s2.event_type, s2.value, s2.modified) IS DISTINCT FROM (i.event_type, i.value, i.modified))) AS w FROM s2 FULL JOIN i ON i.user_id = s2.user_id) x
    LEFT JOIN s2 ON s2.user_id = su LEFT JOIN i ON i.user_id = iu""")
def newer_wins_upsert(spark, sf):
    e = _t(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    s = R.distinct_on(e.where(F.col("event_id") % 2 == 0), ["user_id"], [F.col("event_id").desc()])
    i = R.distinct_on(e.where(F.col("event_id") % 2 == 1), ["user_id"], [F.col("event_id")])
    s = s.select("user_id", "event_type", "value", F.when(F.col("event_id") % 10 != 0, F.col("us")).alias("modified"))
    i = i.select("user_id", "event_type", "value", F.when(F.col("event_id") % 7 != 0, F.col("us")).alias("modified"))
    return upsert(s, i, ["user_id"], newer="modified").table.select("user_id", "event_type", "value", F.col("_written").alias("written"))


@query("""
    WITH s AS (SELECT o_orderkey AS k, o_custkey AS g, o_orderpriority AS v, CASE WHEN o_orderkey % 10 = 0 THEN 'confirmed' ELSE 'auto' END AS status FROM orders WHERE o_orderkey % 3 > 0),
    n AS (SELECT o_orderkey AS k, o_custkey AS g, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderpriority END AS v, 'auto' AS status FROM orders WHERE o_orderkey % 2 = 0),
    sc AS (SELECT DISTINCT g FROM n WHERE g % 2 = 0)
    SELECT coalesce(s.k, n.k) AS k, coalesce(s.g, n.g) AS g, CASE WHEN s.k IS NULL OR (n.k IS NOT NULL AND s.status = 'auto') THEN n.v ELSE s.v END AS v, CASE WHEN s.k IS NULL THEN n.status ELSE s.status END AS status
    FROM s FULL JOIN n ON n.k = s.k AND n.g = s.g WHERE NOT (n.k IS NULL AND s.status = 'auto' AND s.g IN (SELECT g FROM sc))""")
def replace_automatic_rows(spark, sf):
    o = _t(spark, sf, "orders")
    k = F.col("o_orderkey")
    s = o.where(k % 3 > 0).select(k.alias("k"), F.col("o_custkey").alias("g"), F.col("o_orderpriority").alias("v"), F.when(k % 10 == 0, "confirmed").otherwise("auto").alias("status"))
    n = o.where(k % 2 == 0).select(k.alias("k"), F.col("o_custkey").alias("g"), F.when(k % 4 == 0, "new").otherwise(F.col("o_orderpriority")).alias("v"), F.lit("auto").alias("status"))
    return replace_automatic(s, n, ["k", "g"], n.where(F.col("g") % 2 == 0).select("g"))[0]


@query("""
    WITH o AS (SELECT c_custkey, c_name AS title, c_mktsegment AS type, CASE WHEN c_custkey % 4 > 0 THEN c_nationkey END AS links FROM customer),
    n AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || '  x' ELSE '  ' || c_name || ' ' END AS title, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS type, c_nationkey AS links FROM customer)
    SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN 'title' END, CASE WHEN c_custkey % 3 = 0 THEN 'type' END) AS changed FROM o""")
def tracked_changes(spark, sf):
    from bidweave.operators import versions as V

    c = _t(spark, sf, "customer")
    k = F.col("c_custkey")
    types = {f.name: f.dataType for f in schemas.notice()}

    def snapshot(**have):
        return F.struct(*(have.get(f, F.lit(None)).cast(types[f] if f in types else "string").alias(f) for f in V.fields()))

    links = F.array(F.col("c_nationkey").cast("string"))
    old = snapshot(title=F.col("c_name"), type=F.col("c_mktsegment"), attachment_links=F.when(k % 4 > 0, links))
    title = F.when(k % 2 == 0, F.concat("c_name", F.lit("  x"))).otherwise(F.concat(F.lit("  "), "c_name", F.lit(" ")))
    new = snapshot(title=title, type=F.when(k % 3 != 0, F.col("c_mktsegment")), attachment_links=links)
    rows = c.select("c_custkey", old.alias("old"), new.alias("new"))
    found = V.tracked_changes(F.col("old"), F.col("new"))
    return rows.select("c_custkey", F.array_join(F.transform(found, lambda x: x["field"]), ",").alias("changed"))


# --- reports ----------------------------------------------------------------------------------------------------


@query("SELECT event_type AS source, count(*) FILTER (WHERE value > 20) AS done, count(*) AS total, max(CASE WHEN value > 20 THEN CAST(ts AS DATE) END) AS through FROM events GROUP BY 1")
def chunk_progress_watermark(spark, sf):
    e = _t(spark, sf, "events").select(F.col("event_type").alias("source"), F.when(F.col("value") > 20, "done").otherwise("in_progress").alias("status"), "ts")
    through = e.where(F.col("status") == "done").groupBy("source").agg(F.to_date(F.max("ts")).alias("through"))
    return P.chunk_progress(e).join(through, "source", "left")


# --- event-time windows (an extension) --------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_tumbling_window(spark, sf):
    return W.tumbling(_t(spark, sf, "events"), "ts", "1 hour", ["event_type"], "value").withColumn("total", F.round("total", 4))


@query("""
    WITH e AS (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS window_start, event_type, value FROM events)
    SELECT window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY ALL""")
def ext_sliding_window(spark, sf):
    return W.sliding(_t(spark, sf, "events"), "ts", "1 hour", "30 minutes", ["event_type"], "value").withColumn("total", F.round("total", 4))


@query("""
    WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
    SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, sid""")
def ext_session_window(spark, sf):
    return W.sessions(_t(spark, sf, "events"), "ts", "30 minutes", ["user_id"], "value").withColumn("total", F.round("total", 4))
