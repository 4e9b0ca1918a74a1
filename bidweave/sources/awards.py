"""Award files: CSV and zipped CSV, every column as text; typed by ``typed_awards`` and its siblings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave import schemas
from bidweave.functions import normalize as N
from bidweave.operators.merge import Merged, merge_reference, upsert
from bidweave.operators.rows import cut, distinct_on
from bidweave.sources import places, split_csv


class NotAnAwardFileError(ValueError):
    """The file lacks the key column."""


WANTED = schemas.AWARD_CSV_COLUMNS + schemas.BUSINESS_COLUMNS


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names, without reading rows."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def project_wanted(raw: DataFrame, wanted: Sequence[str] = WANTED) -> tuple[DataFrame, list[str]]:
    """The wanted columns as text, missing ones null; also the names of those."""
    have = set(raw.columns)
    missing = [c for c in wanted if c not in have]
    return raw.select(*(F.col(f"`{c}`").cast("string").alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in wanted)), missing


def read_award_csv(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """An award file's wanted columns and the missing ones' names; only the key column has to be there.

    Tasks read it by byte ranges; where only Spark reaches the file, one task reads it.
    """
    here = places.reachable(path)
    names = split_csv.header(path, "utf-8-sig") if here else csv_header(spark, path)
    if schemas.AWARD_KEY not in names:
        raise NotAnAwardFileError(f"{path} has no column {schemas.AWARD_KEY}")
    if here:
        return project_wanted(split_csv.read_split(spark, path, wanted=WANTED))
    return project_wanted(spark.read.options(header=True, inferSchema=False, quote='"', escape='"', multiLine=True).csv(path))


def read_award_files(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame | None, dict[str, list[str]], list[str]]:
    """The rows of award files and of the award members of zips, in one table; columns that files lack; files passed over.

    Members are read as they are inflated, a task each, those of all zips side by side.
    """
    frames, chosen, lacking, others = [], [], {}, []
    for path in paths:
        if path.endswith(".zip"):
            found, skipped, missing = split_csv.members(path, WANTED, schemas.AWARD_KEY)
            chosen += found
            others += skipped
            lacking |= missing
            continue
        try:
            raw, missing = read_award_csv(spark, path)
        except NotAnAwardFileError:
            others.append(path)
            continue
        frames.append(raw)
        if missing:
            lacking[path.rsplit("/", 1)[-1]] = missing
    if chosen:
        frames.append(split_csv.read_members(spark, chosen, WANTED))
    out = None
    for frame in frames:
        out = frame if out is None else out.unionByName(frame)
    return out, lacking, others


def member_headers(path: str) -> dict[str, list[str]]:
    """The column names of each CSV member of a zip."""
    return split_csv.headers(path)


def typed_awards(raw: DataFrame) -> DataFrame:
    """Typed awards, one a key: the newest by last_modified, nulls last. Values that don't parse are null."""
    t, d, m = N.blank_to_null, N.safe_date, N.safe_decimal
    typed = raw.select(
        t("contract_award_unique_key").alias("award_key"),
        t("award_id_piid").alias("piid"),
        N.normalize_contract_id("award_id_piid").alias("piid_norm"),
        t("parent_award_id_piid").alias("referenced_idv_piid"),
        N.normalize_contract_id("parent_award_id_piid").alias("referenced_idv_piid_norm"),
        *(t(c).alias(c) for c in ("award_type_code", "award_type", "idv_type_code", "awarding_agency_code", "awarding_agency_name",
          "awarding_sub_agency_code", "awarding_sub_agency_name", "awarding_office_code", "awarding_office_name", "recipient_uei", "recipient_name")),
        t("naics_code").alias("naics"),
        t("product_or_service_code").alias("psc"),
        t("solicitation_identifier").alias("solicitation_id"),
        N.normalize_contract_id("solicitation_identifier").alias("solicitation_id_norm"),
        t("type_of_set_aside_code").alias("set_aside_code"),
        t("type_of_set_aside").alias("set_aside"),
        t("extent_competed_code").alias("extent_competed_code"),
        N.safe_int("number_of_offers_received").alias("number_of_offers"),
        m("total_obligated_amount").alias("obligated_total"),
        m("current_total_value_of_award").alias("current_total_value"),
        m("potential_total_value_of_award").alias("total_value"),
        d("period_of_performance_start_date").alias("pop_start"),
        d("period_of_performance_current_end_date").alias("current_end"),
        d("period_of_performance_potential_end_date").alias("ultimate_end"),
        d("ordering_period_end_date").alias("ordering_period_end"),
        d("award_base_action_date").alias("base_action_date"),
        d("award_latest_action_date").alias("latest_action_date"),
        t("prime_award_base_transaction_description").alias("description"),
        N.safe_timestamp("last_modified_date").alias("last_modified"),
        t("usaspending_permalink").alias("usaspending_url"),
    ).where(F.col("award_key").isNotNull())
    content = F.xxhash64(*typed.columns)
    return distinct_on(typed, ["award_key"], [F.col("last_modified").desc_nulls_last(), content])


def business_types() -> Column:
    """The certification flags and the size as one JSON object without nulls."""
    parts = [N.flag(c).alias(c) for c in schemas.BUSINESS_FLAGS] + [N.blank_to_null(schemas.BUSINESS_SIZE).alias(schemas.BUSINESS_SIZE)]
    return F.to_json(F.struct(*parts))


def entities(raw: DataFrame) -> DataFrame:
    """Recipients, one a uei: the newest by last_modified, nulls last."""
    t = N.blank_to_null
    typed = raw.select(
        t("recipient_uei").alias("uei"),
        t("recipient_name").alias("name"),
        t("recipient_parent_uei").alias("parent_uei"),
        t("recipient_parent_name").alias("parent_name"),
        t("cage_code").alias("cage"),
        t("recipient_state_code").alias("state"),
        business_types().alias("business_types"),
        N.safe_timestamp("last_modified_date").alias("last_modified"),
    ).where(F.col("uei").isNotNull())
    return distinct_on(typed, ["uei"], [F.col("last_modified").desc_nulls_last(), F.xxhash64(*typed.columns)])


def first_named(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """One row a key: the first by name, unnamed ones last."""
    return distinct_on(df.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)), keys, [F.col(name).asc_nulls_last(), F.xxhash64(*df.columns)])


def reference_tables(raw: DataFrame, vertical: Sequence[str]) -> dict[str, DataFrame]:
    """agencies, offices and naics that an award file names."""
    t = N.blank_to_null
    departments = raw.select(
        F.lit("department").alias("level"), t("awarding_agency_code").alias("code"), t("awarding_agency_name").alias("name"), F.lit(None).cast("string").alias("parent_code")
    )
    subtiers = raw.select(
        F.lit("subtier").alias("level"), t("awarding_sub_agency_code").alias("code"), t("awarding_sub_agency_name").alias("name"), t("awarding_agency_code").alias("parent_code")
    )
    offices = raw.select(t("awarding_sub_agency_code").alias("subtier_code"), t("awarding_office_code").alias("office_code"), t("awarding_office_name").alias("name"))
    naics = raw.select(t("naics_code").alias("code"), t("naics_description").alias("title")).where(F.col("code").rlike("^[0-9]{2,6}$"))
    return {
        "agencies": first_named(departments.unionByName(subtiers), ["level", "code"], "name"),
        "offices": first_named(offices, ["subtier_code", "office_code"], "name"),
        "naics": first_named(naics, ["code"], "title").withColumn("in_vertical", F.col("code").isin(*vertical)),
    }


def seed_vertical_naics(naics: DataFrame, vertical: Sequence[str]) -> DataFrame:
    """The stored codes, with all of the vertical marked."""
    spark = naics.sparkSession
    codes = spark.range(1).select(F.explode(F.array(*map(F.lit, vertical))).alias("code"))
    seeded = codes.select("code", F.lit(None).cast("string").alias("title"), F.lit(True).alias("in_vertical"))
    return merge_reference(naics, seeded, ["code"], flags=["in_vertical"])


def upsert_awards(stored: DataFrame, raw: DataFrame) -> Merged:
    """Stored awards and a file: newer or equally new rows that differ replace stored ones."""
    # Parsed and typed once: the merge, its counts and later uses read the kept rows.
    return upsert(stored, cut(typed_awards(raw).select(*stored.columns)), ["award_key"], newer="last_modified")


def upsert_entities(stored: DataFrame, raw: DataFrame) -> Merged:
    return upsert(stored, cut(entities(raw).select(*stored.columns)), ["uei"], newer="last_modified")


def load_awards(stored: dict[str, DataFrame], raw: DataFrame, vertical: Sequence[str]) -> dict[str, DataFrame]:
    """All tables after a file: agencies, offices, naics, entities, awards. Typed rows are kept in the checkpoint folder."""
    seen = reference_tables(raw, vertical)
    return {
        "agencies": merge_reference(stored["agencies"], seen["agencies"], ["level", "code"]),
        "offices": merge_reference(stored["offices"], seen["offices"], ["subtier_code", "office_code"]),
        "naics": merge_reference(stored["naics"], seen["naics"], ["code"], flags=["in_vertical"]),
        "entities": upsert_entities(stored["entities"], raw).result(),
        "awards": upsert_awards(stored["awards"], raw).result(),
    }


def with_offices(awards: DataFrame, offices: DataFrame) -> DataFrame:
    """Awards with the name that the office table has for their office, as ``office_name``; null where it has none."""
    known = offices.select(F.col("subtier_code").alias("awarding_sub_agency_code"), F.col("office_code").alias("awarding_office_code"), F.col("name").alias("office_name"))
    return awards.join(known, ["awarding_sub_agency_code", "awarding_office_code"], "left").select(*awards.columns, "office_name")


def award_value(prefix: str = "") -> Column:
    """What an award is worth: its potential, current or obligated total."""
    return F.coalesce(f"{prefix}total_value", f"{prefix}current_total_value", f"{prefix}obligated_total")


def award_end(prefix: str = "") -> Column:
    """The last day an award can run to."""
    return F.coalesce(f"{prefix}ultimate_end", f"{prefix}ordering_period_end")

