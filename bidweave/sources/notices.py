"""Notices: pages of the search API (JSON) and extracts (CSV in code page 1252)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave import schemas
from bidweave.functions import normalize as N
from bidweave.sources import places, split_csv

_TEXT = (
    "noticeId", "title", "type", "baseType", "uiLink", "description", "archiveType", "solicitationNumber", "postedDate", "responseDeadLine",
    "reponseDeadLine", "naicsCode", "classificationCode", "typeOfSetAside", "setAsideCode", "typeOfSetAsideDescription", "setAside",
    "fullParentPathCode", "fullParentPathName", "active", "archiveDate", "department", "subTier", "subtier", "office",
)
_RECORD = (
    ", ".join(f"{c} string" for c in _TEXT)
    + f", naicsCodes array<string>, placeOfPerformance {schemas.PLACE}, resourceLinks array<string>,"
    f" pointOfContact array<{schemas.CONTACT}>, pointofContact array<{schemas.CONTACT}>, award {schemas.AWARD_NOTE}"
)
#: Fields of a record that are known, read or not.
KNOWN_FIELDS = (*_TEXT, "naicsCodes", "placeOfPerformance", "resourceLinks", "pointOfContact", "pointofContact", "award",
                "organizationType", "officeAddress", "additionalInfoLink", "links")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """API pages, a file each, as ``page`` (JSON text) and ``file``."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("page"), F.input_file_name().alias("file"))


def page_records(pages: DataFrame) -> DataFrame:
    """Each record of the pages as JSON text, with its file and place."""
    items = F.from_json("page", "struct<totalRecords: bigint, opportunitiesData: array<string>>")
    return pages.select("file", F.posexplode(items["opportunitiesData"]).alias("at", "record"))


def record_fields(record: Column | str) -> Column:
    """Names of a record's fields; null if it isn't an object."""
    return F.json_object_keys(record)


def unknown_fields(records: DataFrame) -> DataFrame:
    """Names of fields that no one reads, each once."""
    known = F.array(*map(F.lit, KNOWN_FIELDS))
    return records.select(F.explode(F.array_except(record_fields("record"), known)).alias("field")).distinct()


def _clean(c: str) -> Column:
    return N.clean_text(F.col(f"r.{c}"))


def _strings(c: Column) -> Column:
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), N.clean_text), lambda x: x.isNotNull())


def parse_notices(records: DataFrame) -> DataFrame:
    """Typed notices of JSON records; those that aren't objects or have no id go. ``seq`` keeps the order."""
    # Field names that differ in case alone can't both be columns of one struct.
    text = F.regexp_replace("record", '"pointofContact"\\s*:', '"pointOfContactOld":')
    text = F.regexp_replace(text, '"subtier"\\s*:', '"subTierOld":')
    ddl = _RECORD.replace("pointofContact array", "pointOfContactOld array").replace(", subtier string", ", subTierOld string")
    rows = records.select("file", "at", F.from_json(text, f"struct<{ddl}>").alias("r")).where(_clean("noticeId").isNotNull())
    naics = _clean("naicsCode")
    listed = _strings(F.col("r.naicsCodes"))
    deadline = F.coalesce("r.responseDeadLine", "r.reponseDeadLine")
    old_name = N.joined(F.col("r.department"), F.coalesce(F.nullif(F.col("r.subTier"), F.lit("")), F.col("r.subTierOld")), F.col("r.office"))
    contacts = F.coalesce("r.pointOfContact", "r.pointOfContactOld", F.array().cast(f"array<{schemas.CONTACT}>"))
    return rows.select(
        _clean("noticeId").alias("notice_id"),
        _clean("solicitationNumber").alias("solicitation_number"),
        _clean("title").alias("title"),
        _clean("type").alias("type"),
        _clean("baseType").alias("base_type"),
        N.parse_datetime("r.postedDate").alias("posted_at"),
        N.parse_datetime(deadline).alias("response_deadline"),
        N.has_time(deadline).alias("response_deadline_has_time"),
        naics.alias("naics"),
        F.when(F.size(listed) > 0, listed).when(naics.isNotNull(), F.array(naics)).otherwise(F.array().cast("array<string>")).alias("naics_codes"),
        _clean("classificationCode").alias("psc"),
        N.clean_text(F.coalesce("r.typeOfSetAside", "r.setAsideCode")).alias("set_aside_code"),
        N.clean_text(F.coalesce("r.typeOfSetAsideDescription", "r.setAside")).alias("set_aside"),
        _clean("fullParentPathCode").alias("full_parent_path_code"),
        F.coalesce(_clean("fullParentPathName"), old_name).alias("full_parent_path_name"),
        F.col("r.placeOfPerformance").alias("place_of_performance"),
        N.clean_text(F.col("r.placeOfPerformance.state.code")).alias("pop_state"),
        _clean("description").alias("description_url"),
        _strings(F.col("r.resourceLinks")).alias("attachment_links"),
        F.filter(contacts, lambda c: c.isNotNull()).alias("contacts"),
        F.col("r.award").alias("award"),
        _clean("uiLink").alias("ui_link"),
        N.yes_no("r.active").alias("active"),
        _clean("archiveType").alias("archive_type"),
        N.parse_date("r.archiveDate").alias("archive_date"),
        F.struct("file", "at").alias("seq"),
    )


def check_header(columns: list[str]) -> list[str]:
    """Names beyond the known ones; a missing one raises ValueError."""
    missing = [c for c in schemas.NOTICE_CSV_COLUMNS if c not in columns]
    if missing:
        raise ValueError(f"the notice extract lacks the columns {', '.join(missing)}")
    return [c for c in columns if c not in schemas.NOTICE_CSV_COLUMNS]


def read_extract(spark: SparkSession, path: str) -> DataFrame:
    """An extract's rows as text: code page 1252, quoted fields over several lines, ragged rows tolerated.

    Tasks read it by byte ranges; where only Spark reaches the file, one task reads it.
    """
    if places.reachable(path):
        names = split_csv.header(path, "cp1252")
        if not names:
            raise ValueError(f"{path} is empty")
        check_header(names)
        return split_csv.read_split(spark, path, "cp1252")
    reader = spark.read.options(header=True, inferSchema=False, multiLine=True, quote='"', escape='"', encoding="windows-1252", mode="PERMISSIVE")
    raw = reader.csv(path)
    if not raw.columns:
        raise ValueError(f"{path} is empty")
    check_header(raw.columns)
    return raw


def extract_in_scope(raw: DataFrame, vertical: tuple[str, ...], since: date | None = None) -> DataFrame:
    """Rows whose primary code is in the vertical, posted on a day or later."""
    kept = raw.where(N.clean_text("NaicsCode").isin(*vertical))
    return kept if since is None else kept.where(F.to_date(N.parse_datetime("PostedDate")) >= F.lit(since))


def parse_extract(raw: DataFrame, *others: str) -> DataFrame:
    """Typed notices of an extract, with ``description`` and other columns named; what the extract doesn't have is null."""
    c = N.clean_text

    def named(field: str, column: str, other: str) -> Column:
        value = c(f"`{column}`")
        pair = {field: value, other: F.lit(None).cast("string")}
        return F.when(value.isNotNull(), F.struct(*(pair[k].alias(k) for k in ("code", "name"))))

    street, zip_code = c("PopStreetAddress"), c("PopZip")
    city, state, country = named("name", "PopCity", "code"), named("code", "PopState", "name"), named("code", "PopCountry", "name")
    place = F.when(
        street.isNotNull() | city.isNotNull() | state.isNotNull() | zip_code.isNotNull() | country.isNotNull(),
        F.struct(street.alias("streetAddress"), city.alias("city"), state.alias("state"), country.alias("country"), zip_code.alias("zip")),
    )
    people = []
    for kind, p in (("primary", "PrimaryContact"), ("secondary", "SecondaryContact")):
        parts = {"title": c(f"{p}Title"), "fullName": c(f"{p}Fullname"), "email": c(f"{p}Email"), "phone": c(f"{p}Phone"), "fax": c(f"{p}Fax")}
        some = F.coalesce(*parts.values()).isNotNull()
        people.append(F.when(some, F.struct(F.lit(kind).alias("type"), *(v.alias(k) for k, v in parts.items()))))
    number, day, amount, awardee = c("AwardNumber"), c("AwardDate"), c("`Award$`"), c("Awardee")
    award = F.when(
        F.coalesce(number, day, amount, awardee).isNotNull(),
        F.struct(
            number.alias("number"), day.alias("date"), amount.alias("amount"),
            F.when(awardee.isNotNull(), F.struct(awardee.alias("name"), F.lit(None).cast("string").alias("ueiSAM"))).alias("awardee"),
        ),
    )
    naics = c("NaicsCode")
    return raw.where(c("NoticeId").isNotNull()).select(
        c("NoticeId").alias("notice_id"),
        c("`Sol#`").alias("solicitation_number"),
        c("Title").alias("title"),
        c("Type").alias("type"),
        c("BaseType").alias("base_type"),
        N.parse_datetime("PostedDate").alias("posted_at"),
        N.parse_datetime("ResponseDeadLine").alias("response_deadline"),
        N.has_time("ResponseDeadLine").alias("response_deadline_has_time"),
        naics.alias("naics"),
        F.when(naics.isNotNull(), F.array(naics)).otherwise(F.array().cast("array<string>")).alias("naics_codes"),
        c("ClassificationCode").alias("psc"),
        c("SetASideCode").alias("set_aside_code"),
        c("SetASide").alias("set_aside"),
        N.joined("CGAC", "`FPDS Code`", "`AAC Code`").alias("full_parent_path_code"),
        N.joined("`Department/Ind.Agency`", "`Sub-Tier`", "Office").alias("full_parent_path_name"),
        place.alias("place_of_performance"),
        c("PopState").alias("pop_state"),
        F.lit(None).cast("string").alias("description_url"),
        F.lit(None).cast("array<string>").alias("attachment_links"),
        F.filter(F.array(*people), lambda x: x.isNotNull()).alias("contacts"),
        award.alias("award"),
        c("Link").alias("ui_link"),
        N.yes_no("Active").alias("active"),
        c("ArchiveType").alias("archive_type"),
        N.parse_date("ArchiveDate").alias("archive_date"),
        c("Description").alias("description"),
        *others,
    )


def stored_columns(notices: DataFrame) -> DataFrame:
    """A notice table's derived columns: norms, organisation codes, and lists that are never null."""
    path = N.org_path("full_parent_path_code", "full_parent_path_name")
    return (
        notices.withColumn("solicitation_number_norm", N.normalize_contract_id("solicitation_number"))
        .withColumn("_org", path)
        .withColumns({k: F.col(f"_org.{k}") for k in ("department_code", "subtier_code", "office_code")})
        .withColumn("attachment_links", F.coalesce("attachment_links", F.array().cast("array<string>")))
        .withColumn("naics_codes", F.coalesce("naics_codes", F.array().cast("array<string>")))
        .drop("_org")
    )
