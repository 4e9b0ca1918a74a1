"""Schemas of the tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _ddl(text: str) -> T.StructType:
    return T._parse_datatype_string(text)  # noqa: SLF001


#: Columns of a notice extract.
NOTICE_CSV_COLUMNS = (
    "NoticeId", "Title", "Sol#", "Department/Ind.Agency", "CGAC", "Sub-Tier", "FPDS Code", "Office", "AAC Code", "PostedDate",
    "Type", "BaseType", "ArchiveType", "ArchiveDate", "SetASideCode", "SetASide", "ResponseDeadLine", "NaicsCode",
    "ClassificationCode", "PopStreetAddress", "PopCity", "PopState", "PopZip", "PopCountry", "Active", "AwardNumber",
    "AwardDate", "Award$", "Awardee", "PrimaryContactTitle", "PrimaryContactFullname", "PrimaryContactEmail",
    "PrimaryContactPhone", "PrimaryContactFax", "SecondaryContactTitle", "SecondaryContactFullname",
    "SecondaryContactEmail", "SecondaryContactPhone", "SecondaryContactFax", "OrganizationType", "State", "City", "ZipCode",
    "CountryCode", "AdditionalInfoLink", "Link", "Description",
)

#: Columns taken from an award file.
AWARD_KEY = "contract_award_unique_key"
AWARD_CSV_COLUMNS = (
    AWARD_KEY, "award_id_piid", "parent_award_id_piid", "award_type_code", "award_type", "idv_type_code",
    "awarding_agency_code", "awarding_agency_name", "awarding_sub_agency_code", "awarding_sub_agency_name",
    "awarding_office_code", "awarding_office_name", "recipient_uei", "recipient_name", "recipient_parent_uei",
    "recipient_parent_name", "cage_code", "recipient_state_code", "naics_code", "naics_description",
    "product_or_service_code", "solicitation_identifier", "type_of_set_aside_code", "type_of_set_aside",
    "extent_competed_code", "number_of_offers_received", "total_obligated_amount", "current_total_value_of_award",
    "potential_total_value_of_award", "period_of_performance_start_date", "period_of_performance_current_end_date",
    "period_of_performance_potential_end_date", "ordering_period_end_date", "award_base_action_date",
    "award_latest_action_date", "prime_award_base_transaction_description", "last_modified_date", "usaspending_permalink",
)
#: Certification flags of an award file, and its column of the recipient's size.
BUSINESS_FLAGS = (
    "c8a_program_participant", "sba_certified_8a_joint_venture", "historically_underutilized_business_zone_hubzone_firm",
    "service_disabled_veteran_owned_business", "veteran_owned_business", "women_owned_small_business",
    "economically_disadvantaged_women_owned_small_business", "woman_owned_business", "small_disadvantaged_business",
    "self_certified_small_disadvantaged_business",
)
BUSINESS_SIZE = "contracting_officers_determination_of_business_size"
BUSINESS_COLUMNS = (*BUSINESS_FLAGS, BUSINESS_SIZE)

PLACE = "struct<streetAddress: string, city: struct<code: string, name: string>, state: struct<code: string, name: string>, country: struct<code: string, name: string>, zip: string>"
CONTACT = "struct<type: string, title: string, fullName: string, email: string, phone: string, fax: string>"
AWARD_NOTE = "struct<number: string, date: string, amount: string, awardee: struct<name: string, ueiSAM: string>>"

#: The fields of a notice's snapshot, in order, and the columns of the other tables.
NOTICE_DDL = f"""
    notice_id string, solicitation_number string, title string, type string, base_type string, posted_at timestamp,
    response_deadline timestamp, response_deadline_has_time boolean, naics string, naics_codes array<string>, psc string,
    set_aside_code string, set_aside string, full_parent_path_code string, full_parent_path_name string,
    place_of_performance {PLACE}, pop_state string, description_url string, attachment_links array<string>,
    contacts array<{CONTACT}>, award {AWARD_NOTE}, ui_link string, active boolean, archive_type string, archive_date date
"""
AWARD_DDL = """
    award_key string, piid string, piid_norm string, referenced_idv_piid string, referenced_idv_piid_norm string,
    award_type_code string, award_type string, idv_type_code string, awarding_agency_code string, awarding_agency_name string,
    awarding_sub_agency_code string, awarding_sub_agency_name string, awarding_office_code string, awarding_office_name string,
    recipient_uei string, recipient_name string, naics string, psc string, solicitation_id string, solicitation_id_norm string,
    set_aside_code string, set_aside string, extent_competed_code string, number_of_offers int, obligated_total decimal(24,4),
    current_total_value decimal(24,4), total_value decimal(24,4), pop_start date, current_end date, ultimate_end date,
    ordering_period_end date, base_action_date date, latest_action_date date, description string, last_modified timestamp,
    usaspending_url string
"""
MATCH_DDL = """
    notice_id string, award_key string, piid string, kind string, method string, score decimal(5,4), rank int, shown string,
    evidence struct<reasons: array<string>, features: map<string, double>, base_score: double, reference_date: date,
    end_date: date, shared_terms: array<string>, cited_as: string, context_words: array<string>>,
    matcher_version string, status string
"""
REVIEW_DDL = "notice_id string, award_key string, decision string, reviewer string, note string, created_at timestamp, id long"
LABEL_DDL = "notice_id string, award_key string, answer string, source string, labeled_at date, notes string"
RUN_DDL = "id long, source string, job string, status string, params map<string, string>, started_at timestamp, finished_at timestamp, error string, requests long, rows_in long, rows_written long"
CHUNK_DDL = "source string, chunk_key string, status string, state map<string, string>, rows_in long, rows_out long, updated_at timestamp"
RECOMPETE_DDL = """
    award_key string, piid string, award_type_code string, recipient_uei string, recipient_name string, awarding_agency_code string,
    awarding_agency_name string, awarding_sub_agency_code string, awarding_sub_agency_name string, awarding_office_code string,
    awarding_office_name string, naics string, psc string, set_aside_code string, set_aside string, number_of_offers int,
    total_value decimal(24,4), obligated_total decimal(24,4), ultimate_end date, linked_notice_id string
"""
RAW_FILE_DDL = "path string, source string, sha256 string, bytes long, fetched_at timestamp, request_params map<string, string>, run_id long"


def notice() -> T.StructType:
    return _ddl(NOTICE_DDL)


def award() -> T.StructType:
    return _ddl(AWARD_DDL)


def match() -> T.StructType:
    return _ddl(MATCH_DDL)


def table(ddl: str) -> T.StructType:
    return _ddl(ddl)
