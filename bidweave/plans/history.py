"""Links between notices and the awards that resulted from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidweave.functions import normalize as N
from bidweave.functions.text import looks_like_contract_number
from bidweave.operators.merge import replace_automatic
from bidweave.operators.rows import links_within

#: What each method means, and links of one notice above which its number is a placeholder.
REASONS = {
    "same_solicitation": "Awarded under this notice's solicitation number",
    "award_notice_number": "The award notice names this contract number",
}
MAX_LINKS = 50


def find_links(notices: DataFrame, awards: DataFrame, vertical: tuple[str, ...], most: int = MAX_LINKS) -> DataFrame:
    """(notice_id, award_key, method): by solicitation number, by award number, and by order number.

    A pair found by two methods keeps the first in the alphabet. Notices with more links than ``most`` are
    dropped whole; their links are counted before pairs become one.
    """
    rows = notices.where(N.in_vertical("naics", "naics_codes", vertical) & F.col("subtier_code").isNotNull()).select(
        "notice_id", "subtier_code", "type", F.col("solicitation_number_norm").alias("sol"), N.normalize_contract_id("award.number").alias("number")
    )
    sol_ok, number_ok = looks_like_contract_number("sol"), looks_like_contract_number("number")

    def keyed(condition, number: str, method: str) -> DataFrame:
        return rows.where(condition).select("notice_id", "subtier_code", F.col(number).alias("key"), F.lit(method).alias("method"))

    by_solicitation = keyed(sol_ok, "sol", "same_solicitation")
    by_number = keyed(number_ok, "number", "award_notice_number").unionByName(
        keyed((F.col("type") == "Award Notice") & sol_ok, "sol", "award_notice_number")
    )

    def linked(side: DataFrame, column: str) -> DataFrame:
        other = awards.select("award_key", F.col(column).alias("key"), F.col("awarding_sub_agency_code").alias("subtier_code"))
        return side.join(other, ["key", "subtier_code"]).select("notice_id", "award_key", "method")

    found = linked(by_solicitation, "solicitation_id_norm").unionByName(linked(by_number, "piid_norm"))
    return links_within(found, "notice_id", ["notice_id", "award_key"], "method", most)


def link_rows(links: DataFrame, awards: DataFrame, matcher_version: str, like: DataFrame) -> DataFrame:
    """Links as rows of the match table ``like``."""
    evidence = like.schema["evidence"].dataType.simpleString()
    reason = F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair))
    said = F.to_json(F.struct(F.array(reason[F.col("method")]).alias("reasons")))
    return links.join(awards.select("award_key", "piid"), "award_key").select(
        "notice_id", "award_key", "piid", F.lit("resulting_award").alias("kind"), "method", F.lit(1).cast("decimal(5,4)").alias("score"),
        F.lit(None).cast("int").alias("rank"), F.lit("hidden").alias("shown"), F.from_json(said, evidence).alias("evidence"),
        F.lit(matcher_version).alias("matcher_version"), F.lit("auto").alias("status"),
    )


def save_links(stored: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The match table with these links; automatic ones that no longer hold go, whatever their notice."""
    spark = stored.sparkSession
    scope = spark.range(1).select(F.lit("resulting_award").alias("kind"))
    as_text = lambda df: df.withColumn("evidence", F.to_json("evidence"))
    table, counts = replace_automatic(as_text(stored), as_text(rows), ["notice_id", "award_key", "kind"], scope)
    ddl = stored.schema["evidence"].dataType.simpleString()
    return table.withColumn("evidence", F.from_json("evidence", ddl)).select(*stored.columns), counts
