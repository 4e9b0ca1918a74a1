"""Match features between a notice and an award, each a column from 0 to 1, and the reasons they give.

Notice columns carry the prefix ``n_``, award columns ``a_``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidweave.config import Candidates, Features, MatchingConfig, Weights

#: Set-aside codes by family.
SET_ASIDE_FAMILY = {
    "SBA": "small", "SBP": "small", "RSB": "small", "ESB": "small", "8A": "8a", "8AN": "8a", "HZC": "hubzone", "HZS": "hubzone",
    "SDVOSBC": "sdvosb", "SDVOSBS": "sdvosb", "WOSB": "wosb", "WOSBSS": "wosb", "EDWOSB": "edwosb", "EDWOSBSS": "edwosb",
    "VSA": "vosb", "VSS": "vosb", "ISBEE": "isbee", "IEE": "isbee", "NONE": "none",
}
NAMES = ("office", "text", "naics", "end_date", "psc", "set_aside", "value", "vehicle")


def window_low(reference: Column, c: Candidates) -> Column:
    return F.add_months(reference, -c.months_before)


def window_high(reference: Column, c: Candidates) -> Column:
    return F.add_months(reference, c.months_after)


def office(n_subtier: Column, n_office: Column, a_subtier: Column, a_office: Column, f: Features) -> Column:
    same = F.coalesce(n_subtier == a_subtier, F.lit(False))
    return F.when(same & F.coalesce(n_office == a_office, F.lit(False)), 1.0).when(same, f.office_same_subtier_only).otherwise(0.0)


def naics(n_codes: Column, a_code: Column, f: Features) -> Column:
    missing = a_code.isNull() | (a_code == "") | n_codes.isNull() | (F.size(n_codes) == 0)
    group = F.exists(n_codes, lambda c: F.substring(c, 1, 4) == F.substring(a_code, 1, 4))
    return F.when(missing, 0.0).when(F.array_contains(n_codes, a_code), 1.0).when(group, f.naics_same_group).otherwise(0.0)


def psc(n_psc: Column, a_psc: Column, f: Features) -> Column:
    a, b = F.upper(n_psc), F.upper(a_psc)
    missing = a.isNull() | b.isNull() | (a == "") | (b == "")
    return (
        F.when(missing, f.psc_missing)
        .when(a == b, 1.0)
        .when(F.substring(a, 1, 2) == F.substring(b, 1, 2), f.psc_same_prefix2)
        .when(F.substring(a, 1, 1) == F.substring(b, 1, 1), f.psc_same_prefix1)
        .otherwise(0.0)
    )


def end_date(reference: Column, end: Column, c: Candidates, f: Features) -> Column:
    """1 in the ideal range around the reference date, falling in a line to 0 at the window's edges."""
    offset = F.datediff(end, reference)
    low, high = F.datediff(window_low(reference, c), reference), F.datediff(window_high(reference, c), reference)
    a, b = F.lit(f.end_date_ideal_from_days), F.lit(f.end_date_ideal_to_days)
    return (
        F.when(end.isNull() | (offset < low) | (offset > high), 0.0)
        .when(offset < a, F.when(a > low, F.try_divide(offset - low, a - low)).otherwise(1.0))
        .when(offset > b, F.when(high > b, F.try_divide(high - offset, high - b)).otherwise(1.0))
        .otherwise(1.0)
    )


def set_aside_family(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in SET_ASIDE_FAMILY.items() for x in pair))
    text = F.trim(code)
    return F.when(code.isNull() | (code == ""), "none").otherwise(F.coalesce(F.try_element_at(table, F.upper(text)), F.lower(text)))


def set_aside(n_code: Column, a_code: Column) -> Column:
    a, b = set_aside_family(n_code), set_aside_family(a_code)
    return F.when(a == b, 1.0).when((a != "none") & (b != "none"), 0.5).otherwise(0.0)


def value(stated: Column, total: Column, f: Features) -> Column:
    missing = stated.isNull() | (F.size(stated) == 0) | total.isNull() | (total <= 0)
    near = F.exists(stated, lambda s: (total / s >= 1 / 3) & (total / s <= 3))
    return F.when(missing, f.value_missing).when(near, 1.0).otherwise(0.2)


def vehicle(vehicles: Column, referenced: Column, f: Features) -> Column:
    none = vehicles.isNull() | (F.size(vehicles) == 0)
    return F.when(none, f.vehicle_missing).when(F.coalesce(F.array_contains(vehicles, referenced), F.lit(False)), 1.0).otherwise(0.0)


def text(similarity: Column, f: Features) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), similarity / f.text_full_at))


def base_score(weights: Weights) -> Column:
    """Weighted sum of the columns ``f_<name>``, in one fixed order."""
    total = F.lit(0.0)
    for name in NAMES:
        total = total + getattr(weights, name) * F.col(f"f_{name}")
    return total


def _end_reason() -> Column:
    when = F.date_format("a_end", "MMM yyyy")
    anchor = F.when(F.col("n_has_deadline"), "the response deadline").otherwise("the notice date")
    months = F.bround(F.datediff("a_end", "n_reference") / F.lit(30.44)).cast("int")
    side = F.when(months > 0, "after").otherwise("before")
    unit = F.when(F.abs(months) == 1, "month").otherwise("months")
    far = F.concat(F.lit("Current contract ends "), when, F.lit(", "), F.abs(months).cast("string"), F.lit(" "), unit, F.lit(" "), side, F.lit(" "), anchor)
    return F.when(months == 0, F.concat(F.lit("Current contract ends "), when, F.lit(", around "), anchor)).otherwise(far)


def reasons() -> Column:
    """Sentences for what speaks for a match, strongest first; a plain one if nothing does."""
    said = F.lit
    mentioned = F.concat(
        said("The notice mentions this contract ("),
        F.col("cited_as"),
        said(")"),
        F.when(F.size("context") > 0, F.concat(said(" near the words “"), F.try_element_at("context", F.lit(1)), said("”"))).otherwise(""),
    )
    sentences = [
        F.when(F.col("explicit"), mentioned),
        F.when(F.col("f_office") == 1, F.concat(said("Same contracting office ("), F.coalesce("a_office_name", "a_office"), said(")"))).when(
            F.col("f_office") > 0, F.concat(said("Same agency ("), F.coalesce("a_subtier_name", "a_subtier"), said("), different office"))
        ),
        F.when((F.col("f_end_date") > 0) & F.col("a_end").isNotNull(), _end_reason()),
        F.when(F.col("f_naics") == 1, F.concat(said("Same industry code (NAICS "), F.col("a_naics"), said(")"))).when(
            F.col("f_naics") > 0, F.concat(said("Related industry code (NAICS "), F.col("a_naics"), said(")"))
        ),
        F.when((F.col("f_text") >= 0.3) & (F.size("shared_terms") > 0), F.concat(said("Similar work: "), F.array_join("shared_terms", ", "))),
        F.when((F.col("f_psc") == 1) & (F.col("a_psc") != ""), F.concat(said("Same product or service code ("), F.col("a_psc"), said(")"))),
        F.when(F.col("f_vehicle") == 1, said("Ordered under the same contract vehicle the notice names")),
        F.when(
            (F.col("f_set_aside") == 1) & (set_aside_family(F.col("a_set_aside_code")) != "none"),
            F.concat(said("Same set-aside ("), F.coalesce("a_set_aside", "a_set_aside_code"), said(")")),
        ),
        F.when(F.col("f_value") == 1, said("Contract value is in line with the amount in the notice")),
    ]
    kept = F.filter(F.array(*sentences), lambda s: s.isNotNull())
    plain = F.concat(said("Contract "), F.coalesce("a_piid", "award_key"), said(" is from the same agency"))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(plain))


def score_columns(cfg: MatchingConfig) -> dict[str, Column]:
    """All feature columns of a joined pair with its ``similarity``, ``stated`` and ``vehicles``."""
    c, f = cfg.candidates, cfg.features
    col = F.col
    return {
        "f_office": office(col("n_subtier"), col("n_office"), col("a_subtier"), col("a_office"), f),
        "f_text": text(col("similarity"), f),
        "f_naics": naics(col("n_codes"), col("a_naics"), f),
        "f_end_date": end_date(col("n_reference"), col("a_end"), c, f),
        "f_psc": psc(col("n_psc"), col("a_psc"), f),
        "f_set_aside": set_aside(col("n_set_aside_code"), col("a_set_aside_code")),
        "f_value": value(col("stated"), col("a_value"), f),
        "f_vehicle": vehicle(col("vehicles"), col("a_referenced_norm"), f),
    }
