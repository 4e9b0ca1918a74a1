"""Plans of requests: which spans and codes to ask for, and what becomes of those that ask for too much.

Requests are rows; a plan is made, cut and checked by expressions over all of them at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.functions.normalize import fiscal_year_windows

DDL = "start date, end date, codes array<string>, date_type string"
#: Fixed value: days of the shorter spans that a request of one code is cut into.
QUARTER = 92


def key() -> Column:
    """Names a request, in the chunk table too."""
    return F.concat_ws(":", "date_type", F.col("start").cast("string"), F.col("end").cast("string"), F.lit("naics"), F.array_join("codes", "+"))


def plan(spark: SparkSession, spans: Sequence[tuple[date, date]], codes: Sequence[str], date_type: str) -> DataFrame:
    """A request for each span, of all codes."""
    rows = spark.createDataFrame([(a, b, sorted(codes), date_type) for a, b in spans], DDL)
    return rows.withColumn("key", key())


def fiscal_plan(spark: SparkSession, start: date, end: date, codes: Sequence[str], date_type: str) -> DataFrame:
    return plan(spark, fiscal_year_windows(start, end), codes, date_type)


def splittable() -> Column:
    return (F.size("codes") > 1) | (F.datediff("end", "start") >= QUARTER)


def split(requests: DataFrame) -> DataFrame:
    """Every request in parts: one for each of its codes, or for each quarter where it has one code.

    The parts of a request cover it without overlap. One that can't be cut any further gives no parts.
    """
    steps = F.sequence(F.lit(0), F.floor(F.datediff("end", "start") / QUARTER).cast("int"))
    first = lambda i: F.date_add(F.col("start"), i * QUARTER)
    part = lambda a, b, c: F.struct(a.alias("start"), b.alias("end"), c.alias("codes"), F.col("date_type").alias("date_type"))
    by_code = F.transform("codes", lambda c: part(F.col("start"), F.col("end"), F.array(c)))
    by_quarter = F.transform(steps, lambda i: part(first(i), F.least(F.col("end"), F.date_add(first(i), QUARTER - 1)), F.col("codes")))
    cut = F.when(F.size("codes") > 1, by_code).otherwise(by_quarter)
    return requests.where(splittable()).select(F.explode(cut).alias("r")).select("r.*").withColumn("key", key())


def overlaps(requests: DataFrame) -> DataFrame:
    """Requests that ask for a day of a code that another one before them asks for; none in a sound plan."""
    each = requests.select("key", "date_type", F.explode("codes").alias("code"), F.explode(F.sequence("start", "end")).alias("day"))
    return each.groupBy("date_type", "code", "day").agg(F.sort_array(F.collect_list("key")).alias("keys")).where(F.size("keys") > 1).select(F.explode(F.slice("keys", 2, 1 << 20)).alias("key")).distinct()
