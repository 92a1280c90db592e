"""KPIs of any date range from distinct-count sketches kept per day.

A sketch holds the smallest hashes of the values it has seen, at most
``2 ** log_size`` of them. Sketches of two sets of rows join into the sketch of
both, in any order and as often as one likes, so the log is read once and every
range of days after that is a union of small rows. Counts below the size of a
sketch are exact; above it the relative standard error is about
``2 ** (-log_size / 2)``, 0.8 percent at the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartrail.sources.event_log import UNKNOWN
from cartrail.spec import EventLog

LOG_SIZE = 14
COUNTED = ("sessions", "users", "purchase_sessions", "products", "categories", "brands", "event_types")


def daily_sketches(log: EventLog, log_size: int = LOG_SIZE) -> DataFrame:
    """Per day: its number of rows and a sketch for every KPI that counts values.

    Rows without a time form a day of their own, null. Null values are not
    counted, but a null brand or category is ``Unknown``, as in ``commerce.kpis``.
    """
    s = log.spec
    values: dict[str, Column] = {
        "sessions": F.col(s.case),
        "users": F.col(s.user),
        "purchase_sessions": F.when(log.is_activity(s.purchase), F.col(s.case)),
        "products": F.col(s.product),
        "categories": F.coalesce(s.category, F.lit(UNKNOWN)),
        "brands": F.coalesce(s.brand, F.lit(UNKNOWN)),
        "event_types": F.col(s.activity),
    }
    return log.df.groupBy(F.to_date(s.time).alias("day")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.theta_sketch_agg(values[name].cast("string"), log_size).alias(name) for name in COUNTED],
    )


def merged(sketches: DataFrame, *by: str | Column, log_size: int = LOG_SIZE) -> DataFrame:
    """Sketches joined into one row per group, which can be joined again."""
    return sketches.groupBy(*by).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        *[F.theta_union_agg(name, log_size).alias(name) for name in COUNTED],
    )


def estimates(sketches: DataFrame) -> DataFrame:
    """The KPIs that the sketches of each row stand for; other columns stay."""
    counts = {name: F.coalesce(F.theta_sketch_estimate(name), F.lit(0)).cast("bigint") for name in COUNTED}
    return sketches.withColumns(counts)


def kpis_between(sketches: DataFrame, first: str, last: str, log_size: int = LOG_SIZE) -> DataFrame:
    """One row of KPIs for the days from ``first`` to ``last``, both included; zeros if there are none."""
    days = sketches.filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return estimates(merged(days, log_size=log_size))
