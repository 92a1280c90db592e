"""Whole-case samples and previews of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartrail.functions.durable import durable
from cartrail.spec import EventLog

# Seed of the session draw and rows of a preview.
SEED = 42
PREVIEW_ROWS = 1500


def distinct_cases(log: EventLog) -> DataFrame:
    """Distinct case ids, a null id included."""
    return log.df.select(F.col(log.spec.case).alias("case_id")).distinct()


def chosen_cases(log: EventLog, max_rows: int, seed: int = SEED) -> DataFrame:
    """The cases a sample of about ``max_rows`` rows consists of.

    Cases are ranked by a seeded hash and the first n are taken, exactly n of
    them. Only the hash bucket in which the n-th case falls is ranked row by
    row; buckets before it are taken whole, so no task sees all cases.
    """
    case = log.spec.case
    # One pass over the log; all that follows reads the stored cases.
    hashed = durable(
        log.df.groupBy(case)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn(
            "_hash",
            F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(case).cast("string"), F.lit("")))),
        )
        .withColumn("_bucket", F.substring("_hash", 1, 4))
    )
    totals = hashed.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("cases")
    )
    share = F.lit(float(max_rows)) / F.col("rows")
    wanted = totals.select(
        F.when(F.col("rows") <= max_rows, F.col("cases"))
        .otherwise(F.greatest(F.lit(1), F.floor(F.col("cases") * share)))
        .cast("bigint")
    ).scalar()
    # 65,536 buckets at most.
    buckets = (
        hashed.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_upto", F.sum("_size").over(Window.orderBy("_bucket")))
        .withColumn("_room", wanted - (F.col("_upto") - F.col("_size")))
        .filter(F.col("_room") > 0)
    )
    placed = hashed.join(F.broadcast(buckets.select("_bucket", "_size", "_room")), "_bucket")
    whole = placed.filter(F.col("_size") <= F.col("_room"))
    cut = (
        placed.filter(F.col("_size") > F.col("_room"))
        .withColumn("_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", case)))
        .filter(F.col("_rank") <= F.col("_room"))
    )
    return whole.select(case).unionByName(cut.select(case))


def sample_sessions(log: EventLog, max_rows: int, seed: int = SEED) -> DataFrame:
    """All rows of the chosen cases; the whole log if it fits ``max_rows``."""
    case = log.spec.case
    chosen = chosen_cases(log, max_rows, seed)
    return log.df.join(
        chosen.withColumnRenamed(case, "_case"), F.col(case).eqNullSafe(F.col("_case")), "left_semi"
    )


def event_log_preview(log: EventLog, max_rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first ``max_rows`` rows of whole cases, by first appearance of the case.

    Every case has at least one row, so the first ``max_rows`` cases suffice.
    Column ``row`` is the place in the preview; times become text, NaN null.
    """
    s = log.spec
    cases = log.df.filter(F.col(s.case).isNotNull())
    first = (
        cases.groupBy(s.case)
        .agg(F.min(s.time).alias("_start"))
        .orderBy("_start", s.case)
        .limit(max(max_rows, 0))
    )
    place = ["_start", s.case, *s.order]
    # Bounded by the preview size, as is the window below.
    rows = cases.join(F.broadcast(first), s.case).orderBy(*place).limit(max(max_rows, 0))
    types = dict(log.df.dtypes)

    def shown(name: str):
        if name == s.time and types[name].startswith("timestamp"):
            return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)
        if types[name] in ("double", "float"):
            return F.when(~F.isnan(name), F.col(name)).alias(name)
        return F.col(name)

    return rows.select(
        F.row_number().over(Window.orderBy(*place)).cast("bigint").alias("row"),
        *[shown(c) for c in log.df.columns],
    )
