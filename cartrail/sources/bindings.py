"""Event logs derived from the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartrail.functions.durable import shared_folder, utc
from cartrail.functions.ordering import Ordered, hot_keys
from cartrail.spec import DEFAULT_HOT_ROWS, EventLog, LogSpec
from cartrail.sources.event_log import UNKNOWN, fill_defaults

SESSION_GAP_HOURS = 12

SHOP_SPEC = LogSpec(ties=("event_id",))
# Activities named by event type and product group; order as in the shop log.
GRAPH_SPEC = SHOP_SPEC
DIALOGUE_SPEC = LogSpec(case="conv_id", activity="step", time="turn", ties=())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def sessionize(
    events: DataFrame,
    user: str,
    time: str,
    tie: str,
    gap_hours: int,
    hot_rows: int = DEFAULT_HOT_ROWS,
    name: str = "user_session",
) -> DataFrame:
    """Number the visits of each user: a new one starts after a long enough gap."""
    gap = F.col(time) - F.col("_before") > F.expr(f"interval {gap_hours} hours")
    by_user = Ordered.of(
        events, user, [time, tie], hot=hot_keys(events, user, hot_rows), block_rows=hot_rows
    )
    return (
        by_user.over(1, lambda df, w: df.withColumn("_before", F.lag(time).over(w)))
        .running_sum(F.when(gap, 1).otherwise(0).cast("bigint"), "_visit")
        .rows()
        .withColumn(name, F.concat_ws("-", F.col(user), F.col("_visit")))
        .drop("_before", "_visit")
    )


def _sessions(spark: SparkSession, sf_dir: str, hot_rows: int) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    return sessionize(events, "user_id", "ts", "event_id", SESSION_GAP_HOURS, hot_rows)


def _role(event_type: str):
    return (
        F.when(F.col(event_type) == "click", "cart")
        .when(F.col(event_type) == "error", "remove_from_cart")
        .otherwise(F.col(event_type))
    )


_LOGS: dict[tuple, EventLog] = {}
_FOLDERS: dict[tuple, str] = {}


def _once(spark: SparkSession, kind: str, sf_dir: str, hot_rows: int, build) -> EventLog:
    """One log per session and folder, so its hot keys are looked up once."""
    key = (spark.sparkContext.applicationId, kind, sf_dir, hot_rows)
    if key not in _LOGS:
        _LOGS[key] = build()
    return _LOGS[key]


def shop_log(spark: SparkSession, sf_dir: str, hot_rows: int = DEFAULT_HOT_ROWS) -> EventLog:
    """Clickstream with session, brand, category and price columns."""

    def build() -> EventLog:
        rows = _sessions(spark, sf_dir, hot_rows).select(
            "event_id",
            F.col("ts").alias("event_time"),
            _role("event_type").alias("event_type"),
            F.col("k").alias("product_id"),
            (F.col("value") * 10).alias("price"),
            "user_id",
            "user_session",
        )
        part = table(spark, sf_dir, "part").select(
            F.col("p_partkey"),
            F.col("p_brand").alias("brand"),
            F.col("p_type").alias("category_code"),
        )
        known = (F.col("p_partkey") == F.col("product_id")) & (F.col("product_id") % 10 != 0)
        df = rows.join(part, known, "left").drop("p_partkey")
        return EventLog(fill_defaults(df), SHOP_SPEC, hot_rows)

    return _once(spark, "shop", sf_dir, hot_rows, build)


def session_log(spark: SparkSession, sf_dir: str, hot_rows: int = DEFAULT_HOT_ROWS) -> EventLog:
    """The shop log without product attributes, for sequence operators."""

    def build() -> EventLog:
        df = _sessions(spark, sf_dir, hot_rows).select(
            "event_id",
            F.col("ts").alias("event_time"),
            _role("event_type").alias("event_type"),
            "user_id",
            "user_session",
        )
        return EventLog(df, SHOP_SPEC, hot_rows)

    return _once(spark, "session", sf_dir, hot_rows, build)


def graph_log(spark: SparkSession, sf_dir: str, hot_rows: int = DEFAULT_HOT_ROWS) -> EventLog:
    """Sessions whose activity is event type and product group (a richer graph)."""

    def build() -> EventLog:
        df = _sessions(spark, sf_dir, hot_rows).select(
            "event_id",
            F.col("ts").alias("event_time"),
            F.concat_ws(":", "event_type", F.floor(F.col("k") / 5)).alias("event_type"),
            "user_id",
            "user_session",
        )
        return EventLog(df, GRAPH_SPEC, hot_rows)

    return _once(spark, "graph", sf_dir, hot_rows, build)


def dialogue_log(spark: SparkSession, sf_dir: str, hot_rows: int = DEFAULT_HOT_ROWS) -> EventLog:
    """Conversations as cases; a step is the role and its turn number."""

    def build() -> EventLog:
        df = table(spark, sf_dir, "conversations").select(
            "conv_id", "turn", F.concat("role", F.col("turn").cast("string")).alias("step")
        )
        return EventLog(df, DIALOGUE_SPEC, hot_rows)

    return _once(spark, "dialogue", sf_dir, hot_rows, build)


def csv_log_folder(spark: SparkSession, sf_dir: str) -> str:
    """Write the shop log as CSV text, flaws included, and return its folder.

    Every tenth product id gets an unreadable time and every tenth a category
    id too large for a bigint, so that reading it back has something to reject.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FOLDERS:
        folder = f"{shared_folder(spark)}/shop-{uuid.uuid4().hex}"
        k = F.col("product_id") % 10
        time = F.date_format("event_time", "yyyy-MM-dd HH:mm:ss")
        shop_log(spark, sf_dir).df.select(
            F.when(k == 3, F.lit("unknown")).otherwise(F.concat(time, F.lit(" UTC"))).alias("event_time"),
            "event_type",
            "product_id",
            F.when(k == 7, F.lit("9.9E+30"))
            .otherwise(F.concat(F.lit("2."), F.lpad(F.col("product_id").cast("string"), 2, "0"), F.lit("E+18")))
            .alias("category_id"),
            F.nullif("category_code", F.lit(UNKNOWN)).alias("category_code"),
            F.nullif("brand", F.lit(UNKNOWN)).alias("brand"),
            "price",
            "user_id",
            "user_session",
        ).write.option("header", True).csv(folder)
        _FOLDERS[key] = folder
    return _FOLDERS[key]

