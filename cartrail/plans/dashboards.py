"""All shop tables of a report from one pass over the log.

The log is grouped once by all the key sets the tables need. Each event goes
into one group per set and the groups combine before the shuffle, so what is
shuffled and stored is at most one row per distinct key of each set. The tables
are then counts over the stored rows of their set, which is a folder of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartrail.functions.durable import shared_folder
from cartrail.operators import commerce
from cartrail.sources.event_log import UNKNOWN
from cartrail.spec import EventLog

# The key sets by name; each but the last counts sessions.
KEY_SETS = {
    "session": ("case_id",),
    "brand": ("brand", "case_id"),
    "category": ("category", "case_id"),
    "price": ("price_bin", "case_id"),
    "price_hour": ("price_bin", "hour", "case_id"),
    "hour_segment": ("hour", "segment", "case_id"),
    "user": ("user_id", "case_id"),
    "thing": ("product_id", "activity"),
}
KEYS = list(dict.fromkeys(k for keys in KEY_SETS.values() for k in keys))


def _roles(log: EventLog) -> DataFrame:
    """The log's key columns under fixed names, with role flags and times."""
    s = log.spec

    def flag(name: str) -> Column:
        return F.coalesce(log.is_activity(name), F.lit(False))

    price, time = F.col(s.price), F.col(s.time)
    low = F.when(price < commerce.MAX_PRICE + commerce.BIN_SIZE + 1, F.floor(price / commerce.BIN_SIZE))
    low = (low * commerce.BIN_SIZE).cast("bigint")
    return log.df.select(
        F.col(s.case).alias("case_id"),
        F.col(s.user).alias("user_id"),
        F.col(s.product).alias("product_id"),
        F.col(s.activity).alias("activity"),
        F.coalesce(s.brand, F.lit(UNKNOWN)).alias("brand"),
        F.coalesce(s.category, F.lit(UNKNOWN)).alias("category"),
        F.when(low <= commerce.MAX_PRICE, low).alias("price_bin"),
        F.hour(time).cast("bigint").alias("hour"),
        commerce.price_segment(price).alias("segment"),
        time.alias("time"),
        flag(s.view).alias("view"),
        flag(s.cart).alias("cart"),
        flag(s.purchase).alias("purchase"),
        flag(s.remove).alias("remove"),
    )


def session_facts(log: EventLog) -> DataFrame:
    """One row per key set and key: ``set``, the keys (null outside the set), counts, flags and first times."""
    masks = {
        sum(1 << (len(KEYS) - 1 - at) for at, key in enumerate(KEYS) if key not in keys): name
        for name, keys in KEY_SETS.items()
    }
    chosen = F.lit(None).cast("string")
    for mask, name in masks.items():
        chosen = F.when(F.col("mask") == mask, name).otherwise(chosen)
    time = F.col("time")
    return (
        _roles(log)
        .groupingSets([[F.col(k) for k in keys] for keys in KEY_SETS.values()], *[F.col(k) for k in KEYS])
        .agg(
            F.grouping_id().alias("mask"),
            F.count(F.lit(1)).alias("events"),
            F.max("view").alias("has_view"),
            F.max("cart").alias("has_cart"),
            F.max("purchase").alias("has_purchase"),
            F.every("view").alias("only_view"),
            F.min("time").alias("start"),
            F.min(F.when(F.col("remove"), time)).alias("first_remove"),
            F.min(F.when(F.col("purchase"), time)).alias("first_purchase"),
            F.count_if("remove").alias("removals"),
        )
        .withColumn("set", chosen)
        .drop("mask")
    )


def stored_facts(log: EventLog, folder: str | None = None) -> DataFrame:
    """``session_facts`` written below ``folder`` (or the shared one), a folder per key set, and read back."""
    spark = log.df.sparkSession
    folder = folder or f"{shared_folder(spark)}/facts-{uuid.uuid4().hex}"
    facts = session_facts(log)
    facts.write.mode("overwrite").partitionBy("set").parquet(folder)
    return spark.read.schema(facts.schema).parquet(folder)


def _counted(facts: DataFrame, keys: list[str], purchases: bool) -> DataFrame:
    rows = facts.filter("has_purchase") if purchases else facts
    return rows.groupBy(*keys).agg(F.count("case_id").alias("session_count"))


def dashboard_tables(facts: DataFrame) -> dict[str, DataFrame]:
    """KPIs, metrics and every dashboard table from stored facts; each equals the operator of its name."""
    of = {name: facts.filter(F.col("set") == name) for name in KEY_SETS}
    known = F.col("case_id").isNotNull()
    priced = {name: of[name].filter(F.col("price_bin").isNotNull()) for name in ("price", "price_hour")}
    categories = of["category"].groupBy("category").agg(
        F.count("case_id").alias("total_sessions"),
        F.count_if(F.col("has_purchase") & known).alias("purchase_sessions"),
        F.count_if(F.col("has_cart") & known).alias("cart_sessions"),
        F.max(F.col("has_cart") | F.col("has_purchase")).alias("in_funnel"),
    )
    brands = of["brand"].groupBy("brand").agg(
        F.count("case_id").alias("sessions"), F.count_if(F.col("has_purchase") & known).alias("purchase")
    )
    users = of["user"].filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count("case_id").alias("n"))
    starts = of["user"].dropna(subset=["user_id", "case_id"]).select("user_id", "case_id", "start")
    removed = known & (F.col("first_purchase") > F.col("first_remove"))
    tables = {
        "kpis": _kpis(of, users, brands, categories),
        "metrics": _metrics(of["session"], categories, users),
        "brand_compare": commerce.brands_rated(brands),
        "purchase_rate": commerce.purchase_rates(categories, commerce.TOP_CATEGORIES),
        "abandonment_rate": commerce.abandonment_rates(categories, commerce.TOP_CATEGORIES),
        "window_shopper": commerce.window_rates(
            of["category"].select("category", "case_id", "only_view", "has_view")
        ),
        "loyal_returning": commerce.returning_rates(starts),
        "remove_purchase": of["session"]
        .filter(removed)
        .groupBy(F.to_date("start").alias("date"))
        .agg(F.count(F.lit(1)).alias("sessions")),
    }
    for purchases, name in ((False, "session"), (True, "purchase")):
        cells = of["hour_segment"].filter("has_purchase") if purchases else of["hour_segment"]
        tables |= {
            f"{name}_price_dist": commerce.price_labelled(_counted(priced["price"], ["price_bin"], purchases)),
            f"{name}_heatmap": commerce.hours_wide(
                _counted(priced["price_hour"], ["price_bin", "hour"], purchases)
            ),
            f"{name}_hour_price": commerce.segments_filled(cells.select("hour", "segment", "case_id")),
        }
    return tables


def _one_row(parts: list[DataFrame], columns: list[str]) -> DataFrame:
    rows = [part.select(F.struct(*part.columns)).scalar().alias(f"p{k}") for k, part in enumerate(parts)]
    one = parts[0].sparkSession.range(1).select(*rows)
    return one.select(*[f"p{k}.*" for k in range(len(parts))]).select(*columns)


def _kpis(of: dict[str, DataFrame], users: DataFrame, brands: DataFrame, categories: DataFrame) -> DataFrame:
    sessions = of["session"].agg(
        F.coalesce(F.sum("events"), F.lit(0)).alias("rows"),
        F.count("case_id").alias("sessions"),
        F.count_if(F.col("has_purchase") & F.col("case_id").isNotNull()).alias("purchase_sessions"),
    )

    def number(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.select(key).distinct().agg(F.count(key).alias(name))

    parts = [
        sessions,
        users.agg(F.count(F.lit(1)).alias("users")),
        number(of["thing"], "product_id", "products"),
        categories.agg(F.count(F.lit(1)).alias("categories")),
        brands.agg(F.count(F.lit(1)).alias("brands")),
        number(of["thing"], "activity", "event_types"),
    ]
    columns = ["rows", "sessions", "users", "purchase_sessions", "products", "categories", "brands", "event_types"]
    return _one_row(parts, columns)


def _metrics(sessions: DataFrame, categories: DataFrame, users: DataFrame) -> DataFrame:
    parts = [
        commerce.category_averages(categories),
        commerce.session_rates(sessions.withColumn("known", F.col("case_id").isNotNull())),
        commerce.loyalty_rates(users),
    ]
    return _one_row(parts, [c for part in parts for c in part.columns])
