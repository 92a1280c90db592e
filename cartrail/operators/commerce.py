"""Shop KPIs, conversion tables and customer loyalty.

Tables count distinct sessions. They share one plan: reduce the log to one row
per (dimension, session) with role flags, which combines before the shuffle,
then count those rows per dimension. No session is collected anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartrail.functions.ordering import Ordered, hot_keys
from cartrail.spec import EventLog
from cartrail.sources.event_log import UNKNOWN

# Width and last price bin, price segments (right-closed), chart sizes.
BIN_SIZE = 50
MAX_PRICE = 2000
SEGMENTS = [
    ("0-50", 0, 50),
    ("50-100", 50, 100),
    ("100-200", 100, 200),
    ("200-500", 200, 500),
    ("500-1000", 500, 1000),
    ("1000+", 1000, None),
]
TOP_BRANDS = 15
TOP_CATEGORIES = 20
RETURNING_OVER = 1
LOYAL_OVER = 3


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, and 0 where that is undefined."""
    return F.coalesce(F.try_divide(F.lit(100.0) * part, whole), F.lit(0.0))


def _bigint(column: Column) -> Column:
    return column.cast("bigint")


def kpis(log: EventLog, approx: bool = False) -> DataFrame:
    """One row of counts over the whole log."""
    s = log.spec
    distinct = F.approx_count_distinct if approx else F.count_distinct
    known = log.df.withColumns(
        {
            s.brand: F.coalesce(s.brand, F.lit(UNKNOWN)),
            s.category: F.coalesce(s.category, F.lit(UNKNOWN)),
        }
    )
    if approx:
        bought = F.when(log.is_activity(s.purchase), F.col(s.case))
        return known.agg(
            F.count(F.lit(1)).alias("rows"),
            distinct(s.case).alias("sessions"),
            distinct(s.user).alias("users"),
            distinct(bought).alias("purchase_sessions"),
            distinct(s.product).alias("products"),
            distinct(s.category).alias("categories"),
            distinct(s.brand).alias("brands"),
            distinct(s.activity).alias("event_types"),
        )
    # Each row becomes one (kind, value) pair per counted column; pairs combine
    # before the shuffle, and a session's purchase flag rides with its pair. Rows
    # without a session have a pair too, so the session pairs add up to all rows.
    kinds = {
        "sessions": s.case,
        "users": s.user,
        "products": s.product,
        "categories": s.category,
        "brands": s.brand,
        "event_types": s.activity,
    }
    bought = F.coalesce(log.is_activity(s.purchase), F.lit(False))
    pairs = known.select(
        bought.alias("bought"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value"))
                    for k, c in kinds.items()
                ],
            )
        ).alias("pair"),
    )
    values = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.max("bought").alias("bought"))
    kind, value = F.col("pair.kind"), F.col("pair.value")
    per_kind = values.groupBy(kind.alias("kind")).agg(
        F.sum("n").alias("n"),
        F.count(value).alias("values"),
        F.count_if(F.col("bought") & value.isNotNull()).alias("bought"),
    )

    def pick(name: str, column: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("kind") == name, F.col(column))), F.lit(0))

    return per_kind.agg(
        _bigint(pick("sessions", "n")).alias("rows"),
        pick("sessions", "values").alias("sessions"),
        pick("users", "values").alias("users"),
        pick("sessions", "bought").alias("purchase_sessions"),
        *[pick(k, "values").alias(k) for k in ("products", "categories", "brands", "event_types")],
    )


def _per_session(df: DataFrame, log: EventLog, *dims: str) -> DataFrame:
    """One row per (dims, session) with role flags; a null session stays a row."""
    s = log.spec
    flags = {"has_view": s.view, "has_cart": s.cart, "has_purchase": s.purchase}
    return df.groupBy(*dims, s.case).agg(
        *[F.max(F.coalesce(log.is_activity(a), F.lit(False))).alias(n) for n, a in flags.items()]
    )


def _sessions(log: EventLog) -> Column:
    return F.count(log.spec.case)


def _sessions_if(log: EventLog, flag: str) -> Column:
    return F.count_if(F.col(flag) & F.col(log.spec.case).isNotNull())


def _purchases(log: EventLog) -> DataFrame:
    return log.df.filter(log.is_activity(log.spec.purchase))


def _price_binned(df: DataFrame, log: EventLog) -> DataFrame:
    price = F.col(log.spec.price)
    # First a plain bound that scans can use; it also drops NaN and infinity.
    below = df.filter(price < MAX_PRICE + BIN_SIZE + 1)
    binned = below.withColumn("price_bin", _bigint(F.floor(price / BIN_SIZE) * BIN_SIZE))
    return binned.filter(F.col("price_bin") <= MAX_PRICE)


def price_distribution(log: EventLog, purchases: bool = False) -> DataFrame:
    """Sessions per price bin."""
    rows = _price_binned(_purchases(log) if purchases else log.df, log)
    return price_labelled(
        rows.select("price_bin", log.spec.case)
        .distinct()
        .groupBy("price_bin")
        .agg(_sessions(log).alias("session_count"))
    )


def price_labelled(counts: DataFrame) -> DataFrame:
    low = F.col("price_bin")
    label = F.concat(F.lit("$"), low, F.lit("-$"), low + (BIN_SIZE - 1))
    return counts.select("price_bin", label.alias("price_label"), "session_count")


def price_hour_counts(log: EventLog, purchases: bool = False) -> DataFrame:
    """Sessions per (price bin, hour)."""
    rows = _price_binned(_purchases(log) if purchases else log.df, log)
    return (
        rows.select("price_bin", _bigint(F.hour(log.spec.time)).alias("hour"), log.spec.case)
        .distinct()
        .groupBy("price_bin", "hour")
        .agg(_sessions(log).alias("session_count"))
    )


def price_hour_heatmap(log: EventLog, purchases: bool = False) -> DataFrame:
    """The same counts with one column per hour of the day, h00 to h23."""
    return hours_wide(price_hour_counts(log, purchases))


def hours_wide(counts: DataFrame) -> DataFrame:
    hours = list(range(24))
    wide = (
        counts.groupBy("price_bin")
        .pivot("hour", hours)
        .agg(F.first("session_count"))
    )
    return wide.select(
        "price_bin", *[F.coalesce(F.col(str(h)), F.lit(0)).alias(f"h{h:02d}") for h in hours]
    )


def price_segment(price: Column) -> Column:
    """Segment name, upper bound included; null outside all segments and for NaN."""
    segment = F.lit(None).cast("string")
    price = F.nanvl(price, F.lit(None).cast("double"))
    for name, low, high in reversed(SEGMENTS):
        inside = price > low if high is None else (price > low) & (price <= high)
        segment = F.when(inside, name).otherwise(segment)
    return segment


def hour_price_segments(log: EventLog, purchases: bool = False) -> DataFrame:
    """Sessions per (hour, price segment), with zero rows for empty segments."""
    rows = _purchases(log) if purchases else log.df
    cells = rows.select(
        _bigint(F.hour(log.spec.time)).alias("hour"),
        price_segment(F.col(log.spec.price)).alias("segment"),
        F.col(log.spec.case).alias("case_id"),
    )
    return segments_filled(cells.distinct())


def segments_filled(cells: DataFrame) -> DataFrame:
    """Sessions per (hour, segment) from distinct (hour, segment, case_id)."""
    names = [name for name, _, _ in SEGMENTS]
    wide = cells.groupBy("hour").pivot("segment", names).agg(F.count("case_id"))
    filled = wide.select("hour", *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(n) for n in names])
    return filled.unpivot(["hour"], names, "segment", "session_count")


def brand_counts(log: EventLog) -> DataFrame:
    """Sessions and purchase sessions of every brand."""
    s = log.spec
    named = log.df.withColumn(s.brand, F.coalesce(s.brand, F.lit(UNKNOWN)))
    return (
        _per_session(named, log, s.brand)
        .groupBy(F.col(s.brand).alias("brand"))
        .agg(_sessions(log).alias("sessions"), _sessions_if(log, "has_purchase").alias("purchase"))
    )


def brand_compare(log: EventLog, top: int = TOP_BRANDS) -> DataFrame:
    """Leading brands by sessions with their conversion rate."""
    return brands_rated(brand_counts(log), top)


def brands_rated(counts: DataFrame, top: int = TOP_BRANDS) -> DataFrame:
    return (
        counts.orderBy(F.col("sessions").desc(), "brand")
        .limit(top)
        .withColumn("conversion_rate", percent(F.col("purchase"), F.col("sessions")))
    )


def brand_compare_long(log: EventLog, top: int = TOP_BRANDS) -> DataFrame:
    return brand_compare(log, top).unpivot(
        ["brand", "conversion_rate"], ["sessions", "purchase"], "type", "count"
    )


def category_counts(log: EventLog) -> DataFrame:
    """Per category: sessions in total and by role, and whether a role occurs at all."""
    s = log.spec
    named = log.df.withColumn(s.category, F.coalesce(s.category, F.lit(UNKNOWN)))
    return (
        _per_session(named, log, s.category)
        .groupBy(F.col(s.category).alias("category"))
        .agg(
            _sessions(log).alias("total_sessions"),
            _sessions_if(log, "has_purchase").alias("purchase_sessions"),
            _sessions_if(log, "has_cart").alias("cart_sessions"),
            F.max(F.col("has_cart") | F.col("has_purchase")).alias("in_funnel"),
        )
    )


def purchase_rate_by_category(log: EventLog, top: int | None = None) -> DataFrame:
    return purchase_rates(category_counts(log), top)


def purchase_rates(counts: DataFrame, top: int | None = None) -> DataFrame:
    total, bought = F.col("total_sessions"), F.col("purchase_sessions")
    rates = counts.select(
        "category",
        "total_sessions",
        "purchase_sessions",
        (total - bought).alias("non_purchase_sessions"),
        percent(bought, total).alias("purchase_rate"),
    )
    if top is None:
        return rates
    return rates.orderBy(F.col("total_sessions").desc(), "category").limit(top)


def abandonment(cart: Column, bought: Column) -> Column:
    """Share of cart sessions without purchase, kept within 0 to 100."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), percent(cart - bought, cart)))


def cart_abandonment(log: EventLog, top: int | None = None) -> DataFrame:
    """Share of cart sessions without purchase, over categories that have either."""
    return abandonment_rates(category_counts(log), top)


def abandonment_rates(counts: DataFrame, top: int | None = None) -> DataFrame:
    cart, bought = F.col("cart_sessions"), F.col("purchase_sessions")
    rates = counts.filter("in_funnel").select(
        "category",
        "cart_sessions",
        "purchase_sessions",
        abandonment(cart, bought).alias("abandonment_rate"),
    )
    if top is None:
        return rates
    return rates.orderBy(F.col("abandonment_rate").desc(), "category").limit(top)


def _only_view(log: EventLog) -> Column:
    return F.every(F.coalesce(log.is_activity(log.spec.view), F.lit(False)))


def window_shoppers(log: EventLog) -> DataFrame:
    """Sessions in which nothing but views happened."""
    case = log.spec.case
    return (
        log.df.filter(F.col(case).isNotNull())
        .groupBy(F.col(case).alias("case_id"))
        .agg(_only_view(log).alias("only_view"))
        .filter("only_view")
        .select("case_id")
    )


def window_shopper_rate(log: EventLog) -> DataFrame:
    case = log.spec.case
    sessions = log.df.filter(F.col(case).isNotNull()).groupBy(case).agg(
        _only_view(log).alias("only_view")
    )
    window = F.count_if(F.col("only_view"))
    return sessions.agg(
        window.alias("window_sessions"),
        F.count(F.lit(1)).alias("sessions"),
        percent(window, F.greatest(F.lit(1), F.count(F.lit(1)))).alias("window_shopper_rate"),
    )


def window_shopper_by_category(log: EventLog, top: int = TOP_CATEGORIES) -> DataFrame:
    """Window-shopper sessions among the sessions that viewed a category.

    Rows are first reduced to (category, session), so the look over a session
    that follows touches one row per category, however long the session is.
    """
    s = log.spec
    named = log.df.withColumn(s.category, F.coalesce(s.category, F.lit(UNKNOWN)))
    pairs = named.groupBy(F.col(s.category).alias("category"), F.col(s.case).alias("case_id")).agg(
        _only_view(log).alias("only_view"),
        F.max(F.coalesce(log.is_activity(s.view), F.lit(False))).alias("has_view"),
    )
    return window_rates(pairs, top)


def window_rates(pairs: DataFrame, top: int = TOP_CATEGORIES) -> DataFrame:
    """The table above from (category, case_id) with ``only_view`` and ``has_view``."""
    # Null sessions form no session; they only keep their category in the list.
    unnamed = pairs.filter(F.col("case_id").isNull()).withColumn("window", F.lit(False))
    marked = pairs.filter(F.col("case_id").isNotNull()).withColumn(
        "window", F.every("only_view").over(Window.partitionBy("case_id"))
    )
    return (
        marked.unionByName(unnamed)
        .filter("has_view")
        .groupBy("category")
        .agg(F.count("case_id").alias("view_sessions"), F.count_if("window").alias("window_sessions"))
        .withColumn("window_rate", percent(F.col("window_sessions"), F.col("view_sessions")))
        .orderBy(F.col("window_rate").desc(), "category")
        .limit(top)
    )


def user_loyalty(log: EventLog) -> DataFrame:
    """Share of users with more than one and more than three sessions."""
    s = log.spec
    users = (
        log.df.filter(F.col(s.user).isNotNull())
        .groupBy(s.user)
        .agg(F.count_distinct(s.case).alias("n"))
    )
    return loyalty_rates(users)


def loyalty_rates(users: DataFrame) -> DataFrame:
    """Both shares from one row per user with its number of sessions, ``n``."""

    def over(n: int) -> Column:
        return percent(F.count_if(F.col("n") > n), F.count(F.lit(1)))

    return users.agg(over(RETURNING_OVER).alias("returning_rate"), over(LOYAL_OVER).alias("loyal_rate"))


def session_starts(log: EventLog) -> DataFrame:
    """First event time of each (user, session)."""
    s = log.spec
    return (
        log.df.dropna(subset=[s.user, s.case])
        .groupBy(F.col(s.user).alias("user_id"), F.col(s.case).alias("case_id"))
        .agg(F.min(s.time).alias("start"))
    )


def session_order(log: EventLog) -> DataFrame:
    """Ordinal of each session among the sessions of its user."""
    starts = session_starts(log)
    hot = hot_keys(starts, "user_id", log.hot_rows)
    ordered = Ordered.of(starts, "user_id", ["start", "case_id"], hot, log.hot_rows)
    return ordered.numbered("session_order").rows()


def daily_returning(log: EventLog) -> DataFrame:
    """Per start date, the share of sessions that are not their user's first.

    A user's first session is a plain minimum, so no user's sessions need to be
    ranked: sessions per date less first sessions per date.
    """
    return returning_rates(session_starts(log))


def returning_rates(starts: DataFrame) -> DataFrame:
    per_date = starts.groupBy("user_id", F.to_date("start").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.min("start").alias("start")
    )
    # A user's dates are few (days in the log), so the window stays small.
    earliest = F.min("start").over(Window.partitionBy("user_id")) == F.col("start")
    return (
        per_date.withColumn("first", F.when(earliest, 1).otherwise(0))
        .groupBy("date")
        .agg(F.sum("n").alias("sessions"), F.sum(F.col("n") - F.col("first")).alias("returning"))
        .select("date", percent(F.col("returning"), F.col("sessions")).alias("returning_rate"))
    )


def remove_then_purchase(log: EventLog) -> DataFrame:
    """Sessions whose first purchase comes after their first removal from the cart."""
    s = log.spec
    time = F.col(s.time)
    return (
        log.df.filter(F.col(s.case).isNotNull())
        .groupBy(F.col(s.case).alias("case_id"))
        .agg(
            F.min(F.when(log.is_activity(s.remove), time)).alias("first_remove"),
            F.min(F.when(log.is_activity(s.purchase), time)).alias("first_purchase"),
            F.to_date(F.min(time)).alias("date"),
        )
        .filter(F.col("first_purchase") > F.col("first_remove"))
        .select("case_id", "date")
    )


def remove_purchase_daily(log: EventLog) -> DataFrame:
    return remove_then_purchase(log).groupBy("date").agg(F.count(F.lit(1)).alias("sessions"))


def remove_purchase_rate(log: EventLog) -> DataFrame:
    """Removed-then-purchased sessions per removal event, in percent."""
    sessions = remove_then_purchase(log).agg(F.count(F.lit(1))).scalar()
    removals = log.df.agg(F.count_if(log.is_activity(log.spec.remove)).alias("removals"))
    return removals.select(
        sessions.alias("sessions"),
        "removals",
        percent(sessions, F.greatest(F.lit(1), F.col("removals"))).alias("remove_cart_purchase_rate"),
    )


def category_averages(counts: DataFrame) -> DataFrame:
    """Unweighted means of the purchase and abandonment rates over categories."""
    zero = F.lit(0.0)
    total, bought, cart = (F.col(c) for c in ("total_sessions", "purchase_sessions", "cart_sessions"))
    return counts.agg(
        F.coalesce(F.avg(percent(bought, total)), zero).alias("purchase_rate_avg"),
        F.coalesce(
            F.avg(F.when(F.col("in_funnel"), abandonment(cart, bought))), zero
        ).alias("abandonment_rate_avg"),
    )


def session_rates(sessions: DataFrame) -> DataFrame:
    """Rates over one row per session; the row of no session (not ``known``) only adds its removals."""
    removed = F.col("known") & (F.col("first_purchase") > F.col("first_remove"))
    removals = F.coalesce(F.sum("removals"), F.lit(0))
    return sessions.agg(
        percent(
            F.count_if(F.col("known") & F.col("only_view")),
            F.greatest(F.lit(1), F.count_if("known")),
        ).alias("window_shopper_rate"),
        percent(F.count_if(removed), F.greatest(F.lit(1), removals)).alias("remove_cart_purchase_rate"),
    )


def metrics(log: EventLog) -> DataFrame:
    """The six summary rates in one row, from three passes: by category, session and user."""
    s = log.spec
    time = F.col(s.time)
    by_category = category_averages(category_counts(log))
    by_session = session_rates(
        log.df.groupBy(s.case)
        .agg(
            _only_view(log).alias("only_view"),
            F.min(F.when(log.is_activity(s.remove), time)).alias("first_remove"),
            F.min(F.when(log.is_activity(s.purchase), time)).alias("first_purchase"),
            F.count_if(log.is_activity(s.remove)).alias("removals"),
        )
        .withColumn("known", F.col(s.case).isNotNull())
    )
    parts = {"category": by_category, "session": by_session, "user": user_loyalty(log)}
    one = log.df.sparkSession.range(1).select(
        *[df.select(F.struct(*df.columns)).scalar().alias(name) for name, df in parts.items()]
    )
    return one.select("category.*", "session.*", "user.*")


def outer_join_counts(log: EventLog) -> DataFrame:
    """Views and purchases per category by a full outer join of two keyed counts."""
    s = log.spec

    def counted(activity: str, name: str) -> DataFrame:
        return (
            log.df.filter(log.is_activity(activity))
            .select(F.col(s.category).alias("category"), s.case)
            .distinct()
            .groupBy("category")
            .agg(_sessions(log).alias(name))
        )

    both = counted(s.cart, "cart_sessions").join(
        counted(s.purchase, "purchase_sessions"), "category", "full_outer"
    )
    return both.na.fill(0, subset=["cart_sessions", "purchase_sessions"])
