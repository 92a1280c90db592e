"""Tables from stored facts, sketches and label wrapping against plain computations."""

import random
import textwrap

import pytest
from pyspark.sql import functions as F

from cartrail.functions.labels import wrapped
from cartrail.operators import commerce, sketches
from cartrail.plans import dashboards
from cartrail.sources import bindings
from cartrail.spec import EventLog
from check_oracle import plain

OPERATORS = {
    "kpis": commerce.kpis,
    "metrics": commerce.metrics,
    "brand_compare": commerce.brand_compare,
    "purchase_rate": lambda log: commerce.purchase_rate_by_category(log, commerce.TOP_CATEGORIES),
    "abandonment_rate": lambda log: commerce.cart_abandonment(log, commerce.TOP_CATEGORIES),
    "window_shopper": commerce.window_shopper_by_category,
    "loyal_returning": commerce.daily_returning,
    "remove_purchase": commerce.remove_purchase_daily,
    "session_price_dist": commerce.price_distribution,
    "purchase_price_dist": lambda log: commerce.price_distribution(log, purchases=True),
    "session_heatmap": commerce.price_hour_heatmap,
    "purchase_heatmap": lambda log: commerce.price_hour_heatmap(log, purchases=True),
    "session_hour_price": commerce.hour_price_segments,
    "purchase_hour_price": lambda log: commerce.hour_price_segments(log, purchases=True),
}


def odd_rows(count=400, seed=3):
    draw = random.Random(seed)
    prices = [0.0, 50.0, 50.01, 2049.99, 2050.0, -3.0, None, float("nan"), float("inf"), 120.0, 777.0]
    return [
        {
            "event_time": f"2020-01-{draw.randint(1, 9):02d} {draw.randint(0, 23):02d}:{draw.randint(0, 59):02d}:00",
            "event_type": draw.choice(["view", "view", "cart", "purchase", "remove_from_cart", "other", None]),
            "product_id": draw.choice([1, 2, 3, None]),
            "category_code": draw.choice(["a", "b", "c", None]),
            "brand": draw.choice(["x", "y", None]),
            "price": draw.choice(prices),
            "user_id": draw.choice([1, 2, 3, None]),
            "user_session": draw.choice([f"s{k}" for k in range(60)] + [None] * 5),
        }
        for _ in range(count)
    ]


def rows_of(df):
    return sorted(tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("rows", [odd_rows(), []], ids=["odd", "empty"])
def test_every_table_equals_its_operator(shop_rows, rows):
    log = shop_rows(rows)
    log = EventLog(log.df.cache(), log.spec)
    tables = dashboards.dashboard_tables(dashboards.stored_facts(log))
    assert set(tables) == set(OPERATORS)
    for name, operator in OPERATORS.items():
        want = operator(log)
        assert sorted(tables[name].columns) == sorted(want.columns), name
        assert rows_of(tables[name]) == rows_of(want), name


def test_facts_take_one_scan_and_tables_none_of_the_log(spark, shop_rows, tmp_path):
    shop_rows(odd_rows(50)).df.write.parquet(str(tmp_path / "log"))
    log = EventLog(spark.read.parquet(str(tmp_path / "log")))
    plan = dashboards.session_facts(log)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    facts = dashboards.stored_facts(log, str(tmp_path / "facts"))
    for table in dashboards.dashboard_tables(facts).values():
        assert all("/facts/" in name for name in table.inputFiles())


def test_sketches_count_ranges_in_any_order(spark):
    log = bindings.shop_log(spark, "/root/testdata/sf0.01")
    days = sketches.daily_sketches(log).cache()
    first, last = days.agg(F.min("day").cast("string"), F.max("day").cast("string")).first()
    exact = commerce.kpis(log).first().asDict()
    whole = sketches.kpis_between(days, first, last).first().asDict()
    assert whole == exact
    # By week and then in total, or by parity of the day: the same union.
    for by in (F.trunc("day", "week"), F.dayofmonth("day") % 2):
        parts = sketches.merged(days, by.alias("part")).drop("part")
        assert sketches.estimates(sketches.merged(parts)).first().asDict() == exact
    # Small sketches estimate: 2 ** -5 is one standard error of 1024 hashes.
    small = sketches.kpis_between(sketches.daily_sketches(log, 10), first, last, 10).first().asDict()
    for name in sketches.COUNTED:
        assert abs(small[name] - exact[name]) <= 4 * exact[name] / 32, name
    nothing = sketches.kpis_between(days, "1900-01-01", "1900-01-02").first().asDict()
    assert set(nothing.values()) == {0}


@pytest.mark.parametrize("width", [1, 4, 15, 40])
def test_labels_wrap_as_the_standard_library_does(spark, width):
    draw = random.Random(width)
    parts = (
        "a b remove_from_cart x-y well-known - -- 1-2-3 é . ! view->cart cost-benefit-analysis-of-it".split()
        + [" ", " ", "  ", " -> "]
    )
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(400)]
    texts += ["", " ", "   a", "x" * 100, "ECONOMY ANODIZED STEEL", "line\nend", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in rows.select("t", wrapped(F.col("t"), width).alias("label")).collect():
        assert row.label == (None if row.t is None else "\n".join(textwrap.wrap(row.t, width)))


def test_width_below_one_is_refused():
    with pytest.raises(ValueError):
        wrapped(None, 0)
