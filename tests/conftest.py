import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

from cartrail import EventLog, LogSpec  # noqa: E402
from cartrail.sources.event_log import load_event_log  # noqa: E402

CLICKS = os.path.join(ROOT, "tests", "data", "clicks_25.csv")
TINY = LogSpec(case="case", activity="act", time="t", ties=())


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def clicks(spark):
    """The sample log: 8 sessions, 25 rows."""
    log = load_event_log(spark, CLICKS)
    return EventLog(log.df.cache(), log.spec)


@pytest.fixture(scope="session")
def make_log(spark):
    """A log from words: one case per word, one activity per letter."""

    def build(words, hot_rows=2_000_000):
        rows = [(f"c{i:03d}", a, j) for i, w in enumerate(words) for j, a in enumerate(w)]
        df = spark.createDataFrame(rows, "case string, act string, t bigint")
        return EventLog(df, TINY, hot_rows)

    return build


@pytest.fixture(scope="session")
def shop_rows(spark):
    """A shop log from dicts; columns left out are filled in."""

    def build(rows, **kwargs):
        base = {
            "event_time": "2020-01-01 00:00:00",
            "event_type": "view",
            "product_id": 1,
            "category_code": "c",
            "brand": "b",
            "price": 10.0,
            "user_id": 1,
            "user_session": "s",
        }
        types = (
            "event_time string, event_type string, product_id bigint, category_code string, "
            "brand string, price double, user_id bigint, user_session string"
        )
        data = [tuple({**base, **r}.values()) for r in rows]
        df = spark.createDataFrame(data, types).selectExpr(
            "CAST(event_time AS timestamp_ntz) AS event_time",
            *[c for c in base if c != "event_time"],
        )
        return EventLog(df, **kwargs)

    return build


def as_set(df, *columns):
    return {tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}
